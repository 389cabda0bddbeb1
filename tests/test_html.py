import pytest

from corvane.functions.html import clean

LINK = ' target="_blank" rel="noopener noreferrer"'


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (None, ""), ("", ""), ("plain & <b>bold</b>", "plain &amp; <b>bold</b>"),
        ('<p onclick="x()" title="t">a<script>alert(1)</script><blink>b</blink></p>', "<p>ab</p>"),
        ('<a href="javascript:x" title="t">c</a>', f"<a{LINK}>c</a>"), ('<a href="mailto:a@b.c">c</a>', f"<a{LINK}>c</a>"), ('<a href="/x#y">c</a>', f"<a{LINK}>c</a>"),
        ('<a target="_top" href="HTTPS://d.e?x=1&amp;y=2" rel="z">f</a>', f'<a href="HTTPS://d.e?x=1&amp;y=2"{LINK}>f</a>'),
        ('<img src="data:image/png;base64,x" alt="a &quot;b&quot;" onerror="y" title="t" width=3>', '<img src="data:image/png;base64,x" alt="a &quot;b&quot;">'),
        ('<img src="data:text/html,x"><img src="http://h/i">', '<img><img src="http://h/i">'),
        ("<h1>a</h1><h2>b</h2><h3>c</h3><h4>d</h4><u>e</u><span>f</span><div>g</div>", "ab<h3>c</h3><h4>d</h4>efg"),
        ("<table><thead><tr><th>a</th></tr></thead><tbody><tr><td><em>b</em></td></tr></tbody></table>", "a<em>b</em>"),
        ("x<textarea><b>y</b></textarea><select><option>z</select><frameset><frame src=q></frameset>w", "xw"),
        ("<base href='http://x/'><link rel=y><meta z>a", "a"), ("<title>t</title><p>b</p>", "t<p>b</p>"),
        ("<svg><script>1</script><a href='http://x'>b</a></svg>c<svg/>d<math><mi>x</mi></math>", "cd"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul>"), ("<p>a<p>b<div>c</div>", "<p>a</p><p>b</p>c"),
        ("<strong><em>a</strong>b", "<strong><em>a</em></strong>b"), ("a</b></p>", "a<p></p>"), ("a<br/>b<hr>c", "a<br>b<hr>c"), ("<p/>a", "<p>a</p>"),
        ("a<!-- note -->b", "a<!-- note -->b"), ("a b", "a&nbsp;b"), ("<form><p>a</p></form>b<noscript>c</noscript>", "b"),
        ("<figure><img src=http://a alt=b><figcaption>c</figcaption></figure><blockquote><pre><code>d</code></pre></blockquote>", '<figure><img src="http://a" alt="b"><figcaption>c</figcaption></figure><blockquote><pre><code>d</code></pre></blockquote>'),
    ],
)
def test_golden_cases(page, expected):
    assert clean(page) == expected
