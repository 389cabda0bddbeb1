"""HTML reduced to an allow-list of tags and attributes."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The tags that stay, those that go with their content, and what addresses may begin with.
ALLOWED = frozenset("p h3 h4 ul ol li strong em b i blockquote a code pre br hr img figure figcaption".split())
DROPPED = frozenset("script style iframe object embed svg math template noscript frame frameset link meta base form textarea select".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
ADDRESSES = {("a", "href"): re.compile("https?:", re.I), ("img", "src"): re.compile("https?:|data:image/", re.I), ("img", "alt"): re.compile("")}
#: Tags before which an open paragraph ends.
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split())


def _escaped(text: str, quoted: bool = False) -> str:
    return html.escape(text, quote=False).replace("\xa0", "&nbsp;").replace('"', "&quot;" if quoted else '"')


class _Cleaner(HTMLParser):
    """Writes the allowed tags as they come, and closes what a page leaves open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.open, self.dropping = [], [], []

    def _close(self, tag: str) -> None:
        """Ends the innermost open element of this name, and those within it."""
        while self.open:
            last = self.open.pop()
            self.out.append(f"</{last}>" if last in ALLOWED else "")
            if last == tag:
                break

    def handle_starttag(self, tag, attrs):
        if self.dropping or tag in DROPPED:
            self.dropping += [tag] if tag not in VOID else []
            return
        if tag in BLOCKS and "p" in self.open:
            self._close("p")
        if tag == "li" and next((x for x in reversed(self.open) if x in ("ul", "ol", "li")), "") == "li":
            self._close("li")
        if tag in ALLOWED:
            kept = [(k, v or "") for k, v in dict(reversed(attrs)).items() if (tag, k) in ADDRESSES and ADDRESSES[tag, k].match(v or "")][::-1]
            kept += [("target", "_blank"), ("rel", "noopener noreferrer")] if tag == "a" else []
            self.out.append(f"<{tag}" + "".join(f' {k}="{_escaped(v, True)}"' for k, v in kept) + ">")
        if tag not in VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        if tag not in ("svg", "math"):  # other tags aren't closed by their slash
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.dropping:
            if tag in self.dropping:
                while self.dropping.pop() != tag:
                    pass
        elif tag in self.open:
            self._close(tag)
        elif tag == "p":
            self.out.append("<p></p>")

    def handle_data(self, data):
        if not self.dropping:
            self.out.append(_escaped(data))

    def handle_comment(self, data):
        if not self.dropping:
            self.out.append(f"<!--{data}-->")

    def finished(self) -> str:
        self.close()
        while self.open:
            self._close("")
        return "".join(self.out)


def clean(page: str | None) -> str:
    """Dropped tags go with their content, other tags that aren't allowed leave theirs; links open apart."""
    cleaner = _Cleaner()
    cleaner.feed(page or "")
    return cleaner.finished()


def sanitised(col: Column) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(clean)

    return run(col)
