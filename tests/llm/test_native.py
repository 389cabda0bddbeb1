import re

from corvane.llm import decontaminate, lines, queries, urls

from ..oracle import DATA, connect, same
from .cases import SCHEMA, documents, frame, prose


def oracle(spark, df, sql, **tables):
    import duckdb

    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows.toPandas())
    same(df, con, sql)


def test_queries_same_as_sql(spark):
    con = connect()
    for name, sql in queries.oracle_sql().items():
        same(queries.queries()[name](spark, DATA), con, sql)


def test_line_dedup(spark):
    rows = list(dict.fromkeys(documents()))
    docs = frame(spark, rows)
    oracle(spark, lines.dedup_lines(docs.select("doc_id", "text")), queries.OP1_SQL, documents=docs.select("doc_id", "text"))


def test_line_dedup_generalises_fields(spark):
    rows = [(i, f"own {i * 7}\nServer alpha node {w} has started now\nIt took {i}.5 ms to read the whole table\n{i} 7.5 {i * i}\n20{i}1\nTotal 48") for i, w in enumerate(["red", "blue", "grey", "pink"])]
    found = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), depth=2).collect()}
    assert found[0].n_dropped == 0
    for i in (1, 2, 3):  # numbers alone, which differ, aren't a template
        assert found[i].text == f"own {i * 7}\n{i} 7.5 {i * i}\n20{i}1"


def test_line_dedup_cases(spark):
    rows = documents()
    docs = frame(spark, rows).selectExpr("*", "source as n_lines", "source as line", "source as template", "source as id")
    found = lines.dedup_lines(docs)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "line", "template", "id", "n_lines", "n_dropped"]
    got = found.collect()
    assert len(got) == len(rows)
    assert [r.text for r in got if r.doc_id == 60] == [None]
    twins = [r.text for r in got if r.doc_id == 1]
    assert len(twins) == 3
    assert len(set(twins)) == 1
    assert lines.dedup_lines(frame(spark, [])).count() == 0


def test_decontaminate_brute_force(spark):
    import random

    rng = random.Random(5)
    items = [(1, prose(rng, 20)), (2, prose(rng, 9)), (3, "only five words in here"), (4, ""), (5, None), (6, "a"), (6, prose(rng, 8)), (None, prose(rng, 12))]
    rows = documents()
    rows += [(200, f"{prose(rng, 9)} {items[0][1].upper()} {prose(rng, 5)} {items[1][1]}", "en", "s", 0), (201, f"x {items[2][1]} y", "en", "s", 0), (202, items[0][1].split(" ", 10)[-1], "en", "s", 0)]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for item, text in items:
        w = words(text)
        if item is not None and w:
            for i in range(max(1, len(w) - 7)):
                windows.setdefault(tuple(w[i : i + 8]), set()).add(str(item))
    docs = frame(spark, rows).selectExpr("*", "1 as n_hit", "2 as item", "3 as word")
    found = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(found) == len(rows)
    for r in found:
        w, hit, ids = words(r.text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    ids |= windows[tuple(w[i : i + n])]
        assert (r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) == (len(w), len(hit), len(ids), sorted(ids), len(ids) >= 2)
    assert any(r.contaminated for r in found)


def test_decontaminate_empty(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    found = decontaminate.decontaminate(frame(spark, documents()), bench).collect()
    assert all((r.n_hit, r.n_items, r.contaminated) == (0, 0, False) for r in found)
    assert decontaminate.decontaminate(frame(spark, [], SCHEMA), bench).count() == 0


def test_urls(spark):
    cases = [
        ("https://A.example.COM/en/7x?q=/en/8", "a.example.com", "/en/7x", "example.com/en/7", "allow"), ("http://example.com/en/8#x", "example.com", "/en/8", "com/en/", "block"),
        ("https://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "block"), ("ftp://x.net/de/9", "x.net", "/de/9", "net/de/", "allow"), ("http://notexample.org/es/", "notexample.org", "/es/", "org/es/", "block"),
        ("http://com/en/", "com", "/en/", "com/en/", "block"), ("http://dotcom/en/", "dotcom", "/en/", None, "allow"), ("no address", "", "", None, "allow"), (None, "", "", None, "allow"), ("x://", "", "", None, "allow"),
        ("http://h.org", "h.org", "", None, "allow"), ("http://h.org?a://b.com/en/", "h.org", "", None, "allow"), ("a\nb://q.org/es/\n", "q.org", "/es/\n", "org/es/", "block"),
    ]
    rows = spark.createDataFrame([(i, c[0], "old") for i, c in enumerate(cases * 2)], "page_id long, url string, verdict string")
    rules = urls.rule_table(spark, queries.URL_RULES)
    found = sorted(urls.judge_urls(rows, rules, [4, 5]).collect())
    assert [(r.host, r.path, r.rule, r.verdict) for r in found] == [c[1:] for c in cases * 2]
    assert found[0].__fields__ == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert [r.verdict for r in urls.judge_urls(rows.limit(1), rules.limit(0), []).collect()] == ["allow"]
