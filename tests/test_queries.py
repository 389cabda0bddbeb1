import pytest

from corvane import queries

from .oracle import DATA, connect, same


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, con, name):
    same(queries.QUERIES[name](spark, DATA), con, queries.SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc", "score", "rank"]


def test_or_widens_and_and_narrows(spark):
    from corvane.plans import search
    from corvane.plans.query import Vocabulary, parse

    index = queries.primary(spark, DATA)
    docs = lambda q: {r.doc for r in search.lexical(index, parse(q, Vocabulary())).collect()}
    a, b, both, either = docs("that"), docs("with"), docs("that with"), docs("that or with")
    assert both == a & b
    assert either == a | b
    assert docs("?") == set()


def test_filters_widen_within_a_kind_and_narrow_across(spark):
    from corvane.operators import facets

    own = queries.document_facets(queries.documents(spark, DATA))
    n = lambda f: facets.allowed(own, f).count()
    assert n({"lang": ["en"]}) <= n({"lang": ["en", "fr"]})
    assert n({"lang": ["en"], "size": ["long"]}) <= n({"lang": ["en"]})
    assert n({"lang": ["none"]}) == 0
    assert facets.allowed(own, {"lang": []}) is None


def test_numbered_records(spark):
    from corvane.operators.resolve import numbered

    rows = spark.createDataFrame([(f"s{i:03d}", 2000 + i % 3) for i in range(100)], "slug string, year int").repartition(7)
    assert [(r.doc, r.slug) for r in numbered(rows).orderBy("doc").collect()] == [(i, f"s{i:03d}") for i in range(100)]


def test_items(spark):
    from corvane.operators.records import items_of

    given = ['["a", {"name":"b","importance":"Core"}, {"name":" "}]', '"c"', "d", None, "[]", '[{"name":"e","role":"r"}]']
    rows = spark.createDataFrame(list(enumerate(given)), "i int, raw string")
    found = {r.i: [tuple(x) for x in r.x] for r in rows.selectExpr("i", "raw").withColumn("x", items_of(rows.raw)).collect()}
    assert found == {0: [("a", "core", ""), ("b", "core", "")], 1: [("c", "core", "")], 2: [("d", "core", "")], 3: [], 4: [], 5: [("e", "mentioned", "r")]}


def test_grounding_of_blank_values(spark, tmp_path):
    """Null is missing, blank is not: as in SQL."""
    import itertools

    import duckdb

    values = ["", " ", "\n", None, "x"]
    rows = [(i, *r, 1) for i, r in enumerate(itertools.product([*values, "é" * 120_001, "\0"], values, values))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(queries.grounding(spark, str(tmp_path)), con, queries.SQL["grounding"])
