"""Blocks of postings against the tokens of every text."""

import random

from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import counting, evaluate, index
from corvane.plans import every_word, search


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def random_texts(spark, n=3000):
    rng = random.Random(3)
    pieces = [*"ab1.-_ \n|zZ9 .. --", "é", "ß", "٣", "𐐨", "€", "İ", "K", "\x0b", "x. abc", "a. bcd", "foo-bar_baz9"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 80)))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, "a" * 65 + " " + "b" * 33 + "-" + "c" * 40), (n + 1, ""), (n + 2, None)], "doc long, text string").repartition(3)


def test_counts_without_a_shuffle(spark):
    docs = random_texts(spark)
    joined, plain = ((F.col("text"), True), text.tokens), ((F.col("text"), False), text.plain_tokens)
    for (col, more), tokens in (joined, plain):
        blocks = counting.counted(docs, "doc", [(col, 1)], more)
        found = counting.postings(blocks.filter("term is not null"))
        expected = docs.select("doc", F.explode(tokens(col)).alias("term")).groupBy("term", "doc").agg(F.count("*").alias("w"))
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
        sums = blocks.filter("term is null").select(F.explode(F.arrays_zip("docs", "ws")).alias("at")).select("at.docs", "at.ws")
        assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, docs.select("doc", F.size(tokens(col))).collect()))
    files = spark.range(9).select(F.col("id").alias("doc"), F.lit("aa bb aa").alias("text"))
    assert exchanges(index.token_counts(files, "doc", "text")) == 0


def test_an_index_deals_out_blocks_once(spark):
    own = index.full_text_index(random_texts(spark), "doc", "text")
    assert exchanges(own.postings) == 2  # the blocks by term; random_texts' own


def test_small_chunks_and_repeated_documents(spark, monkeypatch):
    rows = [(1, "aa b. cde"), (2, "bb"), (1, "cde aa x-y"), (3, "")]
    docs = spark.createDataFrame(rows, "doc long, text string").coalesce(1)
    assert sorted(map(tuple, index.token_counts(docs, "doc", "text").collect())) == [("aa", 1, 2), ("bb", 2, 1), ("bcde", 1, 1), ("cde", 1, 2), ("xy", 1, 1)]
    batch = counting._blocks([1])
    monkeypatch.setattr(counting, "CHUNK_BYTES", 4)
    monkeypatch.setattr(counting, "TaskContext", type("One", (), {"get": staticmethod(lambda: type("Task", (), {"partitionId": lambda _: 7})())}))
    import pyarrow as pa

    given = pa.RecordBatch.from_pydict({"doc": ["d", "e", "f"], "t0": ["aa bb aa", "", "aa"], "m0": pa.array([["x"], [], []], pa.list_(pa.string()))})
    found = [r for b in batch(iter([given])) for r in b.to_pylist()]
    assert [(r["term"], r["chunk"] - (7 << 32), r["docs"], r["ws"]) for r in found] == [("aa", 0, ["d"], [2]), ("bb", 0, ["d"], [1]), ("x", 0, ["d"], [1]), (None, 0, ["d"], [4]), ("aa", 1, ["f"], [1]), (None, 1, ["e", "f"], [0, 1])]


def test_queries_for_every_word_meet_groups_of_documents(spark, monkeypatch):
    """The same ranking as by the postings of all words, from many small groups, in rows that don't grow with the pairs."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words[: 3 + i % 38]) for _ in range(rng.randint(0, 30)))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc long, text string").repartition(5)
    own = index.full_text_index(docs, "doc", "text")
    asked = spark.createDataFrame([(i, rng.sample([*words, "none"], rng.randint(1, 4))) for i in range(300)], "qid long, words array<string>")
    exploded = asked.select("qid", F.size("words").alias("units"), F.posexplode("words").alias("unit", "word"))
    plain = exploded.select("qid", F.lit(0).alias("grp"), "unit", "units", F.lit(0).alias("spelling"), F.lit(1).alias("words"), "word", F.lit(1).alias("times"), F.lit(1.0).alias("weight"))
    ranks = lambda scores: sorted((r.qid, r["rank"], r.doc, round(r.score, 9)) for r in search.batch_ranked(scores, 5).collect())
    expected = ranks(search.batch(own, plain))
    assert len(expected) > 500
    for size, pairs in ((1 << 14, 1 << 20), (100, 50)):
        monkeypatch.setattr(every_word, "DOCS_EACH", size)
        monkeypatch.setattr(every_word, "PAIRS_EACH", pairs)
        found = search.every_word(own, asked, 5)
        assert ranks(found) == expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "doc#" not in "".join(line for line in plan.splitlines() if "Exchange" in line)  # no (query, document) is shuffled


def test_rarest_words(spark):
    rows = [(1, "b a. cc dd cc ee"), (2, "cc dd"), (3, "ff ff cc dd gg"), (4, ""), (5, None)]
    docs = spark.createDataFrame(rows, "doc long, text string")
    assert sorted(map(tuple, evaluate.rarest_words(docs, "doc", F.col("text")).collect())) == [(1, "ee dd cc"), (3, "gg ff dd cc")]
    assert sorted(map(tuple, evaluate.rarest_words(docs, "doc", F.col("text"), most=2, least=2).collect())) == [(1, "ee dd"), (2, "dd cc"), (3, "gg ff")]
