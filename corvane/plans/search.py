"""Searches over an index: parsed groups become one aggregation by document."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.facets import Filters, filtered, pools
from ..operators.index import Index
from ..operators.places import globally
from . import every_word as in_groups
from .query import Unit, words_of

#: BM25's parameters, and where tails end.
K1, B = 3.0, 0.55
PAGE_SIZE = 20
MOST_TAIL_WORDS = 32
SCORE_DIGITS = 9


def document_frequencies(index: Index, words: list[str]) -> dict[str, int]:
    """At most one row for each word of the query reaches the driver."""
    return {r["term"]: r["df"] for r in index.vocabulary().filter(F.col("term").isin(*words)).collect()}


def idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def _word_columns(index: Index, words: list[str]) -> DataFrame:
    """(doc, tf_0, tf_1, ..): the query's words side by side; one shuffle, on the document."""
    hits = index.postings.filter(F.col("term").isin(*words))
    return hits.groupBy("doc").agg(*[F.max(F.when(F.col("term") == w, F.col("w"))).alias(f"tf_{i}") for i, w in enumerate(words)])


def _all_present(at: dict[str, int], words) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"tf_{at[w]}").isNotNull() for w in dict.fromkeys(words)))


def _best(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.greatest(*columns)


def _plus(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def lexical(index: Index, groups: list[list[Unit]]) -> DataFrame:
    """(doc, score) of the documents that match all units of a group.

    A spelling needs all its words and scores their sum times its weight, repeated words
    counting again; a unit scores its best spelling, a group the sum of its units, a
    document its best group. Word statistics are those of the whole index.
    """
    if not groups:
        return index.lengths.select("doc", F.lit(0.0).alias("score")).limit(0)
    words = words_of(groups)
    at = {w: i for i, w in enumerate(words)}
    stats = index.stats.first()
    n, avgdl = stats["n"], stats["avgdl"] or 1.0
    df = document_frequencies(index, words)
    length = F.col("dl") / F.lit(float(avgdl))

    def word(w: str) -> Column:
        tf = F.col(f"tf_{at[w]}")
        return F.lit(idf(n, df.get(w, 0))) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length))

    def unit(u: Unit) -> Column:
        return _best([F.when(_all_present(at, s.words), _plus([word(w) for w in s.words]) * s.weight) for s in u.spellings])

    scores = [_plus([unit(u) for u in units]) for units in groups]
    rows = _word_columns(index, words).join(index.lengths, "doc").select("doc", _best(scores).alias("score"))
    return rows.filter("score is not null")


def query_table(spark: SparkSession, queries: dict[int, list[list[Unit]]]) -> DataFrame:
    """Parsed queries as rows (qid, grp, unit, units, spelling, words, word, times, weight)."""
    rows = []
    for qid, groups in queries.items():
        for g, units in enumerate(groups):
            for u, unit in enumerate(units):
                for s, spelling in enumerate(unit.spellings):
                    distinct = dict.fromkeys(spelling.words)
                    rows += [(qid, g, u, len(units), s, len(distinct), w, spelling.words.count(w), float(spelling.weight)) for w in distinct]
    return spark.createDataFrame(rows, "qid long, grp int, unit int, units int, spelling int, words int, word string, times int, weight double")


def batch(index: Index, queries: DataFrame) -> DataFrame:
    """(qid, doc, score) of many queries at once: their words meet the postings in one join, then groups shrink step by step.

    The scores are those of `lexical`; every step aggregates, none lists a group.
    """
    stats = index.stats.first()
    n, avgdl = stats["n"], float(stats["avgdl"] or 1.0)
    terms = queries.select(F.col("word").alias("term")).distinct()
    used = index.of(terms).postings
    df = index.vocabulary().join(terms, "term", "left_semi")
    known = queries.join(df, queries["word"] == df["term"])
    inverse = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = inverse * F.col("w") * (K1 + 1) / (F.col("w") + K1 * (1 - B + B * F.col("dl") / avgdl))
    hits = used.join(known.drop("term").withColumnRenamed("word", "term"), "term").join(index.lengths, "doc")
    spelled = hits.groupBy("qid", "doc", "grp", "unit", "spelling", "units", "words", "weight").agg(F.count("*").alias("found"), F.sum(part * F.col("times")).alias("score")).filter("found = words")
    by_unit = spelled.groupBy("qid", "doc", "grp", "unit", "units").agg(F.max(F.col("score") * F.col("weight")).alias("score"))
    by_group = by_unit.groupBy("qid", "doc", "grp", "units").agg(F.count("*").alias("found"), F.sum("score").alias("score")).filter("found = units")
    return by_group.groupBy("qid", "doc").agg(F.max("score").alias("score"))


def every_word(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(qid, doc, score) of many queries (qid, words) for documents that have all words: k or more of the best of each; as `batch`, but by groups of documents."""
    return in_groups.every_word(index, queries, k, K1, B, SCORE_DIGITS)


def batch_ranked(scores: DataFrame, k: int) -> DataFrame:
    """(qid, doc, score, rank) of each query's k best."""
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", SCORE_DIGITS)), "doc")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked(scores: DataFrame) -> DataFrame:
    """Adds rank: by score (rounded, so that equal documents tie whatever the order of addition), then document."""
    return globally(scores, score_order(), "rank")


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k best; each task keeps k."""
    return scores.orderBy(*score_order()).limit(k)


def page(scores: DataFrame, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """A page, the number being held between 1 and the last; no more than the rows up to its end are gathered."""
    total = scores.count()
    number = min(max(1, number), max(1, math.ceil(total / size)))
    return ranked(top(scores, number * size)).filter(F.col("rank") > (number - 1) * size)


def browse(cards: DataFrame, facets: DataFrame | None = None, filters: Filters | None = None) -> DataFrame:
    """Without text: the latest years first, then by name, then by document. cards: (doc, name, year)."""
    rows = cards if facets is None else filtered(cards, facets, filters)
    return rows.orderBy(F.desc("year"), F.collate("name", "UNICODE"), "doc")


def mentions(index: Index, units: list[Unit]) -> DataFrame:
    """(doc, hits, total, parts, dl): the full-text tail of one group.

    A spelling counts its rarest word, a unit the sum of its spellings, a document the
    least of its units; parts are the units' own counts. More than 32 words find nothing.
    """
    words = words_of([units])
    if not words or len(words) > MOST_TAIL_WORDS:
        return index.lengths.select("doc", F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("total"), F.array().cast("array<struct<label:string,n:bigint>>").alias("parts"), "dl").limit(0)
    at = {w: i for i, w in enumerate(words)}
    zero = F.lit(0).cast("long")

    def spelling(s) -> Column:
        tfs = [F.col(f"tf_{at[w]}") for w in dict.fromkeys(s.words)]
        return F.when(_all_present(at, s.words), tfs[0] if len(tfs) == 1 else F.least(*tfs)).otherwise(zero)

    counted = [_plus([spelling(s) for s in u.spellings]) for u in units]
    least = counted[0] if len(counted) == 1 else F.least(*counted)
    parts = F.array(*[F.struct(F.lit(u.label).alias("label"), c.alias("n")) for u, c in zip(units, counted, strict=True)])
    rows = _word_columns(index, words).select("doc", least.alias("hits"), _plus(counted).alias("total"), parts.alias("parts"))
    return rows.filter("hits > 0").join(index.lengths, "doc")


def mention_order() -> list[Column]:
    return [-F.col("hits"), -F.col("total"), F.col("dl"), F.col("doc")]


def mention_tail(index: Index, groups: list[list[Unit]], primary: DataFrame | None = None) -> DataFrame:
    """The tail of all groups: a document's best row of any group, without those of the primary result."""
    found = [mentions(index, units) for units in groups]
    if not found:
        return mentions(index, [])
    rows = reduce(DataFrame.unionByName, found)
    if len(found) > 1:
        best = F.max_by(F.struct(*rows.columns), F.struct("hits", "total"))
        rows = rows.groupBy("doc").agg(best.alias("best")).select("best.*")
    return rows if primary is None else rows.join(primary.select("doc"), "doc", "left_anti")


def segmented(*segments: tuple[str, DataFrame, list[Column]]) -> DataFrame:
    """(segment_no, segment, place, doc): results one after the other, each in its own ascending order, a document only where it comes first."""
    rows, before = None, None
    for i, (name, docs, order) in enumerate(segments):
        own = docs if before is None else docs.join(before, "doc", "left_anti")
        placed = globally(own, order, "place").select("doc", F.lit(i).alias("segment_no"), F.lit(name).alias("segment"), "place")
        rows = placed if rows is None else rows.unionByName(placed)
        before = docs.select("doc") if before is None else before.unionByName(docs.select("doc"))
    return rows


def hybrid(primary: DataFrame, concepts: DataFrame, full_text: DataFrame | None = None) -> DataFrame:
    """The three segments of a search in hybrid mode: what matches, what is alike, and what mentions the words.

    concepts: (doc, score), e.g. of vectors.concept_tail; full_text: (doc, hits, total, dl), of mentions or mention_tail.
    """
    own = [("lexical", primary, score_order()), ("concept", concepts, score_order())]
    return segmented(*own, *([("full_text", full_text, mention_order())] if full_text is not None else []))


def hybrid_pools(primary: DataFrame, concepts: DataFrame, full_text: DataFrame, facets: DataFrame, filters: Filters | None, k: int = 400) -> DataFrame:
    """(doc, pool): what a search in hybrid mode finds under all filters, and under all but each kind's own.

    primary (doc, ..), concepts (doc, score) without a limit and full_text (doc, ..) are unfiltered. A pool has the k documents
    most alike of its own, since the tail is cut after filtering; one ranking serves all pools.
    """
    alike = pools(concepts.join(primary.select("doc"), "doc", "left_anti").select("doc", "score"), facets, filters)
    order = Window.partitionBy("pool").orderBy(F.desc(F.round("score", SCORE_DIGITS)), "doc")
    cut = alike.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("doc", "pool")
    rest = pools(primary.select("doc").unionByName(full_text.select("doc")), facets, filters)
    return cut.unionByName(rest.select("doc", "pool")).distinct()


def score_order() -> list[Column]:
    return [-F.round("score", SCORE_DIGITS), F.col("doc")]
