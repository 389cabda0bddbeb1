"""Retrieval quality: metrics over rankings, and queries mined from the records."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .counting import counted
from .places import cumulated, globally


def per_query(rankings: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(qid, n_rel, first, rr, recall, ndcg, ap) from rankings (qid, doc, rank) and relevant (qid, doc); a query without hits has zeros."""
    n_rel = relevant.groupBy("qid").agg(F.count("*").alias("n_rel"))
    hits = rankings.join(relevant, ["qid", "doc"]).withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    found = hits.groupBy("qid").agg(
        F.min("rank").alias("first"), F.count_if(F.col("rank") <= k).alias("top"), F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1))).alias("dcg"), F.sum(F.col("nth") / F.col("rank")).alias("precisions"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_rel", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return n_rel.join(found, "qid", "left").select("qid", "n_rel", "first", zero(1 / F.col("first")).alias("rr"), zero(F.col("top") / F.col("n_rel")).alias("recall"), zero(F.col("dcg") / ideal).alias("ndcg"), zero(F.col("precisions") / F.col("n_rel")).alias("ap"), F.coalesce(F.col("top") / k, F.lit(0.0)).alias("precision"))


def summary(scored: DataFrame, k: int = 10) -> DataFrame:
    """Means over queries, with what could be reached at most."""
    return scored.agg(
        F.count("*").alias("n"), F.avg("rr").alias("mrr"), F.avg((F.col("first") == 1).cast("int").cast("double")).alias("hit1_of_found"), F.avg(F.coalesce((F.col("first") == 1).cast("int"), F.lit(0))).alias("hit1"),
        F.avg(F.col("first").isNull().cast("int")).alias("no_hit"), F.avg("recall").alias("recall"), F.avg("ndcg").alias("ndcg"), F.avg("ap").alias("map"), F.avg("precision").alias("precision"),
        F.avg(F.least("n_rel", F.lit(k)) / F.col("n_rel")).alias("recall_ceiling"), F.avg("n_rel").alias("mean_relevant"),
    )


def compare(before: DataFrame, after: DataFrame, by: str = "ndcg") -> DataFrame:
    """How many queries got better, worse or stayed; both from per_query."""
    met = before.select("qid", F.col(by).alias("x")).join(after.select("qid", F.col(by).alias("y")), "qid")
    return met.agg(F.count_if(F.col("y") > F.col("x")).alias("better"), F.count_if(F.col("y") < F.col("x")).alias("worse"), F.count_if(F.col("y") == F.col("x")).alias("same"))


def inversions(rankings: DataFrame, value: str) -> DataFrame:
    """(qid, inversions): how often a value rises from one rank to the next."""
    before = F.lag(value).over(Window.partitionBy("qid").orderBy("rank"))
    return rankings.withColumn("before", before).groupBy("qid").agg(F.count_if(F.col(value) > F.col("before")).alias("inversions"))


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Values at a place of the sorted ones: the median at n // 2, a share p at floor(p (n - 1)).

    Values are counted first, so that a group's places are those of its different values, whatever it has of each;
    groups with very many of them are numbered in ranges.
    """
    counted = rows.groupBy(*by, value).agg(F.count("*").alias("_n"))
    totals = counted.groupBy(*by).agg(F.sum("_n").alias("_all"))
    placed = cumulated(counted, [F.col(value)], "_n", "_end", by).join(totals, by)
    where = {name: F.floor(F.lit(p) * (F.col("_all") - 1)) for name, p in shares.items()} | {"median": F.floor(F.col("_all") / 2)}
    return placed.groupBy(*by).agg(*[F.min(F.when(F.col("_end") > at, F.col(value))).alias(name) for name, at in where.items()])


def known_item_text(summary: Column, problem: Column) -> Column:
    """What a record's query is mined from: its summary, or without one the problem."""
    return F.coalesce(F.nullif(summary, F.lit("")), problem, F.lit(""))


def rarest_words(rows: DataFrame, doc: str, text: Column, most: int = 8, least: int = 3) -> DataFrame:
    """(doc, query): the rarest different words of a text (by document frequency, then from the end of the alphabet).

    Words are counted in blocks, which are dealt out by word for the frequencies and by chunk of documents for their words.
    """
    blocks = counted(rows, doc, [(text, 1)], joined=False).filter("term is not null")
    known = blocks.withColumn("df", F.sum("n").over(Window.partitionBy("term"))).select("chunk", "df", "term", "docs")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = known.repartition(parts, "chunk").sortWithinPartitions("chunk", "df", F.desc("term"))
    return dealt.mapInArrow(_first_words(most, least), f"doc {rows.schema[doc].dataType.simpleString()}, query string")


def _first_words(most: int, least: int):
    """Of rows (chunk, df, term, docs), sorted: each document's first terms, if there are enough."""

    def listed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        docs = pa.concat_arrays([p["docs"].flatten() for p in parts]).dictionary_encode()
        sizes = np.concatenate([pc.list_value_length(p["docs"]).to_numpy(zero_copy_only=False) for p in parts])
        own = docs.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(own, kind="stable")
        ends = np.cumsum(np.bincount(own, minlength=len(docs.dictionary)))
        begins = np.r_[0, ends[:-1]]
        n = np.minimum(ends - begins, most)
        kept = np.flatnonzero(n >= least)
        place = np.repeat(begins[kept] - (np.cumsum(n[kept]) - n[kept]), n[kept]) + np.arange(n[kept].sum())
        terms = pa.concat_arrays([p["term"] for p in parts]).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)[order[place]]))
        words = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n[kept])], pa.int32()), terms)
        return pa.RecordBatch.from_arrays([docs.dictionary.take(pa.array(kept)), pc.binary_join(words, " ")], ["doc", "query"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        for batch in batches:
            chunk = batch.column(0).to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]) if len(chunk) else []
            for begin, end in zip(begins, [*begins[1:], len(chunk)], strict=True):
                if parts and at != chunk[begin]:
                    yield listed(parts)
                    parts = []
                at = chunk[begin]
                parts.append(batch.slice(begin, end - begin))
        if parts:
            yield listed(parts)

    return run


def opening_words(text: Column, least: int = 12, most: int = 60) -> Column:
    """A long enough text's first words, or null."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    return F.when(F.size(words) >= least, F.array_join(F.slice(words, 1, most), " "))


def lineages(records: DataFrame) -> DataFrame:
    """(team, id, doc, n_rel): the records (id, doc, team, year) of teams that have records of two years, and how many others each has.

    A record's relevant documents are its team's others: rows of this table, not pairs.
    """
    teams = records.groupBy("team").agg((F.count("*") - 1).alias("n_rel"), F.count_distinct("year").alias("years")).filter("n_rel >= 1 and years >= 2")
    return records.select("team", "id", "doc").join(teams.select("team", "n_rel"), "team")


def lineage_relevant(groups: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, doc) of chosen queries (qid), from lineages()."""
    own = queries.join(groups.select(F.col("id").alias("qid"), "team"), "qid")
    return own.join(groups.select("team", "id", "doc"), "team").filter("id <> qid").select("qid", "doc")


def team_of(record_id: Column) -> Column:
    return F.regexp_replace(record_id, "-([0-9]{4}|na)$", "")


def flipped_number(word: Column) -> Column:
    """Singular to plural and back, by endings."""
    cut = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    return (
        F.when(F.length(word) < 4, word)
        .when(word.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(word.rlike("(s|x|ch|sh)es$"), cut(2))
        .when(word.endswith("s"), cut(1))
        .when(word.rlike("[^aeiou]y$"), F.concat(cut(1), F.lit("ies")))
        .when(word.rlike("(x|ch|sh)$"), F.concat(word, F.lit("es")))
        .otherwise(F.concat(word, F.lit("s")))
    )


def morph_queries(queries: DataFrame) -> DataFrame:
    """(qid, query) with every word's number flipped, if at least two changed."""
    words = F.split("query", " ")
    flipped = F.transform(words, flipped_number)
    changed = F.size(F.filter(F.zip_with(words, flipped, lambda a, b: a != b), lambda x: x))
    return queries.filter(changed >= 2).select("qid", F.array_join(flipped, " ").alias("query"))


def cohesive_values(values: DataFrame, kind: str, least: int = 3, most: int = 25, key_length: int = 3) -> DataFrame:
    """Facet values that make a query with a countable answer."""
    return values.filter((F.col("kind") == kind) & F.col("n").between(least, most) & (F.length("key") >= key_length))


def term_queries(vocabulary: DataFrame, least: int = 5, most: int = 40, length: int = 5) -> DataFrame:
    """(term, df) of a vocabulary's longer words of letters that some documents have."""
    return vocabulary.filter((F.length("term") >= length) & F.col("term").rlike("^[a-z]+$") & F.col("df").between(least, most))


def chosen(terms: DataFrame, size: int) -> DataFrame:
    """(term, df, place): evenly spaced ones of the alphabetical list, from place 0 on; at most `size`."""
    n = terms.count()
    at = globally(terms, [F.col("term")], "_at").withColumn("_at", F.col("_at") - 1)
    place = F.ceil(F.col("_at") * min(size, n) / max(n, 1)).cast("long")
    fits = F.floor(place * n / min(size, max(n, 1))) == F.col("_at")
    return at.filter(fits & (place < size)).withColumn("place", place).drop("_at")


def pair_queries(postings: DataFrame, terms: DataFrame, size: int = 50, least: int = 3, most: int = 40, tries: int = 59, stride: int = 7) -> DataFrame:
    """(a, b, n): two words that stand together in some documents. terms: chosen(), of a bounded number.

    Every second word is tried with those 7, 14, .. places on (round the list), and keeps the first that shares `least`
    to `most` documents with it; the first `size` pairs stay. Only the chosen words' postings, of at most 150 documents each, meet.
    """
    n = terms.count()
    first = terms.filter(F.col("place") % 2 == 0).select(F.col("term").alias("a"), F.col("place").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(tries))).alias("j"))
    asked = first.withColumn("place", (F.col("i") + F.col("j") * stride) % max(n, 1)).join(terms.select("place", F.col("term").alias("b")), "place").filter("a <> b")
    own = postings.join(terms.select("term"), "term", "left_semi").select("term", "doc")
    met = asked.join(own.withColumnsRenamed({"term": "a"}), "a").join(own.withColumnsRenamed({"term": "b"}), ["b", "doc"])
    shared = met.groupBy("a", "b", "i", "j").agg(F.count("*").alias("n")).filter(F.col("n").between(least, most))
    best = shared.groupBy("a", "i").agg(F.min_by(F.struct("b", "n"), "j").alias("at"))
    return best.orderBy("i").limit(size).select("a", "at.b", "at.n")


def unexplained(found: DataFrame, least: int = 3, most: int = 25) -> DataFrame:
    """(short, doc) of the abbreviations that some documents have only in the long form; found: synonyms.long_without_short."""
    some = found.groupBy("short").agg(F.count_distinct("doc").alias("n")).filter(F.col("n").between(least, most))
    return found.join(some.select("short"), "short", "left_semi").distinct()


def random_precision(n_rel: Column, n_ranked: Column) -> Column:
    """The precision that any order at random has on average."""
    return n_rel / F.nullif(n_ranked, F.lit(0))


def fingerprint(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n, digest): the number of each table's rows and a checksum of them, whatever their order."""
    parts = [df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("h")).select(F.lit(name).alias("name"), "n", F.substring(F.sha2(F.col("h").cast("string"), 256), 1, 16).alias("digest")) for name, df in tables.items()]
    return functools.reduce(DataFrame.unionByName, parts)


def preflight(cards: DataFrame, lengths: DataFrame, facets: DataFrame) -> DataFrame:
    """Invariants as counts that must be zero: repeated ids, documents without a length, facets of unknown documents."""
    repeated = cards.groupBy("id").count().filter("count > 1").agg(F.count("*").alias("repeated_ids"))
    missing = cards.join(lengths, "doc", "left_anti").agg(F.count("*").alias("without_length"))
    unknown = facets.join(cards.select("doc"), "doc", "left_anti").agg(F.count("*").alias("unknown_facets"))
    return repeated.join(F.broadcast(missing), F.lit(True)).join(F.broadcast(unknown), F.lit(True))
