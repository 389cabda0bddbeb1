"""Facets as a long table (doc, kind, label, key), filters and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canon import TAIL_KINDS, keeps_value
from ..functions.text import facet_key
from .places import globally

Filters = dict[str, list[str]]


def facet_docs(records: DataFrame, doc: str, kinds: dict[str, Column]) -> DataFrame:
    """One row for each value of each kind; a kind's column is a label or an array of labels, blank ones don't count."""
    types = records.select(*[c.alias(k) for k, c in kinds.items()]).dtypes
    arrays = [F.when(c.isNotNull(), c if kind.startswith("array") else F.array(c.cast("string"))).alias(k) for (k, kind), c in zip(types, kinds.values(), strict=True)]
    listed = F.array(*[F.struct(F.lit(k).alias("kind"), a.alias("labels")) for k, a in zip(kinds, arrays, strict=True)])
    rows = records.select(F.col(doc).alias("doc"), F.explode(listed).alias("at")).select("doc", "at.kind", F.explode("at.labels").alias("label"))
    return rows.filter("label is not null and label <> ''").distinct().withColumn("key", facet_key(F.col("label")))


def values(facets: DataFrame) -> DataFrame:
    """(kind, label, key, n) of the values that are kept."""
    counted = facets.groupBy("kind", "label", "key").agg(F.count("*").alias("n"))
    return counted.filter(keeps_value(F.col("kind"), F.col("label"), F.col("n")))


def value_documents(facets: DataFrame, doc: str = "doc", chunk: int = 4096) -> DataFrame:
    """(kind, label, key, n, chunk, docs): each kept value's documents in ascending order, in rows of up to `chunk` numbers.

    Documents are numbers; a value that a third of them have takes as many rows as it needs.
    """
    kept = facets.join(values(facets), ["kind", "label", "key"])
    dealt = kept.withColumn("chunk", F.floor(F.col(doc) / chunk))
    return dealt.groupBy("kind", "label", "key", "n", "chunk").agg(F.sort_array(F.collect_set(doc)).alias("docs"))


def value_order(counted: DataFrame) -> DataFrame:
    """Ranks values within their kind: years from the latest, others by count, then label."""
    year = F.when(F.col("kind") == "year", -F.expr("try_cast(label as int)"))
    return globally(counted, [F.coalesce(year, F.lit(1 << 30)), -F.col("n"), F.col("label")], "rank", ["kind"])


def shown(counted: DataFrame, selected: Filters | None = None, first: int = 14, least: int = 3) -> DataFrame:
    """What a panel shows: long-tailed kinds from `least` records on, the first values and all up to the last selected."""
    from pyspark.sql import Window

    chosen = F.lit(False)
    for kind, keys in (selected or {}).items():
        chosen = chosen | ((F.col("kind") == kind) & F.col("key").isin(*keys))
    marked = value_order(counted.withColumn("selected", chosen).filter(~F.col("kind").isin(*TAIL_KINDS) | (F.col("n") >= least) | F.col("selected")))
    last = F.max(F.when(F.col("selected"), F.col("rank")).otherwise(0)).over(Window.partitionBy("kind"))
    return marked.withColumn("last", last).filter(F.col("rank") <= F.greatest(F.lit(first), F.col("last"))).drop("last")


def active(filters: Filters | None) -> Filters:
    """Kinds with at least one key, which are compared in lower case."""
    return {k: [x.lower() for x in v] for k, v in (filters or {}).items() if v}


def _matches(facets: DataFrame, filters: Filters) -> DataFrame:
    """(doc, one flag for each active kind): a single pass over the facets."""
    flag = lambda k, keys: F.coalesce(F.max(F.when((F.col("kind") == k) & F.col("key").isin(*keys), True)), F.lit(False)).alias(f"is_{k}")
    return facets.filter(F.col("kind").isin(*filters)).groupBy("doc").agg(*[flag(k, v) for k, v in filters.items()])


def allowed(facets: DataFrame, filters: Filters | None) -> DataFrame | None:
    """Documents with a chosen key of every active kind; None if nothing is chosen."""
    kinds = active(filters)
    if not kinds:
        return None
    return _matches(facets, kinds).filter(reduce(lambda a, b: a & b, (F.col(f"is_{k}") for k in kinds))).select("doc")


def filtered(docs: DataFrame, facets: DataFrame, filters: Filters | None) -> DataFrame:
    allow = allowed(facets, filters)
    return docs if allow is None else docs.join(allow, "doc", "left_semi")


def counts(docs: DataFrame, facets: DataFrame) -> DataFrame:
    """(kind, key, label, n) over a set of documents."""
    return facets.join(docs.select("doc"), "doc", "left_semi").groupBy("kind", "key", "label").agg(F.count("*").alias("n"))


def disjunctive_counts(docs: DataFrame, facets: DataFrame, filters: Filters | None) -> DataFrame:
    """Counts in which each active kind disregards its own choice.

    docs: the unfiltered result. Every document gets one flag for each kind; a value counts
    the documents that pass all other kinds, so that no search is run again.
    """
    kinds = active(filters)
    if not kinds:
        return counts(docs, facets)
    flags = docs.select("doc").join(_matches(facets, kinds), "doc", "left").na.fill(False)
    passing = lambda but: reduce(lambda a, b: a & b, (F.col(f"is_{k}") for k in kinds if k != but), F.lit(True))
    counts_here = passing(None)
    for k in kinds:
        counts_here = F.when(F.col("kind") == k, passing(k)).otherwise(counts_here)
    return facets.join(flags, "doc").filter(counts_here).groupBy("kind", "key", "label").agg(F.count("*").alias("n"))


def pools(docs: DataFrame, facets: DataFrame, filters: Filters | None) -> DataFrame:
    """Documents (doc, ..) once for each pool that they are in: `pool` is empty where they pass all filters, and a kind where they pass all but its own."""
    kinds = active(filters)
    if not kinds:
        return docs.withColumn("pool", F.lit(""))
    flags = docs.join(_matches(facets, kinds), "doc", "left").na.fill(False, [f"is_{k}" for k in kinds])
    passing = lambda but: reduce(lambda a, b: a & b, (F.col(f"is_{k}") for k in kinds if k != but), F.lit(True))
    listed = F.array_compact(F.array(*[F.when(passing(k), k or "") for k in (None, *kinds)]))
    return flags.select(*docs.columns, F.explode(listed).alias("pool"))


def pooled_counts(members: DataFrame, facets: DataFrame, filters: Filters | None) -> DataFrame:
    """(kind, key, label, n): each kind over its own pool of (doc, pool), kinds without a choice over the pool of all filters."""
    own = F.when(F.col("kind").isin(*active(filters)), F.col("kind")).otherwise("")
    met = facets.withColumn("pool", own).join(members.select("doc", "pool").distinct(), ["doc", "pool"])
    return met.groupBy("kind", "key", "label").agg(F.count("*").alias("n"))
