"""Inverted indexes as tables: blocks of postings(term, doc, w), lengths(doc, dl) and one row of statistics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shard_of
from .counting import counted, postings

#: How much an occurrence counts by where it stands.
FIELD_WEIGHTS = {"name": 12, "core": 7, "support": 3, "body": 2}
LARGEST_WEIGHT = 65535
LARGEST_COUNT = 255
FOLD_LEAST_DF = 20


#: How a table that is read more than once is kept: as it is, or stored.
Keep = Callable[[DataFrame], DataFrame]


def _as_it_is(df: DataFrame) -> DataFrame:
    return df


@dataclass
class Index:
    """Tables of one index: blocks (term, chunk, n, docs, ws) of postings, and blocks without a term for the lengths.

    Words of a search meet blocks by a literal filter, so sort or partition these by term. Until an index is stored, its
    blocks have all words, and `cut` takes off what the index leaves out; it needs a word's blocks in one partition.
    """

    blocks: DataFrame
    lists: DataFrame  # chunk, n, docs, ws
    stats: DataFrame  # n, avgdl
    terms: DataFrame | None = None  # term, df, where they are stored
    cut: Callable[[DataFrame], DataFrame] = _as_it_is

    @property
    def postings(self) -> DataFrame:
        return postings(self.cut(self.blocks))

    @property
    def lengths(self) -> DataFrame:
        return _doc_lengths(self.lists)

    def of(self, terms: DataFrame) -> Index:
        """This index with the blocks of some terms (term) only."""
        return Index(self.cut(self.blocks).join(terms.select("term").distinct(), "term", "left_semi"), self.lists, self.stats, self.terms)

    def vocabulary(self) -> DataFrame:
        return vocabulary(self.cut(self.blocks)) if self.terms is None else self.terms


def token_counts(docs: DataFrame, doc: str, text: str | Column) -> DataFrame:
    """(term, doc, tf): without a shuffle."""
    col = F.col(text) if isinstance(text, str) else text
    return postings(counted(docs, doc, [(col, 1)]).filter("term is not null"), "tf")


def summary_index(records: DataFrame, doc: str, fields: dict[str, Column], keep: Keep = _as_it_is) -> Index:
    """The weighted index: an occurrence in a field (FIELD_WEIGHTS) counts the field's weight.

    Lengths count every weight; short terms of one document and weights beyond the largest are cut.
    keep: stores the blocks, which postings and lengths both read, so that texts are cut into tokens once.
    """
    blocks = keep(counted(records, doc, [(text, FIELD_WEIGHTS[name]) for name, text in fields.items()]))
    lists = blocks.filter("term is null").drop("term")
    return Index(blocks.filter("term is not null"), lists, statistics(_doc_lengths(lists)), cut=lambda b: clamp(pruned(b), LARGEST_WEIGHT))


def full_text_index(docs: DataFrame, doc: str, text: str, keep: Keep = _as_it_is) -> Index:
    """The plain index: terms of one document go, counts end at the largest, the mean length is over non-empty documents. keep: as above."""
    blocks = keep(counted(docs, doc, [(F.col(text), 1)]))
    return _plain_index(blocks.filter("term is not null"), blocks.filter("term is null").drop("term"))


def index_of_counts(counts: DataFrame, all_docs: DataFrame, chunks: int = 64) -> Index:
    """The plain index of (term, doc, w) and all documents (doc)."""
    chunk = F.pmod(F.xxhash64("doc"), F.lit(chunks)).alias("chunk")
    at = F.sort_array(F.collect_list(F.struct("doc", F.col("w").cast("int").alias("w")))).alias("at")
    block = [F.size("at").cast("long").alias("n"), F.col("at.doc").alias("docs"), F.col("at.w").alias("ws")]
    sums = counts.groupBy("doc").agg(F.sum("w").alias("w"))
    lengths = all_docs.join(sums, "doc", "left").na.fill(0, ["w"])
    return _plain_index(counts.groupBy("term", chunk).agg(at).select("term", "chunk", *block), lengths.groupBy(chunk).agg(at).select("chunk", *block))


def _plain_index(blocks: DataFrame, lists: DataFrame) -> Index:
    stats = _doc_lengths(lists).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("dl") > 0, F.col("dl"))), 2).alias("avgdl"))
    return Index(blocks.withColumn("shard", shard_of(F.col("term"))), lists, stats, cut=lambda b: clamp(pruned(b, long_term=None), LARGEST_COUNT))


def _doc_lengths(lists: DataFrame) -> DataFrame:
    return lists.select(F.explode(F.arrays_zip("docs", "ws")).alias("at")).select(F.col("at.docs").alias("doc"), F.col("at.ws").cast("long").alias("dl"))


def statistics(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n"), F.round(F.avg("dl"), 2).alias("avgdl"))


def pruned(blocks: DataFrame, least_df: int = 2, long_term: int | None = 4) -> DataFrame:
    """Without terms that are rare, or that are both rare and short: of blocks that are dealt out by term, without another shuffle."""
    df = F.sum("n").over(Window.partitionBy("term"))
    kept = F.col("df") >= least_df
    return blocks.withColumn("df", df).filter(kept if long_term is None else kept | (F.length("term") >= long_term)).drop("df")


def clamp(blocks: DataFrame, most: int) -> DataFrame:
    return blocks.withColumn("ws", F.transform("ws", lambda w: F.least(w, F.lit(most))))


def stems_of(words: DataFrame, vocabulary: DataFrame, least_df: int = FOLD_LEAST_DF) -> DataFrame:
    """(term, stem) of words (term): the first of -ies to -y, -s and -es whose stem is frequent in the vocabulary (term, df)."""
    cut = lambda n, end="": F.concat(F.substring("term", F.lit(1), F.length("term") - n), F.lit(end))
    candidates = F.array(
        F.when(F.col("term").endswith("ies") & (F.length("term") >= 6), cut(3, "y")),
        F.when(F.col("term").endswith("s") & (F.length("term") >= 4), cut(1)),
        F.when(F.col("term").rlike("(s|x|z|ch|sh)es$") & (F.length("term") >= 5), cut(2)),
    )
    tried = words.select("term", F.posexplode(candidates).alias("rule", "stem")).filter("stem is not null")
    known = vocabulary.filter(F.col("df") >= least_df).select(F.col("term").alias("stem"))
    return tried.join(known, "stem").groupBy("term").agg(F.min_by("stem", "rule").alias("stem"))


def fallbacks(words: DataFrame, vocabulary: DataFrame, least_df: int = FOLD_LEAST_DF) -> DataFrame:
    """(term, stem) of typed words (term) that the vocabulary lacks: such a word also finds its stem."""
    return stems_of(words.join(vocabulary, "term", "left_anti"), vocabulary, least_df)


def folds(vocabulary: DataFrame, least_df: int = FOLD_LEAST_DF) -> DataFrame:
    """(term, other): grammatical number both ways."""
    found = stems_of(vocabulary.select("term"), vocabulary, least_df)
    return found.select("term", F.col("stem").alias("other")).unionByName(found.select(F.col("stem").alias("term"), F.col("term").alias("other"))).distinct()


def vocabulary(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("term").agg(F.sum("n").alias("df"))
