"""Many searches at once for the documents that have all of some words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.index import Index

#: Documents of a group, about, and pairs of a query and a document that are looked at together.
DOCS_EACH, PAIRS_EACH = 1 << 12, 1 << 18
LISTS, BLOCKS, ASKED = range(3)


def every_word(index: Index, queries: DataFrame, k: int, k1: float, b: float, digits: int) -> DataFrame:
    """(qid, doc, score): for every query (qid, words) its k best of each group of documents, of those that have all its words.

    Words are different ones; scores are those of search.lexical. Documents, which are numbers, are dealt out in groups. A group gets its own
    postings and the queries whose rarest word it has, and leaves k rows a query. So what is shuffled is the index and,
    for each query, a row for each group that has its rarest word: not the documents that have one of the words.
    """
    stats = index.stats.first()
    n, avgdl = stats["n"], float(stats["avgdl"] or 1.0)
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-n // DOCS_EACH))
    group = F.pmod(F.xxhash64("chunk"), F.lit(groups)).cast("int").alias("grp")
    spread = queries.select("qid", F.size("words").alias("n"), F.explode("words").alias("term")).join(index.vocabulary(), "term")
    inverse = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = spread.groupBy("qid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "term", inverse.alias("idf")))).alias("at")).filter("size(at) = n")
    blocks = index.cut(index.blocks)
    places = blocks.select("term", group).distinct()
    asked = known.withColumn("term", F.col("at")[0]["term"]).join(places, "term")
    none = lambda kind: F.lit(None).cast(kind)
    docs, ws = F.col("docs").cast("array<long>").alias("docs"), F.col("ws").cast("array<int>").alias("ws")
    rows = [
        index.lists.select(group, F.lit(LISTS).alias("kind"), none("string").alias("term"), docs, ws, none("long").alias("qid"), none("array<string>").alias("words"), none("array<double>").alias("idfs")),
        blocks.select(group, F.lit(BLOCKS).alias("kind"), "term", docs, ws, none("long").alias("qid"), none("array<string>").alias("words"), none("array<double>").alias("idfs")),
        asked.select("grp", F.lit(ASKED).alias("kind"), none("string").alias("term"), none("array<long>").alias("docs"), none("array<int>").alias("ws"), F.col("qid").cast("long").alias("qid"), F.col("at.term").alias("words"), F.col("at.idf").alias("idfs")),
    ]
    dealt = rows[0].unionByName(rows[1]).unionByName(rows[2]).repartition(max(1, min(groups, 8 * parts)), "grp").sortWithinPartitions("grp", "kind", "term")
    return dealt.mapInArrow(_met(k, avgdl, k1, b, digits), "qid long, doc long, score double")


class _Group:
    """Postings of a group of documents, as ascending numbers of a term and a document, which queries meet."""

    def __init__(self):
        self.ids, self.lengths, self.terms, self.keys, self.weights = [], [], [], [], []
        self.last, self.n_terms, self.ready = None, 0, False

    def add_lists(self, rows: pa.RecordBatch) -> None:
        self.ids.append(_values(rows, "docs"))
        self.lengths.append(_values(rows, "ws"))

    def add_blocks(self, rows: pa.RecordBatch) -> None:
        if isinstance(self.ids, list):
            ids, lengths = np.concatenate(self.ids), np.concatenate(self.lengths)
            order = np.argsort(ids)
            self.ids, self.lengths = ids[order], lengths[order]
        terms = rows["term"]
        new = np.ones(len(terms), bool)
        new[1:] = pc.not_equal(terms.slice(1), terms.slice(0, len(terms) - 1)).to_numpy(zero_copy_only=False)
        new[0] = terms[0].as_py() != self.last
        at = self.n_terms - 1 + np.cumsum(new)
        self.terms.append(terms.filter(pa.array(new)))
        self.last, self.n_terms = terms[-1].as_py(), int(at[-1]) + 1
        sizes = pc.list_value_length(rows["docs"]).to_numpy(zero_copy_only=False)
        self.keys.append(np.repeat(at, sizes) * len(self.ids) + np.searchsorted(self.ids, _values(rows, "docs")))
        self.weights.append(_values(rows, "ws"))

    def finish(self) -> None:
        keys = np.concatenate(self.keys)
        order = np.argsort(keys, kind="stable")
        self.keys, self.weights = keys[order], np.concatenate(self.weights)[order]
        self.starts = np.searchsorted(self.keys, np.arange(self.n_terms + 1) * len(self.ids))
        self.terms = pa.concat_arrays(self.terms)
        self.ready = True

    def meet(self, rows: pa.RecordBatch, k: int, avgdl: float, k1: float, b: float, digits: int) -> Iterator[pa.RecordBatch]:
        if not self.ready:
            self.finish()
        qids = rows["qid"].to_numpy(zero_copy_only=False)
        sizes = pc.list_value_length(rows["words"]).to_numpy(zero_copy_only=False)
        term = pc.index_in(rows["words"].flatten(), value_set=self.terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        idf = rows["idfs"].flatten().to_numpy(zero_copy_only=False)
        query = np.repeat(np.arange(len(qids)), sizes)
        held = np.where(term < 0, 0, self.starts[term + 1] - self.starts[term])
        order = np.lexsort((held, query))  # a query's words from the rarest of the group on
        term, idf, held = term[order], idf[order], held[order]
        first = np.cumsum(sizes) - sizes
        whole = np.flatnonzero((sizes > 0) & (held[np.minimum(first, max(0, len(held) - 1))] > 0)) if len(held) else np.empty(0, np.int64)
        pairs = np.cumsum(held[first[whole]])
        begin = 0
        while begin < len(whole):
            before = pairs[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(pairs, before + PAIRS_EACH, side="right")))
            some = whole[begin:stop]
            yield from self._scored(qids, sizes, term, idf, held, first, some, k, avgdl, k1, b, digits)
            begin = stop

    def _scored(self, qids, sizes, term, idf, held, first, some, k, avgdl, k1, b, digits) -> Iterator[pa.RecordBatch]:
        n = len(self.ids)
        count = held[first[some]]
        query = np.repeat(some, count)
        place = np.repeat(self.starts[term[first[some]]], count) + np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
        doc = self.keys[place] % n
        score = np.zeros(len(query))
        for i in range(int(sizes[some].max(initial=0))):
            more = sizes[query] > i
            at = first[query] + np.where(more, i, 0)
            wanted = term[at] * n + doc
            place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            w = self.weights[place].astype(np.float64)
            part = idf[at] * w * (k1 + 1) / (w + k1 * (1 - b + b * self.lengths[doc] / avgdl))
            score += np.where(more, part, 0.0)
            kept = ~more | (self.keys[place] == wanted)
            query, doc, score = query[kept], doc[kept], score[kept]
        order = np.lexsort((self.ids[doc], -np.round(score, digits), query))
        query, doc, score = query[order], doc[order], score[order]
        if len(query):
            begins = np.maximum.accumulate(np.where(np.r_[True, query[1:] != query[:-1]], np.arange(len(query)), 0))
            best = np.arange(len(query)) - begins < k
            yield pa.RecordBatch.from_arrays([pa.array(qids[query[best]], pa.int64()), pa.array(self.ids[doc[best]], pa.int64()), pa.array(score[best])], ["qid", "doc", "score"])


def _values(rows: pa.RecordBatch, name: str) -> np.ndarray:
    return rows[name].flatten().to_numpy(zero_copy_only=False)


def _met(k: int, avgdl: float, k1: float, b: float, digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, _Group()
        for batch in batches:
            grp, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            begins = np.flatnonzero(np.r_[True, (grp[1:] != grp[:-1]) | (kind[1:] != kind[:-1])]) if len(grp) else []
            for begin, end in zip(begins, [*begins[1:], len(grp)], strict=True):
                if at != grp[begin]:
                    at, own = grp[begin], _Group()
                rows = batch.slice(begin, end - begin)
                if kind[begin] == LISTS:
                    own.add_lists(rows)
                elif kind[begin] == BLOCKS:
                    own.add_blocks(rows)
                else:
                    yield from own.meet(rows, k, avgdl, k1, b, digits)

    return run
