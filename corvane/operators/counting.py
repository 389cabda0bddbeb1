"""Words counted document by document: each task turns some documents at a time into blocks of postings, so that no occurrence is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LONGEST_TOKEN, abbreviation_tokens, compound_tokens, text_of

#: Documents of a chunk: up to so many bytes of text, and no more than a batch has.
CHUNK_BYTES = 1 << 24

_WORD = np.zeros(256, bool)
_WORD[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = True


def counted(rows: DataFrame, doc: str, fields: list[tuple[Column, int]], joined: bool = True) -> DataFrame:
    """Blocks (term, chunk, n, docs, ws): of each chunk of documents and each of its words, the n documents and how much the word counts there.

    fields: texts, and what an occurrence in each counts. A row without a term has all documents of a chunk, with their
    sums. A document's words are those of text.tokens, or without `joined` those of text.plain_tokens. All of a
    document is in one chunk; the texts of a repeated document are taken as one.
    """
    own = rows.select(F.col(doc).alias("doc"), *[text_of(c).alias(f"t{i}") for i, (c, _) in enumerate(fields)])
    if not own.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        own = own.groupBy("doc").agg(*[F.array_join(F.collect_list(f"t{i}"), "|").alias(f"t{i}") for i in range(len(fields))])  # no word goes over a bar
    lower = [F.lower(f"t{i}").alias(f"t{i}") for i in range(len(fields))]
    more = [F.concat(abbreviation_tokens(F.col(f"t{i}")), compound_tokens(F.col(f"t{i}"))).alias(f"m{i}") for i in range(len(fields))] if joined else []
    kind = own.schema["doc"].dataType.simpleString()
    return own.select("doc", *lower, *more).mapInArrow(_blocks([w for _, w in fields]), f"term string, chunk long, n long, docs array<{kind}>, ws array<int>")


def postings(blocks: DataFrame, w: str = "w") -> DataFrame:
    """(term, doc, w) of blocks, and whatever other columns they have."""
    own = [c for c in blocks.columns if c not in ("term", "chunk", "n", "docs", "ws")]
    at = blocks.select("term", *own, F.explode(F.arrays_zip("docs", "ws")).alias("at"))
    return at.select("term", F.col("at.docs").alias("doc"), F.col("at.ws").cast("long").alias(w), *own)


def _blocks(weights: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            size = sum(pc.binary_length(batch.column(1 + i)).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(weights)))
            ends = np.cumsum(size)
            begin = 0
            while begin < batch.num_rows:
                stop = max(begin + 1, int(np.searchsorted(ends, ends[begin] - size[begin] + CHUNK_BYTES, side="right")))
                yield _block(batch.slice(begin, stop - begin), chunk, weights)
                begin, chunk = stop, chunk + 1

    return run


def _block(batch: pa.RecordBatch, chunk: int, weights: list[int]) -> pa.RecordBatch:
    """The blocks of one chunk, then its documents and their sums."""
    n, k = batch.num_rows, len(weights)
    found = []  # (words, their documents) of each field, plain and joined
    for i in range(k):
        found.append(_plain(batch.column(1 + i)))
        if batch.num_columns > 1 + k:
            more = batch.column(1 + k + i)
            found.append((more.flatten().cast(pa.string()), np.repeat(np.arange(n), pc.list_value_length(more).to_numpy(zero_copy_only=False))))
    words = pa.concat_arrays([x for x, _ in found]).dictionary_encode()
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key = code * n + np.concatenate([x for _, x in found])
    ends = np.cumsum([len(x) for x, _ in found])[len(found) // k - 1 :: len(found) // k]
    parts = [np.unique(x, return_counts=True) for x in np.split(key, ends[:-1])]
    key, w = np.concatenate([x for x, _ in parts]), np.concatenate([x * weight for (_, x), weight in zip(parts, weights, strict=True)])
    if k > 1:
        order = np.argsort(key, kind="stable")
        key, w = key[order], w[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        key, w = key[first], np.add.reduceat(w, first) if len(key) else w
    code, row = np.divmod(key, n)
    sizes = np.bincount(code, minlength=len(words.dictionary))
    sums = np.bincount(row, weights=w, minlength=n).astype(np.int64)
    sizes = np.r_[sizes, n]
    docs = batch.column(0).take(pa.array(np.r_[row, np.arange(n)]))
    offsets = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
    columns = [
        pa.concat_arrays([words.dictionary, pa.nulls(1, pa.string())]), pa.array(np.full(len(sizes), chunk)), pa.array(sizes),
        pa.ListArray.from_arrays(offsets, docs), pa.ListArray.from_arrays(offsets, pa.array(np.r_[w, sums], pa.int32())),
    ]
    return pa.RecordBatch.from_arrays(columns, ["term", "chunk", "n", "docs", "ws"])


def _plain(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The plain tokens of texts in lower case, and the row of each."""
    n = len(texts)
    _, at, data = texts.buffers()
    off = np.frombuffer(at, np.int32, n + 1, texts.offset * 4).astype(np.int64)
    b = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    off -= off[0]
    word = _WORD[b]
    edge = np.zeros(len(b) + 1, bool)  # where a text begins, none of its words goes on from the text before
    edge[off] = edge[0] = True
    joint = np.zeros(len(b) + 1, bool)
    joint[1:-1] = word[:-1] & word[1:] & ~edge[1:-1]
    starts, ends = np.flatnonzero(word & ~joint[:-1]), np.flatnonzero(word & ~joint[1:]) + 1
    pieces = -(-(ends - starts) // LONGEST_TOKEN)
    if len(pieces) and pieces.max() > 1:
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = np.repeat(starts, pieces) + LONGEST_TOKEN * within
        ends = np.minimum(starts + LONGEST_TOKEN, np.repeat(ends, pieces))
    single = ends - starts < 2
    word[starts[single]] = False
    starts, ends = starts[~single], ends[~single]
    offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
    row = np.repeat(np.arange(n), np.diff(np.searchsorted(starts, off)))
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(b[word])), row
