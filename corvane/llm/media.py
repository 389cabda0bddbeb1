"""Text payloads as lossless image columns, written and read back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp

ROW_BYTES = 576
MOST_ROWS = webp.MAX_SIDE
OPAQUE = np.uint32(webp.OPAQUE)


def payload_of(text: str | None) -> bytes:
    """The UTF-8 bytes, padded by 255 to a positive multiple of ROW_BYTES."""
    return padded(text.encode("utf-8", "replace") if text else b"")


def padded(data: bytes) -> bytes:
    return data.ljust(max(1, -(-len(data) // ROW_BYTES)) * ROW_BYTES, b"\xff")


def _bits(counts: np.ndarray) -> float:
    """The entropy of so many symbols, in bits altogether."""
    some = counts[counts > 0]
    return float(some @ (np.log2(some.sum()) - np.log2(some)))


def coding(payload: bytes) -> dict:
    """How a payload is written: by a palette if it has few values, with back-references and a colour cache if it
    repeats itself, with the left neighbour's prediction if its steps are far more regular than its values, else by prefix codes alone."""
    own = np.frombuffer(payload, np.uint8)
    counts = np.bincount(own, minlength=256)
    if np.count_nonzero(counts) <= 16:
        return {"transforms": (webp.PALETTE,)}
    if 8 * len(zlib.compress(payload, 1)) < len(payload):
        return {"references": True, "cache_bits": 6}
    steps = np.bincount((own[1:] - own[:-1]).astype(np.uint8), minlength=256)
    if _bits(steps) < 0.7 * _bits(counts):
        return {"transforms": (webp.PREDICTOR,), "block_bits": 8, "mode": lambda x, y: 1}
    return {}


def to_files(payload: bytes) -> bytes:
    """Lossless files, one after the other, of up to MOST_ROWS rows of ROW_BYTES pixels; a byte is a pixel's green sample."""
    pixels = (np.frombuffer(payload, np.uint8).astype(np.uint32) << np.uint32(8) | OPAQUE).reshape(-1, ROW_BYTES)
    how = coding(payload)
    return b"".join(webp.encode(pixels[at : at + MOST_ROWS], **how) for at in range(0, len(pixels), MOST_ROWS))


def from_files(media: bytes) -> np.ndarray:
    """The green samples of all files of a column value, (rows x ROW_BYTES) bytes."""
    at, parts = 0, []
    while at < len(media):
        pixels, size = webp.decode(media[at:] if at else media)
        parts.append((pixels >> np.uint32(8)).astype(np.uint8))
        at += size
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty((0, ROW_BYTES), np.uint8)


def describe(samples: np.ndarray) -> str:
    """Mean, deviation and entropy (bits) of the samples, then the shares of eight equal classes."""
    counts = np.bincount(samples.ravel(), minlength=256)
    share, level = counts / samples.size, np.arange(256)
    mean, some = float(share @ level), share[share > 0]
    numbers = [mean, float(np.sqrt(share @ (level - mean) ** 2)), float(-(some @ np.log2(some))), *share.reshape(8, 32).sum(axis=1).tolist()]
    return ",".join(f"{x:.4f}" for x in numbers)


def store_media(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes (of the UTF-8 text, null being empty) and media (binary, lossless WebP) of every row.

    Only these three columns are returned, whatever others there are; an id column of one of
    the new names is an error. Texts are stored whole, in several files of MOST_ROWS rows if they are
    long; equal texts have equal media, repeated rows are repeated, an empty table gives no rows.
    """
    if id_col.lower() in ("n_bytes", "media"):
        raise ValueError(f"{id_col} is the name of a new column")
    source = docs.select(docs[id_col].alias("id"), docs[text].alias("text_")).withColumnRenamed("id", id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data = [t.encode("utf-8", "replace") if t else b"" for t in part.column(1).to_pylist()]
                sizes, media = list(map(len, data)), [to_files(padded(x)) for x in data]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    return source.mapInArrow(run, docs.select(docs[id_col], F.lit(0).cast("long").alias("n_bytes"), F.lit(b"").alias("media")).schema)


def read_media(stored: DataFrame, media: str = "media") -> DataFrame:
    """Adds payload (binary, the bytes of the decoded pixels) and feature to every row; clashing columns are replaced.

    Null media give null for both, and no file gives an empty payload with an empty feature;
    what isn't a lossless WebP file is an error. Repeated rows are repeated; an empty table gives no rows.
    """
    if media.lower() in ("payload", "feature"):
        raise ValueError(f"{media} is the name of a new column")
    stored = stored.drop(*[c for c in stored.columns if c.lower() in ("payload", "feature")])
    names, at = stored.columns, stored.columns.index(media)
    schema = stored.select("*", F.lit(None).cast("binary").alias("payload"), F.lit(None).cast("string").alias("feature")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                pixels = [None if m is None else from_files(m) for m in part.column(at).to_pylist()]
                payloads = pa.array([None if p is None else p.tobytes() for p in pixels], pa.binary())
                features = pa.array([None if p is None else describe(p) if p.size else "" for p in pixels], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, payloads, features], [*names, "payload", "feature"])

    return stored.mapInArrow(run, schema)
