"""Document quality by Bradley-Terry pairwise ranking."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts, text_source

BUCKETS = 256
SYMBOLS = re.compile(rb"[!-/:-@\[-`{-~]")
DIGITS = bytes(range(48, 58))
CAPITALS = bytes(range(65, 91))
LETTERS = CAPITALS + bytes(range(97, 123)) + bytes(range(128, 256))
DENSE = 16


def features(text: str | None, buckets: dict[bytes, int]) -> np.ndarray:
    """Length, make-up, repetition and hashed words of a whole text; zeros for null or blank.

    buckets: a memory of words' buckets, which the caller keeps bounded.
    """
    x = np.zeros(DENSE + BUCKETS, np.float32)
    data = text.encode("utf-8", "replace") if text else b""
    words = data.lower().split()
    if not words:
        return x
    n, n_words = len(data), len(words)
    counts = Counter(words)
    lines = data.split(b"\n")
    share = lambda chars: (n - len(data.translate(None, chars))) / n
    symbols = Counter(SYMBOLS.findall(data))
    top = max(counts.values())
    ends = sum(symbols[c] for c in (b".", b",", b"!", b"?", b";", b":"))
    x[:DENSE] = (
        np.log1p(n), np.log1p(n_words), n / n_words, share(DIGITS), share(CAPITALS), share(LETTERS), sum(symbols.values()) / n, len(symbols) / 10,
        len(counts) / n_words, top / n_words, np.log1p(top), len(set(lines)) / len(lines), len(lines) / n_words, ends / n_words, symbols[b"|"] / n_words, sum(map(len, counts)) / len(counts),
    )
    at = []
    for word in counts:
        if (b := buckets.get(word)) is None:
            b = buckets[word] = zlib.crc32(word) % BUCKETS
        at.append(b)
    x[DENSE:] = np.sqrt(np.bincount(at, np.fromiter(counts.values(), float, len(counts)), BUCKETS) / n_words)
    return x


def feature_matrix(texts: list[str | None], buckets: dict[bytes, int]) -> np.ndarray:
    if len(buckets) > 60_000:
        buckets.clear()
    return np.stack([features(t, buckets) for t in texts]) if texts else np.zeros((0, DENSE + BUCKETS), np.float32)


@dataclass
class BradleyTerry:
    """A linear score, learned so that the better of two documents scores higher."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0
    spread: float = 1.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, at least 0.5 from the score quantile on that divides the labels."""
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.threshold) / self.spread, -30, 30)))

    @classmethod
    def fit(cls, x: np.ndarray, label: np.ndarray, good_share: float, rounds: int = 600, batch: int = 1024, rate: float = 0.02, decay: float = 1e-3, seed: int = 11) -> BradleyTerry:
        """Logistic loss on feature differences of random (good, bad) pairs, by Adam."""
        rng = np.random.default_rng(seed)
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = (x - mean) / scale
        model = cls(mean, scale, np.zeros(x.shape[1], np.float32))
        good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
        if not len(good) or not len(bad):
            model.threshold = -1.0 if len(good) else 1.0
            return model
        m, v = np.zeros_like(model.weights), np.zeros_like(model.weights)
        for step in range(1, rounds + 1):
            d = z[rng.choice(good, batch)] - z[rng.choice(bad, batch)]
            wins = 1 / (1 + np.exp(-np.clip(d @ model.weights, -30, 30)))
            g = -(1 - wins) @ d / batch + decay * model.weights
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            model.weights -= (rate * (1 - step / (rounds + 1)) * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        raw = model.raw(x)
        weight = np.where(label == 1, good_share / len(good), (1 - good_share) / len(bad))  # the sample may be balanced, the corpus isn't
        order = np.argsort(raw)
        below = np.cumsum(weight[order])
        cut = min(int(np.searchsorted(below, 1 - good_share)), len(raw) - 2)
        model.threshold = float((raw[order[cut]] + raw[order[cut + 1]]) / 2)
        model.spread = float(max(raw.std() / 3, 1e-6))
        return model


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text: str = "text", label: str = "quality", docs_each: int = 3000) -> BradleyTerry | None:
    """Learns from about docs_each documents of each label (chosen by hashed id); None without labels.

    The chosen ids and labels, about 2 x docs_each rows, are broadcast to the documents. Only features of the chosen documents reach the driver. A document with several labels
    takes their majority, 1 on a tie; null labels are ignored.
    """
    own = labels.select(F.col(id_col).alias("id"), F.col(label).alias("label")).dropna().groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    own = own.filter(learn(F.col("id")))
    counts = {r[0]: r[1] for r in own.groupBy("label").count().collect()}
    if not counts:
        return None
    draw = F.xxhash64(F.lit("quality"), F.col("id")).bitwiseAND(F.lit((1 << 30) - 1))
    below = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, docs_each / n) * (1 << 30)))])
    chosen = own.filter(draw < below[F.col("label")])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets: dict[bytes, int] = {}
        for batch in parts(batches):
            x = feature_matrix(batch.column(1).to_pylist(), buckets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "x"])

    found = sorted((r["label"], bytes(r["x"])) for r in rows.mapInArrow(run, "label int, x binary").collect())
    if not found:
        return None
    x = np.frombuffer(b"".join(f[1] for f in found), np.float32).reshape(len(found), -1)
    return BradleyTerry.fit(x, np.array([f[0] for f in found]), counts.get(1, 0) / sum(counts.values()))


def score_quality(docs: DataFrame, model: BradleyTerry | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds score (0 to 1) to the kept columns; 0.5 for every text without a model.

    Null, empty and blank texts have the features zero and are scored like any other. A
    clashing column `score` is replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != "score"]
    source, at = text_source(docs, keep, text)
    schema = docs.select(*[docs[c] for c in keep], F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets: dict[bytes, int] = {}
        for batch in parts(batches):
            scores = model.score(feature_matrix(batch.column(at).to_pylist(), buckets)) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores.astype(float))], [*keep, "score"])

    return source.mapInArrow(run, schema)
