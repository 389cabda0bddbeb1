"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts, text_source

LETTER = re.compile(r"[^\W\d_]")
#: A text is read in segments of SEGMENT bytes, each with up to MARGIN bytes of its neighbours on either side.
SEGMENT, MARGIN = 160, 16
#: Segments that go through the network together.
AT_ONCE = 2048
#: The evidence of so many neighbouring positions counts as that of one, since they share what they saw.
SHARED = 8


def stream(text: str) -> bytes:
    """What the network reads of a text: all its bytes, lower-cased."""
    return text.lower().encode("utf-8", "replace")


def segments(streams: list[bytes], size: int = SEGMENT, margin: int = MARGIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, owner, valid): all overlapping segments of all streams, whose they are, and how many of their own bytes they have.

    A segment is its own bytes between `margin` bytes of context on either side; zeros stand
    for what lies beyond a stream.
    """
    lengths = np.fromiter(map(len, streams), np.int64, len(streams))
    before, after = bytes(margin), bytes(margin + size)
    data = np.frombuffer(b"".join([x for s in streams for x in (before, s, after)]), np.uint8)
    n = -(-lengths // size)
    owner = np.repeat(np.arange(len(streams)), n)
    begin = (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * size
    base = np.cumsum(lengths + 2 * margin + size) - (lengths + 2 * margin + size)
    if not len(owner):
        return np.empty((0, size + 2 * margin), np.uint8), owner, begin
    x = np.lib.stride_tricks.sliding_window_view(data, size + 2 * margin)[base[owner] + begin]
    return x, owner, np.minimum(size, lengths[owner] - begin)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Direction:
    """One direction's gated recurrent unit: update and reset gates, then the candidate state."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        scale = 1 / np.sqrt(hidden)
        self.p = {
            "inputs": rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32),
            "gates": rng.uniform(-scale, scale, (hidden, 2 * hidden)).astype(np.float32),
            "candidate": rng.uniform(-scale, scale, (hidden, hidden)).astype(np.float32),
        }
        self.hidden = hidden

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """x: bytes (n, steps), in reading order. States after each step (steps, n, hidden), and what backward() needs."""
        n, h = len(x), self.hidden
        state, states, past = np.zeros((n, h), np.float32), [], []
        for t in range(x.shape[1]):
            given = self.p["inputs"][x[:, t]]
            both = _sigmoid(given[:, : 2 * h] + state @ self.p["gates"])
            update, reset = both[:, :h], both[:, h:]
            damped = reset * state
            new = np.tanh(given[:, 2 * h :] + damped @ self.p["candidate"])
            past.append((state, update, reset, damped, new))
            state = new + update * (state - new)
            states.append(state)
        return np.stack(states), past

    def backward(self, x: np.ndarray, past: list, d_states: np.ndarray) -> dict[str, np.ndarray]:
        """Backpropagation through time from the gradient on each state."""
        h, grads = self.hidden, {k: np.zeros_like(v) for k, v in self.p.items()}
        carried, given = np.zeros_like(d_states[0]), np.empty((x.shape[1], len(x), 3 * h), d_states.dtype)
        for t in range(x.shape[1] - 1, -1, -1):
            state, update, reset, damped, new = past[t]
            d = d_states[t] + carried
            d_new = d * (1 - update) * (1 - new * new)
            d_damped = d_new @ self.p["candidate"].T
            d_gates = np.concatenate([d * (state - new) * update * (1 - update), d_damped * state * reset * (1 - reset)], axis=1)
            grads["candidate"] += damped.T @ d_new
            grads["gates"] += state.T @ d_gates
            given[t, :, : 2 * h], given[t, :, 2 * h :] = d_gates, d_new
            carried = d * update + d_damped * reset + d_gates @ self.p["gates"].T
        order = np.argsort(x.T.ravel(), kind="stable")
        byte = x.T.ravel()[order]
        first = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
        grads["inputs"][byte[first]] = np.add.reduceat(given.reshape(-1, 3 * h)[order], first)
        return grads

    def add_logits(self, x: np.ndarray, out: np.ndarray, logits: np.ndarray) -> None:
        """forward() without a memory: adds states @ out to logits (steps, n, languages); x: bytes (steps, n)."""
        n, h = x.shape[1], self.hidden
        inputs, gates, candidate = self.p["inputs"].copy(), self.p["gates"] * np.float32(0.5), self.p["candidate"]
        inputs[:, : 2 * h] *= 0.5  # a sigmoid is a tanh of half its argument
        state, damped, new = (np.zeros((n, h), np.float32) for _ in range(3))
        given, both, own = np.empty((n, 3 * h), np.float32), np.empty((n, 2 * h), np.float32), np.empty(logits.shape[1:], np.float32)
        update, reset = both[:, :h], both[:, h:]
        for t in range(len(x)):
            np.take(inputs, x[t], axis=0, out=given, mode="clip")
            np.dot(state, gates, out=both)
            both += given[:, : 2 * h]
            np.tanh(both, out=both)
            both += 1
            both *= 0.5
            np.multiply(reset, state, out=damped)
            np.dot(damped, candidate, out=new)
            new += given[:, 2 * h :]
            np.tanh(new, out=new)
            state -= new
            state *= update
            state += new
            logits[t] += np.dot(state, out, out=own)


def _log_softmax(logits: np.ndarray) -> np.ndarray:
    logits = logits - logits.max(axis=-1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=-1, keepdims=True))


@dataclass
class LanguageModel:
    """Two directions and an output layer that labels every position."""

    languages: list[str]
    ahead: Direction
    back: Direction
    out: np.ndarray
    bias: np.ndarray

    def labels(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities (steps, n, languages) of every position of segments (n, steps)."""
        steps, h = np.ascontiguousarray(x.T), self.ahead.hidden
        logits = np.empty((*steps.shape, len(self.languages)), np.float32)
        logits[:] = self.bias
        self.ahead.add_logits(steps, np.ascontiguousarray(self.out[:h]), logits)
        self.back.add_logits(steps[::-1], np.ascontiguousarray(self.out[h:]), logits[::-1])
        return _log_softmax(logits)

    def evidence(self, streams: list[bytes]) -> np.ndarray:
        """For each stream the sum over all its positions of their log-probabilities."""
        x, owner, valid = segments(streams)
        total, inner = np.zeros((len(streams), len(self.languages))), np.arange(SEGMENT)[:, None]
        for at in range(0, len(x), AT_ONCE):
            own = slice(at, at + AT_ONCE)
            p = self.labels(x[own])[MARGIN : MARGIN + SEGMENT]
            p[inner >= valid[own]] = 0
            np.add.at(total, owner[own], p.sum(axis=0, dtype=np.float64))
        return total

    @classmethod
    def fit(cls, pairs: list[tuple[bytes, str]], hidden: int = 12, steps: int = 500, batch: int = 192, size: int = 48, margin: int = 8, rate: float = 0.012, seed: int = 7) -> LanguageModel:
        """pairs: (passage, language). Cross-entropy of every position of passages' segments, by Adam."""
        rng = np.random.default_rng(seed)
        languages = sorted({lang for _, lang in pairs})
        model = cls(languages, Direction(hidden, rng), Direction(hidden, rng), rng.normal(0, 0.1, (2 * hidden, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
        x, owner, _ = segments([s for s, _ in pairs], size, margin)
        if len(languages) < 2 or not len(x):
            return model
        target = np.array([languages.index(lang) for _, lang in pairs])[owner]
        by_language = [np.flatnonzero(target == k) for k in range(len(languages))]
        by_language = [own for own in by_language if len(own)]
        params = {("a", k): v for k, v in model.ahead.p.items()} | {("b", k): v for k, v in model.back.p.items()} | {("o", "out"): model.out, ("o", "bias"): model.bias}
        m, v = ({k: np.zeros_like(p) for k, p in params.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(own, max(1, batch // len(by_language))) for own in by_language])
            now, y = x[pick], target[pick]
            ahead, past_a = model.ahead.forward(now)
            back, past_b = model.back.forward(now[:, ::-1])
            state = np.concatenate([ahead, back[::-1]], axis=2)
            d = np.exp(_log_softmax(state @ model.out + model.bias))
            d[:, np.arange(len(y)), y] -= 1
            d *= (now.T != 0)[:, :, None]
            d /= max(1, np.count_nonzero(now))
            d_state = d @ model.out.T
            grads = {("o", "out"): state.reshape(-1, 2 * hidden).T @ d.reshape(-1, len(languages)), ("o", "bias"): d.sum(axis=(0, 1))}
            grads |= {("a", k): g for k, g in model.ahead.backward(now, past_a, d_state[:, :, :hidden]).items()}
            grads |= {("b", k): g for k, g in model.back.backward(now[:, ::-1], past_b, d_state[::-1, :, hidden:]).items()}
            speed = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                params[k] -= speed * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return model


def training_pairs(docs: DataFrame, learn: Column, id_col: str, text: str, lang: str, docs_each: int, bytes_each: int) -> list[tuple[bytes, str]]:
    """About docs_each documents of every language, a passage of up to bytes_each bytes from anywhere in each.

    The documents are those whose hashed id lies under a threshold that the language's count
    gives, so at most about docs_each x languages x bytes_each bytes reach the driver.
    """
    rows = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not counts:
        return []
    below = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, docs_each / n) * (1 << 30)))])
    draw = F.xxhash64(F.lit("language"), F.col(id_col)).bitwiseAND(F.lit((1 << 30) - 1))
    chosen = rows.filter(draw < below[F.col(lang)]).select(draw.alias("draw"), F.col(text).alias("text"), F.col(lang).alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            passages = []
            for draw, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = stream(text)
                begin = random.Random(draw).randrange(max(1, len(own) - bytes_each + 1))
                passages.append(own[begin : begin + bytes_each])
            yield pa.RecordBatch.from_arrays([pa.array(passages, pa.binary()), batch.column(2)], ["s", "l"])

    return sorted((bytes(r["s"]), r["l"]) for r in chosen.mapInArrow(run, "s binary, l string").collect())


def fit_language_model(docs: DataFrame, learn: Column, id_col: str = "doc_id", text: str = "text", lang: str = "lang", docs_each: int = 500, bytes_each: int = 480) -> LanguageModel | None:
    """Trains on a bounded sample (docs_each documents a language, bytes_each bytes each); None without rows."""
    pairs = training_pairs(docs, learn, id_col, text, lang, docs_each, bytes_each)
    return LanguageModel.fit(pairs) if pairs else None


def identify_language(docs: DataFrame, model: LanguageModel | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score (0 to 1) to the kept columns; clashing ones are replaced.

    The network reads the whole byte stream of a text, with or without spaces, in
    overlapping segments; every position is labelled, and a document's probabilities are the
    normalised product of its positions', of which SHARED count as one. A text that is null or has no letter, or any text
    without a model, gets `und` and score 0. Ties go to the first language by name.
    Repeated rows are repeated; an empty table gives no rows; memory depends on the
    segments of a batch of at most 64 texts.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("lang_pred", "score")]
    source, at = text_source(docs, keep, text)
    schema = docs.select(*[docs[c] for c in keep], F.lit("").cast("string").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 64):
            texts = batch.column(at).to_pylist()
            read = [i for i, t in enumerate(texts) if model and t and LETTER.search(t)]
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            if read:
                total = model.evidence([stream(texts[i]) for i in read])
                best = total.argmax(axis=1)
                score = 1 / np.exp((total - total.max(axis=1, keepdims=True)) / SHARED).sum(axis=1)
                for i, k, x in zip(read, best.tolist(), score.tolist(), strict=True):
                    langs[i], scores[i] = model.languages[k], x
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    return source.mapInArrow(run, schema)
