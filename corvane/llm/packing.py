"""Tokenized documents in sequences of fixed length, planned on a histogram of lengths."""

from __future__ import annotations

import bisect
import functools
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, parts, store

#: Words and chunks whose ids a worker keeps before it starts anew, and characters it looks at together; results don't depend on either.
KEPT_WORDS, CHARS_AT_ONCE = 1 << 18, 1 << 18
#: Bytes of an output batch, about.
BYTES_AT_ONCE = 1 << 22
WORD_BYTES = 16
#: Up to so many counts (three numbers each) are broadcast.
COUNT_ROWS = 100_000

# The parts of a tokenizer file that the fast path relies on.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
#: Bytes as the letters that the model's vocabulary is written in: printable ones stand for themselves, others follow from 256 on.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}

SPACE, LETTER, DIGIT, OTHER, END = range(5)
#: The kind of each byte; the second bytes of Latin-1 letters are letters, whatever else is beyond ASCII isn't looked at here.
KINDS = np.array([SPACE if b in b"\t\n\v\f\r " else DIGIT if 48 <= b < 58 else LETTER if b >= 128 or chr(b).isalpha() else OTHER for b in range(256)], np.uint8)
LOWERED = np.array([b + 32 if 65 <= b < 91 else b for b in range(256)], np.uint8)
#: Bytes of which a chunk goes to the tokenizer whole: control characters, apostrophes and, unless a Latin-1 letter, all beyond ASCII.
DOUBTFUL = np.array([b == 39 or b == 127 or b < 32 and KINDS[b] != SPACE or b >= 128 for b in range(256)])
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class WordTable:
    """Numbers of words of up to WORD_BYTES bytes, by open addressing on the bytes themselves."""

    def __init__(self, most: int):
        bits = max(4, (2 * most - 1).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.low, self.high, self.number = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (((low ^ high * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)) >> self.shift).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The numbers of words, -1 for those not in the table."""
        slot = self._slots(low, high)
        found = self.number[slot]
        open_ = np.flatnonzero((found >= 0) & ((self.low[slot] != low) | (self.high[slot] != high)))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.last
            at = slot[open_]
            found[open_] = self.number[at]
            open_ = open_[(found[open_] >= 0) & ((self.low[at] != low[open_]) | (self.high[at] != high[open_]))]
        return found

    def add(self, low: np.ndarray, high: np.ndarray, number: np.ndarray) -> None:
        """Distinct words that aren't in the table yet."""
        slot, open_ = self._slots(low, high), np.arange(len(low))
        while len(open_):
            at = slot[open_]
            free = self.number[at] < 0
            self.number[at[free]] = number[open_[free]]
            done = self.number[at] == number[open_]
            mine, at = open_[done], at[done]
            self.low[at], self.high[at] = low[mine], high[mine]
            open_ = open_[~done]
            slot[open_] = (slot[open_] + 1) & self.last


class BulkTokenizer:
    """Ids of many texts at once, equal to the tokenizer's for each text, then end_id.

    White space parts a text into chunks, whose ids don't depend on each other. Chunks of ASCII
    and of Latin-1 letters are cut into words and looked up with array operations; words not
    met before are given to the model. All other chunks are given to the tokenizer whole, and
    so is every chunk if the file at `path` isn't built of NORMALIZERS and PRE_TOKENIZERS.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.model = self.tokenizer.model
        normalizer, cutter = (json.loads(x.__getstate__()) if x else {} for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer))
        self.by_word = normalizer.get("normalizers") == NORMALIZERS and cutter.get("pretokenizers") == PRE_TOKENIZERS and isinstance(self.model, BPE) and not self.model.dropout
        self.by_word &= all(x.content.startswith("<|") for x in self.tokenizer.get_added_tokens_decoder().values())
        self._start(KEPT_WORDS)

    def _start(self, most: int) -> None:
        self.most, self.table, self.chunks = most, WordTable(most), {}
        self.ids, self.n_ids = np.zeros(1 << 16, "<u4"), 1
        self.ids[0] = self.end_id
        self.begin, self.size, self.n_words = np.zeros(most + 2, np.int64), np.zeros(most + 2, np.int64), 2
        self.size[0] = 1  # word 0 is the end of a text, word 1 the end of a part of one

    def _store(self, found: list[list[int]]) -> np.ndarray:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        n, total = len(found), int(sizes.sum())
        while self.n_ids + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.n_ids : self.n_ids + total] = [i for own in found for i in own]
        numbers = np.arange(self.n_words, self.n_words + n)
        self.begin[numbers], self.size[numbers] = self.n_ids + np.cumsum(sizes) - sizes, sizes
        self.n_ids, self.n_words = self.n_ids + total, self.n_words + n
        return numbers

    def _numbers(self, low: np.ndarray, high: np.ndarray, whole: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of words (by their bytes) and of whole chunks, new ones learnt."""
        known, new = self.table.find(low, high), {c for c in whole if c not in self.chunks}
        missing = np.flatnonzero(known < 0)
        keys = np.unique(np.stack([low[missing], high[missing]], axis=1).view([("low", "<u8"), ("high", "<u8")]).ravel()) if len(missing) else []
        if self.n_words - 2 + len(keys) + len(new) > self.most and self.n_words > 2:
            self._start(max(KEPT_WORDS, len(low) + len(whole)))
            return self._numbers(low, high, whole)
        if self.n_words - 2 + len(keys) + len(new) > self.most:
            self._start(len(low) + len(whole))
        if len(keys):
            words, tokens = keys.view(f"S{WORD_BYTES}").tolist(), self.model.tokenize  # NUL pads them
            numbers = self._store([[t.id for t in tokens(w.decode("latin-1").translate(BYTE_LETTERS))] for w in words])
            self.table.add(np.ascontiguousarray(keys["low"]), np.ascontiguousarray(keys["high"]), numbers.astype(np.int32))
            known[missing] = self.table.find(low[missing], high[missing])
        if new:
            new = sorted(new)
            found = self.tokenizer.encode_batch_fast([c.decode() for c in new], add_special_tokens=False)
            self.chunks.update(zip(new, self._store([e.ids for e in found]).tolist(), strict=True))
        return known, np.fromiter((self.chunks[c] for c in whole), np.int64, len(whole))

    def _encode(self, texts: list[str], last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, each followed by end_id where `last`, and where each one's end."""
        raw = [t.encode() for t in texts]
        joined = b"\n".join([*raw, bytes(WORD_BYTES)])
        n = len(joined) - WORD_BYTES
        data = np.frombuffer(joined, np.uint8, n)
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1) - 1
        kinds, low = KINDS[data], np.r_[LOWERED[data], np.zeros(WORD_BYTES, np.uint8)]
        kinds[ends] = END
        doubtful = DOUBTFUL[data]
        latin = np.flatnonzero(data == 0xC3)
        second = data[latin + 1]
        doubtful[latin] = doubtful[latin + 1] = (second == 0x97) | (second == 0xB7)  # times, divided by
        low[latin + 1] += np.where(second < 0x9F, 32, 0).astype(np.uint8)
        special = np.flatnonzero(data[:-1] == ord("<"))
        doubtful[special] |= data[special + 1] == ord("|")
        cut = np.r_[True, kinds[1:] != kinds[:-1]] | (kinds == DIGIT) | (kinds == END)
        at = np.flatnonzero(cut)
        kind, size = kinds[at], np.diff(np.r_[at, n])
        gap = (kind == SPACE) | (kind == END)
        chunk = np.cumsum(~gap & np.r_[True, gap[:-1]])  # of words, from 1 on
        bad = np.zeros(chunk[-1] + 1, bool)
        bad[chunk[size > WORD_BYTES]] = True  # chunk 0 is before the first word
        bad[chunk[np.searchsorted(at, np.flatnonzero(doubtful), side="right") - 1]] = True
        first = ~gap & np.r_[True, gap[:-1]]
        bad_word = bad[chunk] & ~gap
        taken = (kind != SPACE) & ~(bad_word & ~first)
        starts = at[first & bad_word]
        stops = np.r_[at[gap], n]
        stops = stops[np.searchsorted(stops, starts)]
        whole = [joined[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        at, kind, size, bad_word = at[taken], kind[taken], size[taken], bad_word[taken]
        plain = (kind != END) & ~bad_word
        eight = np.ndarray(n + 8, "<u8", low.tobytes(), strides=(1,))
        here, size = at[plain], size[plain]
        words = eight[here] & MASKS[np.minimum(size, 8)], eight[here + 8] & MASKS[np.maximum(size - 8, 0)]
        number = np.empty(len(at), np.int64)
        number[plain], number[bad_word] = self._numbers(*words, whole)
        number[kind == END] = ~last
        sizes = self.size[number]
        upto = np.cumsum(sizes)
        places = np.repeat(self.begin[number] - upto + sizes, sizes) + np.arange(upto[-1])
        return self.ids[places], upto[kind == END]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each followed by end_id, and where each one's end; null is empty."""
        found, ends, total = [], [], 0
        if not self.by_word:
            for text in texts:
                found.append(np.array([*self.tokenizer.encode(text or "", add_special_tokens=False).ids, self.end_id], "<u4"))
            return np.concatenate(found), np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        held, last, chars = [], [], 0

        def flush() -> None:
            nonlocal held, last, chars, total
            ids, upto = self._encode(held, np.array(last))
            found.append(ids)
            ends.append(total + upto[np.array(last)])
            total += len(ids)
            held, last, chars = [], [], 0

        for text in texts:
            text, begin = text or "", 0
            while True:
                end = len(text)
                if end - begin > CHARS_AT_ONCE:  # cut at white space
                    gap = GAP.search(text, begin + CHARS_AT_ONCE)
                    end = gap.start() if gap else end
                held.append(text[begin:end])
                last.append(end == len(text))
                chars += end - begin
                if chars >= CHARS_AT_ONCE:
                    flush()
                if end == len(text):
                    break
                begin = end
        if held:
            flush()
        return np.concatenate(found), np.concatenate(ends)


GAP = re.compile("[\t-\r ]")


@functools.lru_cache(maxsize=2)
def tokenizer_of(path: str, end_id: int) -> BulkTokenizer:
    """A worker's tokenizer: later tasks of the same worker find the words that earlier ones met."""
    return BulkTokenizer(path, end_id)


def _portions(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with texts of about BYTES_AT_ONCE bytes, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BYTES_AT_ONCE, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def _ranks(length: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The number of each row among those of its length, counted on in `seen`."""
    order = np.argsort(length, kind="stable")
    own = length[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    n = np.diff(np.r_[first, len(own)])
    ranks = np.empty(len(own), np.int64)
    ranks[order] = np.arange(len(own)) - np.repeat(first, n) + seen[own]
    seen[own[first]] += n
    return ranks


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text: str = "text", numbered: tuple[str, str] | None = None) -> DataFrame:
    """Pieces of at most `capacity` ids: id column, piece, start, length, ids (binary, little-endian uint32).

    A document is its ids and then end_id, so a null or empty text is end_id alone. Only
    longer documents are cut; the last piece may be shorter. Repeated rows, null ids and
    ids of any type are carried along, other columns are left out; an empty table gives no
    rows. numbered: names of two more columns, the task and a piece's number among those of
    its length in the task, so that pack() need not count them.
    """
    source = docs.select(docs[id_col].alias("id"), docs[text].alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer, own, seen = tokenizer_of(tokenizer_path, end_id), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for part in (p for batch in batches for rows in parts([batch], 256) for p in _portions(rows, 1)):
            ids, ends = tokenizer.encode(part.column(1).to_pylist())
            begins = np.r_[0, ends[:-1]]
            n = -(-(ends - begins) // capacity)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = begins[row] + piece * capacity
            upto = np.minimum(at + capacity, ends[row])
            offsets, data = pa.py_buffer((4 * np.r_[at, ends[-1]]).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))
            columns = [part.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(upto - at), pa.Array.from_buffers(pa.binary(), len(row), [None, offsets, data])]
            if numbered:
                columns += [pa.array(np.full(len(row), own, np.int32)), pa.array(_ranks(upto - at, seen))]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "piece", "start", "length", "ids", *(numbered or ())])

    return source.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids binary" + (f", `{numbered[0]}` int, `{numbered[1]}` long" if numbered else ""))


@dataclass(frozen=True)
class Slots:
    """Pieces `first`.. of one length: `each` of them lie side by side, from `offset`, in every sequence from `sequence` on."""

    length: int
    first: int
    sequence: int
    each: int
    offset: int


def plan(counts: dict[int, int], capacity: int = 2048) -> tuple[list[Slots], int]:
    """Best-fit decreasing over counts: the slots of all pieces, and the number of sequences.

    Sequences of one filling are a range of numbers, and all of them that a length fits take
    their pieces at once. So the time and the plan depend on the distinct lengths and
    fillings, at most `capacity` each, and not on the number of pieces.
    """
    slots: list[Slots] = []
    open_: dict[int, list[tuple[int, int]]] = {}  # room -> ranges (first sequence, how many)
    rooms: list[int] = []
    made = 0

    def add(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in open_:
                open_[room] = []
                bisect.insort(rooms, room)
            open_[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, first = capacity, made
                n = -(-left // (capacity // length))
                made += n
            each = room // length
            full = min(n, left // each)
            if full:
                slots.append(Slots(length, rank, first, each, capacity - room))
                add(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:  # fewer than fill one more
                slots.append(Slots(length, rank, first + full, left, capacity - room))
                add(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            add(room, first + full, n - full)
    return slots, made


def _numbered(pieces: DataFrame, part: str, nth: str, capacity: int) -> DataFrame:
    """Numbers the rows of each length within each partition."""
    at = pieces.columns.index("length")
    schema = pieces.select("*", F.lit(0).alias(part), F.lit(0).cast("long").alias(nth)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            if batch.num_rows:
                ranks = _ranks(batch.column(at).to_numpy(zero_copy_only=False), seen)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(ranks), own, np.int32)), pa.array(ranks)], [*batch.schema.names, part, nth])

    return pieces.mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = 2048, numbered: tuple[str, str] | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces that have a length of 1 to capacity.

    Other columns are carried along, but for those that `numbered` names: tokenize()'s numbers
    within (task, length), which are counted here otherwise. Pieces are stored once with them;
    the histogram, at most `capacity` rows, is planned on the driver. A piece's rank within
    its length is its number plus the counts of earlier tasks, so that a length with most of
    the rows is ranked in as many tasks as the input has. The counts, a row for each task and length, are
    broadcast up to COUNT_ROWS of them and joined beyond. Pieces of one length are
    interchangeable: ties are settled by the order of the rows. Rows without a length from 1
    to capacity are an error. Clashing columns sequence_id and offset are replaced; an empty table gives no rows.
    """
    pieces = pieces.drop("sequence_id", "offset")
    checked = pieces.withColumn("length", F.when(F.col("length").between(1, capacity), F.col("length")).otherwise(F.raise_error(F.lit("length out of range")).cast("long")))
    part, nth = numbered or (free_name(pieces, "part"), free_name(pieces, "nth"))
    pieces = pieces.drop(part, nth)
    names = pieces.columns
    kept = store(checked if numbered else _numbered(checked, part, nth, capacity), "pieces")
    counts = store(kept.groupBy("length", part).agg(F.count("*").alias("n")), "counts")
    slots, _ = plan({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base_"))
    bases = F.broadcast(bases) if counts.count() <= COUNT_ROWS else bases
    ranked = kept.join(bases, ["length", part]).select(*names, (F.col(nth) + F.col("base_")).alias("rank_"))
    if not slots:
        return ranked.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    length, first, sequence, each, offset = (np.array(x, np.int64) for x in zip(*((s.length, s.first, s.sequence, s.each, s.offset) for s in slots), strict=True))
    order = np.lexsort((first, length))
    length, first, sequence, each, offset = (x[order] for x in (length, first, sequence, each, offset))
    begins = np.searchsorted(length, np.arange(capacity + 2))
    at = names.index("length")
    schema = pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (at, len(names)))
            slot = np.empty(len(n), np.int64)
            for x in np.unique(n):
                own = n == x
                slot[own] = begins[x] + np.searchsorted(first[begins[x] : begins[x + 1]], rank[own], side="right") - 1
            inside = rank - first[slot]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence[slot] + inside // each[slot]), pa.array(offset[slot] + inside % each[slot] * n)], [*names, "sequence_id", "offset"]
            )

    return ranked.mapInArrow(run, schema)
