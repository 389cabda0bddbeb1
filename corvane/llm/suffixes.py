"""Exact substring dedup by deep-shallow suffix sorting of content-defined runs."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, parallel, parts, reclaim, store

GRAM = 32
#: Bytes that multikey quicksort orders, eight at a time, before blind tries take over.
SHALLOW = 40
#: Windows that are sorted together, about, once their keys are complete.
WINDOWS_AT_ONCE = 200_000
#: Runs of one anchor beyond which each of their windows is dealt on its own.
HOT = 1000
#: Bits of the two filters that keep anchors without a partner from being shuffled: as many as FILTER_EACH for each anchor
#: that occurs again, within these bounds (128 KB and 32 MB). Beyond, more runs pass them, with the same results.
FILTER_EACH, LEAST_BITS, MOST_BITS = 8, 1 << 20, 1 << 28
SEGMENT = 1 << 19


# Deep-shallow sorting


class BlindTrie:
    """Orders strings of one length by few comparisons: a descent by branching bytes alone, then one comparison with a leaf.

    A node is [depth, {byte: child}], a leaf (string, members).
    """

    def __init__(self):
        self.root = None

    def insert(self, text: bytes, member: int) -> None:
        if self.root is None:
            self.root = (text, [member])
            return
        node, path = self.root, []
        while type(node) is list:
            path.append(node)
            children = node[1]
            node = children.get(text[node[0]]) or next(iter(children.values()))
        if node[0] == text:
            node[1].append(member)
            return
        # The leaf shares the longest prefix with the text: the first difference tells where it branches off.
        differ = int.from_bytes(node[0], "big") ^ int.from_bytes(text, "big")
        depth = len(text) - -(-differ.bit_length() // 8)
        leaf, above = (text, [member]), None
        for inner in path:
            if inner[0] >= depth:
                break
            above = inner
        below = self.root if above is None else above[1].get(text[above[0]])
        if type(below) is list and below[0] == depth:
            below[1][text[depth]] = leaf
            return
        split = [depth, {node[0][depth]: below, text[depth]: leaf}]
        if above is None:
            self.root = split
        else:
            above[1][text[above[0]]] = split

    def leaves(self) -> Iterator[list[int]]:
        """Members of equal strings, in the order of the strings."""
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if type(node) is tuple:
                yield node[1]
            else:
                stack += [child for _, child in sorted(node[1].items(), reverse=True)]


def _thirds(key: np.ndarray, starts: np.ndarray, sizes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """0, 1 or 2: whether each place's key is below, at or above its group's pivot, the median of three of the group's keys."""
    one, two, three = (key[x] for x in (starts, starts + sizes // 2, starts + sizes - 1))
    pivot = np.maximum(np.minimum(one, two), np.minimum(np.maximum(one, two), three))[owner]
    return (key > pivot).astype(np.int64) - (key < pivot) + 1


def deep_shallow(rows: np.ndarray, begins: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows of a byte matrix, and for each place in it whether the row differs from the one before.

    Multikey quicksort, of all groups at a time: a group falls into three by its pivot's next
    eight bytes, and the middle one goes on with the eight after these. Groups that are equal in
    SHALLOW bytes are ordered by blind tries. begins: the first rows of groups that are
    ordered by themselves; all rows are one group otherwise.
    """
    n, width = rows.shape
    shallow = min(SHALLOW, width) // 8
    keys = np.ascontiguousarray(rows[:, : 8 * shallow]).view(">u8").astype(np.uint64).reshape(n, shallow)
    order, new = np.arange(n), np.zeros(n, bool)
    new[np.zeros(min(n, 1), np.int64) if begins is None else begins] = True
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else order
    depth, deep = np.zeros(n, np.int64), []
    active = np.arange(n)
    while len(active):
        own = group[active]
        first = np.r_[True, own[1:] != own[:-1]]
        starts = np.flatnonzero(first)
        sizes = np.diff(np.r_[starts, len(active)])
        owner = np.cumsum(first) - 1
        more = sizes > 1
        down = more & (depth[active[starts]] >= shallow)
        deep.append(active[down[owner]])
        keep = (more & ~down)[owner]
        if not keep.all():
            active = active[keep]
            continue
        key = keys[order[active], depth[active]]
        side = 3 * owner + _thirds(key, starts, sizes, owner)
        moved = np.argsort(side, kind="stable")
        order[active], side = order[active[moved]], side[moved]
        step = np.r_[True, side[1:] != side[:-1]]
        new[active[step]] = True
        group[active] = active[np.maximum.accumulate(np.where(step, np.arange(len(active)), 0))]
        depth[active] += side % 3 == 1
    rest = np.sort(np.concatenate(deep)) if deep else active
    if len(rest):
        firsts = np.flatnonzero(np.r_[True, group[rest][1:] != group[rest][:-1]])
        tails = np.ascontiguousarray(rows[order[rest], 8 * shallow :])
        size, data, members = tails.shape[1], tails.tobytes(), order[rest]
        for a, b in zip(firsts.tolist(), [*firsts[1:].tolist(), len(rest)], strict=True):
            trie = BlindTrie()
            for k in range(a, b):
                trie.insert(data[k * size : (k + 1) * size], k)
            at = int(rest[a])
            for leaf in trie.leaves():
                new[at] = True
                order[at : at + len(leaf)] = members[leaf]
                at += len(leaf)
    return order, new


# Content-defined runs


def runs(data: bytes, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash): runs of windows of `depth` bytes that share their anchor.

    A window's anchor is the leftmost gram of least hash in it, so that equal windows have the
    same anchor at the same place; every window start belongs to one run [start, end).
    """
    starts, ends, hashes = [], [], []
    gram = min(GRAM, 1 << (depth // 2).bit_length() - 1)
    with np.errstate(over="ignore"):
        for base in range(0, len(data) - depth + 1, SEGMENT):
            x = np.frombuffer(data, np.uint8, min(SEGMENT + depth - 1, len(data) - base), base).astype(np.uint64) + np.uint64(1)
            size, factor = 1, np.uint64(0x9E3779B97F4A7C15)
            while size < gram:
                x = x[:-size] * factor + x[size:]
                factor, size = factor * factor, 2 * size
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(29)
            least = x & ~np.uint64(0xFFFFF) | np.arange(len(x), dtype=np.uint64)
            wide, size = depth - gram + 1, 1
            while 2 * size <= wide:
                least, size = np.minimum(least[:-size], least[size:]), 2 * size
            if size < wide:
                least = np.minimum(least[: size - wide], least[wide - size :])
            anchor = (least & np.uint64(0xFFFFF)).astype(np.int64)
            first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            starts.append(first + base)
            ends.append(np.r_[first[1:], len(anchor)] + base)
            hashes.append(x[anchor[first]].view(np.int64))
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def _bytes(value) -> bytes:
    return value.encode("utf-8", "replace") if value else b""


def _batch_runs(batch: pa.RecordBatch, depth: int):
    """Of all rows (id, text): arrays (row, start, end, hash, digest and check of the run's bytes) and the texts."""
    import xxhash

    texts = [_bytes(t) for t in batch.column(1).to_pylist()]
    row, start, end, hashes, digests = [], [], [], [], []
    digest = xxhash.xxh3_128_digest
    for i, data in enumerate(texts):
        if len(data) < depth:
            continue
        s, e, h = runs(data, depth)
        row.append(np.full(len(s), i))
        start.append(s)
        end.append(e)
        hashes.append(h)
        digests.append(np.frombuffer(b"".join([digest(data[a:b]) for a, b in zip(s.tolist(), (e + (depth - 1)).tolist(), strict=True)]), "<i8").reshape(-1, 2))
    if not row:
        return None, texts
    both = np.concatenate(digests)
    return (*map(np.concatenate, (row, start, end, hashes)), np.ascontiguousarray(both[:, 0]), both[:, 1].astype(np.int32)), texts


def _tally(depth: int):
    """(hash, runs, least and greatest digest) of every anchor of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 2048):
            found, _ = _batch_runs(batch, depth)
            if found is None:
                continue
            h, d = found[3], found[4]
            order = np.argsort(h, kind="stable")
            h, d = h[order], d[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            n = np.diff(np.r_[first, len(h)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[first], n, np.minimum.reduceat(d, first), np.maximum.reduceat(d, first))], ["h", "n", "low", "high"])

    return run


def _filter(found: DataFrame, n: int) -> np.ndarray:
    """A bit for every slot that one of n hashes falls into."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (FILTER_EACH * n).bit_length()))
    slot = F.col("h").bitwiseAND(F.lit(bits - 1))
    words = found.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((h & {bits - 1}) % 64 as int))")).alias("bits")).toArrow()
    filter_ = np.zeros(bits // 64, np.int64)
    filter_[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return filter_


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h & (64 * len(bits) - 1)
    return (bits[slot >> 6] >> (slot & 63) & 1).astype(bool)


RUN_SCHEMA = "h long, digest long, check int, id long, at long, n int, done boolean, run binary"
NAMES = ["h", "digest", "check", "id", "at", "n", "done", "run"]


def _candidates(depth: int, repeated, various):
    """Runs whose anchor may occur again; of equal runs in a batch the first goes on, the others are done.

    Runs whose anchor may have different runs carry their bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 2048):
            found, texts = _batch_runs(batch, depth)
            if found is None:
                continue
            keep = _passes(repeated.value, found[3])
            row, start, end, h, d, c = (x[keep] for x in found)
            if not len(row):
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)[row]
            versions = np.array([zlib.crc32(t) for t in texts], np.int64)[row]
            at = (versions - (1 << 31) << 32) | start
            order = np.lexsort((at, ids, c, d, h))
            row, start, end, h, d, c, ids, at = (x[order] for x in (row, start, end, h, d, c, ids, at))
            again = np.r_[False, (h[1:] == h[:-1]) & (d[1:] == d[:-1]) & (c[1:] == c[:-1])]
            first = np.maximum.accumulate(np.where(again, 0, np.arange(len(h))))
            done = again & ((ids != ids[first]) | (at != at[first]))
            wanted = ~done & _passes(various.value, h)
            data = [texts[r][a:b] if w else None for r, a, b, w in zip(row.tolist(), start.tolist(), (end + (depth - 1)).tolist(), wanted.tolist(), strict=True)]
            h = np.where(done, ids * 31 + at, h)  # only to spread them
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (h, d, c, ids, at, (end - start).astype(np.int32), done)), pa.array(data, pa.binary())], NAMES)

    return run


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by (h, digest, check, id, at): all but the first of equal runs are done; firsts go on if they carry bytes."""
    last, first = None, None
    for batch in batches:
        h, d, c, ids, at = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        before = batch.column(6).to_numpy(zero_copy_only=False)
        if not len(h):
            continue
        new = np.r_[last != (h[0], d[0], c[0]), (h[1:] != h[:-1]) | (d[1:] != d[:-1]) | (c[1:] != c[:-1])] | before
        index = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
        first_id = np.where(index >= 0, ids[index], first[0] if first else 0)
        first_at = np.where(index >= 0, at[index], first[1] if first else 0)
        done = before | (ids != first_id) | (at != first_at)
        last, first = (h[-1], d[-1], c[-1]), (first_id[-1], first_at[-1])
        kept = done | (new & np.array([x.is_valid for x in batch.column(7)]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(done), batch.column(7)], NAMES).filter(pa.array(kept))


def _merged(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, at, n): windows at neighbouring places as one."""
    order = np.lexsort((at, ids))
    ids, at = ids[order], at[order]
    start = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (at[1:] != at[:-1] + 1)]) if len(ids) else np.empty(0, np.int64)
    return ids[start], at[start], np.diff(np.r_[start, len(ids)]).astype(np.int32)


WINDOW_SCHEMA = "key long, id long, at long, n int, done boolean, run binary"


def _single_windows(depth: int):
    """Runs of hot anchors as runs of one window, keyed by it; others keyed by their anchor.

    Of equal windows of a batch only the first goes on, the others are done: so a window has
    no more rows than there are batches, however many documents hold it.
    """
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 8192):
            rows, firsts, later = [], {}, []
            for h, i, a, count, bytes_, hot in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not hot:
                    rows.append((h, i, a, count, False, bytes_))
                    continue
                for k in range(count):
                    window, own = bytes_[k : k + depth], (i, a + k)
                    known = firsts.get(window, own)
                    firsts[window] = min(known, own)
                    if known != own:
                        later.append(max(known, own))
            rows += [(xxhash.xxh3_64_intdigest(w) - (1 << 63), i, a, 1, False, w) for w, (i, a) in firsts.items()]
            ids, at, n = _merged(*(np.array(x, np.int64) for x in zip(*later, strict=True))) if later else ((), (), ())
            rows += [(31 * i + a & 0x7FFFFFFF, i, a, k, True, None) for i, a, k in zip(*(x.tolist() for x in (ids, at, n)), strict=True)] if later else []
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            columns = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["key", "id", "at", "n", "done", "run"])

    return run


def _later_windows(depth: int):
    """Rows sorted by key: sorts the windows of complete keys and returns those that occur earlier, as (id, at, n); and the done ones as they are."""

    def later(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        counts = np.array([r[3] for r in rows])
        ids = np.repeat(np.array([r[1] for r in rows], np.int64), counts)
        at = np.repeat(np.array([r[2] for r in rows], np.int64) - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
        lengths = counts + depth - 1
        begins = np.r_[0, np.cumsum(lengths)[:-1]]
        before = np.r_[0, np.cumsum(counts)[:-1]]
        inside = np.repeat(begins - before, counts) + np.arange(counts.sum())
        data = np.frombuffer(b"".join([r[5] for r in rows]), np.uint8)
        keys = np.array([r[0] for r in rows], np.int64)
        order, new = deep_shallow(np.lib.stride_tricks.sliding_window_view(data, depth)[inside], before[np.r_[True, keys[1:] != keys[:-1]]])
        group = np.cumsum(new) - 1
        best = np.lexsort((at[order], ids[order], group))
        head = best[np.r_[True, group[best][1:] != group[best][:-1]]]
        first = order[head][group]
        dup = order[(ids[order] != ids[first]) | (at[order] != at[first])]
        if len(dup):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(ids[dup], at[dup])], ["id", "at", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, windows = [], 0
        for batch in batches:
            done = batch.column(4)
            yield pa.RecordBatch.from_arrays(batch.columns[1:4], ["id", "at", "n"]).filter(done)
            for row in zip(*(c.to_pylist() for c in batch.filter(pc.invert(done)).columns), strict=True):
                if windows >= WINDOWS_AT_ONCE and row[0] != held[-1][0]:
                    yield from later(held)
                    held, windows = [], 0
                held.append(row)
                windows += row[3]
        if held:
            yield from later(held)

    return run


def repeated_windows(rows: DataFrame, depth: int) -> DataFrame:
    """Rows (id long, version int, start int, n int): runs of n window starts whose windows occur earlier.

    rows: (id long, text). First pass: how often every anchor occurs, and whether its runs
    differ. Second: equal runs of one anchor, by 96 bits of their digests; all but the first are repeated
    as a whole. The first of every kind of run then meets the others of its anchor window by
    window, in deep-shallow order. Runs of anchors with more than HOT kinds are dealt by window.
    """
    spark, n_parts = rows.sparkSession, parallel(rows)
    tallied = rows.mapInArrow(_tally(depth), "h long, n int, low long, high long")
    tally = tallied.groupBy("h").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    tally = store(tally.filter("n > 1").select("h", (F.col("low") != F.col("high")).alias("various")), "anchors")
    n_anchors, n_various = tally.agg(F.count("*"), F.count_if("various")).first()
    repeated = spark.sparkContext.broadcast(_filter(tally, n_anchors))
    various = spark.sparkContext.broadcast(_filter(tally.filter("various"), n_various))
    reclaim(spark)
    dealt = rows.mapInArrow(_candidates(depth, repeated, various), RUN_SCHEMA).repartition(n_parts, "h", "digest")
    runs_ = store(dealt.sortWithinPartitions("h", "digest", "check", "id", "at").mapInArrow(_classify, RUN_SCHEMA), "runs")
    reclaim(spark)
    kinds = runs_.filter("not done").select("h", "id", "at", "n", "run")
    counts = kinds.groupBy("h").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("h", (F.col("kinds") > HOT).alias("hot"))
    keyed = kinds.join(counts, "h").select("h", "id", "at", "n", "run", "hot").mapInArrow(_single_windows(depth), WINDOW_SCHEMA)
    sorted_ = keyed.repartition(n_parts, "key").sortWithinPartitions("key")
    windows = store(sorted_.mapInArrow(_later_windows(depth), "id long, at long, n int"), "windows")
    reclaim(spark)
    found = runs_.filter("done").select("id", "at", "n").unionByName(windows)
    return found.select("id", F.shiftright("at", 32).cast("int").alias("version"), F.expr("cast(at & 4294967295 as long)").alias("start"), "n")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", depth: int = 100, keep: list[str] | None = None) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans, spans (start, end) and kept (binary) to the kept columns.

    Removed is every byte in a `depth`-byte string that also starts earlier: in a smaller id,
    or in the same document at an earlier start; strings are judged on the input and never
    cross documents. kept holds the UTF-8 bytes that remain, which may split a character.

    Ids are integers; a null id is the smallest. Null texts are empty, texts shorter than
    depth stay. Of rows with one id but different texts the one of smaller crc32 is earlier; rows
    equal in id and text share their result and aren't repeats of each other. Clashing columns
    are replaced. Copies collapse within a task before they are shuffled, and no group of
    equal anchors, runs or windows is gathered: each is dealt by its own content.
    """
    new = ("n_bytes", "n_removed", "n_spans", "spans", "kept")
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    id_ = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long"))
    found = repeated_windows(docs.select(id_.alias("id"), F.col(text).alias("text")), depth)
    spans = found.groupBy("id", "version").agg(F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("n") + (depth - 1)).alias("end")))).alias("spans_"))
    spans = spans.withColumnsRenamed({"id": "s_id", "version": "s_version"})
    own_id, own_text = free_name(docs, "id_"), free_name(docs, "text_")
    left = docs.select(*keep, id_.alias(own_id), F.col(text).alias(own_text))
    version = (F.crc32(F.coalesce(F.col(own_text), F.lit("")).cast("binary")) - (1 << 31)).cast("int")
    met = left.join(spans, (F.col(own_id) == F.col("s_id")) & (version == F.col("s_version")), "left").select(*keep, own_text, "spans_")
    shape = "array<struct<start:long,end:long>>"
    schema = met.select(*keep, *[F.lit(0).cast("long").alias(c) for c in new[:3]], F.lit(None).cast(shape).alias("spans"), F.lit(b"").alias("kept")).schema
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sizes, merged, left = [], [], []
            for t, own in zip(batch.columns[-2].to_pylist(), batch.columns[-1].to_pylist(), strict=True):
                data, joined, pieces, at = _bytes(t), [], [], 0
                for s in own or ():
                    if joined and s["start"] <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], s["end"])
                    else:
                        joined.append([s["start"], s["end"]])
                for start, end in joined:
                    pieces.append(data[at:start])
                    at = end
                sizes.append(len(data))
                merged.append(joined)
                left.append(b"".join([*pieces, data[at:]]))
            removed = [sum(b - a for a, b in spans) for spans in merged]
            listed = pa.array([[{"start": a, "end": b} for a, b in spans] for spans in merged], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(map(len, merged), pa.int64()), listed, pa.array(left, pa.binary())], [*keep, *new])

    return met.mapInArrow(run, schema)
