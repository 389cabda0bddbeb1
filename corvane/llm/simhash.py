"""SimHash fingerprints and a hierarchical index over their Gray order."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, parallel, parts, text_source
from .components import connected_components

SEED = 42
FAN_OUT = 8
QUERIES_AT_ONCE, OPEN = 1 << 15, 1 << 19


def fingerprint(text: str | None, words_each: int = 3, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 without words.

    A-Z are lower-cased, words are runs other than space and bytes 9 to 13. Fewer words
    than a shingle has make one shingle. A bit is set if it is set in over half the hashes.
    """
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    hashed, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= words_each:
        hashes = [hashed(join(words), seed)]
    else:
        hashes = [hashed(join(s), seed) for s in zip(*(words[i:] for i in range(words_each)), strict=False)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        block = np.array(hashes[at : at + (1 << 14)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", words_each: int = 3, out: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """Adds the fingerprint as a long (the 64 bits, two's complement); keep: columns that stay."""
    keep = docs.columns if keep is None else keep
    source, at = text_source(docs, keep, text)
    schema = docs.select(*[docs[c] for c in keep], F.lit(0).cast("long").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            fps = np.fromiter((fingerprint(t, words_each) for t in batch.column(at).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(fps.view(np.int64))], [*keep, out])

    return source.mapInArrow(run, schema)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence: neighbours there differ in one bit."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of nodes over codes sorted by (key, Gray rank); no node spans two keys.

    A node holds the bits that all codes below it share (mask) and their values (pattern).
    A child's mask is counted only where its parent's is open, so that differences add up
    on the way down and a whole group is left as soon as they exceed the radius.
    """

    def __init__(self, keys: np.ndarray, codes: np.ndarray):
        order = np.lexsort((gray_rank(codes), keys))
        self.order, self.keys, self.codes = order, keys[order], codes[order]
        ones = zeros = self.codes
        owner, self.levels, self.spans = self.keys, [], []
        while True:
            first = np.r_[True, owner[1:] != owner[:-1]]
            within = np.arange(len(owner)) - np.maximum.accumulate(np.where(first, np.arange(len(owner)), 0))
            starts = np.flatnonzero(first | (within % FAN_OUT == 0))
            ends = np.r_[starts[1:], len(owner)]
            ones, zeros = np.bitwise_and.reduceat(ones, starts), np.bitwise_or.reduceat(zeros, starts)
            owner = owner[starts]
            self.levels.append((~(ones ^ zeros), ones))
            self.spans.append((starts, ends))
            if (np.diff(owner) != 0).all():
                break
        self.root_of = np.searchsorted(owner, self.keys)

    def pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Positions (i < j, in sorted order) and distances of codes of one key within the radius.

        Queries that open more than OPEN nodes at a level are halved, so that memory doesn't
        grow with the density of a key.
        """
        for at in range(0, len(self.codes), QUERIES_AT_ONCE):
            query = np.arange(at, min(at + QUERIES_AT_ONCE, len(self.codes)))
            node = self.root_of[query]
            mask, ones = self.levels[-1]
            spent = np.bitwise_count((self.codes[query] ^ ones[node]) & mask[node]).astype(np.int16)
            waiting = [(len(self.levels) - 1, query, node, spent)]
            while waiting:
                level, query, node, spent = waiting.pop()
                ok = spent <= radius
                query, node, spent = query[ok], node[ok], spent[ok]
                starts, ends = self.spans[level]
                n = ends[node] - starts[node]
                if n.sum() > OPEN and len(query) > 1:
                    half = len(query) // 2
                    waiting += [(level, query[half:], node[half:], spent[half:]), (level, query[:half], node[:half], spent[:half])]
                    continue
                above = self.levels[level][0][node]
                child = np.repeat(starts[node] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                query, spent, above = np.repeat(query, n), np.repeat(spent, n), np.repeat(above, n)
                if level:
                    mask, ones = self.levels[level - 1]
                    more = (self.codes[query] ^ ones[child]) & mask[child] & ~above
                    waiting.append((level - 1, query, child, spent + np.bitwise_count(more)))
                    continue
                ahead = child > query
                query, child, spent, above = query[ahead], child[ahead], spent[ahead], above[ahead]
                spent = spent + np.bitwise_count((self.codes[query] ^ self.codes[child]) & ~above)
                ok = spent <= radius
                yield query[ok], child[ok], spent[ok]


def _forest(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest position reachable from each position, given those reachable without these links."""
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        np.minimum.at(root, before[left], low)
        np.minimum.at(root, before[right], low)
        root = root[root]
        if (root == before).all():
            return root


def _masks(radius: int) -> list[int]:
    """Bit masks of which two codes within the radius agree on at least one.

    The 64 bits fall into radius + 1 blocks: one of them agrees. The rest falls into
    radius + 1 parts: one of these agrees as well.
    """
    bits = list(range(64))
    cut = lambda x, n: [x[i * len(x) // n : (i + 1) * len(x) // n] for i in range(n)]
    masks = []
    for block in cut(bits, radius + 1):
        for part in cut([b for b in bits if b not in block], radius + 1):
            masks.append(sum(1 << b for b in block + part))
    return masks


def wide_masks(radius: int) -> list[int]:
    """Fewer and shorter masks for a larger radius: of radius + 2 blocks, two codes within it agree on two."""
    blocks = [sum(1 << b for b in range(i * 64 // (radius + 2), (i + 1) * 64 // (radius + 2))) for i in range(radius + 2)]
    return [a | b for a, b in combinations(blocks, 2)]


def _linked(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, codes = np.empty(0, np.int64), np.empty(0, np.uint64)

        def links(keys: np.ndarray, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(keys):
                return
            index = GrayIndex(keys, codes)
            root = np.arange(len(keys))
            for i, j, _ in index.pairs(radius):
                root = _forest(root, i, j)
            moved = np.flatnonzero(root != np.arange(len(keys)))
            if len(moved):
                own = index.codes.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own[root[moved]]), pa.array(own[moved])], ["a", "b"])

        for batch in batches:  # sorted by key: all but the last key's rows are complete
            keys = np.r_[keys, batch.column(0).to_numpy(zero_copy_only=False)]
            codes = np.r_[codes, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
            done = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if done > 1 << 16:
                yield from links(keys[:done], codes[:done])
                keys, codes = keys[done:], codes[done:]
        yield from links(keys, codes)

    return run


def fingerprint_links(fps: DataFrame, radius: int = 2, col: str = "fp", masks: list[int] | None = None) -> DataFrame:
    """Rows (a, b) of different fingerprints; two within the radius are connected by them.

    masks: other bit masks than the usual ones, of which two codes within the radius agree on one.

    Each distinct code goes to the partition of every mask it must share with a partner,
    where a Gray index finds the pairs. Of a partition's links a spanning forest is kept,
    so that a dense group costs one row a code. Null codes are ignored.
    """
    distinct = fps.select(F.col(col).cast("long").alias("code")).dropna().distinct()
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("code").bitwiseAND(F.lit(signed(m)).cast("long"))) for i, m in enumerate(masks or _masks(radius))])
    dealt = distinct.select(F.explode(keys).alias("key"), "code").repartition(parallel(fps), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_linked(radius), "a long, b long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words_each: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits) and component_id.

    component_id is the smallest id reachable over links of at most `radius` differing bits.
    Equal fingerprints are one node. Null and blank texts have fingerprint zero and link like
    any other. Repeated rows give repeated rows; a null id never is a component's id unless
    the component has no other. An empty table gives no rows.
    """
    prints = Stored(with_fingerprint(docs, text, words_each, "fp", [id_col]), "fingerprints").df
    groups = Stored(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "groups").df
    roots = connected_components(fingerprint_links(groups, radius))
    named = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_code = named.join(least, "root").select("fp", "component_id")
    return prints.join(of_code, "fp").select(
        prints[id_col], F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
