"""Groups of near duplicates by SimHash, confirmed by the similarity of their word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, parallel, parts, reclaim, store
from .components import connected_components
from .simhash import SEED, fingerprint_links, wide_masks

#: Documents among which common shingles are counted, how many of these make a shingle common, and how many shingles are kept.
SAMPLE = 10_000
COMMON_DOCS = 5
COMMON = 100_000
#: Bits of a set's parities, or the next power of two from its size on: sets have at least as many different shingles as their parities have different bits.
BITS = 1024
#: Digests of sets that a task remembers, so as to send each set's keys once.
KEPT_SETS = 1 << 19
#: Members of a meeting that are compared in one place, about.
BLOCK, STRIPE = 256, 4096
SALTS = 64
#: Differing bits up to which fingerprints are searched: from the one to the other, by how many fingerprints a mask may bring together on average.
RADIUS, MOST_RADIUS = 2, 8
CODES = 64


def shingles(text: str | None, words_each: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; fewer words make one shingle, none make none."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashed, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= words_each:
        return np.array([hashed(join(words), SEED)], np.uint64)
    return np.unique(np.fromiter((hashed(join(s), SEED) for s in zip(*(words[i:] for i in range(words_each)), strict=False)), np.uint64))


def simhash_of(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def prefix_keys(hashes: np.ndarray, similarity: float, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of which two sets of at least this Jaccard similarity share one, as signed numbers: rare ones and common ones.

    Such a pair has at least similarity * n shingles in common, so that in any one order of
    all shingles the first n - ceil(similarity * n) + 1 of both sets meet. The order puts common
    shingles last, whichever those are: they only decide how many others a set meets.
    """
    n = len(hashes)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    last = common[np.searchsorted(common[:-1], hashes)] == hashes if len(common) else np.zeros(n, bool)
    most = n - int(np.ceil(similarity * n - 1e-9)) + 1
    rare = hashes[~last][:most]
    return rare.view(np.int64), hashes[last][: most - len(rare)].view(np.int64)


def _shingle_rows(words_each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            for text in part.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text, words_each).view(np.int64))], ["shingle"])

    return run


def common_shingles(rows: DataFrame, words_each: int) -> np.ndarray:
    """The shingles that occur most often in about SAMPLE documents, at most COMMON of them."""
    every = max(1, rows.count() // SAMPLE)
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("text")
    counts = sample.mapInArrow(_shingle_rows(words_each), "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON_DOCS)
    found = counts.orderBy(F.desc("n"), "shingle").limit(COMMON).select("shingle").toArrow()
    return np.sort(found.column(0).to_numpy().astype(np.int64).view(np.uint64))


def parities(hashes: np.ndarray) -> bytes:
    """For each residue modulo a power of two, whether the number of the set's shingles is odd."""
    bits = max(BITS, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else BITS
    return np.packbits(np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(bits: bytes, size: int = BITS // 8) -> bytes:
    """Parities for residues modulo a smaller power of two, of so many bytes."""
    if len(bits) == size:
        return bits
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, size), axis=0).tobytes()


def _digests(words_each: int, similarity: float, common: np.ndarray):
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, none = set(), np.empty(0, np.int64)
        for part in parts(batches):
            whole, prints, sizes, bits, rare, often = [], [], [], [], [], []
            for text in part.column(1).to_pylist():
                h = shingles(text, words_each)
                digest = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
                keys = (none, none) if digest in seen else prefix_keys(h, similarity, common)
                if len(seen) < KEPT_SETS:
                    seen.add(digest)
                whole.append(digest)
                prints.append(simhash_of(h))
                sizes.append(len(h))
                bits.append(parities(h))
                rare.append(keys[0])
                often.append(keys[1])
            kind = pa.list_(pa.int64())
            short = pa.array(np.frombuffer(b"".join(whole), "<i8")[::2].copy())
            columns = [part.column(0), part.column(2), pa.array(whole, pa.binary()), short, pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), pa.array(rare, kind), pa.array(often, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "version", "whole", "set", "fp", "size", "bits", "rare", "often"])

    return run


def search_radius(n: int) -> int:
    """The largest radius, within bounds, whose masks leave at most CODES of n fingerprints in one place on average."""
    fit = [r for r in range(RADIUS + 1, MOST_RADIUS + 1) if n <= CODES << min(m.bit_count() for m in wide_masks(r))]
    return max(fit, default=RADIUS)


def _near_prints(unique: DataFrame) -> DataFrame:
    """Pairs (a, b) of documents whose fingerprints are connected by links within the search radius.

    Of its links each fingerprint keeps two, to the nearest and to the smallest other one, so that a
    dense group has two pairs a member; documents of one fingerprint are paired with the smallest id among them.
    """
    radius = search_radius(unique.count())
    codes = store(unique.groupBy("fp").agg(F.min("id").alias("least")), "codes")
    links = fingerprint_links(codes, radius, "fp", wide_masks(radius) if radius > RADIUS else None)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    far = F.struct(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("far"), "b")
    kept = both.groupBy("a").agg(F.array(F.min(far)["b"], F.min("b")).alias("others")).select(F.col("a").alias("fp"), F.explode("others").alias("other"))
    named = kept.join(codes, "fp").select("least", F.col("other").alias("fp")).join(codes.withColumnRenamed("least", "id"), "fp").select("least", "id")
    same = unique.join(codes, "fp").filter("id <> least").select("least", "id")
    return named.unionByName(same).select(F.least("least", "id").alias("a"), F.greatest("least", "id").alias("b")).distinct()


def _meetings(prints: DataFrame) -> DataFrame:
    """Rows (key, set): sets that share a prefix shingle share a key, and no more keys than there are different meetings.

    A meeting is named by its extreme members, so that shingles with the same sets are one, and
    those with the same extremes may be. Common shingles, which may have a third of all rows, are
    aggregated first and met in a join that can be split; others have no more rows than a sample let pass.
    """
    other = F.xxhash64(F.lit("other"), "set")
    ends = {"a": F.min("set"), "b": F.max("set"), "c": F.min(other), "d": F.max(other)}
    rare = prints.select(F.explode("rare").alias("shingle"), "set")
    key = Window.partitionBy("shingle")
    met = rare.select("set", *[x.over(key).alias(c) for c, x in ends.items()])
    often = prints.select(F.explode("often").alias("shingle"), "set")
    named = often.groupBy("shingle").agg(*[x.alias(c) for c, x in ends.items()]).filter("a <> b")
    met = met.unionByName(often.join(named, "shingle").select("set", *ends))
    return met.filter("a <> b").select(F.xxhash64(*ends).alias("key"), "set").distinct()


def _confirm(words_each: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            last, own, kept = None, None, []
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if left != last:
                    last, own = left, shingles(left, words_each)
                other = shingles(right, words_each)
                both = len(np.intersect1d(own, other, assume_unique=True))
                kept.append(both >= similarity * (len(own) + len(other) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return run


def _possible(similarity: float):
    """Of pairs, those whose parities leave the similarity possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1 << 12):
            differ = []
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                size = min(len(left), len(right))
                differ.append((int.from_bytes(folded(left, size), "little") ^ int.from_bytes(folded(right, size), "little")).bit_count())
            most = batch.column(4).to_numpy() * ((1 - similarity) / (1 + similarity))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(np.array(differ, np.int64) <= most + 1e-6))

    return run


def _possible_pairs(pairs: DataFrame, unique: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b), those whose sizes and parities leave the similarity possible."""
    size = [unique.select(F.col("id").alias(x), F.col("size").alias(f"{x}_size")) for x in ("a", "b")]
    fit = pairs.join(size[0], "a").join(size[1], "b").filter(F.least("a_size", "b_size") >= similarity * F.greatest("a_size", "b_size") - 1e-6)
    bits = [unique.select(F.col("id").alias(x), F.col("bits").alias(f"{x}_bits")) for x in ("a", "b")]
    both = fit.join(bits[0], "a").join(bits[1], "b")
    return both.select("a", "b", "a_bits", "b_bits", (F.col("a_size") + F.col("b_size")).alias("sizes")).mapInArrow(_possible(similarity), "a long, b long")


def _confirmed(rows: DataFrame, unique: DataFrame, pairs: DataFrame, words_each: int, similarity: float) -> DataFrame:
    """Of pairs (a, b), those with the similarity."""
    wanted = unique.select("id", "version").join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi")
    texts = rows.join(wanted, ["id", "version"], "left_semi").dropDuplicates(["id"]).select("id", "text")
    texts = store(texts, "texts")
    left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("left")), texts.select(F.col("id").alias("b"), F.col("text").alias("right"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return both.mapInArrow(_confirm(words_each, similarity), "a long, b long")


def _compared(similarity: float):
    """Of rows (key, block, stripe, theirs, id, size, root, main, bits), each block's own first: the pairs of one of these and another
    member of a different root whose sizes and parities leave the similarity possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, None  # the block's own members, and whose they are
        for batch in batches:
            place = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)], axis=1)
            theirs, ids, size, root, main = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3, 8))
            bits = np.frombuffer(b"".join([folded(x) for x in batch.column(8).to_pylist()]), np.uint64).reshape(-1, BITS // 64)
            begins = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]).any(axis=1)]) if len(ids) else []
            left, right = [], []
            for a, b in zip(begins, [*begins[1:], len(ids)], strict=True):
                if at != tuple(place[a]):
                    held, at = [np.empty(0, np.int64)] * 3 + [bits[:0]], tuple(place[a])
                mine = np.arange(a, b)[~theirs[a:b]]
                held = [np.concatenate([h, x[mine]]) for h, x in zip(held, (ids, size, root, bits), strict=True)]
                other = np.arange(a, b)[theirs[a:b]]
                for i, n, r, own in zip(*held, strict=True):
                    least = np.minimum(size[other], n)
                    near = other[(root[other] != r) & (main[other] | (ids[other] > i)) & (least >= similarity * np.maximum(size[other], n) - 1e-6)]
                    differ = np.bitwise_count(bits[near] ^ own).sum(axis=1, dtype=np.int64)
                    near = near[differ <= (size[near] + n) * ((1 - similarity) / (1 + similarity)) + 1e-6]
                    left.append(np.full(len(near), i))
                    right.append(ids[near])
            left, right = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right))], ["a", "b"])

    return run


def _across(members: DataFrame, unique: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) that meet and have different roots, as far as sizes and parities leave the similarity possible.

    Members of a meeting's largest group are never compared with each other. The others are
    dealt out in blocks, and all members in stripes; a block meets a stripe in one place, where only
    the possible pairs become rows.
    """
    placed = store(members.select("id", "key").join(roots, F.col("id") == F.col("node"), "left").select("id", "key", F.coalesce("root", "id").alias("root")), "placed")
    groups = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    open_ = groups.groupBy("key").agg(F.count("*").alias("groups"), F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n")).filter("groups > 1")
    open_ = open_.select("key", F.col("top.root").alias("largest"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).alias("blocks"), F.ceil(F.col("n") / STRIPE).alias("stripes"))
    met = placed.join(open_, "key").join(unique.select("id", "size", "bits"), "id").withColumn("main", F.col("root") == F.col("largest"))
    spot = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id"), F.col(n))
    all_ = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rest = ["id", "size", "root", "main", "bits"]
    mine = met.filter("not main").select("key", spot("block", "blocks").alias("block"), all_("stripes").alias("stripe"), F.lit(False).alias("theirs"), *rest)
    theirs = met.select("key", all_("blocks").alias("block"), spot("stripe", "stripes").alias("stripe"), F.lit(True).alias("theirs"), *rest)
    where = ["key", "block", "stripe"]
    dealt = mine.unionByName(theirs).repartition(parallel(members), *where).sortWithinPartitions(*where, "theirs")
    return dealt.mapInArrow(_compared(similarity), "a long, b long").distinct()


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words_each: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows (id, component_id) of all documents: component_id is the smallest id of the group.

    Documents with equal sets of word shingles are one from the start. The others are searched by
    their SimHash fingerprints, as in `simhash`: under shared bit masks in a Gray-ordered index, up to the radius that is
    selective for so many. Similar texts whose fingerprints differ in more bits, as they may, are the rest: they meet at
    the shingles of their prefixes, as every pair of the least similarity does, and are compared as far as
    the fingerprints haven't joined them.

    There each member is first compared with two: the smallest id, and the one nearest to the majority of the
    meeting's SimHash bits, which is the text that the others were made from if there is one; that
    costs two links a member, whatever the meeting's size. Where a meeting's members are of several groups
    after that, all its pairs of different groups are compared in blocks, and those whose sizes and parities leave
    the similarity possible by their texts. Links count if the sets' Jaccard similarity is at least `similarity`; the
    groups are the connected components of all such links, whatever the radius.

    Ids are integers; rows with a null id are left out, rows with one id are one document (the
    text of the least digest). Null and blank texts have no shingles, equal ones, and form one group.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("version")).filter("id is not null")
    schema = "id long, version long, whole binary, set long, fp long, size long, bits binary, rare array<long>, often array<long>"
    stored = Stored(rows.mapInArrow(_digests(words_each, similarity, common_shingles(rows, words_each)), schema), "prints")
    prints = stored.df
    own = prints.groupBy("id").agg(F.min(F.struct("whole", "version")).alias("own")).select("id", "own.whole", "own.version")
    alike = own.groupBy("whole").agg(F.min("id").alias("head"))
    heads = store(own.join(alike, "whole").select("id", "head", "whole", "version"), "heads")
    first = ["id", "version", "whole"]
    unique = prints.select(*first, "set", "fp", "size", "bits").join(heads.filter("id = head").select(*first), first).dropDuplicates(["id"])  # equal rows
    unique = store(unique.drop("whole"), "unique")
    meetings = store(_meetings(prints), "meetings")
    stored.drop()
    reclaim(docs.sparkSession)
    near = store(_possible_pairs(_near_prints(unique), unique, similarity), "near")
    reclaim(docs.sparkSession)
    known = connected_components(_confirmed(rows, unique, near, words_each, similarity))
    reclaim(docs.sparkSession)
    rooted = unique.join(known, unique["id"] == known["node"], "left").select("set", "id", "fp", "size", F.coalesce("root", "id").alias("root"))
    members = store(meetings.join(rooted, "set").select("key", "id", "fp", "size", "root"), "members")
    ones = [F.sum(F.shiftrightunsigned("fp", k).bitwiseAND(F.lit(1))).alias(f"b{k}") for k in range(64)]
    majority = sum((F.shiftleft((F.col(f"b{k}") * 2 > F.col("m")).cast("long"), k) for k in range(1, 64)), (F.col("b0") * 2 > F.col("m")).cast("long"))
    ends = [F.count("*").alias("m"), F.min(F.struct("id", "root")).alias("least"), F.min("root").alias("low"), F.max("root").alias("high")]
    centres = members.groupBy("key").agg(*ends, *ones).filter("low <> high").select("key", "least", majority.alias("centre"))
    met = members.join(centres, "key")
    far = F.struct(F.bit_count(F.col("fp").bitwiseXOR(F.col("centre"))).alias("far"), F.struct("id", "root").alias("member"))
    # A large meeting in many tasks: with an exchange after it, the join above can be split.
    salted = met.withColumn("salt", F.pmod("id", F.lit(SALTS))).repartition(parallel(docs), "key", "salt")
    dealt = salted.groupBy("key", "salt").agg(F.min(far).alias("near"))
    nearest = dealt.groupBy("key").agg(F.min("near")["member"].alias("middle"))
    links = met.join(nearest, "key").select("id", "root", F.explode(F.array("least", "middle")).alias("other")).filter("root <> other.root")
    pairs = links.select(F.least("id", "other.id").alias("a"), F.greatest("id", "other.id").alias("b")).distinct()
    pairs = store(_possible_pairs(pairs, unique, similarity), "pairs")
    reclaim(docs.sparkSession)
    linked = lambda roots: roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    edges = store(_confirmed(rows, unique, pairs, words_each, similarity).unionByName(linked(known)), "edges")
    reclaim(docs.sparkSession)
    roots = connected_components(edges)
    further = store(_across(members, unique, roots, similarity).join(pairs, ["a", "b"], "left_anti"), "further")
    reclaim(docs.sparkSession)
    further = store(_possible_pairs(further, unique, similarity), "further")
    more = _confirmed(rows, unique, further, words_each, similarity)
    edges = store(more.unionByName(linked(roots)), "edges")
    reclaim(docs.sparkSession)
    roots = connected_components(edges)
    return heads.join(roots, heads["head"] == roots["node"], "left").groupBy("id").agg(F.min(F.coalesce("root", "head")).alias("component_id"))
