import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import components, neardup, simhash

from .cases import documents, frame


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots_of(keys, linked):
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def test_simhash_components(spark):
    rows = documents()
    found = simhash.simhash_components(frame(spark, rows).selectExpr("*", "doc_id as fp", "doc_id as least", "text as root")).collect()
    assert len(found) == len(rows)
    prints = {r[0]: plain_fingerprint(r[1]) for r in rows}
    roots = roots_of(sorted(prints), [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    for r in found:
        assert (int(r.fingerprint, 16), r.component_id) == (prints[r.doc_id], roots[r.doc_id])
        assert len(r.fingerprint) == 16


def test_empty_table(spark):
    assert simhash.simhash_components(frame(spark, [])).collect() == []
    assert neardup.near_duplicate_groups(frame(spark, [])).collect() == []


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 63), st.integers(0, 63)), min_size=1, max_size=120), st.integers(0, 4))
def test_gray_index(made, radius):
    keys = np.array([m[0] for m in made], np.int64)
    codes = np.array([(1 << m[1]) | (1 << m[2]) for m in made], np.uint64)
    index = simhash.GrayIndex(keys, codes)
    found = {(int(i), int(j)) for a, b, _ in index.pairs(radius) for i, j in zip(a, b, strict=True)}
    k, c = index.keys, index.codes
    assert found == {(i, j) for i in range(len(k)) for j in range(i + 1, len(k)) if k[i] == k[j] and int(c[i] ^ c[j]).bit_count() <= radius}


def test_masks_meet():
    rng = np.random.default_rng(0)
    masks = simhash._masks(2)
    for _ in range(300):
        a, flips = int(rng.integers(0, 1 << 62)), rng.integers(0, 64, 2)
        b = a ^ (1 << int(flips[0])) ^ (1 << int(flips[1]))
        assert any(a & m == b & m for m in masks)


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (102, 101), (200, 200), (7, 3), (7, 3)]
    found = {r.node: r.root for r in components.connected_components(spark.createDataFrame([*edges, (None, 5)], "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(21), 0), 100: 100, 101: 100, 102: 100}


def test_near_duplicate_groups(spark):
    rows = documents()
    sets = {r[0]: frozenset(neardup.shingles(r[1], 5).tolist()) for r in rows}
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    roots = roots_of(sorted(sets), [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])])
    found = {r.id: r.component_id for r in neardup.near_duplicate_groups(frame(spark, rows)).collect()}
    assert found.keys() == sets.keys()
    assert found == roots


def test_similar_sets_share_a_key():
    rng = np.random.default_rng(4)
    common = np.sort(rng.integers(0, 1 << 63, 2000).astype(np.uint64))
    for n in [*range(1, 60), 200, 1000]:
        own = np.unique(np.concatenate([rng.integers(0, 1 << 63, n).astype(np.uint64), rng.choice(common, n // 3)]))
        other = np.sort(np.concatenate([own[rng.permutation(len(own))[: -(-8 * len(own) // 10)]], rng.integers(0, 1 << 63, n).astype(np.uint64)]))
        while len(other) and len(np.intersect1d(own, other)) < 0.8 * len(np.union1d(own, other)):
            strange = np.setdiff1d(other, own)
            other = other[other != strange[0]]
        a, b = (set(np.concatenate(neardup.prefix_keys(x, 0.8, common)).tolist()) for x in (own, other))
        assert a & b, n
    assert [len(x) for x in neardup.prefix_keys(np.empty(0, np.uint64), 0.8, common)] == [0, 0]


def test_parities_bound_the_difference():
    rng = np.random.default_rng(6)
    for n in (0, 1, 900, 1024, 1025, 3000, 9000):
        own = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for m in (0, 5, n // 4, n):
            other = np.unique(np.concatenate([own[m:], rng.integers(0, 1 << 63, m).astype(np.uint64)]))
            a, b = neardup.parities(own), neardup.parities(other)
            size = min(len(a), len(b))
            bits = [int.from_bytes(neardup.folded(x, size), "little") for x in (a, b)]
            assert (bits[0] ^ bits[1]).bit_count() <= len(np.setxor1d(own, other))
            assert neardup.folded(a) == neardup.folded(neardup.folded(a, size))


def test_near_duplicates_among_short_texts(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(60):
        words = [f"w{k}x{rng.integers(0, 10**9)}" for _ in range(11 + k // 3)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words, "more"]))]  # six of seven shingles and more
    found = {r.id: r.component_id for r in neardup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: i - i % 2 for i in range(120)}


def mutual_copies(seed):
    """Groups of 100 copies of a text that is not in the table."""
    import random

    rng, rows = random.Random(seed), []
    for n, least, most in ((400, 4, 6), (100, 1, 2), (200, 2, 3)):
        words = [f"w{rng.randrange(10**9)}" for _ in range(n)]
        for _ in range(100):
            own = list(words)
            for _ in range(rng.randint(least, most)):
                own[rng.randrange(n)] = f"x{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(own)))
    return rows


def test_mutual_copies_without_an_original(spark):
    rows = mutual_copies(1)
    sets = {i: frozenset(neardup.shingles(t, 5).tolist()) for i, t in rows}
    roots = roots_of(sorted(sets), [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    found = {r.id: r.component_id for r in neardup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert found == roots
    assert 3 <= len(set(roots.values())) < 150


def test_wide_masks_meet():
    rng = np.random.default_rng(3)
    for radius in range(3, 9):
        masks = simhash.wide_masks(radius)
        for _ in range(300):
            a = int(rng.integers(0, 1 << 62))
            b = a ^ sum(1 << int(k) for k in rng.choice(64, radius, replace=False))
            assert any(a & m == b & m for m in masks)
    assert [neardup.search_radius(n) for n in (0, 10**4, 10**7, 10**11)] == [8, 8, 5, 2]


def test_links_of_a_larger_radius(spark):
    rng = np.random.default_rng(7)
    codes = [int(c) for c in rng.integers(0, 1 << 63, 40)]
    codes += [c ^ sum(1 << int(k) for k in rng.choice(64, 2 + i % 9, replace=False)) for i, c in enumerate(codes)]
    codes = [c - (1 << 64) if c >> 63 else c for c in codes]
    near = [(a, b) for a in codes for b in codes if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 8]
    links = simhash.fingerprint_links(spark.createDataFrame([(c,) for c in codes], "fp long"), 8, masks=simhash.wide_masks(8)).collect()
    assert roots_of(codes, [(r.a, r.b) for r in links]) == roots_of(codes, near)
    assert len(near) >= 28


def edited_copies():
    """Texts with three copies each, of one to nine edits; and copies of whole sets of shingles."""
    import random

    rng, rows = random.Random(2), []
    for k in range(40):
        words = [f"w{rng.randrange(10**9)}" for _ in range(300)]
        rows.append((len(rows), " ".join(words)))
        for edits in (1, 3 + k % 3, 6 + k % 4):
            own = list(words)
            for _ in range(edits):
                own[rng.randrange(300)] = f"x{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(own)))
    return rows


def test_near_duplicates_meet_by_fingerprints(spark, monkeypatch):
    """Without meetings at shingles, similar texts within the search radius are joined, and no others; with them, all similar ones."""
    rows = edited_copies()
    sets = {i: neardup.shingles(t, 5) for i, t in rows}
    prints = {i: neardup.simhash_of(s) for i, s in sets.items()}
    near = {(a, b) for a in sets for b in sets if a < b and (prints[a] ^ prints[b]).bit_count() <= neardup.search_radius(len(rows))}
    sets = {i: frozenset(s.tolist()) for i, s in sets.items()}
    similar = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert 0.2 * len(similar) < len(near & similar) < len(similar)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    groups = lambda: {r.id: r.component_id for r in neardup.near_duplicate_groups(docs).collect()}
    every = roots_of(sorted(sets), similar)
    assert groups() == every
    none = spark.createDataFrame([], "key long, set long")
    monkeypatch.setattr(neardup, "_meetings", lambda prints: none)
    found = groups()
    assert all(every[i] == every[root] for i, root in found.items())
    assert sum(found[a] == found[b] for a, b in near & similar) >= 0.9 * len(near & similar)


def test_near_duplicates_of_the_test_data(spark):
    """All groups that a comparison of all pairs gives, on the driver's documents: recall 1."""
    from collections import Counter

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: neardup.shingles(r.text, 5).tolist() for r in docs.select("doc_id", "text").collect()}
    holders, shared = {}, Counter()
    for i, own in sorted(sets.items()):
        for h in own:
            for j in holders.setdefault(h, []):
                shared[j, i] += 1
            holders[h].append(i)
    empty = [i for i, own in sets.items() if not own]
    linked = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)] + [(empty[0], i) for i in empty[1:]]
    expected = roots_of(sorted(sets), linked)
    assert {r.id: r.component_id for r in neardup.near_duplicate_groups(docs).collect()} == expected
    assert sum(sets[a] != sets[b] for a, b in linked) >= 10  # near ones, not copies alone


def test_simhash_of_the_test_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    prints = {r.doc_id: plain_fingerprint("".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")) for r in docs.select("doc_id", "text").collect()}
    ids, codes = np.array(list(prints)), np.array(list(prints.values()), np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2, 1))
    expected = roots_of(sorted(prints), [(int(ids[a]), int(ids[b])) for a, b in near])
    found = simhash.simhash_components(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == {i: (f"{prints[i]:016x}", expected[i]) for i in prints}


def test_a_dense_key_is_searched_in_bounded_parts(monkeypatch):
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 1 << 9, 2000).astype(np.uint64))
    keys = np.zeros(len(codes), np.int64)
    pairs = lambda: {(int(i), int(j)) for a, b, _ in simhash.GrayIndex(keys, codes).pairs(2) for i, j in zip(a, b, strict=True)}
    whole = pairs()
    monkeypatch.setattr(simhash, "OPEN", 64)
    sizes = [len(a) for a, _, _ in simhash.GrayIndex(keys, codes).pairs(2)]
    assert pairs() == whole
    assert max(sizes) <= 64


def test_stored_tables_are_dropped(spark):
    import os

    from corvane.llm import common

    common.drop_stored(spark)
    common.store(spark.range(3), "some")
    (path,) = common._STORED[spark.sparkContext.applicationId]
    assert os.path.isdir(path.removeprefix("file://"))
    assert common.drop_stored(spark) == 1
    assert not os.path.exists(path.removeprefix("file://"))
