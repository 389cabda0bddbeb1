import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import langid, media, packing, pii, quality, queries, suffixes, webp
from corvane.llm.common import is_training

from .cases import documents, frame, prose


# Packing


def brute_best_fit(lengths, capacity):
    rooms, n = [], 0
    for length in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - length)
        else:
            n += 1
            rooms.append(capacity - length)
    return n


@pytest.mark.parametrize("seed", range(8))
def test_plan(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 64) if rng.random() < 0.9 else rng.randint(1, 8) for _ in range(400)]
    counts = {n: lengths.count(n) for n in set(lengths)}
    slots, made = packing.plan(counts, 64)
    assert made == brute_best_fit(lengths, 64)
    filled, seen = {}, {n: [] for n in counts}
    ends = {n: max([s.first for s in slots if s.length == n]) for n in counts}
    for s in slots:
        last = min([t.first for t in slots if t.length == s.length and t.first > s.first], default=counts[s.length])
        for rank in range(s.first, last):
            at = rank - s.first
            filled.setdefault(s.sequence + at // s.each, []).append((s.offset + at % s.each * s.length, s.length))
            seen[s.length].append(rank)
    assert ends.keys() == counts.keys()
    assert all(sorted(v) == list(range(counts[n])) for n, v in seen.items())
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


@pytest.mark.parametrize("count_first", [True, False])
def test_packing(spark, monkeypatch, count_first):
    from tokenizers import Tokenizer

    rows = [r for r in documents() if r[0] != 1]
    rows += [(300, "tab\tand\u00a0space <|endoftext|> isn't É́ 😀", "en", "s", 0)]
    numbers = ("task", "nth") if count_first else None
    monkeypatch.setattr(packing, "COUNT_ROWS", 200_000 if count_first else 0)
    pieces = packing.tokenize(frame(spark, rows), queries.tokenizer_path(), capacity=128, numbered=numbers).withColumn("offset", F.lit("old")).withColumn("part", F.lit("own"))
    packed = packing.pack(pieces, 128, numbered=numbers)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids", "part", "sequence_id", "offset"]
    found = packed.collect()
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.part == "own"
    for doc_id, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        own = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert b"".join(bytes(r.ids) for r in own) == ids
        assert [r.start for r in own] == [128 * r.piece for r in own]
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    assert packing.pack(pieces.limit(0), 128, numbered=numbers).collect() == []


CHARACTERS = ["a", "B", "é", "É", "ß", "×", "÷", "'", "'s", "'LL", "don't", "<|endoftext|>", "<|", "|>", "<", " ", "\n", "\t", "\u00a0", "\u1c89", "\ua7cb", "\ua7da", "Σ", "ς", "ﬁ", "e\u0301", "\u0301", "1", "23", "²", "½", "...", "!?", "-", "\x00", "\x1c", "\x1f", "\x7f", "\u200d", "😀", "日本", "ſ", "İ", "ı", "ÿ", "À", "Þ", "xylophonesextraordinary", "o'clock", "c\u0327", "\u0085", "\ufeff", "\u2126"]


@pytest.mark.parametrize("most,chars", [(packing.KEPT_WORDS, packing.CHARS_AT_ONCE), (40, 25)])
def test_bulk_tokenizer(monkeypatch, most, chars):
    monkeypatch.setattr(packing, "KEPT_WORDS", most)
    monkeypatch.setattr(packing, "CHARS_AT_ONCE", chars)
    bulk, rng = packing.BulkTokenizer(queries.tokenizer_path(), 0), random.Random(7)
    assert bulk.by_word
    for by_word in (True, False):
        bulk.by_word = by_word
        for _ in range(60):
            texts = ["".join(rng.choice(CHARACTERS) for _ in range(rng.randint(0, 40))) for _ in range(20)]
            texts += [None, "", " ", "the and of " * 30, *("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x250), rng.randrange(0x250, 0xD800), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(30)) for _ in range(10))]
            ids, ends = bulk.encode(texts)
            for text, begin, end in zip(texts, [0, *ends[:-1]], ends, strict=True):
                assert ids[begin:end].tolist() == [*bulk.tokenizer.encode(text or "", add_special_tokens=False).ids, 0], text


def test_other_tokenizer_files(tmp_path):
    import public_tokenizers

    assert not packing.BulkTokenizer(public_tokenizers.path("byte_bpe_50k.json"), 0).by_word


# Models


SF = "/root/testdata/sf0.01"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_language_accuracy(spark):
    """Held-out documents as they are, and without any white space."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit_language_model(docs, is_training(F.col("doc_id")))
    packed = docs.withColumn("text", F.regexp_replace("text", r"\s", "")).withColumn("source", F.lit("packed"))
    got = langid.identify_language(docs.unionByName(packed), model).filter("lang is not null").collect()
    for kind in (True, False):
        own = [r.lang_pred == r.lang for r in got if held_out(r.doc_id) and (r.source == "packed") == kind and r.lang_pred != "und"]
        assert len(own) > 300 and sum(own) >= (0.9 if kind else 0.98) * len(own), (kind, sum(own) / len(own))


def labelled(n=300):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        fr = i % 2
        words = [rng.choice(["le", "été", "garçon", "que", "nous"] if fr else ["the", "with", "thing", "of", "who"]) + rng.choice(["", "x", "er"]) for _ in range(rng.randint(3, 40))]
        good = i % 3 > 0
        rows.append((i, " ".join(w if good else w + "%%%" for w in words), ["en", "fr"][fr], "s", 0))
        labels.append((i, int(good)))
    return rows, labels


def test_language(spark):
    rows, _ = labelled()
    extra = [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "12 !? 34", "fr", "s", 0), (903, "é" * 5000, None, None, 0), (904, "the with of who " * 3000, None, None, 0), (904, "the with of who " * 3000, None, None, 0)]
    docs = frame(spark, rows + extra).withColumn("lang_pred", F.lit("old"))
    model = langid.fit_language_model(docs, is_training(F.col("doc_id")))
    found = langid.identify_language(docs, model)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "lang_pred", "score"]
    got = found.collect()
    assert len(got) == len(rows) + len(extra)
    held = [r for r in got if r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id >= 900} == {900: "und", 901: "und", 902: "und", 903: "fr", 904: "en"}
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.fit_language_model(frame(spark, []), is_training(F.col("doc_id"))) is None
    assert {r.lang_pred for r in langid.identify_language(docs.limit(3), None).collect()} == {"und"}


def test_quality_accuracy(spark):
    """Held-out labelled documents of the driver's tables: right, and in the right order."""
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    model = quality.fit_quality(docs, labels, is_training)
    scored = quality.score_quality(docs, model, keep=["doc_id"]).join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id").filter("label is not null")
    rows = [r for r in scored.collect() if held_out(r.doc_id)]
    right = [(r.score >= 0.5) == (r.label == 1) for r in rows]
    good, bad = ([r.score for r in rows if r.label == k] for k in (1, 0))
    assert len(rows) > 60 and len(bad) > 5
    assert sum(right) >= 0.97 * len(right), sum(right) / len(right)
    assert sum(g > b for g in good for b in bad) >= 0.99 * len(good) * len(bad)


def test_empty_tables(spark):
    from corvane.llm import urls

    docs = frame(spark, documents())
    none = docs.limit(0)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    language = langid.fit_language_model(docs, F.lit(True))
    assert langid.identify_language(none, language).count() == 0
    model = quality.fit_quality(docs, labels, lambda c: F.lit(True))
    assert quality.score_quality(none, model).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge_urls(pages, urls.rule_table(spark, queries.URL_RULES), [4, 5]).count() == 0


def test_streams_are_read_whole():
    """Every byte is in one segment, with its neighbours around it."""
    rng = random.Random(2)
    streams = [bytes(rng.randrange(1, 256) for _ in range(n)) for n in (1, 159, 160, 161, 1000)] + [b""]
    x, owner, valid = langid.segments(streams)
    for i, own in enumerate(streams):
        parts = [bytes(row[langid.MARGIN : langid.MARGIN + n]) for row, n in zip(x[owner == i], valid[owner == i], strict=True)]
        assert b"".join(parts) == own
    padded = bytes(langid.MARGIN) + streams[4] + bytes(langid.SEGMENT + langid.MARGIN)
    assert bytes(x[owner == 4][2]) == padded[2 * langid.SEGMENT :][: langid.SEGMENT + 2 * langid.MARGIN]
    model = langid.LanguageModel(["a", "b"], langid.Direction(4, np.random.default_rng(0)), langid.Direction(4, np.random.default_rng(1)), np.random.default_rng(2).normal(size=(8, 2)).astype(np.float32), np.zeros(2, np.float32))
    slow = np.concatenate([model.ahead.forward(x)[0], model.back.forward(x[:, ::-1])[0][::-1]], axis=2) @ model.out
    slow -= np.log(np.exp(slow).sum(axis=2, keepdims=True))
    assert np.abs(model.labels(x) - slow).max() < 1e-4


def test_gradients():
    rng = np.random.default_rng(0)
    unit = langid.Direction(4, rng)
    unit.p = {k: v.astype(np.float64) for k, v in unit.p.items()}
    x = rng.integers(0, 5, (3, 6)).astype(np.uint8)
    weight = rng.normal(size=(6, 3, 4))
    loss = lambda: float((unit.forward(x)[0] * weight).sum())
    grads = unit.backward(x, unit.forward(x)[1], weight)
    for name, value in unit.p.items():
        for _ in range(6):
            at = (int(rng.integers(0, 5 if name == "inputs" else value.shape[0])), int(rng.integers(0, value.shape[1])))
            before = value[at]
            value[at] = before + 1e-4
            up = loss()
            value[at] = before - 1e-4
            down = loss()
            value[at] = before
            assert abs((up - down) / 2e-4 - grads[name][at]) < 1e-2


def test_quality(spark):
    rows, labels = labelled()
    docs = frame(spark, [*rows, (900, None, None, None, 0), (901, "", "en", "s", 0), (902, "a " * 9000, "en", "s", 0)])
    own = spark.createDataFrame([*labels, (5, None), (7, labels[7][1])], "doc_id long, quality int")
    model = quality.fit_quality(docs, own, is_training)
    got = quality.score_quality(docs.withColumn("score", F.lit("old")), model, keep=["doc_id", "score"]).collect()
    truth = dict(labels)
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum((r.score >= 0.5) == (truth[r.doc_id] == 1) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    assert len(got) == len(rows) + 3
    assert quality.fit_quality(docs, own.limit(0), is_training) is None
    assert {r.score for r in quality.score_quality(docs.limit(2), None).collect()} == {0.5}


# Personal data


def test_pseudonyms():
    p = pii.Pseudonyms(b"key")
    card, other = "4111 1111 1111 1111", "5500-0000-0000-0004"
    text, spans = p.text(f"pay {card}, {other}. 4111111111111111 but not 4111111111111112")
    assert [k for k, *_ in spans] == ["card"] * 3
    assert "4111111111111112" in text
    assert card not in text
    digits = ["".join(c for c in x if c.isdigit()) for x in text.replace("pay ", "").split(",")]
    assert digits[0] == p.of("card", "4111111111111111")
    assert pii.luhn_digit(digits[0][:-1]) == digits[0][-1]
    for kind, value in (("ip", "10.0.0.255"), ("ssn", "123-45-6789"), ("date", "2001-02-28"), ("email", "Jo.Smith7@mail.example.com"), ("phone", "+1 (017) 555-7713"), ("iban", "GB82 WEST 1234 5698 7654 32")):
        text, spans = p.text(f"x {value} y")
        assert [(k, a, b) for k, a, b in spans] == [(kind, 2, 2 + len(value))]
        new = text[2:-2]
        assert new != value
        assert p.text(text)[1][0][0] == kind  # still valid
        assert pii.Pseudonyms(b"key").of(kind, value) == new
        assert pii.Pseudonyms(b"other").of(kind, value) != new
    assert p.text("v 1.2.3, 999.1.1.1, 2001-02-30, 000-12-3456, 12-34")[1] == []
    assert p.text("")[0] == ""


def test_numbers_next_to_numbers():
    p = pii.Pseudonyms(b"key")
    card, iban = "4111 1111 1111 1111", "BE68 5390 0754 7034"
    for kind, value, before, after in [
        ("card", "4111111111111111", "", " 12/27"), ("card", card, "", " 123"), ("card", card, "5 ", ""), ("card", card, "12 ", " 12/27"), ("card", card, "77777777 7171 ", ""),
        ("card", "4111-1111-1111-1111", "7 ", " 123"), ("iban", iban, "", " EUR"), ("iban", iban, "", " EURO NOW"), ("iban", "GB82 WEST 1234 5698 7654 32", "", ""),
    ]:
        text, spans = p.text(f"x {before}{value}{after} y")
        assert spans == [(kind, 2 + len(before), 2 + len(before) + len(value))], (before, value, after)
        assert text == f"x {before}{p.of(kind, value)}{after} y"
    for text in ("4111111111111112", "4111 1111 1111 1112", "BE68 5390 0754 7035 EUR"):
        assert p.text(text) == (text, [])
    assert [k for k, *_ in p.text("5 4111 1111 1111 1111 4111 1111 1111 1111 9")[1]] == ["card", "card"]


def test_permutation():
    p = pii.Pseudonyms(b"key")
    for size in (2, 10, 97, 1000):
        assert sorted(p.permute(i, size, "x") for i in range(size)) == list(range(size))


def test_pseudonyms_of_phones_and_addresses():
    p = pii.Pseudonyms(b"k")
    plain = lambda t: "".join(c for c in t if c in "+0123456789")
    for spaced, joined, code in (("+49 30 1234567", "+49301234567", "+49"), ("+1 (743) 555-3824", "+17435553824", "+1"), ("+353 1 234 5678", "+35312345678", "+353")):
        new = [p.text(f"call {t} now")[0][5:-4] for t in (spaced, joined)]
        assert plain(new[0]) == plain(new[1]) != plain(spaced)
        assert plain(new[0]).startswith(code)
        assert [c for c in new[0] if not c.isdigit()] == [c for c in spaced if not c.isdigit()]
    for local in ("日本", "josé", "___", "müller.1"):
        new, spans = p.text(f"an {local}@example.com")
        assert local not in new and new.endswith("@example.com") and [s[0] for s in spans] == ["email"]
    assert p.text("an ann@x.org")[0] != "an ann@x.org"


@pytest.mark.parametrize("form", ["{y:04}-{a:02}-{b:02}", "{a:02}/{b:02}/{y:04}", "{a}/{b}/{y:04}", "{a:02}.{b:02}.{y:04}", "{a}.{b:02}.{y:04}"])
def test_dates_are_permuted_within_their_form(form):
    import datetime

    def real(y, a, b):
        try:
            datetime.date(y, a, b)
            return True
        except ValueError:
            return False

    p, valid = pii.Pseudonyms(b"k"), set()
    pii_years, pii.YEARS = pii.YEARS, range(2015, 2017)
    pii.dates.cache_clear()
    try:
        for y in (2015, 2016):
            for a in range(1, 32):
                for b in range(1, 32):
                    text = form.format(y=y, a=a, b=b)
                    wide = "{a}" in form and a > 9 or "{b}" in form and b > 9
                    if not wide and (real(y, a, b) if form[0:2] == "{y" else real(y, b, a) or "/" in form and real(y, a, b)):
                        valid.add(text)
                    elif not wide:
                        assert p.text(text) == (text, [])
        assert {p.text(t)[0] for t in valid} == valid
    finally:
        pii.YEARS = pii_years
        pii.dates.cache_clear()


def test_detection_by_brute_force():
    """Cards among spaced digits: every valid reading that starts and ends at a separator is found."""
    rng = random.Random(8)
    for _ in range(300):
        groups = ["".join(rng.choice("0123456789") for _ in range(4)) for _ in range(rng.randint(3, 6))]
        if rng.random() < 0.5 and len(groups) > 3:
            body = "".join(groups[:4])[:15]
            groups[:4] = [(body + pii.luhn_digit(body))[i : i + 4] for i in range(0, 16, 4)]
        text = " ".join(groups)
        wanted = any(13 <= len(d := "".join(groups[a:b])) <= 19 and pii.luhn_digit(d[:-1]) == d[-1] and len(set(d)) > 1 for a in range(len(groups)) for b in range(a + 1, len(groups) + 1))
        assert bool(pii.Pseudonyms(b"k").text(text)[1]) == wanted, text


def test_pseudonymize(spark):
    rows = [(1, "a 10.1.2.3", "x"), (2, "10.1.2.3 b", "y"), (3, None, "z"), (4, "", None), (4, "", None), (5, "no " * 9000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii string")
    got = {r.doc_id: r for r in pii.pseudonymize(docs, b"k").collect()}
    assert got[1].text[2:] == got[2].text[:-2] != "10.1.2.3"
    assert [(s.kind, s.start, s.end) for s in got[2].pii] == [("ip", 0, 8)]
    assert (got[3].text, got[3].n_pii, got[4].text, got[5].n_pii) == (None, 0, "", 0)
    assert pii.pseudonymize(docs.limit(0), b"k").count() == 0


# Images


@pytest.mark.parametrize("transforms", [(), (0,), (1,), (2,), (3,), (0, 1, 2), (2, 0), (1, 0), (3, 0)])
def test_webp_round_trip(transforms):
    rng = np.random.default_rng(4)
    for height, width in ((1, 1), (7, 5), (13, 40)):
        for colours in (1, 2, 4, 13, 200):
            pixels = rng.choice(rng.integers(0, 1 << 32, colours, dtype=np.uint64), (height, width)).astype(np.uint32)
            for cache, references in ((0, False), (4, False), (0, True), (11, True)):
                data = webp.encode(pixels, transforms, cache, references)
                found, size = webp.decode(data + b"more")
                assert size == len(data)
                assert (found == pixels).all()


def test_webp_refuses():
    data = webp.encode(np.zeros((2, 2), np.uint32))
    for bad in (b"", data[:12] + b"VP8 " + data[16:], data[:20] + b"\x00" + data[21:]):
        with pytest.raises(ValueError, match="not"):
            webp.decode(bad)


def test_webp_of_another_encoder():
    """A published 1 x 1 lossless file that browsers' abilities are tested with."""
    import base64

    pixels, size = webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))
    assert pixels.shape == (1, 1)
    assert size == 34


def test_near_distances():
    assert len(webp.NEAR) == 120
    assert webp.NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)]
    assert webp.NEAR[-2:] == [(8, 6), (8, 7)]


def test_media(spark, monkeypatch):
    rows = documents()
    got = media.read_media(media.store_media(frame(spark, rows))).collect()
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    assert len(got) == len(rows)
    for r in got:
        payload = bytes(r.payload)
        assert payload == texts[r.doc_id].ljust(max(1, -(-len(texts[r.doc_id]) // 576)) * 576, b"\xff")
        assert r.n_bytes == len(texts[r.doc_id])
    clashing = media.store_media(frame(spark, rows)).selectExpr("*", "1 as payload", "2 as Feature")
    read = media.read_media(clashing)
    assert read.columns == ["doc_id", "n_bytes", "media", "payload", "feature"]
    assert {(r.doc_id, bytes(r.payload)) for r in read.collect()} == {(r.doc_id, bytes(r.payload)) for r in got}
    assert media.read_media(media.store_media(frame(spark, []))).count() == 0
    odd = spark.createDataFrame([(1, None), (2, bytearray())], "doc_id long, media binary")
    assert [(r.payload, r.feature) for r in sorted(media.read_media(odd).collect())] == [(None, None), (b"", "")]
    ways = {"few": b"abc " * 400, "again": bytes(range(32, 96)) * 90, "steps": bytes(k // 2 % 64 + 32 for k in range(0, 5760)), "prose": rows[0][1].encode()}
    chosen = {k: media.coding(media.padded(v)) for k, v in ways.items()}
    assert [bool(chosen[k].get("transforms")) for k in ways] == [True, False, False, False]
    assert chosen["again"] == {"references": True, "cache_bits": 6}
    slow = bytes(int(127 + 60 * np.sin(k / 40) + k * k % 3) for k in range(5760))
    assert media.coding(slow)["transforms"] == (webp.PREDICTOR,)
    for payload in (*map(media.padded, ways.values()), slow):
        assert media.from_files(media.to_files(payload)).tobytes() == payload
    monkeypatch.setattr(media, "MOST_ROWS", 3)  # several files for one payload
    payload = bytes(range(256)) * 18
    assert media.from_files(media.to_files(payload[:4032])).tobytes() == payload[:4032]
    assert media.from_files(media.to_files(b"abc" * 1920)).tobytes() == b"abc" * 1920


# Repeated strings


def brute_repeats(texts, depth):
    seen, found = set(), {}
    for doc_id, text in sorted(texts.items()):
        data = (text or "").encode()
        mark = bytearray(len(data))
        for i in range(len(data) - depth + 1):
            s = data[i : i + depth]
            if s in seen:
                mark[i : i + depth] = b"\1" * depth
            seen.add(s)
        spans = sum(1 for i in range(len(mark)) if mark[i] and (not i or not mark[i - 1]))
        found[doc_id] = (len(data), sum(mark), spans, hashlib.sha256(bytes(c for c, m in zip(data, mark, strict=True) if not m)).hexdigest())
    return found


def test_deep_shallow():
    rng = np.random.default_rng(2)
    for n, width, letters in ((0, 100, 3), (1, 100, 3), (300, 100, 2), (900, 60, 2), (400, 7, 2)):
        base = rng.integers(0, letters, (max(1, n // 3), width), dtype=np.uint8)
        rows = base[rng.integers(0, len(base), n)].copy()
        for _ in range(n // 2):
            rows[rng.integers(n), rng.integers(width)] ^= 1
        order, new = suffixes.deep_shallow(rows)
        strings = [rows[i].tobytes() for i in order]
        assert strings == sorted(strings)
        assert sorted(order) == list(range(n))
        assert list(new) == [i == 0 or strings[i] != strings[i - 1] for i in range(n)]
        if n > 1:
            begins = np.array([0, n // 3, n // 2])
            order, new = suffixes.deep_shallow(rows, begins)
            for a, b in zip(begins, [*begins[1:], n], strict=True):
                strings = [rows[i].tobytes() for i in order[a:b]]
                assert strings == sorted(rows[i].tobytes() for i in range(a, b))
                assert list(new[a:b]) == [i == 0 or strings[i] != strings[i - 1] for i in range(b - a)]


@pytest.mark.parametrize("hot", [1000, 1])
def test_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "SEGMENT", 700)
    rows = list({r[0]: r for r in documents()}.values())
    rng = random.Random(8)
    passage = prose(rng, 60)
    rows += [(400 + i, f"{prose(rng, 12)} {passage} {prose(rng, 12)}", "en", "s", 0) for i in range(25)]
    common = prose(rng, 25)[:110]
    rows += [(500 + i, f"{prose(rng, 9)} {common}{i} {prose(rng, 9)}", "en", "s", 0) for i in range(60)]
    got = suffixes.remove_repeats(frame(spark, rows).withColumn("spans", F.lit("old")), depth=100).collect()
    expected = brute_repeats({r[0]: r[1] for r in rows}, 100)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got} == expected
    assert sum(e[1] for e in expected.values()) > 1000


def test_repeats_cases(spark):
    long = prose(random.Random(3), 80)
    rows = [(None, long), (1, long), (1, long), (2, None), (2, "x" * 99), (3, "x" * 101)]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed) for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    n = len(long.encode())
    assert got == [(-1, 0), (1, n), (1, n), (2, 0), (2, 0), (3, 100)]
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
