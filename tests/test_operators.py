"""Operators by known answers and by brute force."""

import difflib
import functools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane import queries
from corvane.functions import text
from corvane.operators import evaluate, facets, index, places, resolve, synonyms, vectors
from corvane.plans import search
from corvane.plans.query import Vocabulary, parse
from corvane.sources import index_files
from corvane.streaming import events

from .oracle import DATA


@pytest.mark.parametrize("one_window", [100_000, 0])
def test_places(spark, monkeypatch, one_window):
    monkeypatch.setattr(places, "ONE_WINDOW", one_window)
    monkeypatch.setattr(places, "SAMPLED", 128)
    rng = random.Random(3)
    rows = [(i, rng.choice("abc"), rng.randrange(400) if i % 3 else 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, g string, x int").repartition(5)
    ranked = places.globally(df, [-F.col("x"), F.col("i")], "at").collect()
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    assert {r.i: r.at for r in ranked} == {r[0]: n + 1 for n, r in enumerate(order)}
    grouped = {r.i: r.at for r in places.globally(df, [F.col("x"), F.col("i")], "at", ["g"]).collect()}
    for g in "abc":
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))
        assert [grouped[r[0]] for r in own] == list(range(1, len(own) + 1))
    found = {r.g: (r.p95, r.median) for r in evaluate.percentiles(df, ["g"], "x", {"p95": 0.95}).collect()}
    for g in "abc":
        own = sorted(r[2] for r in rows if r[1] == g)
        assert found[g] == (own[int(0.95 * (len(own) - 1))], own[len(own) // 2])


def test_close_names_by_brute_force(spark):
    rng = random.Random(4)
    keys = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 14))) for _ in range(150)]
    names = [*keys[:20], *("".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(40))]
    for k in keys[:90]:
        k = list(k)
        for _ in range(rng.randint(1, 2)):
            at = rng.randrange(len(k))
            k[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "x"])
        names.append("".join(k) or "q")
    pool = {k: i // 2 for i, k in enumerate(dict.fromkeys(keys))}
    expected = {}
    for i, s in enumerate(names):
        rows = {pool[k] for k in difflib.get_close_matches(s, list(pool), n=2, cutoff=resolve.CLOSE)}
        if len(rows) == 1:
            expected[i] = rows.pop()
    left = spark.createDataFrame([(i, 2020, s) for i, s in enumerate(names)], "id long, year int, s string")
    right = spark.createDataFrame([(2020, k, r) for k, r in pool.items()] + [(2019, names[-1], 999)], "year int, key string, row long")
    assert {r.id: r.row for r in resolve.close_names(left, right).collect()} == expected
    assert len(expected) > 60


def test_fuzzy_names(spark):
    rows = {r.id: (r.row, r.match) for r in queries.entity_fuzzy(spark, DATA).collect()}
    assert any(match == "unmatched" for _, match in rows.values())


def test_duplicate_groups(spark):
    rows = [("a-1", "Ann", "http://h/Team:Ann", "fuzzy"), ("b-1", "Bo", "http://h/Team:Ann", "exact"), ("c-1", "Example", "http://h/Team:Ann", "exact"), ("d-1", "Dee", "", None), ("e-1", "Eve", None, "exact"), ("f-1", "Ann", "http://h/Team:Ann", "exact")]
    df = spark.createDataFrame(rows, "id string, name string, url string, match string")
    assert {r.id: r.winner for r in resolve.duplicate_groups(df).collect()} == {"a-1": "f-1", "b-1": "f-1", "f-1": "f-1", "d-1": "d-1", "e-1": "e-1"}
    assert {r.id: r.n_merged for r in resolve.dedupe(df).collect()} == {"f-1": 2, "d-1": 0, "e-1": 0}


def test_stored_index(spark, tmp_path):
    docs = queries.documents(spark, DATA)
    own = index.full_text_index(docs, "doc", "text")
    index_files.write_index(own, f"{tmp_path}/i", files=4)
    stored = index_files.open_index(spark, f"{tmp_path}/i")
    assert sorted(map(tuple, own.postings.select("term", "doc", "w").collect())) == sorted(map(tuple, stored.postings.select("term", "doc", "w").collect()))
    assert own.stats.first().asDict() == stored.stats.first().asDict()
    groups = parse("that with", Vocabulary())
    assert search.document_frequencies(own, ["that", "with"]) == search.document_frequencies(stored, ["that", "with"])
    assert {(r.doc, r.hits) for r in search.mention_tail(own, groups).collect()} == {(r.doc, r.hits) for r in search.mention_tail(stored, groups).collect()}
    plan = stored.postings.filter(F.col("term").isin("that", "with"))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term, [that,with])]" in plan
    again = queries.full_text(spark, DATA)
    assert again.postings.inputFiles() == queries.full_text(spark, DATA).postings.inputFiles()  # built once


def test_word_fallback(spark):
    vocabulary = spark.createDataFrame([("cell", 30), ("berry", 25), ("box", 40), ("rare", 3), ("cats", 50), ("cat", 50)], "term string, df long")
    typed = spark.createDataFrame([(w,) for w in ("cells", "berries", "boxes", "rares", "cats", "xs", "s")], "term string")
    found = {r.term: r.stem for r in index.fallbacks(typed, vocabulary).collect()}
    assert found == {"cells": "cell", "berries": "berry", "boxes": "box"}
    (group,) = parse("cells cats", Vocabulary(fallbacks=found))
    assert [[(s.words, s.weight) for s in u.spellings] for u in group] == [[(("cells",), 1.0), (("cell",), 0.35)], [(("cats",), 1.0)]]


def test_top_similar_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "DOCS_EACH", 60)
    monkeypatch.setattr(vectors, "QUERIES_EACH", 7)
    rng = np.random.default_rng(2)
    vecs = rng.normal(size=(300, 6))
    vecs[10] = vecs[11] = vecs[12]
    vecs[13] = 0
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "doc long, vec array<double>")
    asked = docs.filter("doc % 20 = 0 or doc = 13").select(F.col("doc").alias("qid"), "vec")
    out = docs.filter("doc % 2 = 1").select("doc")
    norms = np.linalg.norm(vecs, axis=1)
    for exclude in (None, out):
        found = {}
        for r in vectors.top_similar(docs, asked, k=9, least=0.2, exclude=exclude).collect():
            found.setdefault(r.qid, []).append((r["rank"], r.doc))
        for q in range(0, 300, 20):
            cos = vecs @ vecs[q] / np.where(norms > 0, norms * norms[q], 1)
            best = sorted((-round(c, 9), d) for d, c in enumerate(cos) if c > 0.2 and (exclude is None or d % 2 == 0))[:9]
            assert [d for _, d in sorted(found[q])] == [d for _, d in best]
        assert 13 not in found


def test_concepts_against_a_dense_decomposition(spark):
    rng = random.Random(5)
    topics = [["river", "stone", "water", "flow"], ["cloud", "light", "rain", "storm"], ["green", "leaf", "tree", "wood"]]
    words = [w for t in topics for w in t] + [f"word{chr(97 + i)}" for i in range(20)]
    texts = [(i, " ".join(rng.choice(topics[i % 3] * 4 + words) for _ in range(40))) for i in range(90)] + [(900, "zzz")]
    docs = spark.createDataFrame(texts, "doc long, text string").repartition(3)
    for k in (3, 8):
        terms, found = vectors.train(docs, "doc", "text", k=k)
        listed, weights = vectors.term_weights(docs, "doc", "text")
        place = {t: i for i, t in enumerate(sorted(r.term for r in listed.collect()))}
        dense = np.zeros((90, len(place)))
        for r in weights.collect():
            dense[r.doc, place[r.term]] = r.w
        _, _, v = np.linalg.svd(dense, full_matrices=False)
        exact = dense @ v[:k].T
        exact /= np.linalg.norm(exact, axis=1, keepdims=True)
        got = {r.doc: np.array(r.vec) for r in found.collect()}
        assert sorted(got) == list(range(90))
        ours = np.stack([got[i] for i in range(90)])
        assert np.abs(ours @ ours.T - exact @ exact.T).max() < 1e-6
        again = {r.doc: np.array(r.vec) for r in vectors.project(weights, terms).collect()}
        assert all(np.abs(again[i] - got[i]).max() < 1e-9 for i in got)
        query = vectors.query_vector("rivers water WATER the zzz", terms)
        rows = {r.term: (r.idf, np.array(r.vec)) for r in terms.collect()}
        wanted = (1 + np.log(2)) * rows["water"][0] * rows["water"][1]
        assert np.allclose(query, wanted / np.linalg.norm(wanted))
        assert vectors.query_vector("the zzz", terms) is None
        tail = vectors.concept_tail(found, query, k=5).collect()
        cos = ours @ np.array(query)
        assert [r.doc for r in tail] == [d for _, d in sorted((-round(c, 9), d) for d, c in enumerate(cos) if c > 0.12)[:5]]


def test_many_terms_need_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TERMS_EACH", 16)
    rng = np.random.default_rng(8)
    dense = rng.normal(size=(120, 70)) * (0.8 ** np.arange(70))
    rows = spark.createDataFrame([(i, list(range(70)), x.tolist()) for i, x in enumerate(dense)], "doc long, at array<int>, w array<double>").repartition(4)
    v = vectors.singular_vectors(rows, 70, 5)
    _, _, exact = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(np.abs((v * exact[:5].T).sum(axis=0)), 1, atol=1e-8)


def test_evaluation(spark):
    ranked = spark.createDataFrame([(1, d, r) for r, d in enumerate([5, 6, 7, 8], 1)] + [(2, 5, 1)], "qid int, doc int, rank int")
    relevant = spark.createDataFrame([(1, 6), (1, 8), (1, 9), (2, 4), (3, 1)], "qid int, doc int")
    per = {r.qid: r for r in evaluate.per_query(ranked, relevant).collect()}
    assert (per[1].n_rel, per[1].first, per[1].rr) == (3, 2, 0.5)
    assert per[1].recall == pytest.approx(2 / 3)
    assert per[1].ap == pytest.approx((1 / 2 + 2 / 4) / 3)
    assert per[1].precision == pytest.approx(0.2)
    assert per[1].ndcg == pytest.approx((1 / np.log2(3) + 1 / np.log2(5)) / sum(1 / np.log2(i + 1) for i in (1, 2, 3)))
    assert (per[2].first, per[2].rr, per[3].ndcg) == (None, 0, 0)
    before, after = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.5)], "qid int, ndcg double"), spark.createDataFrame([(1, 0.6), (2, 0.1), (3, 0.5)], "qid int, ndcg double")
    assert tuple(evaluate.compare(before, after).first()) == (1, 1, 1)
    assert spark.range(1).select(evaluate.random_precision(F.lit(3), F.lit(12)).alias("p")).first().p == 0.25
    queries_ = spark.createDataFrame([(1, "cells grow"), (2, "an of"), (3, "boxes cities")], "qid int, query string")
    assert {r.qid: r["query"] for r in evaluate.morph_queries(queries_).collect()} == {1: "cell grows", 3: "box city"}


def test_lineages(spark):
    rows = spark.createDataFrame([(f"{t}-{y}", i, t, y) for i, (t, y) in enumerate([("a", 2019), ("a", 2020), ("a", 2021), ("b", 2020), ("c", 2020), ("c", 2020)])], "id string, doc int, team string, year int")
    groups = evaluate.lineages(rows)
    assert {(r.id, r.n_rel) for r in groups.collect()} == {("a-2019", 2), ("a-2020", 2), ("a-2021", 2)}
    wanted = spark.createDataFrame([("a-2020",)], "qid string")
    assert sorted(r.doc for r in evaluate.lineage_relevant(groups, wanted).collect()) == [0, 2]
    assert [r.t for r in spark.createDataFrame([("x-1-2020",), ("y-na",), ("z",)], "id string").select(evaluate.team_of(F.col("id")).alias("t")).collect()] == ["x-1", "y", "z"]


def test_preflight_and_fingerprint(spark):
    cards = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc int, id string")
    lengths, own = spark.createDataFrame([(1, 5), (2, 5)], "doc int, dl int"), spark.createDataFrame([(1, "k"), (9, "k")], "doc int, kind string")
    assert evaluate.preflight(cards, lengths, own).first().asDict() == {"repeated_ids": 1, "without_length": 1, "unknown_facets": 1}
    prints = [{r.name: (r.n, r.digest) for r in evaluate.fingerprint({"cards": c, "lengths": lengths}).collect()} for c in (cards, cards.orderBy(F.desc("doc")), cards.filter("doc < 3"))]
    assert prints[0] == prints[1]
    assert prints[0]["cards"] != prints[2]["cards"]
    assert prints[0]["lengths"] == prints[2]["lengths"]


def test_abbreviations(spark):
    rows = [(1, "the green  Fluorescent protein glows"), (2, "green fluorescent protein gfp"), (3, "evergreen fluorescent protein"), (4, None), (5, "green fluorescent protein"), (6, "a green fluorescent protein, gfpx")]
    docs = spark.createDataFrame(rows, "doc int, text string")
    found = synonyms.long_without_short(docs, "doc", "text", [("gfp", "green fluorescent protein"), ("glo", "glows")])
    assert {(r.short, r.doc) for r in found.collect()} == {("gfp", 1), ("gfp", 5), ("gfp", 6), ("glo", 1)}
    assert {(r.short, r.doc) for r in evaluate.unexplained(found).collect()} == {("gfp", 1), ("gfp", 5), ("gfp", 6)}
    explained = ["the green fluorescent protein (GFP) glows", "a green fluorescent protein ( gfp )", "of the lateral flow assay (LFA)", "lateral flow assay (LFA)", "western blot (XY)", "by mass spectrometry (MS)"]
    mined = synonyms.mine(spark.createDataFrame([(t,) for t in explained], "text string"), "text")
    assert {(r.short, r.long, r.n) for r in mined.collect()} == {("gfp", "green fluorescent protein", 2), ("lfa", "lateral flow assay", 2)}


def test_events(spark):
    bodies = ['data: {"choices":[{"delta":{"content":"Hel"}}]}\r\n\r\ndata: {"choices":[{"delta":{"content":"lo"}}]}\n\ndata: [DONE]\n\n', 'data: {"error":{"message":"no"}}\n\ndata: {"error":{"message":"later"}}\n\n', ": comment\n\n"]
    rows = spark.createDataFrame(list(enumerate(bodies)), "id long, body string")
    assert [tuple(r) for r in rows.select(events.event_text(F.col("body")), events.event_error(F.col("body"))).collect()] == [("Hello", None), ("", "no"), ("", None)]
    cases = [("a-1", "https://h/x", "chat", True), ("-a", "https://h", "chat", False), ("a", "http://h", "chat", False), ("a", "https://h", "else", False), ("A", "https://h", "chat", False), ("a" * 41, "https://h", "messages", False)]
    given = spark.createDataFrame(cases, "id string, base string, kind string, ok boolean")
    assert all(r.ok == r.valid for r in given.withColumn("valid", events.valid_provider(F.col("id"), F.col("base"), F.col("kind"))).collect())


def test_postings_kept_by_a_stream(spark, tmp_path):
    arrivals = [[(1, "aa bb aa"), (2, "bb cc")], [(2, "aa dd dd"), (3, "dd"), (4, "")]]
    schema = "doc long, text string"
    for batch in arrivals:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        for _ in range(2):  # the second start finds nothing new
            events.maintain_postings(stream, "doc", "text", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    kept = events.maintained_index(spark, f"{tmp_path}/out")
    now = index.full_text_index(spark.createDataFrame(list(dict(arrivals[0] + arrivals[1]).items()), schema), "doc", "text")
    for name in ("postings", "lengths", "stats"):
        assert sorted(map(tuple, getattr(kept, name).collect())) == sorted(map(tuple, getattr(now, name).collect()))
    index_files.write_index(kept, f"{tmp_path}/index", files=2)
    found = search.mentions(index_files.open_index(spark, f"{tmp_path}/index"), parse("aa", Vocabulary())[0]).collect()
    assert {(r.doc, r.hits, r.dl) for r in found} == {(1, 2, 3), (2, 1, 3)}


def test_addresses(spark):
    rows = [(" St. Mary's (HS)  Team ", 2023, None, "https://2023.n.org/st-mary-s-hs-team/"), ("A  B_c", 2019, None, "https://2019.o.org/Team:A__B_c"), (" ", 2022, None, ""), (None, 2010, "", ""), ("x", 2022, "Óne Two!", "https://2022.n.org/ne-two/"), ("x", 2021, " Y Z\t", "https://2021.o.org/Team:Y_Z")]
    df = spark.createDataFrame(rows, "name string, year int, official string, url string")
    assert [r.u for r in df.select(text.page_url("n.org", "o.org", F.col("name"), F.col("year"), F.col("official")).alias("u")).collect()] == [r[3] for r in rows]
    old = df.select(text.archive_url(F.col("url"), F.col("year"), "http://archive/").alias("u")).collect()
    assert [r.u.startswith("http://archive/") for r in old] == [r[1] < 2022 for r in rows]


def test_every_pool_has_its_own_tail(spark):
    docs = spark.createDataFrame([(i, ["en", "fr"][i % 2], ["s", "m", "l"][i % 3]) for i in range(60)], "doc int, lang string, size string")
    own = facets.facet_docs(docs, "doc", {"lang": F.col("lang"), "size": F.col("size")})
    first, tail = docs.filter("doc < 6"), docs.filter("doc in (7, 58, 59)")
    scored = docs.select("doc", (F.lit(1.0) - F.col("doc") / 100).alias("score"))
    filters = {"lang": ["en"], "size": ["m"]}
    found = {}
    for r in search.hybrid_pools(first, scored, tail, own, filters, k=4).collect():
        found.setdefault(r.pool, set()).add(r.doc)
    tests = {"": lambda i: i % 2 == 0 and i % 3 == 1, "lang": lambda i: i % 3 == 1, "size": lambda i: i % 2 == 0}
    for pool, fits in tests.items():
        alike = [i for i in range(6, 60) if fits(i)][:4]
        assert found[pool] == {i for i in [*range(6), *alike, 7, 58, 59] if fits(i)}
    counts = {(r.kind, r.label): r.n for r in facets.pooled_counts(search.hybrid_pools(first, scored, tail, own, filters, k=4), own, filters).collect()}
    assert counts["size", "l"] == sum(i % 3 == 2 for i in found["size"])
    plain = search.hybrid_pools(first, scored, tail, own, None, k=4)
    assert {(r.doc, r.pool) for r in plain.collect()} == {(i, "") for i in [*range(10), 58, 59]}
    said = spark.createDataFrame([("", "p"), (None, "q"), ("s", "p"), (None, None)], "s string, p string")
    assert [r.t for r in said.select(evaluate.known_item_text(F.col("s"), F.col("p")).alias("t")).collect()] == ["p", "q", "s", ""]


def test_facet_panel_keeps_what_is_selected(spark):
    rows = [("technique", f"t{i}", f"t{i}", 20 - i) for i in range(20)] + [("year", str(y), str(y), 1) for y in (2019, 2021, 2020)]
    counted = spark.createDataFrame(rows, "kind string, label string, key string, n long")
    shown = {(r.kind, r.label): r["rank"] for r in facets.shown(counted, {"technique": ["t16"]}).collect()}
    assert sorted(k for k in shown if k[0] == "year") == [("year", "2019"), ("year", "2020"), ("year", "2021")]
    assert [shown["year", y] for y in ("2021", "2020", "2019")] == [1, 2, 3]
    assert sum(k[0] == "technique" for k in shown) == 17
    plain = facets.shown(counted)
    assert plain.filter("kind = 'technique'").count() == 14


def test_a_name_is_made_normal_once(spark):
    """However many rules it is tried by: records of many items cost in proportion to the items alone."""
    from corvane.functions import canon

    names = spark.createDataFrame([(["gibson assembly", "x"],)], "names array<string>")
    for kind in canon.RULES:
        plan = names.select(F.transform("names", functools.partial(canon.canonical, kind)).alias("labels"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("[_/,;:]+") == 1
