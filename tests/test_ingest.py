"""Files in, records, files out."""

import gzip
import json

from pyspark.sql import functions as F

from corvane.operators import records, resolve
from corvane.sources import files

RAW = "team string, team_name string, summary string, chassis_organisms string, application_domain string"


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())


def test_json_roots(spark, tmp_path):
    write(tmp_path / "a/Team One!/2020/metadata_x.json", json.dumps({"team": "One", "chassis_organisms": ["E. coli", {"name": "yeast"}]}))
    write(tmp_path / "a/Two/2021/metadata_x.json", "{not json")
    write(tmp_path / "a/Three/none/metadata_x.json", json.dumps({"team": "Three"}))
    write(tmp_path / "b/TeamOne/2020/metadata_y.json", json.dumps({"team": "Other"}))
    write(tmp_path / "b/Old/1999/metadata_y.json", json.dumps({"team": "Old"}))
    raw = files.with_identity(files.read_json_roots(spark, [str(tmp_path / "a"), str(tmp_path / "b")], RAW))
    found = {(r.slug, r.year): r for r in raw.collect()}
    assert set(found) == {("teamone", 2020), ("three", None), ("old", 1999)}
    first = resolve.first_records(raw).collect()
    assert [(r.slug, r.year, r.team, r.root) for r in first] == [("teamone", 2020, "One", 0)]
    assert json.loads(first[0].chassis_organisms) == ["E. coli", {"name": "yeast"}]


def test_directory(spark, tmp_path):
    write(tmp_path / "d.csv", "﻿name, country,year\n Ann , DE , 2020 \nBob,,\nCy,FR,x\nDee,US,2021\n")
    found = files.read_directory(spark, str(tmp_path / "d.csv")).orderBy("row").collect()
    assert [(r["name"], r[" country"] if " country" in r.__fields__ else r["country"], r["year"]) for r in found] == [("Ann", "DE", 2020), ("Dee", "US", 2021)]
    keys = {(r.key, r.year): r.row for r in resolve.directory_keys(files.read_directory(spark, str(tmp_path / "d.csv"))).collect()}
    assert keys[("ann", 2020)] == found[0].row


def test_texts(spark, tmp_path):
    write(tmp_path / "t/One/2020/b.txt", b"h\xc3\xa9 \xff\xc3(ok\xef\xbf\xbd")
    write(tmp_path / "t/One/2020/c.txt", b"later")
    (tmp_path / "t/Two/2021").mkdir(parents=True)
    with gzip.open(tmp_path / "t/Two/2021/a.txt.gz", "wb") as out:
        out.write(b"zipped \xe2\x82 text")
    texts = files.read_texts(spark, str(tmp_path / "t"))
    found = {r.path.split("/t/")[1]: r.text for r in texts.collect()}
    assert found == {"One/2020/b.txt": "hé (ok�", "One/2020/c.txt": "later", "Two/2021/a.txt.gz": "zipped  text"}
    assert sorted(r.text for r in files.first_texts(texts).collect()) == ["hé (ok�", "zipped  text"]


def test_sinks_and_manifests(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("x")).repartition(5)
    for name in ("one", "two"):
        files.write_json(rows.repartition(3 if name == "two" else 7), f"{tmp_path}/{name}", ["x", "id"])
    read = [[json.loads(x) for f in sorted((tmp_path / name).glob("*.json.gz")) for x in gzip.open(f, "rt")] for name in ("one", "two")]
    assert read[0] == read[1] == sorted(read[0], key=lambda r: (r["x"], r["id"]))
    assert files.read_records(spark, f"{tmp_path}/one", "json").count() == 1000
    sums = [{r.sha for r in files.checksums(spark, f"{tmp_path}/{name}").filter("name like '%.gz'").collect()} for name in ("one", "two")]
    assert sums[0] == sums[1]
    assert len(sums[0]) == 1
    files.write_json(rows, f"{tmp_path}/many", ["x", "id"], files=3)
    assert len(list((tmp_path / "many").glob("*.json.gz"))) == 3
    (tmp_path / "site/data").mkdir(parents=True)
    (tmp_path / "site/data/a.bin").write_bytes(b"abc")
    manifest = files.write_manifest(spark, f"{tmp_path}/site/data", "2026-01-01").first()
    assert [(f.name, f.sha, f.bytes) for f in manifest.files] == [("a.bin", "ba7816bf8f01cfea", 3)]
    (tmp_path / "old").mkdir()
    (tmp_path / "old/manifest.json").write_text('{"schema": 1}')
    found = files.first_loadable(spark, [f"{tmp_path}/missing", f"{tmp_path}/old", f"{tmp_path}/site/data"])
    assert found.first().build == "2026-01-01"
    assert files.first_loadable(spark, [f"{tmp_path}/old"]) is None


def test_build_and_enrich(spark):
    empty = dict.fromkeys("problem_statement approach_statement novelty_claim failure_modes key_references chassis_organisms molecular_techniques target_molecules biological_parts application_domain model processed_by track summary key_results".split())
    raw = [
        {**empty, "slug": "one", "year": 2020, "team": " One ", "path": "a/metadata_M x.json", "chassis_organisms": '[{"name": "Escherichia coli", "importance": "CORE", "role": "host"}, 3, "yeast"]', "biological_parts": '["BBa_B0034"]', "key_results": '["r", 1]', "track": "Old"},
        {**empty, "slug": "example", "year": 2020, "team": "[your name]", "path": "x"},
    ]
    columns = sorted(raw[0])
    schema = ", ".join(f"{c} {'int' if c == 'year' else 'string'}" for c in columns)
    built = records.build_records(spark.createDataFrame([tuple(r[c] for c in columns) for r in raw], schema))
    (r,) = built.collect()
    assert (r.id, r.name, r.model, r.summary, r.key_results, r.failure_modes) == ("one-2020", "One", "m-x", "", ["r"], [])
    assert [tuple(x) for x in r.chassis_organisms] == [("Escherichia coli", "core", "host"), ("yeast", "core", "")]
    assert (r.biological_parts[0].registry_id, r.biological_parts[0].registry_slug) == ("BBa_B0034", "bba-b0034")
    assert r.core == ["Escherichia coli", "yeast", "BBa_B0034"]
    assert r.f["year"] == ["2020"]
    assert len(r.f["chassis"]) == 2
    assert "domain" not in r.f
    directory = spark.createDataFrame([(5, "", "north-america", "US", "undergrad", "Town")], "row long, village string, region string, country string, section string, city string")
    (e,) = resolve.enrich(built, spark.createDataFrame([("one-2020", 5, "exact")], "id string, row long, match string"), directory).collect()
    assert (e.match, e.city) == ("exact", "Town")
    assert {"region", "country", "section"} <= set(e.f)
    assert e.f["year"] == ["2020"]
    (u,) = resolve.enrich(built, spark.createDataFrame([("one-2020", None, "unmatched")], "id string, row long, match string"), directory).collect()
    assert (u.match, u.city, u.f) == (None, "", r.f)
    shown = records.cards(built.withColumn("doc", F.lit(0))).collect()
    assert [(c.id, c.needs_summary, [x.name for x in c.chassis]) for c in shown] == [("one-2020", True, ["Escherichia coli", "yeast"])]
    assert [r.id for r in records.by_id(built, ["ONE-2020"]).collect()] == ["one-2020"]
    names = built.select(records.searchable_names(records.names(F.col("chassis_organisms")), F.col("core")).alias("n")).first().n
    assert names == "Escherichia coli yeast Escherichia coli yeast BBa_B0034"


def test_annotation_skips_bad_years(spark):
    rows = spark.createDataFrame([("a", 2020), ("b", 2021)], "slug string, year int")
    notes = spark.createDataFrame([("a", "2020", 1, "x"), ("a", " 2020", 2, "y"), ("a", "20x0", 3, "z"), ("b", None, 4, "w")], "slug string, year string, n int, qa string")
    assert {r.slug: r.qa for r in resolve.annotate(rows, notes).collect()} == {"a": "y", "b": None}


def test_merge_lines(spark):
    rows = [(1, 0, "\n\nmain a\n"), (1, 1, "main a\r\nnew\n\n \t\nnew"), (1, 2, " main a\nmain a"), (2, 0, "\nalone\n"), (3, 0, " \n"), (3, 1, "\nx\nx\ny\n")]
    found = {r.grp: r.text for r in resolve.merge_lines(spark.createDataFrame(rows, "grp int, part int, text string")).collect()}
    assert found == {1: "\n\nmain a\n\n\nnew\n\n \t", 2: "\nalone\n", 3: "x\ny"}


def test_overview_and_rates(spark):
    rows = spark.createDataFrame([(1, "exact"), (2, None), (3, "fuzzy"), (4, "exact")], "doc int, match string")
    assert records.join_rate(rows).first().rate == 75.0
    posts = spark.createDataFrame([(0, None), (1, True), (2, False), (3, True)], "pos int, pinned boolean")
    assert [r.pos for r in records.newest_first(posts).collect()] == [1, 3, 0]
