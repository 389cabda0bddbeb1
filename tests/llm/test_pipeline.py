import corpus_pipeline
from corvane.llm import neardup

from ..oracle import DATA
from .cases import documents, frame


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), docs.schema)
        now = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns
        assert now.keys() <= before.keys()
        assert len(now) > 0.8 * len(before), name
        before = now
    sets = [neardup.shingles(t, 5) for t in before.values()]
    assert len({s.tobytes() for s in sets}) == len(sets)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {p.doc_id for p in pieces} == before.keys()


def test_stages_handle_cases(spark, tmp_path):
    bench = spark.createDataFrame([(1, "nothing like this stands in any of the documents here")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    extra = ["score", "lang_pred", "n_lines", "n_dropped", "n_words", "contaminated", "Items", "own_score", "id", "key", "text_hash"]
    docs = frame(spark, documents()).selectExpr("*", *[f"concat('{c}', doc_id) as {c}" for c in extra])
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, str(tmp_path))
        rows = found.collect()
        assert 0 < len({r.doc_id for r in rows}) <= docs.count()
        if name != "best_fit_packing":
            assert found.schema == docs.schema or [(f.name, f.dataType) for f in found.schema] == [(f.name, f.dataType) for f in docs.schema]
            assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in extra)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_texts_of_one_id(spark):
    """A document that stands under one id with two texts is its text of the least digest, whatever the order of the rows."""
    rows = [(1, "one two three four five six seven"), (1, "other words that are not like these at all"), (2, "one two three four five six seven"), (3, "other words that are not like these at all"), (None, "x"), (4, None), (5, " ")]
    found = [{r.id: r.component_id for r in neardup.near_duplicate_groups(spark.createDataFrame(own, "doc_id long, text string").repartition(3)).collect()} for own in (rows, rows[::-1])]
    assert found[0] == found[1]
    assert found[0][1] == 1
    assert sorted(found[0].values()) in ([1, 1, 3, 4, 4], [1, 1, 2, 4, 4])
