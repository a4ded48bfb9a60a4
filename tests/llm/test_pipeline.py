import corpus_pipeline as C
from tests.llm.cases import awkward, clashing, empty


def test_stages_on_awkward_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs = clashing(awkward(spark)).drop("ids", "n_tokens")
    columns = docs.columns
    for name, step in C.STAGES:
        out = step(spark, docs, sf)
        if name != "token_ids":
            assert out.columns == columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        else:
            assert out.filter("n_tokens IS NULL").count() == 0


def test_stages_on_nothing(spark):
    docs = empty(spark)
    for _, step in C.STAGES:
        out = step(spark, docs, "/root/testdata/sf0.001")
        assert out.count() == 0
        docs = spark.createDataFrame([], out.schema) if "text" in out.columns else docs


def test_run(spark):
    rows = C.run(spark, "/root/testdata/sf0.001").collect()
    assert 100 < len(rows) < 200 and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
