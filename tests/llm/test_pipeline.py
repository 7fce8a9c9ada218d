import corpus_pipeline
from searchkit.llm import decontaminate, secrets, toxicity

from .test_similar import groups

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        after = {r["doc_id"]: r for r in out.collect()}
        assert set(after) <= set(before) and out.count() == len(after)
        if name == "toxicity":
            bad = {r["doc_id"] for r in toxicity.score_toxicity(docs, toxicity.training_rows(docs), labels).where("predicted = 1").collect()}
            assert set(after) == set(before) - bad
        elif name == "near-dedup":
            ids = sorted(before)
            assert set(after) == {ids[g[0]] for g in groups([before[i]["text"] for i in ids])}
        elif name == "decontamination":
            found = decontaminate.find_contamination(docs, bench)
            assert set(after) == {r["doc_id"] for r in found.where("n_hit = 0").collect()}
        elif name == "secrets":
            spans = {r["doc_id"]: r["secret_spans"] for r in secrets.find_secrets(docs).collect()}
            assert set(after) == set(before)
            for i, r in after.items():
                assert (r["text"] == before[i]["text"]) == (not spans[i]) and r["n_chars"] == len(r["text"])
        else:
            assert all(r["taken"] > 0 for r in after.values()) and out.columns[:5] == columns
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        docs = out
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == set(after)


def test_every_stage_takes_an_empty_table_and_nulls(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, 0), (2, "", "en", "s", 0)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        assert stage(spark, docs.limit(50).unionByName(odd), SF).count() > 0


def test_other_columns_go_through_and_long_and_repeated_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    long = docs.limit(1).selectExpr("cast(90001 as long) as doc_id", "concat_ws(' ', transform(sequence(1, 20000), x -> concat('the', x))) as text", "lang", "source", "n_chars")
    docs = docs.unionByName(long).unionByName(docs.limit(3))
    clashing = ("score", "predicted", "_key", "items", "spans", "blob", "n_words", "_Spans", "group")
    docs = docs.selectExpr("*", *[f"concat('{c}', cast(doc_id as string)) as {c}" for c in clashing])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, SF).collect()
        assert rows and rows[0].asDict().keys() == dict.fromkeys(docs.columns).keys()
        assert all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in clashing)
        assert 90001 in {r["doc_id"] for r in rows}
        assert (len(rows) == len({r["doc_id"] for r in rows})) == (name == "near-dedup")


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-dedup", "decontamination", "secrets", "mixing"] and corpus_pipeline.ORACLE_SQL is None
