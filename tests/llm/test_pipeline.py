import corpus_pipeline
from attestor.llm import registry
from attestor.llm.common import saved

from .helpers import ODD, SCHEMA, prose
from .test_dedup import brute_components, edited


def _tables(spark, path):
    texts = dict(ODD)
    for i in range(120):
        texts[i] = prose(120, i)
    for i in range(120, 150):
        texts[i] = " ".join(["SPAM!!", "###", "BUY!!"] * 20)
    for i in range(150, 160):
        texts[i] = edited(texts[i - 150], 2, i)
    item = prose(30, 777)
    for i in range(160, 170):
        texts[i] = prose(70, i) + " " + item + " " + prose(30, i + 1000)
    write = lambda name, data, schema: spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}.parquet")
    write("documents", [(k, t, "en", "s", len(t or "")) for k, t in texts.items()], SCHEMA)
    write("labels", [(i, int(not 120 <= i < 150), int(i % 11 == 0)) for i in range(170)], "doc_id long, quality int, toxic int")
    write("benchmark", [(1, item)], "item_id long, text string")
    return texts


def test_stages_keep_and_drop_what_they_should(spark, tmp_path):
    texts = _tables(spark, tmp_path)
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, str(tmp_path)))
        seen.append((name, docs))
        if name != "sharding":
            assert docs.columns == columns
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    kept = [ids(df) for _, df in seen]
    assert not kept[0] & set(range(120, 150)) and set(range(120)) <= kept[0]
    groups = brute_components({k: texts[k] for k in kept[0]})
    assert kept[1] == {k for k in kept[0] if groups[k][1] == k}
    assert kept[2] == kept[1] - set(range(160, 170))
    assert kept[3] <= kept[2] and {k for k in kept[2] if k % 11} <= kept[3] | set(ODD)
    assert kept[4] == kept[3] and {"size", "shard", "slot"} <= set(seen[4][1].columns)
    assert seen[4][1].count() == seen[3][1].count()


def test_clean_documents_stay_where_hardly_any_are_toxic(spark, tmp_path):
    texts = {i: prose(120, i) for i in range(600)} | {600 + i: " ".join([f"vile{i} awful nasty foul"] * 2) for i in range(40)}
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts.items()], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k >= 600)) for k in texts], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    words = {k: len(t.split()) for k, t in texts.items()}
    assert sum(n for k, n in words.items() if k >= 600) < 0.01 * sum(words.values())
    copies = {r["doc_id"]: r["count"] for r in corpus_pipeline._mix(spark, docs, str(tmp_path)).groupBy("doc_id").count().collect()}
    assert set(range(600)) <= set(copies)
    assert all(copies.get(k, 0) <= 1 for k in range(600, 640))


def test_no_document_is_lost_for_its_doc_id(spark, tmp_path):
    item = prose(30, 777)
    rows = [(1, prose(90, 1)), (1, prose(90, 2)), (1, prose(90, 1)), (None, prose(90, 3)), (None, prose(90, 4)), (None, prose(90, 3)), (None, None), (7, prose(60, 5) + " " + item), (7, prose(90, 6)), (None, prose(60, 8) + " " + item), (8, prose(90, 9))]
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline._near_dedup(spark, docs, str(tmp_path))
    texts = lambda df: sorted((r["doc_id"] or 0, r["text"] or "") for r in df.collect())
    assert texts(kept) == sorted({(k or 0, t or "") for k, t in rows}) and kept.columns == docs.columns
    clean = corpus_pipeline._decontaminate(spark, docs, str(tmp_path))
    assert texts(clean) == sorted((k or 0, t or "") for k, t in rows if item not in (t or ""))


def test_run_gives_the_last_stage_and_bears_no_documents(spark, tmp_path):
    _tables(spark, tmp_path)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 100
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert len(registry.queries()) == 13
