"""Job states over a stream, and relations by retrieval."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from attestor.operators import adaptive, pairs
from attestor.queries import ingest_queries
from attestor.sources.claims import claims
from attestor.streaming import ingest, jobs

from .test_operators import CLAIM, claim

EVENT = "job_id long, at timestamp, event_id long, action string, stage string, error string"
DAY = 86_400_000_000


def test_jobs_only_take_legal_steps():
    at = iter(range(1, 100))
    go = lambda job, action, stage=None, error=None: jobs.stepped(job, next(at), action, stage, error)
    job = go(jobs.Job(), "step", "parsing")
    assert job == jobs.Job(ignored=1)  # unknown jobs stay unknown
    job = go(go(job, "queue"), "complete")
    assert (job.stage, job.status, job.attempts, job.ignored) == ("queued", "queued", 1, 2)
    job = go(go(go(job, "step", "extracting"), "step", "parsing"), "step", "elsewhere")
    assert (job.stage, job.status, job.ignored) == ("extracting", "processing", 4)
    job = go(job, "fail", error="no such file /srv/in/a b.pdf: " + "x" * 400)
    assert job.status == "failed" and job.error.startswith("no such file <path> b.pdf: x") and len(job.error) == jobs.ERROR_CHARS
    for attempt in (2, 3):
        job = go(job, "queue")
        assert (job.attempts, job.error, job.status) == (attempt, None, "queued")
        job = go(job, "fail")
    assert go(job, "queue") == jobs.replace(job, ignored=job.ignored + 1)  # no fourth attempt
    done = go(go(go(jobs.Job(), "queue"), "step", "storing"), "complete")
    assert done.status == "completed" and go(done, "fail").status == "completed"
    assert jobs.stepped(done, 0, "queue", None, None).ignored == 1


def test_a_job_without_progress_fails():
    job = jobs.stepped(jobs.Job(), 0, "queue", None, None)
    assert jobs.expired(job, jobs.PATIENCE).runs and jobs.expired(job, jobs.PATIENCE + 1).error == jobs.TIMED_OUT
    again = jobs.stepped(job, 9 * DAY, "queue", None, None)
    assert (again.attempts, again.updated, again.status) == (2, 9 * DAY, "queued")


def test_a_stream_in_batches_gives_what_a_sorted_pass_gives(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(6), f"2024-01-{1 + i // 20:02d} {i % 20:02d}:00:00", i, rng.choice(["queue", "step", "step", "step", "complete", "fail"]), rng.choice(jobs.STAGES), "at /x/y") for i in range(280)]
    rows += [(99, "2024-01-01 00:00:00", 1000, "queue", None, None)]
    df = spark.createDataFrame(rows, "job_id long, at string, event_id long, action string, stage string, error string").withColumn("at", F.col("at").cast("timestamp"))
    for day in range(3):
        df.where(F.floor((F.dayofmonth("at") - 1) / 5) == day).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        got = jobs.run(spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}")  # goes on where it stopped
    events = df.select("*", F.unix_micros("at").alias("us")).toPandas()
    events["at"] = events["us"]
    watermark = int(events["us"].max()) - 600_000_000
    want = {int(j): jobs.expired(jobs.after(jobs.Job(), e), watermark) for j, e in events.groupby("job_id")}
    found = {r["job_id"]: jobs.Job(*r[1:]) for r in got.collect()}
    assert found == want and found[99].error == jobs.TIMED_OUT


def about(subject, row, page=1):
    return (*row[:3], page, subject, *row[5:])


def claims_of(spark, n, subjects=3):
    rng = random.Random(2)
    return spark.createDataFrame([about(f"s{rng.randrange(subjects)}", claim(i, value=rng.randrange(1, 5)), rng.randrange(4)) for i in range(n)], CLAIM)


def pairs_in(relations):
    return {(r["source_id"], r["target_id"], r["relation"]) for r in relations.collect()}


def test_a_full_budget_gives_what_all_pairs_give(spark):
    rows = claims_of(spark, 40)
    wide = adaptive.Knobs(k_ladder=(2, 100))
    assert pairs_in(adaptive.relations(rows, mode="retrieval", knobs=wide)) == pairs_in(adaptive.relations(rows))
    new = rows.where("seq % 4 = 0")
    assert {frozenset(p[:2]) for p in pairs_in(adaptive.relations(rows, new, "retrieval", wide))} == {frozenset(p[:2]) for p in pairs_in(adaptive.relations(rows, new))}
    with pytest.raises(ValueError, match="mode"):
        adaptive.relations(rows, mode="other")
    assert adaptive.relations(rows.limit(0), mode="retrieval").collect() == []


def test_queries_stop_for_a_reason(spark):
    rows = claims_of(spark, 40).unionByName(spark.createDataFrame([about("alone", claim(900))], CLAIM))
    knobs = adaptive.Knobs(k_ladder=(4, 8, 100), max_rounds=2, min_unblocked=2)
    found, ends = adaptive.adaptive_search(rows, knobs=knobs)
    size = {r["subject"]: r["n"] for r in rows.groupBy("subject").agg(F.count("*").alias("n")).collect()}
    of = {r["fact_id"]: r["subject"] for r in rows.collect()}
    for r in ends.collect():
        others = size[of[r["query"]]] - 1
        assert r["retrieved"] == min(others, r["k"]) and r["k"] == (4 if others < 4 else 8)
        assert r["reason"] == ("no_candidates_found" if not others else "no_further_candidates" if others < r["k"] else "budget_exhausted")
    assert ends.count() == 41 and found.groupBy("query").count().agg(F.max("count")).first()[0] == 8
    # with two of three blocked a full rung isn't saturated, and enough are left
    known = rows.withColumn("measure", F.when(F.col("seq") % 3 > 0, "other").otherwise(F.col("measure"))).where("seq % 10 > 0")
    found, ends = adaptive.adaptive_search(rows, knobs=adaptive.Knobs(k_ladder=(6, 100), min_unblocked=1), known=known)
    assert {r["blocking_reason"] for r in found.collect()} == {None, "BLOCK", "UNKNOWN_FACT_ID"}
    assert "sufficient_candidates" in {r["reason"] for r in ends.collect()}


def test_a_filter_says_what_may_be_found(spark):
    rows = claims_of(spark, 30)
    found, ends = adaptive.adaptive_search(rows, knobs=adaptive.Knobs(k_ladder=(100,)), where=F.col("seq") < 10)
    of = {r["fact_id"]: r["subject"] for r in rows.collect()}
    assert {(r["query"], r["fact_id"]) for r in found.collect()} == {(q, f"f{i}") for q in of for i in range(10) if of[q] == of[f"f{i}"] and q != f"f{i}"}
    assert ends.count() == 30


def test_an_ingest_tells_its_stages(spark, tmp_path):
    heard = []
    store = ingest.IncrementalStore(spark, f"file://{tmp_path}/s", heard.append)
    store.ingest(claims_of(spark, 6), 0)
    assert heard == ["resolving", "adjudicating", "storing", "completed"] and set(heard) <= set(jobs.STAGES)


def test_knobs_are_read_from_text():
    assert adaptive.Knobs.parsed({}) == adaptive.Knobs()
    got = adaptive.Knobs.parsed({"RETRIEVAL_K_LADDER": "50, 10,,10", "RETRIEVAL_TOP_K": "x", "RETRIEVAL_ENABLED": "On", "RETRIEVAL_MIN_UNBLOCKED": "7", "EMBEDDING_MODE": " REPLAY ", "RETRIEVAL_SATURATION_RATIO": ".5", "RETRIEVAL_ADAPTIVE": "no"})
    assert (got.k_ladder, got.top_k, got.enabled, got.min_unblocked, got.embedding_mode, got.saturation_ratio, got.rungs()) == ((10, 50), 50, True, 7, "replay", 0.5, [50])
    for bad in ("0,5", "a", "-1", ","):
        assert adaptive.Knobs.parsed({"RETRIEVAL_K_LADDER": bad}).k_ladder == adaptive.Knobs().k_ladder


def test_hashed_words_make_unit_vectors(spark):
    e = adaptive.HashingEmbedder(16)
    rows = spark.createDataFrame([("one two two",), ("",), (None,)], "t string").select(e.embed(F.col("t")).alias("v"), adaptive.unit(e.embed(F.col("t"))).alias("u")).collect()
    assert len(rows[0]["v"]) == e.dimension and abs(sum(x * x for x in rows[0]["u"]) - 1) < 1e-9 and sum(map(abs, rows[0]["v"])) in (1.0, 3.0)
    assert set(rows[1]["u"]) == set(rows[2]["u"]) == {0.0}


def test_stream_has_as_many_batches_however_many_files_the_claims_are(spark, tmp_path, monkeypatch):
    sf = "/root/testdata/sf0.001"
    for name in ("orders", "customer"):
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(24).write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(ingest_queries, "_folder", lambda spark: f"file://{tmp_path}/stream")
    monkeypatch.setattr(ingest_queries, "claims", lambda spark, d: claims(spark, d).repartition(24))
    found = ingest_queries.st01_streaming_ingest(spark, str(tmp_path))
    assert sorted(p.name for p in (tmp_path / "stream/store/claims").glob("batch=*")) == ["batch=0", "batch=1", "batch=2"]
    one = pairs.relations(pairs.cluster_pairs(claims(spark, sf)))
    ends = lambda df, a, b: sorted((*sorted((r[a], r[b])), r["relation"], r["reason_code"]) for r in df.collect())
    assert ends(found, "one", "other") == ends(one, "source_id", "target_id")


def test_store_has_no_method_generated_that_java_would_interpret(spark):
    seen = []

    class Rows:
        sparkSession, write = spark, type("", (), {"mode": lambda self, how: self, "parquet": lambda self, path: seen.append(int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")))})()

    before = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    ingest.IncrementalStore(spark, "file:///nowhere").append("relations", Rows(), 0)
    assert seen == [8000] and spark.conf.get("spark.sql.codegen.hugeMethodLimit") == before
