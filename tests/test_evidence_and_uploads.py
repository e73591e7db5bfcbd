"""Evidence and display, counters in passing, and files by content."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from attestor.operators import adaptive, counted, evidence, pairs
from attestor.sources.uploads import Inbox, ParseCache

from .test_jobs_and_retrieval import claims_of


def test_verified_needs_both_checks(spark):
    rows = spark.createDataFrame([(True, "verified"), (True, "verified_with_context"), (True, ""), (True, None), (False, "verified"), (None, "verified"), (True, "mismatch")], "s boolean, v string")
    assert [r[0] for r in rows.select(evidence.is_verified(F.col("s"), F.col("v"))).collect()] == [True, True, False, False, False, False, False]


def test_claims_are_shown(spark):
    rows = spark.createDataFrame([("8,141.71", "INR", "currency", "FY2024", "consolidated"), ("", None, "percent", None, "unknown"), (None, None, None, "", None)], "raw string, currency string, unit string, period string, scope string")
    shown = evidence.value_display(F.col("raw"), F.lit(5), F.col("currency"), F.col("unit"))
    got = rows.select(shown.alias("s"), evidence.subtitle(shown, F.col("period"), F.col("scope")).alias("t")).collect()
    assert [tuple(r) for r in got] == [("8,141.71 INR", "8,141.71 INR · FY2024 · consolidated"), ("5 percent", "5 percent"), ("5", "5")]
    quotes = spark.createDataFrame([(" x" * 100,), ("a" * 120,), ("a" * 121,), (None,)], "q string").select(evidence.short_quote(F.col("q"))).collect()
    assert [len(r[0]) for r in quotes] == [120, 120, 120, 0] and quotes[2][0].endswith("a…")


def test_references_say_where_evidence_is_missing(spark):
    held = spark.createDataFrame([("f1", "d", 3, "q", 1, 2, True, "")], "fact_id string, doc_id string, page int, quote string, char_start int, char_end int, verified boolean, value_check string")
    r = evidence.evidence_references(spark.createDataFrame([("f1", "f2")], "a_fact_id string, b_fact_id string"), held).first()
    assert r["a_evidence"].asDict() == {"role": "a", "fact_id": "f1", "available": True, "doc_id": "d", "page": 3, "quote": "q", "char_start": 1, "char_end": 2, "verified": True, "value_check": None}
    assert not r["b_evidence"]["available"] and r["b_evidence"]["page"] is None
    cases = spark.createDataFrame([("x", True), ("x", None), ("y", False)], "category string, passed boolean")
    assert {tuple(r) for r in evidence.by_category(cases).collect()} == {("x", 1, 2), ("y", 0, 1)}


def test_counters_are_those_of_the_written_relations(spark, tmp_path):
    rows = claims_of(spark, 40)
    for n, mode in enumerate(("bruteforce", "retrieval")):
        found = counted.benchmark(rows, f"file://{tmp_path}/{n}", mode, adaptive.Knobs(k_ladder=(100,)))
        assert found["pairs"] == pairs.cluster_pairs(rows).count() == sum(v for k, v in found.items() if k.startswith("reason:"))
        assert found["relations"] == spark.read.parquet(f"file://{tmp_path}/{n}").count() == pairs.relations(pairs.cluster_pairs(rows)).count()


def test_files_are_read_once(spark, tmp_path):
    box = tmp_path / "in"
    (box / "sub").mkdir(parents=True)
    put = lambda name, data: (box / name).write_bytes(data)
    put("a.pdf", b"%PDF-1.4 one")
    put("sub/../same.pdf", b"%PDF-1.4 one")
    put("sub/b c;.pdf", b"%PDF-1.7 two")
    put("note.txt", b"plain")
    put("large.pdf", b"%PDF-" + b"x" * 400)
    put("empty.pdf", b"")  # Spark lists no empty files
    inbox = Inbox(spark, f"file://{box}", f"file://{tmp_path}/known", max_bytes=100)
    got = {os.path.basename(r["path"]): r for r in inbox.look().collect()}
    states = {k: r["status"] for k, r in got.items()}
    assert states == {"a.pdf": "new", "same.pdf": "duplicate", next(k for k in states if k.startswith("b")): "new", "note.txt": "no_document", "large.pdf": "too_large"}
    assert got["large.pdf"]["key"] is None and got["note.txt"]["name"] == "note.txt.pdf"
    assert "content" not in inbox.unseen().columns and inbox.unseen().count() == 0
    put("again.pdf", b"%PDF-1.7 two")
    put("c.pdf", b"%PDF-1.7 three")
    assert {os.path.basename(r["path"]): r["status"] for r in inbox.look().collect()} == {"again.pdf": "duplicate", "c.pdf": "new"}
    assert inbox.look().collect() == [] and inbox.known().count() == 7


def test_a_parse_is_made_once_for_each_version(spark, tmp_path):
    made = []

    def parse(missing):
        made.append(sorted(r["key"] for r in missing.collect()))
        return missing.select("key", F.length("key").alias("n"))

    keys = spark.createDataFrame([("aa",), ("b",), ("b",)], "key string")
    cache = ParseCache(spark, f"file://{tmp_path}/cache", "1")
    assert {tuple(r) for r in cache.get(keys, parse, "key string, n int").collect()} == {("aa", 2), ("b", 1)}
    more = keys.unionByName(spark.createDataFrame([("ccc",)], "key string"))
    assert cache.get(more, parse, "key string, n int").count() == 3
    assert ParseCache(spark, f"file://{tmp_path}/cache", "2").get(keys, parse, "key string, n int").count() == 2
    assert made == [["aa", "b"], ["ccc"], ["aa", "b"]]
