"""Results about pairs that are had without forming all of them."""

import random

from pyspark.sql import functions as F

from attestor.operators import pairs

from .test_operators import CLAIM, claim


def test_counted_blocking_is_that_of_all_pairs(spark):
    rng = random.Random(7)
    pick = lambda *values: rng.choice(values)
    for seqs, nulls in ((90, ()), (40, (None,))):  # of 90 claims some have one seq
        rows = spark.createDataFrame([(rng.randrange(seqs), pick("d", "e", *nulls), pick(1, 2), pick("a", "b", *nulls), pick("m", "n", *nulls), pick("q", "t", *nulls)) for _ in range(90)], "seq long, doc_id string, page int, subject string, measure string, value_kind string")
        a, b = (pairs.prefixed(rows, p, ("doc_id", "page")) for p in ("a_", "b_"))
        want = pairs.blocking(a.join(b, ["doc_id", "page"]).where("a_seq < b_seq")).groupBy("candidate", "blocking_reason").agg(F.count("*").alias("n"))
        assert {tuple(r) for r in pairs.blocking_counts(rows, ["doc_id", "page"]).collect()} == {tuple(r) for r in want.collect()}


def test_touching_pairs_form_no_other_pair(spark):
    rows = spark.createDataFrame([claim(i, doc=f"d{i % 4}" if i % 5 else None) for i in range(20)], CLAIM)
    for name, some in (("d1", F.col("doc_id") == "d1"), ("even", F.col("seq") % 2 == 0)):
        ends = {r["seq"] for r in rows.where(some).collect()}
        want = {(r["a_seq"], r["b_seq"]) for r in pairs.cluster_pairs(rows).collect() if {r["a_seq"], r["b_seq"]} & ends}
        got = [(r["a_seq"], r["b_seq"]) for r in pairs.touching_pairs(rows, some).collect()]
        assert set(got) == want and len(got) == len(want), name
