"""The ladder within tasks and by tiles."""

import pytest
from pyspark.sql import functions as F

from attestor.operators import adaptive, tiles

from .test_jobs_and_retrieval import claims_of, pairs_in


def test_large_blocks_give_what_small_ones_give(spark, monkeypatch):
    rows = claims_of(spark, 50)
    known = rows.withColumn("measure", F.when(F.col("seq") % 3 > 0, "other").otherwise(F.col("measure"))).where("seq % 10 > 0")
    knobs = adaptive.Knobs(k_ladder=(3, 6, 9), min_unblocked=2)

    def all_of(**more):
        found = adaptive.search(rows, rows.where("seq % 2 = 0"), knobs, known=known, **more)
        return {tuple(r) for r in found.ends().collect()}, {(*r[:2], round(r[2], 6), *r[3:]) for r in found.candidates().collect()}

    filtered, free = all_of(where=F.col("seq") < 30), all_of()
    found = pairs_in(adaptive.relations(rows, rows.where("seq % 2 = 0"), "retrieval", knobs))
    monkeypatch.setattr(tiles, "ROWS", 4)
    assert all_of(where=F.col("seq") < 30) == filtered and all_of() == free
    assert pairs_in(adaptive.relations(rows, rows.where("seq % 2 = 0"), "retrieval", knobs)) == found


def test_scores_stay_in_their_task(spark):
    plan = adaptive.search(claims_of(spark, 20)).ends()._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" in plan and "row_number" not in plan  # no window over hits


@pytest.mark.parametrize("cells", [1, 7, 1 << 21])
def test_a_few_queries_at_a_time(spark, monkeypatch, cells):
    want = {tuple(r) for r in adaptive.search(claims_of(spark, 25)).ends().collect()}
    monkeypatch.setattr(adaptive, "CELLS", cells)
    assert {tuple(r) for r in adaptive.search(claims_of(spark, 25)).ends().collect()} == want
