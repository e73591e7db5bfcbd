"""Many small blocks in one task give what each of them gives alone."""

import pytest
from pyspark.sql import functions as F

from attestor.operators import adaptive

from .test_jobs_and_retrieval import claims_of, pairs_in


class Given:
    """Vectors of two dimensions, of one for some texts and of none for others."""

    model_id, dimension = "given", 2

    def embed(self, text):
        n = F.length(text).cast("double")
        return F.when(text.contains("retail"), F.array(n)).when(~text.contains("export"), F.array(n, F.lit(100.0) - n))


def found(spark, embedder=None):
    rows = claims_of(spark, 60).withColumn("subject", F.concat("subject", F.lit(" "), (F.col("seq") % F.lit(7) % 4).cast("string")))
    known = rows.withColumn("measure", F.when(F.col("seq") % 5 == 0, "other").otherwise(F.col("measure"))).where("seq % 11 > 0")
    out = []
    for new, where, more in ((None, None, {}), (rows.where("seq % 3 > 0"), F.col("seq") % 4 > 0, {"known": known})):
        got = adaptive.search(rows, new, adaptive.Knobs(k_ladder=(2, 4, 8), min_unblocked=2), embedder, where=where, **more)
        out += [{tuple(r) for r in got.ends().collect()}, {(*r[:2], round(r[2], 6), *r[3:]) for r in got.candidates().collect()}]
    return [*out, pairs_in(adaptive.relations(rows, rows.where("seq % 3 > 0"), "retrieval", adaptive.Knobs(k_ladder=(2, 4)), embedder))]


@pytest.mark.parametrize("embedder", [None, Given()])
def test_blocks_together_give_what_each_gives_alone(spark, monkeypatch, embedder):
    want = found(spark, embedder)
    assert all(want)
    for name, value in (("SMALL", 0), ("FREQUENT", 3)):
        with monkeypatch.context() as m:
            m.setattr(adaptive, name, value)
            assert found(spark, embedder) == want


def test_words_are_not_shuffled_by_claim(spark):
    plan = adaptive.search(claims_of(spark, 20)).ends()._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "collect_list" not in plan and "pmod" in plan  # no claim is taken apart, and blocks share groups


def test_places_count_as_the_embedding_does(spark):
    e = adaptive.HashingEmbedder(16)
    rows = spark.createDataFrame([("one two two",), ("",), (" ".join(f"w{i}" for i in range(99)),)], "t string")
    rows = rows.select(e.embed(F.col("t")).alias("v"), e.places(adaptive.texts.tokens(F.col("t"))).alias("p")).toArrow()
    assert e.counted(rows["p"]).tolist() == rows["v"].to_pylist()
