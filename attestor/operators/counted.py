"""Relations and what it took to get them, counted in passing: the same job that writes the relations counts its pairs."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import adaptive, pairs


def observed_relations(candidates: DataFrame) -> tuple[DataFrame, Observation]:
    """(relations of a set of pairs, an observation of pairs, kept pairs and pairs by reason); it has values once the relations were written or collected."""
    seen = Observation()
    rows = pairs.adjudicate(pairs.gate(candidates))
    reasons = [F.count_if(F.col("reason_code") == r).alias(f"reason:{r}") for r in pairs.VERDICTS]
    rows = rows.observe(seen, F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("relation") == "unrelated").alias("unrelated"), *reasons)
    return pairs.shown(pairs.kept(rows)), seen


def benchmark(claims: DataFrame, path: str, mode: str = "bruteforce", knobs: adaptive.Knobs = adaptive.Knobs()) -> dict[str, float]:
    """Writes the relations of all claims to `path`; the counters of that job, its relations and its seconds."""
    began = time.time()
    if mode == "bruteforce":
        candidates = pairs.cluster_pairs(claims)
    else:
        candidates = adaptive.candidate_pairs(adaptive.adaptive_search(claims, knobs=knobs)[0], claims)
    found, seen = observed_relations(candidates)
    written = Observation()
    found.observe(written, F.count(F.lit(1)).alias("relations")).write.parquet(path)
    return {**seen.get, **written.get, "seconds": time.time() - began}
