"""Queries on evidence and display, and relations with their counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import counted, evidence, pairs
from ..sources.claims import CLAIMS_SQL, claims, table
from ..sources.scratch import fresh_folder
from .pair_queries import GATE_SQL, OBJECTIONS_SQL, RELATIONS_SQL


def p18_verified(spark, sf_dir):
    """Order lines as checked claims: shipped ones have a verified span, and the return flag stands for the value check."""
    check = F.when(F.col("l_returnflag") == "A", "verified").when(F.col("l_returnflag") == "N", "verified_with_context").when(F.col("l_linenumber") % 2 == 0, "mismatch").otherwise("")
    rows = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") < 7, F.col("l_linestatus") == "F").alias("span"), check.alias("check"))
    return rows.groupBy("span", "check", evidence.is_verified(F.col("span"), F.col("check")).alias("verified")).agg(F.count("*").alias("n"))


def j20_evidence_references(spark, sf_dir):
    """Both sides of every pair; each fifth claim has no evidence."""
    rows = claims(spark, sf_dir)
    held = rows.where("seq % 5 > 0").select("fact_id", "doc_id", "page", F.concat(F.lit("quote of "), "subject").alias("quote"), F.lit(0).alias("char_start"), F.lit(9).alias("char_end"), F.lit(True).alias("verified"), F.when(F.col("seq") % 2 == 0, "verified").otherwise("").alias("value_check"))
    found = evidence.evidence_references(pairs.cluster_pairs(rows).select("a_fact_id", "b_fact_id"), held)
    return found.select("a_fact_id", "b_fact_id", *[F.col(f"{s}_evidence.{c}").alias(f"{s}_{c}") for s in ("a", "b") for c in ("available", "page", "value_check")])


def f49_display(spark, sf_dir):
    shown = evidence.value_display(F.col("text_value"), F.col("value"), F.col("currency"), F.col("unit"))
    return claims(spark, sf_dir).select("seq", shown.alias("shown"), evidence.subtitle(shown, F.col("period_label"), F.col("scope")).alias("subtitle"))


def f49_short_quotes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", evidence.short_quote(F.col("text")).alias("quote"))


def a19_by_category(spark, sf_dir):
    """Every pair as a case by its verdict: it passes if the turned pair gets the same one."""
    rows = pairs.gate(pairs.cluster_pairs(claims(spark, sf_dir))).withColumn("category", F.col("verdict"))
    turned = rows.select("category", "subject", "measure", *[F.col(c).alias(("b_" if c.startswith("a_") else "a_") + c[2:]) for c in rows.columns if c[:2] in ("a_", "b_")])
    return evidence.by_category(pairs.gate(turned).select("category", (F.col("verdict") == F.col("category")).alias("passed")))


def a25_counters(spark, sf_dir):
    """All relations are written once, and the counters of that job are the result."""
    found = counted.benchmark(claims(spark, sf_dir), fresh_folder(spark, "relations"))
    return spark.createDataFrame([(k, int(v)) for k, v in found.items() if k != "seconds"], "counter string, n long")


QUERIES = {
    "P-18_verified": p18_verified, "J-20_evidence_references": j20_evidence_references, "F-49_display": f49_display, "F-49_short_quotes": f49_short_quotes,
    "A-19_by_category": a19_by_category, "A-25_benchmark_counters": a25_counters,
}

_SHOWN = "trim(concat_ws(' ', coalesce(nullif(text_value, ''), cast(value as varchar), ''), coalesce(nullif(currency, ''), nullif(unit, ''))))"
SQL = {
    "P-18_verified": """with x as (select case when l_linenumber < 7 then l_linestatus = 'F' end as span, case when l_returnflag = 'A' then 'verified' when l_returnflag = 'N' then 'verified_with_context' when l_linenumber % 2 = 0 then 'mismatch' else '' end as "check" from lineitem)
        select span, "check", coalesce(span and l in ('verified', 'verified_with_context'), false) as verified, count(*) as n from (select span, "check", "check" as l from x) group by all""",
    "J-20_evidence_references": f"with {RELATIONS_SQL} select a_fact_id, b_fact_id, "
    + ", ".join(f"{s}_seq % 5 > 0 as {s}_available, case when {s}_seq % 5 > 0 then {s}_page end as {s}_page, case when {s}_seq % 5 > 0 and {s}_seq % 2 = 0 then 'verified' end as {s}_value_check" for s in ("a", "b"))
    + " from pairs",
    "F-49_display": f"with {CLAIMS_SQL}, s as (select *, {_SHOWN} as shown from claims) select seq, shown, concat_ws(' · ', nullif(shown, ''), nullif(period_label, ''), case when scope <> 'unknown' then scope end) as subtitle from s",
    "F-49_short_quotes": "with d as (select doc_id, trim(coalesce(text, ''), ' ') as t from documents) select doc_id, case when length(t) <= 120 then t else concat(left(t, 119), '…') end as quote from d",
    "A-19_by_category": f"with {GATE_SQL} select verdict as category, count(*) as passed, count(*) as total from judged group by verdict",
    "A-25_benchmark_counters": f"with {RELATIONS_SQL}, r as (select unnest(['value_kind_mismatch', 'scope_mismatch', 'forecast_disagreement', 'segment_mismatch', 'unit_mismatch', 'ambiguous_period', 'temporal_succession', 'period_disjoint', 'period_subsumption', 'period_overlap', 'basis_mismatch', 'comparable']) as reason) "
    "select concat('reason:', reason) as counter, (select count(*) from judged j where j.reason = r.reason) as n from r union all select 'pairs', count(*) from judged union all select 'unrelated', count(*) from decided where relation = 'unrelated' union all select 'relations', count(*) from relations",
    "R-10_conclusions": f"with {GATE_SQL}, o as (select verdict, {OBJECTIONS_SQL} as o from judged) select verdict, cast(case when o = '' then 0 else len(string_split(o, ',')) end as integer) as objections, count(*) as n from o group by all",
    "W-06_packing": """with recursive l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents), n as (select doc_id, l, unnest(range(1, (len(l) + 5) // 3)) as page from l),
        p as (select doc_id, page, length(array_to_string(l[page * 3 - 2:page * 3], chr(10))) as size from n),
        r(doc_id, page, batch, fill) as (select doc_id, page, cast(0 as bigint), size from p where page = 1
            union all select p.doc_id, p.page, batch + case when fill + size <= 6000 then 0 else 1 end, case when fill + size <= 6000 then fill + size else size end from r join p on p.doc_id = r.doc_id and p.page = r.page + 1)
        select doc_id, page, batch from r""",
}
