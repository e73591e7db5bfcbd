"""Queries on pairs of claims: gate, adjudication, objections, relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, periods
from ..operators import pairs
from ..sources.claims import CLAIM_COLUMNS, CLAIMS_SQL, claims


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.cluster_pairs(claims(spark, sf_dir))


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.relations(_pairs(spark, sf_dir))


def j01_relations(spark, sf_dir):
    return _relations(spark, sf_dir).groupBy("relation", "reason_code").agg(F.count("*").alias("n")).orderBy("relation", "reason_code")


def p05_gate_verdicts(spark, sf_dir):
    return pairs.gate(_pairs(spark, sf_dir)).groupBy("verdict", "reason_code", "period_relation", "cross_issuer").agg(F.count("*").alias("n"))


def p06_period_relation(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a_seq", "b_seq", periods.relation("a_", "b_").alias("period_relation"))


def p07_unit_compatible(spark, sf_dir):
    same = F.col("a_unit").eqNullSafe(F.col("b_unit")) & F.col("a_currency").eqNullSafe(F.col("b_currency"))
    return _pairs(spark, sf_dir).groupBy(same.alias("compatible")).agg(F.count("*").alias("n"))


def p08_same_page(spark, sf_dir):
    rows = claims(spark, sf_dir)
    joined = pairs.prefixed(rows, "a_").join(pairs.prefixed(rows, "b_"), ["subject", "measure"]).where("a_seq < b_seq")
    return joined.groupBy(pairs.same_page().alias("same_page")).agg(F.count("*").alias("n"))


def r01_adjudicated(spark, sf_dir):
    return _relations(spark, sf_dir).select("relation_id", "source_id", "target_id", "relation", "reason_code", F.round("confidence", 6).alias("confidence"))


def r02_values_agree(spark, sf_dir):
    agree = numbers.values_agree(F.col("a_value"), F.col("a_sig_figs"), F.col("b_value"), F.col("b_sig_figs"))
    return _pairs(spark, sf_dir).where("a_value is not null and b_value is not null").select("a_seq", "b_seq", agree.alias("agree"))


def r03_relative_difference(spark, sf_dir):
    gap = numbers.relative_difference(F.col("a_value"), F.col("b_value"))
    return _pairs(spark, sf_dir).where("a_value is not null and b_value is not null").select("a_seq", "b_seq", F.round(gap, 6).alias("gap"))


def r04_same_value(spark, sf_dir):
    return _pairs(spark, sf_dir).groupBy("a_value_kind", "b_value_kind", pairs.same_value().alias("same")).agg(F.count("*").alias("n"))


def r05_investigation(spark, sf_dir):
    return pairs.investigate(_pairs(spark, sf_dir)).select("a_seq", "b_seq", "verdict", F.array_join("blocking", ",").alias("blocking"), (F.col("verdict") == "comparable").alias("comparable"))


def r06_all_objections(spark, sf_dir):
    rows = pairs.gate(_pairs(spark, sf_dir))
    return rows.select("a_seq", "b_seq", F.array_join(pairs.all_objections(), ",").alias("objections"))


def r07_dimension_matrix(spark, sf_dir):
    rows = pairs.gate(_pairs(spark, sf_dir)).select(F.explode(pairs.dimension_matrix()).alias("d"))
    return rows.groupBy(F.col("d.dimension").alias("dimension"), F.col("d.status").alias("status")).agg(F.count("*").alias("n"))


def r08_refined_dimension(spark, sf_dir):
    rows = pairs.gate(_pairs(spark, sf_dir)).where("reason_code = 'unit_mismatch'")
    return rows.groupBy(pairs.refined_dimension(F.col("reason_code")).alias("dimension")).agg(F.count("*").alias("n"))


def r09_actions(spark, sf_dir):
    rows = pairs.investigate(_pairs(spark, sf_dir)).select(F.explode("actions").alias("x"))
    return rows.groupBy("x.dimension", "x.action", "x.safe").agg(F.count("*").alias("n"))


def r11_confidence_label(spark, sf_dir):
    rows = pairs.adjudicate(pairs.gate(_pairs(spark, sf_dir)))
    label = pairs.confidence_label(F.col("relation_confidence"), F.col("verdict"), F.lit(True))
    return rows.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def p04_blocking(spark, sf_dir):
    """Pairs of one document and page, of whatever subject."""
    return pairs.blocking_counts(claims(spark, sf_dir), ["doc_id", "page"])


def p15_qualifier_diff(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select("a_seq", "b_seq", F.explode(F.map_entries(pairs.qualifier_diff())).alias("e"))
    return rows.select("a_seq", "b_seq", F.col("e.key").alias("qualifier"), F.col("e.value.a").alias("a"), F.col("e.value.b").alias("b"))


def j02_delta_relations(spark, sf_dir):
    """Relations that the claims of the last two document months add; direction-free but for supersedes."""
    rows = claims(spark, sf_dir)
    new, old = rows.where("doc_id >= '1998-01'"), rows.where("doc_id < '1998-01'")
    found = pairs.relations(pairs.delta_pairs(new, old))
    return found.select(F.least("source_id", "target_id").alias("one"), F.greatest("source_id", "target_id").alias("other"), "relation", "reason_code")


def _prefixed_columns(alias: str) -> str:
    return ", ".join(f"{alias}.{c} as {alias}_{c}" for c in CLAIM_COLUMNS if c not in ("subject", "measure"))


PAIRS_SQL = f"""{CLAIMS_SQL},
pairs as (
    select a.subject, a.measure, {_prefixed_columns("a")}, {_prefixed_columns("b")}
    from claims a join claims b on a.subject = b.subject and a.measure = b.measure and a.seq < b.seq
    where not (a.doc_id = b.doc_id and a.page = b.page)
)"""

RELATION_SQL = """case when a_period_start is null or b_period_start is null then 'unknown'
    when a_period_kind = 'instant' and b_period_kind = 'instant' then
        case when a_period_end = b_period_end then 'equal' when a_period_end > b_period_end then 'succeeds' else 'precedes' end
    when a_period_start = b_period_start and a_period_end = b_period_end then 'equal'
    when a_period_start <= b_period_start and a_period_end >= b_period_end then 'subsumes'
    when b_period_start <= a_period_start and b_period_end >= a_period_end then 'subsumed_by'
    when a_period_end < b_period_start or b_period_end < a_period_start then 'disjoint' else 'overlaps' end"""


def tolerance_sql(value: str, figs: str) -> str:
    size = f"abs({value})"
    exponent = f"(case when {size} >= 1 then length(cast(cast(floor({size}) as bigint) as varchar)) - 1 else -length(regexp_extract(cast({size} as varchar), '\\.(0*)', 1)) - 1 end)"
    return f"(case when {value} = 0 then 0 else cast(concat('5E', {exponent} - {figs}) as decimal(30,9)) end)"


AGREE_SQL = f"(abs(a_value - b_value) <= {tolerance_sql('a_value', 'a_sig_figs')} + {tolerance_sql('b_value', 'b_sig_figs')})"
SAME_SQL = f"""case when a_value_kind = 'quantity' and b_value_kind = 'quantity' then {AGREE_SQL}
    when a_value_kind = 'text' and b_value_kind = 'text' then lower(trim(a_text_value)) = lower(trim(b_text_value)) else false end"""
FORECAST_SQL = "(a_issuer <> b_issuer and (a_modality in ('estimated', 'projected') or b_modality in ('estimated', 'projected')))"
UNIT_SQL = "(a_value_kind = 'quantity' and b_value_kind = 'quantity' and (a_unit is distinct from b_unit or a_currency is distinct from b_currency))"
SCOPE_SQL = "(a_scope <> b_scope and a_scope <> 'unknown' and b_scope <> 'unknown')"
BASIS_SQL = "(a_basis <> b_basis)"

GATE_SQL = f"""{PAIRS_SQL},
related as (select *, {RELATION_SQL} as period_relation from pairs),
gated as (
    select *, case
        when a_value_kind <> b_value_kind then 'value_kind_mismatch'
        when {SCOPE_SQL} then 'scope_mismatch'
        when {FORECAST_SQL} then 'forecast_disagreement'
        when a_segment <> b_segment then 'segment_mismatch'
        when {UNIT_SQL} then 'unit_mismatch'
        when period_relation = 'unknown' then 'ambiguous_period'
        when period_relation in ('succeeds', 'precedes') then 'temporal_succession'
        when period_relation = 'disjoint' then 'period_disjoint'
        when period_relation in ('subsumes', 'subsumed_by') then 'period_subsumption'
        when period_relation = 'overlaps' then 'period_overlap'
        when {BASIS_SQL} then 'basis_mismatch' else 'comparable' end as reason
    from related
),
judged as (
    select *, case reason when 'value_kind_mismatch' then 'incomparable_kind' when 'scope_mismatch' then 'incomparable_scope'
        when 'forecast_disagreement' then 'incomparable_issuer' when 'segment_mismatch' then 'incomparable_segment'
        when 'unit_mismatch' then 'incomparable_unit' when 'ambiguous_period' then 'ambiguous' when 'temporal_succession' then 'temporal_succession'
        when 'period_disjoint' then 'incomparable_period' when 'period_subsumption' then 'aggregation_candidate'
        when 'period_overlap' then 'incomparable_period' when 'basis_mismatch' then 'incomparable_basis' else 'comparable' end as verdict,
        reason not in ('value_kind_mismatch', 'scope_mismatch') and coalesce(a_issuer <> b_issuer, false) as cross_issuer,
        {SAME_SQL} as same
    from gated
)"""

RELATIONS_SQL = f"""{GATE_SQL},
decided as (
    select *, case when verdict = 'temporal_succession' then case when same then 'corroborates' else 'supersedes' end
        when verdict = 'aggregation_candidate' then 'aggregates_into'
        when verdict in ('incomparable_kind', 'ambiguous') then 'unrelated'
        when verdict = 'comparable' then case when same then 'corroborates' else 'contradicts' end
        else case when same then 'corroborates' else 'apparent_conflict' end end as relation,
        case when verdict = 'comparable' then case when same then 'value_match' else 'value_mismatch' end
        when same and verdict = 'temporal_succession' then 'restated_unchanged'
        when same and verdict not in ('incomparable_kind', 'ambiguous', 'aggregation_candidate') then concat('value_match_despite_', reason) else reason end as reason_code,
        case when verdict = 'temporal_succession' then case when same then 0.85 else 0.9 end
        when verdict = 'aggregation_candidate' then 0.8
        when verdict in ('incomparable_kind', 'ambiguous') then 0.5
        when verdict <> 'comparable' then case when same then 0.6 else 0.85 end
        when a_value_kind = 'quantity' and same then least(0.99, 0.85 + 0.14 * least(a_confidence, b_confidence))
        when a_value_kind = 'quantity' then round(0.6 + least(0.35, 2 * abs(cast(a_value - b_value as double)) / greatest(abs(cast(a_value as double)), abs(cast(b_value as double)))), 2)
        when same then 0.9 else 0.7 end as confidence
    from judged
),
relations as (
    select *, case when relation = 'supersedes' and period_relation = 'precedes' then b_fact_id else a_fact_id end as source_id,
        case when relation = 'supersedes' and period_relation = 'precedes' then a_fact_id else b_fact_id end as target_id
    from decided where relation <> 'unrelated' and not (relation = 'corroborates' and a_doc_id = b_doc_id)
)"""

OBJECTIONS_SQL = f"""case when a_value_kind <> b_value_kind then 'value_kind_mismatch' else concat_ws(',',
    case when {SCOPE_SQL} then 'scope_mismatch' end, case when {FORECAST_SQL} then 'forecast_disagreement' end,
    case when a_segment <> b_segment then 'segment_mismatch' end, case when {UNIT_SQL} then 'unit_mismatch' end,
    case period_relation when 'unknown' then 'ambiguous_period' when 'disjoint' then 'period_disjoint' when 'overlaps' then 'period_overlap' end,
    case when {BASIS_SQL} and not (period_relation in ('succeeds', 'precedes', 'subsumes', 'subsumed_by') or (period_relation = 'unknown' and a_period_start is null))
        then 'basis_mismatch' end) end"""


def _pair_status(name: str) -> str:
    return f"case when a_{name} is null or b_{name} is null then 'MISSING' when a_{name} = b_{name} then 'MATCH' else 'MISMATCH' end"


def _matrix_sql() -> str:
    both = "a_value_kind = 'quantity' and b_value_kind = 'quantity'"
    status = {
        "subject": "'MATCH'",
        "measure": "'MATCH'",
        "value_kind": _pair_status("value_kind"),
        "period": "case when a_period_kind is null or b_period_kind is null then 'MISSING' when period_relation = 'unknown' then 'AMBIGUOUS' when a_period_label = b_period_label then 'MATCH' else 'MISMATCH' end",
        "unit": f"case when {both} then {_pair_status('unit')} else 'NOT_APPLICABLE' end",
        "currency": f"case when not ({both}) or (a_currency is null and b_currency is null) then 'NOT_APPLICABLE' else {_pair_status('currency')} end",
        "scope": "case when a_scope = 'unknown' or b_scope = 'unknown' then 'MISSING' when a_scope = b_scope then 'MATCH' else 'MISMATCH' end",
        "issuer": _pair_status("issuer"),
        "segment": _pair_status("segment"),
        "geography": "'MISSING'",
        "basis": _pair_status("basis"),
        "verification": "'UNVERIFIABLE'",
    }
    return " union all ".join(f"select '{d}' as dimension, {s} as status from judged" for d, s in status.items())


_DIMENSIONS = "case o when 'value_kind_mismatch' then 'value_kind' when 'scope_mismatch' then 'scope' when 'forecast_disagreement' then 'issuer' when 'segment_mismatch' then 'segment' when 'unit_mismatch' then case when a_unit is not distinct from b_unit and a_currency <> b_currency then 'currency' else 'unit' end when 'basis_mismatch' then 'basis' else 'period' end"
_OBJECTED = f"{GATE_SQL}, listed as (select *, {OBJECTIONS_SQL} as objections from judged), named as (select *, unnest(case when objections = '' then [] else string_split(objections, ',') end) as o from listed)"

QUERIES = {
    "J-01_relations": j01_relations,
    "P-04_blocking": p04_blocking,
    "P-05_gate_verdicts": p05_gate_verdicts,
    "P-06_period_relation": p06_period_relation,
    "P-07_unit_compatible": p07_unit_compatible,
    "P-08_same_page": p08_same_page,
    "P-15_qualifier_diff": p15_qualifier_diff,
    "R-01_adjudicated": r01_adjudicated,
    "R-02_values_agree": r02_values_agree,
    "R-03_relative_difference": r03_relative_difference,
    "R-04_same_value": r04_same_value,
    "R-05_investigation": r05_investigation,
    "R-06_all_objections": r06_all_objections,
    "R-07_dimension_matrix": r07_dimension_matrix,
    "R-08_refined_dimension": r08_refined_dimension,
    "R-09_actions": r09_actions,
    "R-11_confidence_label": r11_confidence_label,
    "J-02_delta_relations": j02_delta_relations,
}

SQL = {
    "J-01_relations": f"with {RELATIONS_SQL} select relation, reason_code, count(*) as n from relations group by all",
    "P-04_blocking": f"""with {CLAIMS_SQL}, x as (
        select case when a.subject <> b.subject then 'SUBJECT' when a.measure <> b.measure then 'MEASURE' when a.value_kind <> b.value_kind then 'VALUE_KIND' end as blocking_reason
        from claims a join claims b on a.doc_id = b.doc_id and a.page = b.page and a.seq < b.seq)
        select blocking_reason is null as candidate, blocking_reason, count(*) as n from x group by all""",
    "P-05_gate_verdicts": f"with {GATE_SQL} select verdict, reason as reason_code, period_relation, cross_issuer, count(*) as n from judged group by all",
    "P-06_period_relation": f"with {PAIRS_SQL} select a_seq, b_seq, {RELATION_SQL} as period_relation from pairs",
    "P-07_unit_compatible": f"with {PAIRS_SQL} select a_unit is not distinct from b_unit and a_currency is not distinct from b_currency as compatible, count(*) as n from pairs group by all",
    "P-08_same_page": f"with {CLAIMS_SQL} select a.doc_id = b.doc_id and a.page = b.page as same_page, count(*) as n from claims a join claims b on a.subject = b.subject and a.measure = b.measure and a.seq < b.seq group by all",
    "P-15_qualifier_diff": f"with {PAIRS_SQL} "
    + " union all ".join(
        f"select a_seq, b_seq, '{k}' as qualifier, a_{c} as a, b_{c} as b from pairs where a_{c} is distinct from b_{c}"
        for k, c in {"period": "period_label", "scope": "scope", "basis": "basis", "segment": "segment", "issuer": "issuer"}.items()
    ),
    "R-01_adjudicated": f"with {RELATIONS_SQL} select substring(sha1(concat_ws('|', source_id, target_id, relation)), 1, 12) as relation_id, source_id, target_id, relation, reason_code, round(cast(confidence as double), 6) as confidence from relations",
    "R-02_values_agree": f"with {PAIRS_SQL} select a_seq, b_seq, {AGREE_SQL} as agree from pairs where a_value is not null and b_value is not null",
    "R-03_relative_difference": f"with {PAIRS_SQL} select a_seq, b_seq, round(abs(cast(a_value - b_value as double)) / greatest(abs(cast(a_value as double)), abs(cast(b_value as double))), 6) as gap from pairs where a_value is not null and b_value is not null",
    "R-04_same_value": f"with {PAIRS_SQL} select a_value_kind, b_value_kind, {SAME_SQL} as same, count(*) as n from pairs group by all",
    "R-05_investigation": f"with {_OBJECTED}, marked as (select a_seq, b_seq, verdict, string_agg({_DIMENSIONS}, ',' order by list_position(string_split(objections, ','), o)) as blocking from named group by all) select j.a_seq, j.b_seq, j.verdict, coalesce(m.blocking, '') as blocking, j.verdict = 'comparable' as comparable from judged j left join marked m using (a_seq, b_seq)",
    "R-06_all_objections": f"with {GATE_SQL} select a_seq, b_seq, {OBJECTIONS_SQL} as objections from judged",
    "R-07_dimension_matrix": f"with {GATE_SQL}, m as ({_matrix_sql()}) select dimension, status, count(*) as n from m group by all",
    "R-08_refined_dimension": f"with {GATE_SQL} select case when a_unit is not distinct from b_unit and a_currency <> b_currency then 'currency' else 'unit' end as dimension, count(*) as n from judged where reason = 'unit_mismatch' group by all",
    "R-09_actions": f"with {_OBJECTED}, x as (select {_DIMENSIONS} as dimension from named) select dimension, case when dimension in ('subject', 'measure', 'value_kind') then concat('resolve_', dimension) else concat('align_', dimension) end as action, dimension not in ('currency', 'subject', 'issuer') as safe, count(*) as n from x group by all",
    "R-11_confidence_label": f"with {RELATIONS_SQL} select case when verdict = 'ambiguous' then 'AMBIGUOUS' when verdict like 'incomparable%' then 'INCOMPARABLE' when confidence >= 0.85 then 'CONFIDENT' when confidence >= 0.65 then 'SUPPORTED' else 'PARTIALLY VERIFIED' end as label, count(*) as n from decided group by all",
    "J-02_delta_relations": f"with {RELATIONS_SQL} select least(source_id, target_id) as one, greatest(source_id, target_id) as other, relation, reason_code from relations where a_doc_id >= '1998-01' or b_doc_id >= '1998-01'",
}
