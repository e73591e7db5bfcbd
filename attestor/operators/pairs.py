"""Pairs of claims: may they be compared, and what do they say of each other?

A pair has the columns of both claims with the prefixes `a_` and `b_`. The gate and the
adjudication are single CASE expressions over them, so a whole cluster join stays
in one stage of generated code after the join itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys, numbers, periods
from ..sources.scratch import saved

FORECASTS = ("estimated", "projected")
#: Reasons whose pairs may still be explained by context.
EXPLAINED = ("period_disjoint", "period_overlap", "scope_mismatch", "unit_mismatch", "segment_mismatch", "basis_mismatch", "forecast_disagreement")
VERDICTS = {
    "value_kind_mismatch": "incomparable_kind",
    "scope_mismatch": "incomparable_scope",
    "forecast_disagreement": "incomparable_issuer",
    "segment_mismatch": "incomparable_segment",
    "unit_mismatch": "incomparable_unit",
    "ambiguous_period": "ambiguous",
    "temporal_succession": "temporal_succession",
    "period_disjoint": "incomparable_period",
    "period_subsumption": "aggregation_candidate",
    "period_overlap": "incomparable_period",
    "basis_mismatch": "incomparable_basis",
    "comparable": "comparable",
}
EXPLANATIONS = {
    "value_kind_mismatch": "The two claims state values of different kinds.",
    "scope_mismatch": "Standalone and consolidated figures may both hold for one period.",
    "forecast_disagreement": "Two institutions forecast different values; neither is an error.",
    "segment_mismatch": "The claims are about different segments.",
    "unit_mismatch": "Units or currencies differ, and no exchange rate is stated.",
    "ambiguous_period": "A period is missing or can't be placed in time, so nothing is known of how the periods lie.",
    "temporal_succession": "Both hold at a point in time; the later one updates the earlier one.",
    "period_disjoint": "The periods don't meet.",
    "period_subsumption": "One period contains the other, so one figure is part of the other.",
    "period_overlap": "The periods overlap in part.",
    "basis_mismatch": "One figure is audited and the other is not.",
    "comparable": "Nothing known keeps the two values from being compared.",
}


def _a(name: str) -> Column:
    return F.col(f"a_{name}")


def _b(name: str) -> Column:
    return F.col(f"b_{name}")


def prefixed(claims: DataFrame, prefix: str, keep: tuple[str, ...] = ("subject", "measure")) -> DataFrame:
    """Columns renamed with a prefix, but for the keys of the join."""
    return claims.select(*[F.col(c) if c in keep else F.col(c).alias(f"{prefix}{c}") for c in claims.columns])


def cluster_pairs(claims: DataFrame) -> DataFrame:
    """All pairs of a cluster, the earlier claim first, but for mentions on one page.

    One equi-join on the cluster's key; AQE splits the clusters that are much larger than others.
    """
    pairs = prefixed(claims, "a_").join(prefixed(claims, "b_"), ["subject", "measure"])
    return pairs.where((_a("seq") < _b("seq")) & ~same_page())


def touching_pairs(claims: DataFrame, some: Column) -> DataFrame:
    """The pairs of `cluster_pairs` that hold a claim for which `some` is true; no other pair is formed."""
    mine, others = claims.where(some), claims.where(~F.coalesce(some, F.lit(False)))
    one = prefixed(mine, "a_").join(prefixed(claims, "b_"), ["subject", "measure"])
    two = prefixed(others, "a_").join(prefixed(mine, "b_"), ["subject", "measure"])
    return one.unionByName(two).where((_a("seq") < _b("seq")) & ~same_page())


def delta_pairs(new: DataFrame, old: DataFrame) -> DataFrame:
    """Pairs that hold a new claim: new with new (earlier first) and new with old (new first); never old with old."""
    everything = new.withColumn("is_new", F.lit(True)).unionByName(old.withColumn("is_new", F.lit(False)))
    pairs = prefixed(new, "a_").join(prefixed(everything, "b_"), ["subject", "measure"])
    return pairs.where((~F.col("b_is_new") | (_a("seq") < _b("seq"))) & (_a("seq") != _b("seq")) & ~same_page()).drop("b_is_new")


def same_page() -> Column:
    return F.coalesce((_a("doc_id") == _b("doc_id")) & (_a("page") == _b("page")), F.lit(False))


def _stated(column: Column) -> Column:
    """An empty qualifier is as good as none."""
    return F.nullif(column, F.lit(""))


def _differ(name: str) -> Column:
    return F.coalesce(_stated(_a(name)) != _stated(_b(name)), F.lit(False))


def objections() -> dict[str, Column]:
    """Each reason to object, as a condition of its own, in the gate's order."""
    relation = F.col("period_relation")
    both_quantities = (_a("value_kind") == "quantity") & (_b("value_kind") == "quantity")
    return {
        "value_kind_mismatch": _a("value_kind") != _b("value_kind"),
        "scope_mismatch": (_a("scope") != _b("scope")) & (_a("scope") != "unknown") & (_b("scope") != "unknown"),
        "forecast_disagreement": _differ("issuer") & (_a("modality").isin(*FORECASTS) | _b("modality").isin(*FORECASTS)),
        "segment_mismatch": _differ("segment"),
        "unit_mismatch": both_quantities & ~(_a("unit").eqNullSafe(_b("unit")) & _a("currency").eqNullSafe(_b("currency"))),
        "ambiguous_period": relation == "unknown",
        "temporal_succession": relation.isin("succeeds", "precedes"),
        "period_disjoint": relation == "disjoint",
        "period_subsumption": relation.isin("subsumes", "subsumed_by"),
        "period_overlap": relation == "overlaps",
        "basis_mismatch": _differ("basis") & _a("basis").isin("audited", "unaudited") & _b("basis").isin("audited", "unaudited"),
    }


def _first(conditions: dict[str, Column], default: str) -> Column:
    out = None
    for name, condition in conditions.items():
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return out.otherwise(default)


def _constant(mapping: dict, key: Column) -> Column:
    """Looks the key up in a constant map; the key's expression stands in the plan once."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), key)


def gate(pairs: DataFrame) -> DataFrame:
    """Adds period_relation, reason_code, verdict, gate_explanation and cross_issuer."""
    pairs = pairs.withColumn("period_relation", periods.relation("a_", "b_"))
    pairs = pairs.withColumn("reason_code", _first(objections(), "comparable"))
    early = F.col("reason_code").isin("value_kind_mismatch", "scope_mismatch")
    return pairs.withColumns({
        "verdict": _constant(VERDICTS, F.col("reason_code")),
        "gate_explanation": _constant(EXPLANATIONS, F.col("reason_code")),
        "cross_issuer": ~early & _differ("issuer"),
    })


def same_value() -> Column:
    """Quantities by their tolerances, texts but for case and outer blanks, others exactly."""
    agree = numbers.values_agree(_a("value"), _a("sig_figs"), _b("value"), _b("sig_figs"))
    return (
        F.when((_a("value_kind") == "quantity") & (_b("value_kind") == "quantity"), F.coalesce(agree, F.lit(False)))
        .when((_a("value_kind") == "text") & (_b("value_kind") == "text"), F.lower(F.trim(_a("text_value"))).eqNullSafe(F.lower(F.trim(_b("text_value")))))
        .otherwise(F.lit(False))
    )


def _outcomes() -> tuple[dict[str, str], dict[str, str], dict[str, float]]:
    """Relation, reason and confidence by `reason|same`; compared quantities get their confidence elsewhere."""
    relation, code, confidence = {}, {}, {}
    for reason, verdict in VERDICTS.items():
        for same in (True, False):
            key = f"{reason}|{str(same).lower()}"
            if verdict == "temporal_succession":
                found = ("corroborates", "restated_unchanged", 0.85) if same else ("supersedes", reason, 0.9)
            elif verdict == "aggregation_candidate":
                found = "aggregates_into", reason, 0.8
            elif reason in EXPLAINED:
                found = ("corroborates", f"value_match_despite_{reason}", 0.6) if same else ("apparent_conflict", reason, 0.85)
            elif verdict == "comparable":
                found = ("corroborates", "value_match", 0.9) if same else ("contradicts", "value_mismatch", 0.7)
            else:
                found = "unrelated", reason, 0.5
            relation[key], code[key], confidence[key] = found
    return relation, code, confidence


def adjudicate(gated: DataFrame) -> DataFrame:
    """Adds same_value, relation, relation_reason, relation_confidence, source_id and target_id to gated pairs."""
    relations_by, codes_by, confidence_by = _outcomes()
    rows = gated.withColumn("same_value", same_value())
    rows = rows.withColumn("outcome", F.concat(F.col("reason_code"), F.lit("|"), F.col("same_value").cast("string")))
    rows = rows.withColumn("relation", _constant(relations_by, F.col("outcome")))
    gap = numbers.relative_difference(_a("value"), _b("value"))
    confidence = (
        F.when((F.col("outcome") == "comparable|true") & (_a("value_kind") == "quantity"), F.least(F.lit(0.99), 0.85 + 0.14 * F.least(_a("confidence"), _b("confidence"))))
        .when((F.col("outcome") == "comparable|false") & (_a("value_kind") == "quantity"), F.round(0.6 + F.least(F.lit(0.35), gap * 2), 2))
        .otherwise(_constant(confidence_by, F.col("outcome")))
    )
    turned = (F.col("relation") == "supersedes") & (F.col("period_relation") == "precedes")
    return rows.withColumns({
        "relation_reason": _constant(codes_by, F.col("outcome")),
        "relation_confidence": confidence,
        "source_id": F.when(turned, _b("fact_id")).otherwise(_a("fact_id")),
        "target_id": F.when(turned, _a("fact_id")).otherwise(_b("fact_id")),
    })


def kept(adjudicated: DataFrame) -> DataFrame:
    """Without unrelated pairs and without a document's agreement with itself.

    One lookup of outcome and document, so that pushing the filter down copies the outcome's expression once.
    """
    stays = {f"{outcome}|{own}": relation != "unrelated" and not (own == "true" and relation == "corroborates") for outcome, relation in _outcomes()[0].items() for own in ("true", "false")}
    own = F.coalesce(_a("doc_id") == _b("doc_id"), F.lit(False)).cast("string")
    return adjudicated.where(_constant(stays, F.concat(F.col("outcome"), F.lit("|"), own)))


def relations(pairs: DataFrame) -> DataFrame:
    """The relations that a set of pairs gives, with their ids and period relation."""
    return shown(kept(adjudicate(gate(pairs))))


def shown(rows: DataFrame) -> DataFrame:
    """The columns of relations, from adjudicated pairs."""
    return rows.select(
        keys.relation_id().alias("relation_id"),
        "source_id",
        "target_id",
        "relation",
        F.col("relation_reason").alias("reason_code"),
        F.col("relation_confidence").alias("confidence"),
        "period_relation",
        "cross_issuer",
        "subject",
        "measure",
    )


def blocking(pairs: DataFrame) -> DataFrame:
    """Adds candidate and blocking_reason: the first key that the two claims don't share."""
    reason = _first({"SUBJECT": _a("subject") != _b("subject"), "MEASURE": _a("measure") != _b("measure"), "VALUE_KIND": _a("value_kind") != _b("value_kind")}, "")
    return pairs.withColumn("blocking_reason", F.nullif(reason, F.lit(""))).withColumn("candidate", F.col("blocking_reason").isNull())


def blocking_counts(claims: DataFrame, on: list[str]) -> DataFrame:
    """(candidate, blocking_reason, n): what `blocking` says of all pairs of claims that agree in `on`, from counts of groups instead of pairs.

    Pairs that differ first in a key are those that agree in all keys before it, less those that agree in it as well. Only pairs with a claim that
    lacks a key, and those of one `seq`, which count as none, are looked at one by one.
    """
    reasons = {"SUBJECT": "subject", "MEASURE": "measure", "VALUE_KIND": "value_kind"}
    columns = list(reasons.values())
    rows = saved(claims.select(*on, *columns, "seq"))
    stated = F.lit(True)
    for c in columns:
        stated = stated & F.col(c).isNotNull()
    for c in (*on, "seq"):
        rows = rows.where(F.col(c).isNotNull())
    whole, lacking = rows.where(stated), rows.where(~stated)
    counts, grouped = [], whole.groupBy(*on, *columns).agg(F.count("*").alias("n"))
    for i in reversed(range(len(columns) + 1)):
        same = grouped.groupBy(*on, *columns[:i]).agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")), F.lit(0)).alias("n"))
        # those that agree in the first i keys: of the reason of the next key, less of that of the last one
        counts.append(same.select(F.lit([*reasons, None][i]).cast("string").alias("blocking_reason"), "n"))
        if i:
            counts.append(same.select(F.lit([*reasons][i - 1]).alias("blocking_reason"), (-F.col("n")).alias("n")))

    def looked_at(a: DataFrame, b: DataFrame, which: Column, sign: int, *more: str) -> DataFrame:
        held = (*on, *more)
        found = blocking(prefixed(a, "a_", held).join(prefixed(b, "b_", held), [*held]).where(which))
        return found.groupBy("blocking_reason").agg((F.lit(sign) * F.count("*")).alias("n"))

    apart = F.col("a_seq") != F.col("b_seq")
    counts += [looked_at(lacking, whole, apart, 1), looked_at(lacking, lacking, F.col("a_seq") < F.col("b_seq"), 1)]
    again = whole.join(whole.groupBy("seq").agg(F.count("*").alias("n")).where("n > 1").select("seq"), "seq", "left_semi").withColumn("__i", F.monotonically_increasing_id())
    again = saved(again)
    counts.append(looked_at(again, again, F.col("a___i") < F.col("b___i"), -1, "seq"))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    out = out.groupBy("blocking_reason").agg(F.sum("n").alias("n")).where("n > 0")
    return out.select(F.col("blocking_reason").isNull().alias("candidate"), "blocking_reason", "n")


# --- every objection of a pair, not only the first ------------------------------------------------

DIMENSION_OF = {
    "value_kind_mismatch": "value_kind", "scope_mismatch": "scope", "forecast_disagreement": "issuer", "segment_mismatch": "segment",
    "unit_mismatch": "unit", "ambiguous_period": "period", "period_disjoint": "period", "period_overlap": "period", "basis_mismatch": "basis",
}
ACTION_OF = {d: f"align_{d}" for d in ("period", "scope", "unit", "currency", "issuer", "segment", "geography", "basis")} | {"subject": "resolve_entity", "measure": "resolve_measure", "value_kind": "resolve_value_kind"}
#: Dimensions that must not be aligned without a person.
UNSAFE = ("currency", "subject", "issuer")


def all_objections() -> Column:
    """Array of every reason that would come up if each named dimension were aligned in turn.

    The kind can't be aligned, so it ends the list; so do a period relation that itself bears a
    relation, and a period that stays unknown after it was copied. Any of these hides the basis.
    """
    found = objections()
    period = {k: found[k] for k in ("ambiguous_period", "period_disjoint", "period_overlap")}
    ends = found["temporal_succession"] | found["period_subsumption"] | (found["ambiguous_period"] & _a("period_start").isNull())
    parts = [F.when(found[k], F.lit(k)) for k in ("scope_mismatch", "forecast_disagreement", "segment_mismatch", "unit_mismatch")]
    parts += [F.when(v, F.lit(k)) for k, v in period.items()]
    parts.append(F.when(found["basis_mismatch"] & ~ends, F.lit("basis_mismatch")))
    return F.when(found["value_kind_mismatch"], F.array(F.lit("value_kind_mismatch"))).otherwise(F.array_compact(F.array(*parts)))


def refined_dimension(reason: Column) -> Column:
    """The dimension of a reason; a unit objection is the currency's if the units agree and both currencies are stated."""
    currency = _a("unit").eqNullSafe(_b("unit")) & _a("currency").isNotNull() & _b("currency").isNotNull() & (_a("currency") != _b("currency"))
    return F.when((reason == "unit_mismatch") & currency, "currency").otherwise(_constant(DIMENSION_OF, reason))


def dimension_matrix() -> Column:
    """Array of twelve structs (dimension, status, a, b)."""

    def pair(a: Column, b: Column) -> Column:
        return F.when(a.isNull() | b.isNull(), "MISSING").when(a == b, "MATCH").otherwise("MISMATCH")

    both = (_a("value_kind") == "quantity") & (_b("value_kind") == "quantity")
    stated = lambda c: F.when(c != "unknown", c)
    plain = lambda name: (pair(_a(name), _b(name)), _a(name), _b(name))
    period = (
        F.when(_a("period_kind").isNull() | _b("period_kind").isNull(), "MISSING")
        .when(F.col("period_relation") == "unknown", "AMBIGUOUS")
        .when(_a("period_label").eqNullSafe(_b("period_label")), "MATCH")
        .otherwise("MISMATCH")
    )
    rows = {
        "subject": (F.lit("MATCH"), F.col("subject"), F.col("subject")),
        "measure": (F.lit("MATCH"), F.col("measure"), F.col("measure")),
        "value_kind": plain("value_kind"),
        "period": (period, _a("period_label"), _b("period_label")),
        "unit": (F.when(both, pair(_a("unit"), _b("unit"))).otherwise("NOT_APPLICABLE"), _a("unit"), _b("unit")),
        "currency": (F.when(~both | (_a("currency").isNull() & _b("currency").isNull()), "NOT_APPLICABLE").otherwise(pair(_a("currency"), _b("currency"))), _a("currency"), _b("currency")),
        "scope": (pair(stated(_a("scope")), stated(_b("scope"))), stated(_a("scope")), stated(_b("scope"))),
        "issuer": plain("issuer"),
        "segment": plain("segment"),
        "geography": (F.lit("MISSING"), F.lit(None).cast("string"), F.lit(None).cast("string")),
        "basis": plain("basis"),
        "verification": (F.lit("UNVERIFIABLE"), F.lit("span verified; value check not evaluated"), F.lit("span verified; value check not evaluated")),
    }
    return F.array(*[F.struct(F.lit(k).alias("dimension"), s.alias("status"), a.cast("string").alias("a_value"), b.cast("string").alias("b_value")) for k, (s, a, b) in rows.items()])


def investigate(pairs: DataFrame) -> DataFrame:
    """Gate verdict, every objection with its dimension and action, and a safe conclusion, for each pair."""
    rows = gate(pairs).withColumn("objections", all_objections())
    dims = F.transform("objections", refined_dimension)
    rows = rows.withColumn("blocking", dims).withColumn("dimensions", dimension_matrix())
    actions = F.transform("blocking", lambda d: F.struct(d.alias("dimension"), _constant(ACTION_OF, d).alias("action"), (~d.isin(*UNSAFE)).alias("safe")))
    named = F.array_join("blocking", ", ")
    conclusion = (
        F.when(F.col("verdict") == "temporal_succession", "The later statement updates the earlier one.")
        .when(F.col("verdict") == "aggregation_candidate", "One figure is expected to be part of the other.")
        .when(F.col("verdict") == "comparable", "The values may be compared.")
        .when(F.col("verdict") == "ambiguous", F.concat(F.lit("Unresolved: "), named, F.lit(" could not be established.")))
        .otherwise(F.concat(F.lit("Not compared: the claims differ in "), named, F.lit(".")))
    )
    return rows.withColumns({"actions": actions, "conclusion": conclusion})


def qualifier_diff() -> Column:
    """Map of the qualifiers that differ to both values; periods differ by their labels."""
    names = {"period": "period_label", "scope": "scope", "basis": "basis", "segment": "segment", "issuer": "issuer"}
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.struct(_a(c).alias("a"), _b(c).alias("b")).alias("value")) for k, c in names.items()])
    return F.map_from_entries(F.filter(entries, lambda e: ~e["value"]["a"].eqNullSafe(e["value"]["b"])))


def confidence_label(confidence: Column, verdict: Column, verified: Column) -> Column:
    return (
        F.when(verdict == "ambiguous", "AMBIGUOUS")
        .when(verdict.startswith("incomparable"), "INCOMPARABLE")
        .when(verified & (confidence >= 0.85), "CONFIDENT")
        .when(verified & (confidence >= 0.65), "SUPPORTED")
        .otherwise("PARTIALLY VERIFIED")
    )
