"""What stands behind a claim, and how claims are shown: verified states, references to evidence, short texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Results of the value check that confirm a claim; characters of a short quote.
VERIFIED = ("verified", "verified_with_context")
QUOTE_CHARS = 120


def is_verified(span_verified: Column, value_check: Column) -> Column:
    """Whether both the span and the value were confirmed; a value check that was never made confirms nothing."""
    return F.coalesce(span_verified & value_check.isin(*VERIFIED), F.lit(False))


def evidence_references(pairs: DataFrame, evidence: DataFrame) -> DataFrame:
    """`pairs` (a_fact_id, b_fact_id) with a_evidence and b_evidence: structs of role, fact_id, available, and the evidence's place, quote and checks.

    `evidence` has a row for each claim that has any: fact_id, doc_id, page, quote, char_start, char_end, verified, value_check.
    """
    shown = ["doc_id", "page", "quote", "char_start", "char_end", "verified"]
    for side in ("a", "b"):
        found = evidence.select(F.col("fact_id").alias("__fact"), F.struct(*shown, F.nullif("value_check", F.lit("")).alias("value_check")).alias("__e"))
        key = F.col(f"{side}_fact_id")
        pairs = pairs.join(found, key == F.col("__fact"), "left")
        reference = F.struct(F.lit(side).alias("role"), key.alias("fact_id"), F.col("__e").isNotNull().alias("available"), *[F.col(f"__e.{c}").alias(c) for c in (*shown, "value_check")])
        pairs = pairs.withColumn(f"{side}_evidence", reference).drop("__fact", "__e")
    return pairs


def short_quote(quote: Column, limit: int = QUOTE_CHARS) -> Column:
    """The quote without outer blanks; a longer one ends in an ellipsis and has `limit` characters."""
    text = F.trim(F.coalesce(quote, F.lit("")))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 1), F.lit("…")))


def value_display(raw: Column, value: Column, currency: Column, unit: Column) -> Column:
    """The value as written (else as a number), then its currency, else its unit."""
    text = F.coalesce(F.nullif(raw, F.lit("")), value.cast("string"), F.lit(""))
    return F.trim(F.concat_ws(" ", text, F.coalesce(F.nullif(currency, F.lit("")), F.nullif(unit, F.lit("")))))


def subtitle(display: Column, period_label: Column, scope: Column) -> Column:
    """Value, period and scope, as far as they are stated."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws(" · ", some(display), some(period_label), F.when(scope != "unknown", some(scope)))


def by_category(results: DataFrame) -> DataFrame:
    """(category, passed, total) of cases (category, passed); a case without an answer has failed."""
    return results.groupBy("category").agg(F.count_if(F.coalesce("passed", F.lit(False))).alias("passed"), F.count("*").alias("total"))
