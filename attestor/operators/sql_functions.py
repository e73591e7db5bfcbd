"""Functions for SQL text: `register(spark)` makes them callable in `spark.sql`.

DataFrame code should use the column expressions in `attestor.functions` and `operators.verify`; these work on whole
Arrow batches with pandas and numpy, and the tests hold both against the same cases.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import numbers
from .resolve import similarity
from .verify import LITERAL, PERIOD_DIGITS

#: The rules of `verify.verdict` in order; the first that applies rules.
RULES = [
    ("none stated", "unverified", "non_numeric_value_no_deterministic_verifier"),
    ("none found", "unverified", "quote_contains_no_numeric_literal"),
    ("several", "unverified", "multiple_numeric_candidates_in_quote_ambiguous"),
    ("percent", "unverified", "percent_vs_non_percent_ambiguous"),
    ("currencies", "unverified", "currency_mismatch_no_fx_conversion"),
    ("agree", "verified", "value_matches_sole_quote_number"),
    ("one currency", "unverified", "incomplete_currency_context_magnitude_differs"),
    ("scale", "unverified", "scale_context_asymmetry_same_digits_different_scale"),
]


def _figures(literals: pd.Series) -> pd.Series:
    """Significant figures: without a point, zeros at the end don't count."""
    digits = literals.astype(object).fillna("0").astype(str).str.replace(r"[^\d.]", "", regex=True)
    point = digits.str.contains(".", regex=False)
    whole = digits.str.strip("0").str.len()
    fraction = digits.str.replace(r"^0*\.0*(?=\d*[1-9])|^0*\.(?=0*$)", "", regex=True).str.lstrip("0").str.replace(".", "", regex=False).str.len()
    zero = digits.str.fullmatch(r"0*\.?0*")
    return whole.where(~point, fraction.where(~zero, digits.str.extract(r"\.(.*)$")[0].str.len().astype("Int64").fillna(0))).clip(lower=1)


def quantities(literals: pd.Series, own: pd.Series, blob: pd.Series) -> pd.DataFrame:
    """value, unit, currency and sig_figs of literals; `own` is the text each stands in, `blob` that and its context."""
    bare = literals.str.replace(r"[,%\s]", "", regex=True)
    percent = own.str.contains("%", regex=False) | blob.str.contains("per ?cent")
    order = {t: i for i, t in enumerate(numbers._BY_LENGTH)}
    word = lambda s: s.str.findall(numbers.ANY_SCALE).map(lambda found: numbers.SCALES[min(found, key=order.get)] if found else 0)
    near, far = word(own.str.lower()), word(blob)
    factor = near.where(near > 0, far.where(far > 0, 1)).where(~percent, 1)
    currency = blob.map(lambda b: next((c for t, c in numbers.CURRENCIES.items() if t in b), None)).where(~percent, None)
    value = pd.Series([None if pd.isna(b) else Decimal(b) * int(f) for b, f in zip(bare, factor, strict=True)], bare.index, dtype=object)
    unit = np.select([percent, currency.notna()], ["percent", "currency"], "count")
    return pd.DataFrame({"value": value, "unit": unit, "currency": currency, "sig_figs": _figures(bare).astype("Int32")}, bare.index).mask(bare.isna())


def _tolerance(value: Decimal, figures: int) -> Decimal:
    return Decimal(5).scaleb(value.adjusted() - int(figures)) if value else Decimal(0)


def stated(text: pd.Series, context: pd.Series) -> pd.DataFrame:
    own, context = text.fillna("").str.strip(), context.fillna("")
    literal = own.str.replace("−", "-").str.extract(f"({numbers.NUMBER})")[0]
    return quantities(literal, own, (own + " " + context).str.lower())


def verdicts(value: pd.Series, quote: pd.Series, context: pd.Series) -> pd.DataFrame:
    value, quote, context = (c.reset_index(drop=True).fillna("") for c in (value, quote, context))
    said = stated(value, context)
    literals = quote.str.replace("−", "-").str.replace(PERIOD_DIGITS, " ", regex=True).str.findall(LITERAL).explode().dropna()
    found = quantities(literals, literals, (quote + " " + context).str.lower().loc[literals.index]).astype(object)
    several = found["value"].groupby(level=0).nunique().reindex(value.index, fill_value=0)
    only = found.groupby(level=0).first().reindex(value.index) if len(found) else pd.DataFrame(None, value.index, found.columns, dtype=object)
    pairs = list(zip(said.itertuples(index=False), only.itertuples(index=False), strict=True))
    real = [not pd.isna(a.value) and not pd.isna(b.value) for a, b in pairs]
    both = lambda test: np.array([ok and test(a, b) for ok, (a, b) in zip(real, pairs, strict=True)], bool)
    sizes = lambda a, b: sorted((abs(a.value), abs(b.value)))
    applies = {
        "none stated": said["value"].isna(),
        "none found": only["value"].isna(),
        "several": several > 1,
        "percent": both(lambda a, b: (a.unit == "percent") != (b.unit == "percent")),
        "currencies": both(lambda a, b: not pd.isna(a.currency) and not pd.isna(b.currency) and a.currency != b.currency),
        "agree": both(lambda a, b: abs(a.value - b.value) <= _tolerance(a.value, a.sig_figs) + _tolerance(b.value, b.sig_figs)),
        "one currency": both(lambda a, b: pd.isna(a.currency) != pd.isna(b.currency)),
        "scale": both(lambda a, b: sizes(a, b)[0] != 0 and sizes(a, b)[1] / sizes(a, b)[0] in set(numbers.SCALES.values())),
    }
    pick = lambda i, rest: np.select([np.asarray(applies[r[0]], bool) for r in RULES], [r[i] for r in RULES], rest)
    reason = pick(2, "value_disagrees_with_sole_quote_number")
    reason = [f"{r} ({a.currency} vs {b.currency})" if r == RULES[4][2] else r for r, (a, b) in zip(reason, pairs, strict=True)]
    return pd.DataFrame({"status": pick(1, "mismatch"), "reason": reason})


def register(spark: SparkSession) -> None:
    """Registers parse_quantity(text, context), verify_value(value, quote, context) and text_similarity(a, b)."""

    @F.pandas_udf("struct<value:decimal(30,8),unit:string,currency:string,sig_figs:int>")
    def parse_quantity(text: pd.Series, context: pd.Series) -> pd.DataFrame:
        return stated(text, context)

    @F.pandas_udf("struct<status:string,reason:string>")
    def verify(value: pd.Series, quote: pd.Series, context: pd.Series) -> pd.DataFrame:
        return verdicts(value, quote, context)

    @F.pandas_udf("double")
    def text_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    spark.udf.register("parse_quantity", parse_quantity)
    spark.udf.register("verify_value", verify)
    spark.udf.register("text_similarity", text_similarity)
