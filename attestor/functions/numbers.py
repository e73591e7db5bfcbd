"""Quantities as written in text: value, scale, unit, currency, precision.

Values are DECIMAL(30,8) in base units. A literal with more than eight decimals is
out of range and gives null rather than a rounded value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a scale word multiplies by.
SCALES = {
    "hundred": 100, "thousand": 1_000, "k": 1_000, "lac": 100_000, "lakh": 100_000, "lakhs": 100_000, "lakhs.": 100_000,
    "million": 1_000_000, "mn": 1_000_000, "mm": 1_000_000, "crore": 10_000_000, "crores": 10_000_000, "cr": 10_000_000,
    "cr.": 10_000_000, "billion": 1_000_000_000, "bn": 1_000_000_000, "trillion": 1_000_000_000_000,
}

# The first of these found as a substring names the currency ("rs" also inside other words).
CURRENCIES = {
    "₹": "INR", "rs": "INR", "rs.": "INR", "inr": "INR", "rupees": "INR", "$": "USD", "us$": "USD", "usd": "USD",
    "dollars": "USD", "€": "EUR", "eur": "EUR", "£": "GBP", "gbp": "GBP",
}

NUMBER = r"[-+]?\d[\d,]*\.?\d*"
VALUE = "decimal(30,8)"


def number_literal(text: Column) -> Column:
    """The first number as written, with U+2212 read as a minus; null if there is none."""
    return F.nullif(F.regexp_extract(F.translate(F.trim(text), "−", "-"), NUMBER, 0), F.lit(""))


def significant_figures(literal: Column) -> Column:
    """Digits that the writer vouches for: trailing zeros count after a point, not before one."""
    digits = F.regexp_replace(F.regexp_replace(literal, "[,+]", ""), "^-+", "")
    whole, part = F.substring_index(digits, ".", 1), F.regexp_extract(digits, r"\.(.*)$", 1)
    lead = F.regexp_replace(whole, "^0+", "")
    small = F.regexp_replace(part, "^0+", "")
    decimal = F.when(lead != "", F.length(lead) + F.length(part)).otherwise(F.length(F.when(small == "", part).otherwise(small)))
    integer = F.length(F.regexp_replace(F.regexp_replace(digits, "0+$", ""), "^0+", ""))
    return F.greatest(F.when(digits.contains("."), decimal).otherwise(integer), F.lit(1)).cast("int")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` worked out once for a row, however often `use` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Longest first, so that of the words in a text the first of this list counts.
_BY_LENGTH = sorted(SCALES, key=lambda t: -len(t))
ANY_SCALE = r"(?<![a-z])(?:" + "|".join(t.replace(".", r"\.") for t in _BY_LENGTH) + r")(?![a-z])"


def scale_of(text: Column) -> Column:
    """The factor of the longest scale word in `text` (lower case), else null."""
    words, factors = F.lit(_BY_LENGTH), F.lit([SCALES[t] for t in _BY_LENGTH]).cast("array<decimal(13,0)>")
    first = F.array_min(F.transform(F.regexp_extract_all(text, F.lit(ANY_SCALE), F.lit(0)), lambda w: F.array_position(words, w)))
    return F.get(factors, (first - 1).cast("int"))


def currency_of(text: Column) -> Column:
    """The code of the first currency token that `text` contains, else null."""
    tokens = F.filter(F.lit(list(CURRENCIES)), lambda t: F.contains(text, t))
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in CURRENCIES.items() for x in pair]), F.get(tokens, F.lit(0)))


def parse_quantity(text: Column, context: Column | None = None) -> Column:
    """Struct (value, unit, currency, sig_figs, raw), or null without a number.

    A percent sign or word makes a percentage, which is never scaled. Otherwise a scale word
    in the text itself wins over one in the context.
    """
    context = F.lit("") if context is None else F.coalesce(context, F.lit(""))
    raw = F.trim(text)

    def with_blob(blob: Column, literal: Column) -> Column:
        bare = F.regexp_replace(literal, ",", "")
        value = F.when(F.length(F.substring_index(bare, ".", -1)) <= F.when(bare.contains("."), 8).otherwise(99), bare.try_cast("decimal(24,8)"))
        percent = raw.contains("%") | blob.contains("per cent") | blob.contains("percent")
        scale = F.coalesce(scale_of(F.lower(raw)), scale_of(blob), F.lit(1).cast("decimal(13,0)"))
        fields = let(
            F.struct(value.alias("value"), percent.alias("percent"), F.when(~percent, currency_of(blob)).alias("currency")),
            lambda x: F.when(
                x["value"].isNotNull(),
                F.struct(
                    F.when(x["percent"], x["value"].cast(VALUE)).otherwise((x["value"] * scale).cast(VALUE)).alias("value"),
                    F.when(x["percent"], "percent").when(x["currency"].isNotNull(), "currency").otherwise("count").alias("unit"),
                    x["currency"].alias("currency"),
                    significant_figures(literal).alias("sig_figs"),
                    raw.alias("raw"),
                ),
            ),
        )
        return F.when(literal.isNotNull(), fields)

    found = F.struct(F.lower(F.concat(raw, F.lit(" "), context)).alias("blob"), number_literal(text).alias("literal"))
    return let(found, lambda x: with_blob(x["blob"], x["literal"]))


def tolerance(value: Column, sig_figs: Column) -> Column:
    """Half a unit of the last stated digit, exact; 0 for 0."""
    size = F.abs(value)
    whole = F.length(F.floor(size).cast("string"))
    zeros = F.length(F.regexp_extract(size.cast("string"), r"\.(0*)", 1))
    exponent = F.when(size >= 1, whole - 1).otherwise(-zeros - 1)
    return F.when(value == 0, F.lit(0).cast("decimal(30,9)")).otherwise(F.concat(F.lit("5E"), (exponent - sig_figs).cast("string")).cast("decimal(30,9)"))


def values_agree(a_value: Column, a_figs: Column, b_value: Column, b_figs: Column) -> Column:
    """Whether two values differ by no more than both tolerances together."""
    return F.abs(a_value - b_value) <= tolerance(a_value, a_figs) + tolerance(b_value, b_figs)


def relative_difference(a: Column, b: Column) -> Column:
    """|a - b| over the larger of both sizes, as a double; 0 if both are 0."""
    most = F.greatest(F.abs(a), F.abs(b)).cast("double")
    return F.when(most == 0, 0.0).otherwise(F.abs(a - b).cast("double") / most)


def is_bare_year(literal: Column) -> Column:
    """Four digits between 1990 and 2035: a year or a page footer, no measurement."""
    text = F.trim(literal)
    return text.rlike(r"^\d{4}$") & text.try_cast("int").between(1990, 2035)


def is_scale_factor(a: Column, b: Column) -> Column:
    """Whether the larger value is exactly a scale word's factor times the smaller one."""
    big, small = F.greatest(F.abs(a), F.abs(b)), F.least(F.abs(a), F.abs(b))
    hit = F.lit(False)
    for factor in sorted(set(SCALES.values())):
        hit = hit | (big == small * F.lit(factor).cast("decimal(13,0)"))
    return (small != 0) & hit


def short_number(value: Column) -> Column:
    """1.2B, 3.4M, or the number itself."""
    size = F.abs(value)
    return (
        F.when(size >= 1_000_000_000, F.concat(F.format_number(value / 1_000_000_000, 1), F.lit("B")))
        .when(size >= 1_000_000, F.concat(F.format_number(value / 1_000_000, 1), F.lit("M")))
        .otherwise(F.format_number(value, 0))
    )
