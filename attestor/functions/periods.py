"""Dates and reporting periods as column expressions.

Fiscal years run from 1 April to 31 March. A single year in "FY2024" or "Q1 FY25"
names the year in which the fiscal year ends; in a range it is the first year.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import let

# Month names, and the months that each kind of "... ended" phrase spans.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
ENDED_MONTHS = {
    "year": 12, "twelve months": 12, "quarter": 3, "three months": 3,
    "half year": 6, "halfyear": 6, "six months": 6, "nine months": 9,
}

# The patterns of the four date forms and the five period phrases.
DATE_DMY = r"(\d{1,2})[\s./-](\d{1,2})[\s./-](\d{4})"
DATE_D_MONTH_Y = r"(?i)(\d{1,2})(?:st|nd|rd|th)?\s+([a-z]+),?\s+(\d{4})"
DATE_MONTH_D_Y = r"(?i)([a-z]+)\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})"
DATE_ISO = r"(\d{4})-(\d{2})-(\d{2})"
QUARTER = r"(?i)\bq([1-4])\s*(?:of\s*)?(?:f\.?y\.?)?\s*(\d{2,4})(?:\s*[-–/]\s*(\d{2,4}))?"
FISCAL_RANGE = r"(?i)\b(?:f\.?y\.?|fiscal(?:\s+year)?|financial\s+year)\s*[:\-]?\s*(\d{4})\s*[-–/]\s*(\d{2,4})"
FISCAL_SINGLE = r"(?i)\b(?:f\.?y\.?|fiscal(?:\s+year)?)\s*[:\-]?\s*(\d{4})\b"
ENDED = r"(?i)\b(year|quarter|half[\s-]?year|three\s+months|six\s+months|nine\s+months|twelve\s+months)\s+ended\s+(?:on\s+)?(.{4,30}?)(?:[,.)]|$)"
AS_ON = r"(?i)\b(?:as\s+(?:on|at|of)|w\.e\.f\.|with\s+effect\s+from|dated)\s+(.{4,30}?)(?:[,.)]|$)"


def fiscal_year(date: Column) -> Column:
    """The calendar year in which the fiscal year of `date` begins."""
    return F.year(date) - F.when(F.month(date) < 4, 1).otherwise(0)


def _day(year: Column, month: Column, day: Column) -> Column:
    """The date, or null where there is no such day."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def _month(name: Column) -> Column:
    return F.nullif(F.array_position(F.lit([m[:3] for m in MONTHS]), F.substring(F.lower(name), 1, 3)).cast("int"), F.lit(0))


def _parts(text: Column, pattern: str, order: tuple[int, ...]) -> Column:
    """The groups of the first match in the asked order, or null without one."""
    found = F.regexp_extract(text, pattern, 0)
    return F.when(found != "", F.split(F.regexp_replace(found, pattern, "\u0001".join(f"${i}" for i in order)), "\u0001"))


def parse_date(text: Column) -> Column:
    """First of d/m/Y, d Month Y, Month d Y and ISO that is a real day."""
    number = lambda p, i: F.get(p, F.lit(i)).cast("int")

    def numeric(t: Column, pattern: str, order: tuple[int, int, int]) -> Column:
        return let(_parts(t, pattern, order), lambda p: _day(number(p, 0), number(p, 1), number(p, 2)))

    def named(t: Column, pattern: str, order: tuple[int, int, int]) -> Column:
        return let(_parts(t, pattern, order), lambda p: _day(number(p, 0), _month(F.get(p, F.lit(1))), number(p, 2)))

    return let(
        F.lower(F.trim(text)),
        lambda t: F.when(
            t.rlike(r"\d"),
            F.coalesce(numeric(t, DATE_DMY, (3, 2, 1)), named(t, DATE_D_MONTH_Y, (3, 2, 1)), named(t, DATE_MONTH_D_Y, (3, 1, 2)), numeric(t, DATE_ISO, (1, 2, 3))),
        ),
    )


def _period(kind: str, start: Column, end: Column, label: Column) -> Column:
    return F.when(
        start.isNotNull() & end.isNotNull(),
        F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), label.alias("label")),
    )


def expand_year(year: Column) -> Column:
    """Two-digit years belong to the century of 2000; from 1900 on they stand as written."""
    return F.when(year >= 1900, year).otherwise(year + 2000)


def parse_period(text: Column) -> Column:
    """Struct (kind, start, end, label) of the first phrase that names a period, else null.

    In order: quarter, fiscal range, single fiscal year, "... ended D", "as on D", a bare date.
    """
    april = lambda year: F.make_date(year, F.lit(4), F.lit(1))
    march = lambda year: F.make_date(year + 1, F.lit(3), F.lit(31))
    number = lambda p, i: F.nullif(F.get(p, F.lit(i)), F.lit("")).cast("int")
    months_of = F.create_map(*[F.lit(x) for pair in ENDED_MONTHS.items() for x in pair])

    def quarter(p: Column) -> Column:
        y = expand_year(number(p, 2))
        first = F.add_months(april(F.when(F.get(p, F.lit(3)) != "", y).otherwise(y - 1)), 3 * (number(p, 1) - 1))
        return _period("duration", first, F.last_day(F.add_months(first, 2)), F.get(p, F.lit(0)))

    def ended(p: Column) -> Column:
        months = F.coalesce(F.try_element_at(months_of, F.regexp_replace(F.lower(F.get(p, F.lit(1))), "-", " ")), F.lit(12))
        return let(parse_date(F.get(p, F.lit(2))), lambda end: _period("duration", F.trunc(F.add_months(end, 1 - months), "month"), end, F.get(p, F.lit(0))))

    def first_of(t: Column) -> Column:
        year = lambda p, less: _period("duration", april(number(p, 1) - less), march(number(p, 1) - less), F.get(p, F.lit(0)))
        instant = lambda label: lambda day: _period("instant", day, day, label)
        return F.coalesce(
            let(_parts(t, QUARTER, (0, 1, 2, 3)), quarter),
            let(_parts(t, FISCAL_RANGE, (0, 1)), lambda p: year(p, 0)),
            let(_parts(t, FISCAL_SINGLE, (0, 1)), lambda p: year(p, 1)),
            let(_parts(t, ENDED, (0, 1, 2)), ended),
            let(_parts(t, AS_ON, (0, 1)), lambda p: let(parse_date(F.get(p, F.lit(1))), instant(F.get(p, F.lit(0))))),
            let(parse_date(t), instant(t)),
        )

    return let(F.trim(F.regexp_replace(text, r"\s+", " ")), lambda t: F.when(t.rlike(r"\d"), first_of(t)))


def relation(a: str, b: str) -> Column:
    """How period a lies to period b; `a` and `b` are column prefixes. `unknown` unless both have a start."""
    ak, as_, ae = (F.col(f"{a}period_{x}") for x in ("kind", "start", "end"))
    bk, bs, be = (F.col(f"{b}period_{x}") for x in ("kind", "start", "end"))
    return (
        F.when(as_.isNull() | bs.isNull(), "unknown")
        .when((ak == "instant") & (bk == "instant"), F.when(ae == be, "equal").when(ae > be, "succeeds").otherwise("precedes"))
        .when((as_ == bs) & (ae == be), "equal")
        .when((as_ <= bs) & (ae >= be), "subsumes")
        .when((bs <= as_) & (be >= ae), "subsumed_by")
        .when((ae < bs) | (be < as_), "disjoint")
        .otherwise("overlaps")
    )


def display_kind(kind: Column, start: Column, label: Column) -> Column:
    """unstated, unknown, as_of, quarter, half_year or fiscal_year; durations go by their label."""
    name = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return (
        F.when(kind.isNull(), "unstated")
        .when(start.isNull(), "unknown")
        .when(kind == "instant", "as_of")
        .when(name.rlike(r"^q\d"), "quarter")
        .when(name.contains("half") | name.startswith("h1") | name.startswith("h2"), "half_year")
        .otherwise("fiscal_year")
    )
