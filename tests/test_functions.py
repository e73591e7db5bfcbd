import time
from datetime import date
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from attestor.functions import numbers, periods
from attestor.functions import text as texts
from attestor.operators import sql_functions, verify


def one(spark, column, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,context,value,unit,currency",
    [
        ("12,040", "Rs. in lakhs", "1204000000", "currency", "INR"),
        ("Rs. 120.4 Cr", "", "1204000000", "currency", "INR"),
        ("6.5%", "in crore", "6.5", "percent", None),
        ("−0.4", "percent", "-0.4", "percent", None),
        ("$ 3.5 million", "", "3500000", "currency", "USD"),
        ("1,20,000 units", "", "120000", "count", None),
        ("2 bn", "5 lakh", "2000000000", "count", None),
        ("7 dollars", "", "7", "currency", "INR"),  # "rs" inside "dollars" is found first
        ("no number", "", None, None, None),
        ("0.123456789", "", None, None, None),  # more decimals than are held
    ],
)
def test_parse_quantity(spark, text, context, value, unit, currency):
    q = one(spark, numbers.parse_quantity, text, context)
    twin = sql_functions.stated(pd.Series([text]), pd.Series([context])).iloc[0]
    if value is None:
        assert q is None
        return
    assert (q["value"], q["unit"], q["currency"]) == (Decimal(value), unit, currency)
    assert (twin["value"], twin["unit"], twin["currency"], twin["sig_figs"]) == (Decimal(value), unit, currency, q["sig_figs"])


@pytest.mark.parametrize("text,n", [("120.4", 4), ("1,20,000", 2), ("12,040", 4), ("0.0500", 3), ("0", 1), ("-7.50", 3), ("0.00", 2), ("100.0", 4), ("007", 1)])
def test_significant_figures(spark, text, n):
    assert one(spark, numbers.significant_figures, text) == n == sql_functions._figures(pd.Series([text]))[0]


@pytest.mark.parametrize("value,n,expected", [("1204000000", 4, "500000"), ("0", 3, "0"), ("0.05", 1, "0.005"), ("999999", 1, "50000"), ("1000000", 1, "500000"), ("6.5", 2, "0.05")])
def test_tolerance_is_exact(spark, value, n, expected):
    got = one(spark, lambda v: numbers.tolerance(v.cast("decimal(30,8)"), F.lit(n)), value)
    assert got == Decimal(expected) == sql_functions._tolerance(Decimal(value), n)


@pytest.mark.parametrize(
    "text,expected",
    [
        ("31.03.2025", date(2025, 3, 31)),
        ("31/02/2025", None),
        ("12th March, 2024", date(2024, 3, 12)),
        ("Mar 5, 2021", date(2021, 3, 5)),
        ("2020-02-29", date(2020, 2, 29)),
        ("on 1 Foo 2020 or 2020-01-02", date(2020, 1, 2)),
        ("nothing", None),
    ],
)
def test_parse_date(spark, text, expected):
    assert one(spark, periods.parse_date, text) == expected


@pytest.mark.parametrize(
    "text,kind,start,end",
    [
        ("FY2023-24", "duration", date(2023, 4, 1), date(2024, 3, 31)),
        ("FY2024", "duration", date(2023, 4, 1), date(2024, 3, 31)),
        ("Q1 FY25", "duration", date(2024, 4, 1), date(2024, 6, 30)),
        ("Q1 FY2024-25", "duration", date(2024, 4, 1), date(2024, 6, 30)),
        ("Q4 FY2024", "duration", date(2024, 1, 1), date(2024, 3, 31)),
        ("year ended 31 March 2024", "duration", date(2023, 4, 1), date(2024, 3, 31)),
        ("six months ended 30 September 2024", "duration", date(2024, 4, 1), date(2024, 9, 30)),
        ("as on 31.03.2024", "instant", date(2024, 3, 31), date(2024, 3, 31)),
        ("w.e.f. 12-03-2025", "instant", date(2025, 3, 12), date(2025, 3, 12)),
        ("5 May 2020", "instant", date(2020, 5, 5), date(2020, 5, 5)),
    ],
)
def test_parse_period(spark, text, kind, start, end):
    p = one(spark, periods.parse_period, text)
    assert (p["kind"], p["start"], p["end"]) == (kind, start, end)


def test_unparsed_periods_are_null(spark):
    assert one(spark, periods.parse_period, "the last year or so") is None


def test_names_and_addresses(spark):
    assert one(spark, texts.normalize_entity, "Acme Technologies Pvt. Ltd.") == one(spark, texts.normalize_entity, "ACME TECHNOLOGIES PRIVATE LIMITED") == "acme technologies"
    assert one(spark, texts.normalize_entity, "Dr. A. B. Shah") == "a b shah"
    assert one(spark, texts.address_similarity, "No. 12, 2nd Cross, Indiranagar, Bengaluru 560038", "12, II Cross Rd, Indira Nagar, Bangalore - 560 038") > 0.7
    assert one(spark, texts.detect_scope, "Unconsolidated") == "consolidated" and one(spark, texts.detect_basis, "Unaudited") == "unaudited"
    assert one(spark, texts.slug, "  % Change! ") == "change" and one(spark, texts.slug, "--") == "unknown"
    assert one(spark, texts.safe_filename, "../../etc/pass wd?.PDF") == "pass wd_.PDF"


@pytest.mark.parametrize(
    "value,quote,context,status",
    [
        ("₹120.4 crore", "revenue of ₹145.9 crore", "", "mismatch"),
        ("₹120.4 crore", "revenue of ₹120.4 crore in FY2023-24", "", "verified"),
        ("6.5%", "growth of 6.5 percent in FY2024/25", "", "verified"),
        ("−0.4 percent", "a fall of −0.4 percent", "", "verified"),
        ("120", "120 and 130", "", "unverified"),
        ("5 crore", "5 lakh", "", "unverified"),
        ("active", "the firm is active", "", "unverified"),
        ("$ 5", "€ 5", "", "unverified"),
        ("12", "it stood there in FY24", "", "unverified"),
    ],
)
def test_verify_value(spark, value, quote, context, status):
    row = verify.check_values(spark.createDataFrame([(value, quote, context)], "value_raw string, quote string, context string")).first()
    assert row["status"] == status
    again = sql_functions.verdicts(pd.Series([value]), pd.Series([quote]), pd.Series([context])).iloc[0]
    assert (again["status"], again["reason"]) == (row["status"], row["reason"])


def test_reasons_and_odd_input_of_verification(spark):
    cases = [
        (None, None, None, "non_numeric_value_no_deterministic_verifier"), ("5", None, "", "quote_contains_no_numeric_literal"), ("5", "", None, "quote_contains_no_numeric_literal"),
        ("5%", "it was 5", "", "percent_vs_non_percent_ambiguous"), ("$ 5", "€ 5", "", "currency_mismatch_no_fx_conversion (USD vs EUR)"), ("₹ 7", "it was 9", "", "incomplete_currency_context_magnitude_differs"),
        ("5 crore", "5 lakh", "", "scale_context_asymmetry_same_digits_different_scale"), ("12", "12 on 5 May 2020, 12.0 since", "", "value_matches_sole_quote_number"),
        ("31", "31 on 45/13/2020", "", "multiple_numeric_candidates_in_quote_ambiguous"), ("8", "19", "", "value_disagrees_with_sole_quote_number"),
    ]
    rows = spark.createDataFrame([c[:3] for c in cases], "value_raw string, quote string, context string")
    assert [r["reason"] for r in verify.check_values(rows).collect()] == [c[3] for c in cases]
    assert sql_functions.verdicts(*(pd.Series([c[i] for c in cases], dtype=object) for i in range(3)))["reason"].tolist() == [c[3] for c in cases]


def test_cell_only_strengthens_a_match(spark):
    rows = [("12", "12", "", cell, "", labelled) for cell, labelled in (("12", True), ("15", True), ("12", False), (None, None))]
    got = verify.check_values(spark.createDataFrame(rows, "value_raw string, quote string, context string, cell string, cell_unit string, labelled boolean")).collect()
    assert [r["status"] for r in got] == ["verified_with_context", "verified", "verified", "verified"]


def test_fuzzy_spans_in_long_pages():
    page = " ".join(f"word{i} stands{i * 7 % 13}" for i in range(20000))
    quote = page[150_000:150_120].strip()
    wrong = quote[:40] + "x" + quote[41:90] + quote[92:]
    began = time.time()
    start, end, ratio = verify.fuzzy_span(wrong, page)
    assert abs(start - 150_000) <= 2 and abs(end - 150_120) <= 2 and ratio > 0.97 and time.time() - began < 5
    assert verify.fuzzy_span("", page) is None and verify.fuzzy_span("zzzz yyyy", page) is None and verify.fuzzy_span("ab", "") is None


def test_spans():
    text = "Total\n revenue   was 3,809.88 in\tall."
    assert text[slice(*verify.exact_span("revenue was 3,809.88", text))] == "revenue   was 3,809.88"
    assert verify.exact_span("no such", text) is None
    assert verify.fuzzy_span("revenue was 3,809.89 in", text)[2] >= 0.92
    assert verify.cover_numbers(text, 8, 20, "was 3809.88") == (8, text.index("3,809.88") + 8)
    assert verify.cover_numbers(text, 8, 20, "was 92.00") is None
