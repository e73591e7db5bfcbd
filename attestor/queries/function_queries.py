"""Queries on the scalar functions, over text made from typed columns.

The SQL side derives what is expected from the typed columns, never by parsing.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, periods
from ..functions import text as texts
from ..sources.claims import table


def _grouped(whole):
    """A whole number in text with thousands separated by commas."""
    return F.format_number(whole, 0)


def f01_literal(spark, sf_dir):
    text = F.concat(F.lit("total of "), _grouped(F.floor("o_totalprice").cast("long")), F.lit(" in all"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.regexp_replace(numbers.number_literal(text), ",", "").cast("long").alias("number"))


def f02_parse_quantity(spark, sf_dir):
    """Order totals as "Rs. 1,234 lakh", "US$ 1234.50", "12.5%" or a bare count, by key."""
    key, whole = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    text = (
        F.when(key % 4 == 0, F.concat(F.lit("Rs. "), _grouped(whole), F.lit(" lakh")))
        .when(key % 4 == 1, F.concat(F.lit("US$ "), whole.cast("string"), F.lit(".50")))
        .when(key % 4 == 2, F.concat((key % 100).cast("string"), F.lit(".5%")))
        .otherwise(F.concat(_grouped(whole), F.lit(" units, approx")))
    )
    q = numbers.parse_quantity(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", q.alias("q")).select("o_orderkey", F.col("q.value").cast("decimal(28,2)").alias("value"), "q.unit", "q.currency")


def f03_sig_figs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", numbers.significant_figures(F.col("p_partkey").cast("string")).alias("whole"), numbers.significant_figures(F.concat(F.lit("0.0"), F.col("p_partkey").cast("string"), F.lit("0"))).alias("small"))


def f04_tolerance(spark, sf_dir):
    value = F.col("p_retailprice").cast("decimal(18,2)").cast("decimal(30,8)")
    return table(spark, sf_dir, "part").select("p_partkey", numbers.tolerance(value, F.lit(1) + F.col("p_size") % 5).cast("decimal(28,6)").alias("tolerance"))


def f05_scales(spark, sf_dir):
    words = list(numbers.SCALES)
    word = F.element_at(F.lit(words), (F.col("p_partkey") % len(words) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", numbers.scale_of(F.concat(F.lit("rs in "), word, F.lit(" only"))).cast("bigint").alias("scale"))


def f06_currency(spark, sf_dir):
    word = F.element_at(F.lit(["₹", "inr", "usd", "€", "eur", "£", "gbp", "yen"]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", numbers.currency_of(F.concat(F.lit("in "), word)).alias("currency"))


def f07_bare_year(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", numbers.is_bare_year((F.col("p_partkey") + 1000).cast("string")).alias("year"))


def f08_scale_factor(spark, sf_dir):
    a = F.col("p_size").cast("decimal(24,8)")
    b = a * F.element_at(F.lit([1, 100, 1000, 1500, 100000]), (F.col("p_partkey") % 5 + 1).cast("int")).cast("decimal(13,0)")
    return table(spark, sf_dir, "part").select("p_partkey", numbers.is_scale_factor(a.cast("decimal(20,2)"), b.cast("decimal(20,2)")).alias("explained"))


def _day():
    return F.to_date("o_orderdate")


def f20_parse_date(spark, sf_dir):
    """Order dates in five written forms, one of them no real day."""
    key = F.col("o_orderkey")
    text = (
        F.when(key % 5 == 0, F.date_format(_day(), "dd.MM.yyyy"))
        .when(key % 5 == 1, F.concat(F.date_format(_day(), "d"), F.lit("th "), F.date_format(_day(), "MMMM"), F.lit(", "), F.date_format(_day(), "yyyy")))
        .when(key % 5 == 2, F.date_format(_day(), "MMM d, yyyy"))
        .when(key % 5 == 3, F.concat(F.lit("on "), F.date_format(_day(), "yyyy-MM-dd")))
        .otherwise(F.concat(F.lit("31/02/"), F.date_format(_day(), "yyyy")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", periods.parse_date(text).alias("day"))


def f21_parse_period(spark, sf_dir):
    """Quarters, fiscal ranges and years, "... ended", "as on" and no period at all, from order dates."""
    key, year, quarter = F.col("o_orderkey"), F.year(_day()), F.quarter(_day())
    text = (
        F.when(key % 6 == 0, F.concat(F.lit("Q"), quarter, F.lit(" FY"), F.date_format(_day(), "yyyy")))
        .when(key % 6 == 1, F.concat(F.lit("FY "), year, F.lit("-"), F.substring((year + 1).cast("string"), 3, 2)))
        .when(key % 6 == 2, F.concat(F.lit("fiscal year "), year))
        .when(key % 6 == 3, F.concat(F.lit("quarter ended "), F.date_format(_day(), "d MMMM yyyy")))
        .when(key % 6 == 4, F.concat(F.lit("as on "), F.date_format(_day(), "dd.MM.yyyy")))
        .otherwise("not stated")
    )
    p = periods.parse_period(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", p.alias("p")).select("o_orderkey", "p.kind", "p.start", "p.end")


def f22_fiscal_year(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", periods.fiscal_year(_day()).alias("fiscal_year"))


def f25_expand_year(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", periods.expand_year((F.col("p_partkey") % 100).cast("int")).alias("short"), periods.expand_year((1900 + F.col("p_partkey") % 200).cast("int")).alias("long"))


def f30_entity(spark, sf_dir):
    name = F.concat(F.lit("Shri "), F.upper(F.col("s_name")), F.element_at(F.lit([" Pvt. Ltd.", " LIMITED", ", Inc.", " & Co."]), (F.col("s_suppkey") % 4 + 1).cast("int")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", texts.normalize_entity(name).alias("entity"))


def f31_address(spark, sf_dir):
    text = F.concat(F.lit("No. "), F.col("s_suppkey"), F.lit(", II Cross Rd, Bangalore - 560 "), F.lpad((F.col("s_suppkey") % 1000).cast("string"), 3, "0"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", texts.normalize_address(text).alias("address"))


def u06_jaccard(spark, sf_dir):
    a = F.concat(F.lit("alpha beta w"), F.col("s_suppkey") % 3)
    b = F.concat(F.lit("beta w1 w"), F.col("s_suppkey") % 5)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(texts.jaccard(a, b), 6).alias("similarity"))


def f32_scope(spark, sf_dir):
    text = F.concat(F.lit("The "), F.element_at(F.lit(["Unconsolidated", "standalone", "Separate Financial", "segment", "other"]), (F.col("s_suppkey") % 5 + 1).cast("int")), F.lit(" results"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", texts.detect_scope(text).alias("scope"))


def f33_basis(spark, sf_dir):
    text = F.concat(F.lit("The "), F.element_at(F.lit(["Unaudited", "audited", "restated and reviewed", "provisional", "other"]), (F.col("s_suppkey") % 5 + 1).cast("int")), F.lit(" results"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", texts.detect_basis(text).alias("basis"))


def f34_lookup_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", texts.lookup_key(F.concat(F.lit("  "), F.col("p_name"), F.lit(" / (Net) "))).alias("key"))


def f35_slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", texts.slug(F.concat(F.lit("  "), F.col("p_type"), F.lit(" - (Net)!"))).alias("slug"))


def f36_one_spaced(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", texts.one_spaced(F.concat(F.lit(" \t"), F.regexp_replace("p_name", " ", "  \n "), F.lit("  "))).alias("text"))


def f40_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(texts.tokens(F.col("text"))).alias("n_tokens"))


def f42_edge_line(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", texts.edge_line(F.concat(F.lit("Page "), F.col("c_custkey"), F.lit("  of 99"))).alias("line"))


def f43_number_cell(spark, sf_dir):
    text = F.element_at(F.lit(["(1,234.5)", "12%", "abc", "12 abc", "₹ 5", "-7"]), (F.col("s_suppkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", texts.is_number_cell(text).alias("number"))


def f47_filename(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", texts.safe_filename(F.concat(F.lit("../a/"), F.col("s_name"), F.lit("?x"))).alias("name"))


QUERIES = {
    "F-01_literal": f01_literal, "F-02_parse_quantity": f02_parse_quantity, "F-03_sig_figs": f03_sig_figs, "F-04_tolerance": f04_tolerance,
    "F-05_scales": f05_scales, "F-06_currency": f06_currency, "F-07_bare_year": f07_bare_year, "F-08_scale_factor": f08_scale_factor,
    "F-20_parse_date": f20_parse_date, "F-21_parse_period": f21_parse_period, "F-22_fiscal_year": f22_fiscal_year, "F-25_expand_year": f25_expand_year,
    "F-30_entity": f30_entity, "F-31_address": f31_address, "U-06_jaccard": u06_jaccard, "F-32_scope": f32_scope, "F-33_basis": f33_basis,
    "F-34_lookup_key": f34_lookup_key, "F-35_slug": f35_slug, "F-36_one_spaced": f36_one_spaced, "F-40_tokens": f40_tokens, "F-42_edge_line": f42_edge_line,
    "F-43_number_cell": f43_number_cell, "F-47_filename": f47_filename,
}

_D = "cast(o_orderdate as date)"
_Y = "year(o_orderdate)"
_FY = "(year(o_orderdate) - case when month(o_orderdate) < 4 then 1 else 0 end)"
# quarter q of the fiscal year that ends in the order's year
_QS = f"cast(make_date({_Y} - 1, 4, 1) + to_months(cast(3 * (quarter(o_orderdate) - 1) as integer)) as date)"
_QE = f"cast(make_date({_Y} - 1, 4, 1) + to_months(cast(3 * quarter(o_orderdate) as integer)) - interval 1 day as date)"

SQL = {
    "F-01_literal": "select o_orderkey, cast(floor(o_totalprice) as bigint) as number from orders",
    "F-02_parse_quantity": """select o_orderkey, cast(case o_orderkey % 4 when 0 then floor(o_totalprice) * 100000 when 1 then floor(o_totalprice) + 0.5
        when 2 then o_orderkey % 100 + 0.5 else floor(o_totalprice) end as decimal(28,2)) as value,
        case o_orderkey % 4 when 2 then 'percent' when 3 then 'count' else 'currency' end as unit,
        case o_orderkey % 4 when 0 then 'INR' when 1 then 'USD' end as currency from orders""",
    "F-03_sig_figs": "select p_partkey, cast(greatest(1, length(rtrim(cast(p_partkey as varchar), '0'))) as integer) as whole, cast(case when p_partkey = 0 then 3 else length(cast(p_partkey as varchar)) + 1 end as integer) as small from part",
    "F-04_tolerance": "select p_partkey, cast(5 * power(10, floor(log10(p_retailprice)) - (1 + p_size % 5)) as decimal(28,6)) as tolerance from part",
    "F-05_scales": "with w as (select [" + ", ".join(str(v) for v in numbers.SCALES.values()) + f"] as v) select p_partkey, cast(v[p_partkey % {len(numbers.SCALES)} + 1] as bigint) as scale from part, w",
    "F-06_currency": "select p_partkey, (['INR', 'INR', 'USD', 'EUR', 'EUR', 'GBP', 'GBP', null])[p_partkey % 8 + 1] as currency from part",
    "F-07_bare_year": "select p_partkey, p_partkey + 1000 between 1990 and 2035 as year from part",
    "F-08_scale_factor": "select p_partkey, p_partkey % 5 in (1, 2, 4) as explained from part",
    "F-20_parse_date": f"select o_orderkey, case when o_orderkey % 5 < 4 then {_D} end as day from orders",
    "F-21_parse_period": f"""select o_orderkey, case when o_orderkey % 6 < 4 then 'duration' when o_orderkey % 6 = 4 then 'instant' end as kind,
        case o_orderkey % 6 when 0 then {_QS} when 1 then make_date({_Y}, 4, 1) when 2 then make_date({_Y} - 1, 4, 1) when 3 then cast(date_trunc('month', {_D}) - interval 2 month as date) when 4 then {_D} end as start,
        case o_orderkey % 6 when 0 then {_QE} when 1 then make_date({_Y} + 1, 3, 31) when 2 then make_date({_Y}, 3, 31) when 3 then {_D} when 4 then {_D} end as "end" from orders""",
    "F-22_fiscal_year": f"select o_orderkey, cast({_FY} as integer) as fiscal_year from orders",
    "F-25_expand_year": "select p_partkey, cast(2000 + p_partkey % 100 as integer) as short, cast(1900 + p_partkey % 200 as integer) as long from part",
    "F-30_entity": "select s_suppkey, trim(concat(lower(regexp_replace(regexp_replace(s_name, '[^a-zA-Z0-9_.&-]+', ' ', 'g'), '[.&,-]+', ' ', 'g')), '')) as entity from supplier",
    "F-31_address": "select s_suppkey, array_to_string(list_sort(list_distinct(['2', cast(s_suppkey as varchar), concat('560', lpad(cast(s_suppkey % 1000 as varchar), 3, '0')), 'bengaluru', 'cross', 'road'])), ' ') as address from supplier",
    "U-06_jaccard": "select s_suppkey, round(len(list_intersect(['alpha', 'beta', concat('w', s_suppkey % 3)], ['beta', 'w1', concat('w', s_suppkey % 5)])) / len(list_distinct(['alpha', 'beta', concat('w', s_suppkey % 3), 'w1', concat('w', s_suppkey % 5)])), 6) as similarity from supplier",
    "F-32_scope": "select s_suppkey, (['consolidated', 'standalone', 'standalone', 'segment', 'unknown'])[s_suppkey % 5 + 1] as scope from supplier",
    "F-33_basis": "select s_suppkey, (['unaudited', 'audited', 'restated', 'provisional', null])[s_suppkey % 5 + 1] as basis from supplier",
    "F-34_lookup_key": "select p_partkey, concat(trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9_ ]', ' ', 'g'), ' +', ' ', 'g')), ' net') as key from part",
    "F-35_slug": "select p_partkey, concat(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_net') as slug from part",
    "F-36_one_spaced": "select p_partkey, trim(regexp_replace(p_name, ' +', ' ', 'g')) as text from part",
    "F-40_tokens": "select doc_id, cast(len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) as integer) as n_tokens from documents",
    "F-42_edge_line": "select c_custkey, 'page # of #' as line from customer",
    "F-43_number_cell": "select s_suppkey, s_suppkey % 6 not in (2, 3) as number from supplier",
    "F-47_filename": "select s_suppkey, concat(regexp_replace(s_name, '[^A-Za-z0-9._ -]', '_', 'g'), '_x.pdf') as name from supplier",
}
