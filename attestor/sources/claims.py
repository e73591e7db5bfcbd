"""The claim view over the driver's tables: one claim for each order of a customer.

Identical to `CLAIMS_SQL`, which states the same view for other engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import periods

#: Columns that describe the claim itself; the order is the one used in keys.
CLAIM_COLUMNS = [
    "seq", "fact_id", "doc_id", "page", "subject", "measure", "value_kind", "value", "unit", "currency", "sig_figs", "text_value",
    "period_kind", "period_start", "period_end", "period_label", "scope", "modality", "issuer", "segment", "basis", "confidence",
]

CLAIMS_SQL = """
claims as (
    select o_orderkey as seq, concat('o', o_orderkey) as fact_id, strftime(o_orderdate, '%Y-%m') as doc_id,
        cast(o_orderkey % 40 + 1 as integer) as page, c_name as subject, 'order_total' as measure,
        case when o_orderkey % 17 = 0 then 'text' else 'quantity' end as value_kind,
        case when o_orderkey % 17 <> 0 then cast(cast(o_totalprice as decimal(18,2)) as decimal(30,8)) end as value,
        case when o_orderkey % 17 <> 0 then 'currency' end as unit,
        case when o_orderkey % 17 = 0 then null when o_orderkey % 7 = 0 then 'USD' else 'INR' end as currency,
        case when o_orderkey % 17 <> 0 then cast(1 + o_orderkey % 4 as integer) end as sig_figs,
        case when o_orderkey % 17 = 0 then o_orderstatus end as text_value,
        case o_orderkey % 5 when 3 then 'instant' when 4 then null else 'duration' end as period_kind,
        case o_orderkey % 5
            when 0 then make_date(year(o_orderdate) - case when month(o_orderdate) < 4 then 1 else 0 end, 4, 1)
            when 1 then cast(date_trunc('quarter', o_orderdate) as date)
            when 2 then make_date(year(o_orderdate), 1, 1)
            when 3 then cast(o_orderdate as date) end as period_start,
        case o_orderkey % 5
            when 0 then make_date(year(o_orderdate) + case when month(o_orderdate) < 4 then 0 else 1 end, 3, 31)
            when 1 then cast(date_trunc('quarter', o_orderdate) + interval 3 month - interval 1 day as date)
            when 2 then make_date(year(o_orderdate), 12, 31)
            when 3 then cast(o_orderdate as date) end as period_end,
        case o_orderkey % 5
            when 0 then concat('FY', year(o_orderdate) - case when month(o_orderdate) < 4 then 1 else 0 end)
            when 1 then concat('Q', quarter(o_orderdate), ' ', year(o_orderdate))
            when 2 then concat('CY', year(o_orderdate))
            when 3 then strftime(o_orderdate, '%Y-%m-%d') end as period_label,
        case o_orderpriority when '1-URGENT' then 'standalone' when '2-HIGH' then 'consolidated' else 'unknown' end as scope,
        case o_orderstatus when 'F' then 'asserted' when 'O' then 'projected' else 'estimated' end as modality,
        case o_orderkey % 3 when 0 then 'A' when 1 then 'B' end as issuer,
        case o_orderkey % 11 when 0 then 'retail' when 1 then 'export' end as segment,
        case when o_orderkey % 13 in (0, 2) then 'audited' when o_orderkey % 13 in (1, 3) then 'unaudited' end as basis,
        case when o_orderkey % 5 = 4 then 0.9 else 1.0 end::double as confidence
    from orders join customer on o_custkey = c_custkey
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order: value, qualifiers and evidence place of the claim it makes."""
    key, date = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    text = key % 17 == 0
    year = F.year(date)
    fiscal = periods.fiscal_year(date)
    turn = key % 5
    pick = lambda fy, quarter, calendar, instant: F.when(turn == 0, fy).when(turn == 1, quarter).when(turn == 2, calendar).when(turn == 3, instant)
    quarter_start = F.trunc(date, "quarter")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("seq"),
        F.concat(F.lit("o"), key.cast("string")).alias("fact_id"),
        F.date_format("o_orderdate", "yyyy-MM").alias("doc_id"),
        (key % 40 + 1).cast("int").alias("page"),
        F.col("c_name").alias("subject"),
        F.lit("order_total").alias("measure"),
        F.when(text, "text").otherwise("quantity").alias("value_kind"),
        F.when(~text, F.col("o_totalprice").cast("decimal(18,2)").cast("decimal(30,8)")).alias("value"),
        F.when(~text, "currency").alias("unit"),
        F.when(~text, F.when(key % 7 == 0, "USD").otherwise("INR")).alias("currency"),
        F.when(~text, (1 + key % 4).cast("int")).alias("sig_figs"),
        F.when(text, F.col("o_orderstatus")).alias("text_value"),
        F.when(turn == 3, "instant").when(turn != 4, "duration").alias("period_kind"),
        pick(F.make_date(fiscal, F.lit(4), F.lit(1)), quarter_start, F.make_date(year, F.lit(1), F.lit(1)), date).alias("period_start"),
        pick(F.make_date(fiscal + 1, F.lit(3), F.lit(31)), F.date_sub(F.add_months(quarter_start, 3), 1), F.make_date(year, F.lit(12), F.lit(31)), date).alias("period_end"),
        pick(F.concat(F.lit("FY"), fiscal), F.concat(F.lit("Q"), F.quarter(date), F.lit(" "), year), F.concat(F.lit("CY"), year), F.date_format(date, "yyyy-MM-dd")).alias("period_label"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "standalone").when(F.col("o_orderpriority") == "2-HIGH", "consolidated").otherwise("unknown").alias("scope"),
        F.when(F.col("o_orderstatus") == "F", "asserted").when(F.col("o_orderstatus") == "O", "projected").otherwise("estimated").alias("modality"),
        F.when(key % 3 == 0, "A").when(key % 3 == 1, "B").alias("issuer"),
        F.when(key % 11 == 0, "retail").when(key % 11 == 1, "export").alias("segment"),
        F.when((key % 13).isin(0, 2), "audited").when((key % 13).isin(1, 3), "unaudited").alias("basis"),
        F.when(turn == 4, 0.9).otherwise(1.0).alias("confidence"),
    )
