"""A synthetic claim corpus over any table's row numbers.

Each 12,000 numbers make a corpus of their own, of documents of 120 claims over 25 subjects and 20 measures; some 8 in 100 claims
fall on six popular pairs. Periods, scopes and values repeat in fixed cycles, so the corpus is the same on every run and in every engine, and
its clusters stay as large as they are, however long the table is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUBJECTS, MEASURES, POPULAR, PER_DOC, PER_CORPUS = 25, 20, 6, 120, 12_000

#: The claim view, with `{ids}` as a query of the numbers (seq).
CORPUS_SQL = f"""
claims as (
    select seq, concat('s', seq) as fact_id, cast(seq // {PER_DOC} as varchar) as doc_id, cast(seq % 40 + 1 as integer) as page,
        concat('subject', seq // {PER_CORPUS}, '_', case when h % 100 < 8 then h % {POPULAR} else h // 100 % {SUBJECTS} end) as subject,
        concat('measure', case when h % 100 < 8 then h % {POPULAR} else h // 2500 % {MEASURES} end) as measure,
        'quantity' as value_kind, cast(1000 + h % 9000 as decimal(30,8)) as value, 'currency' as unit, 'INR' as currency, 4 as sig_figs, cast(null as varchar) as text_value,
        'duration' as period_kind, make_date(2016 + h // 7 % 8, 4, 1) as period_start, make_date(2017 + h // 7 % 8, 3, 31) as period_end, concat('FY', 2016 + h // 7 % 8) as period_label,
        ['unknown', 'standalone', 'consolidated', 'unknown'][h // 3 % 4 + 1] as scope, 'asserted' as modality, cast(null as varchar) as issuer, cast(null as varchar) as segment, cast(null as varchar) as basis, 1.0::double as confidence
    from (select seq, (seq * 7919 + 104729) % 1000003 as h from ({{ids}}))
)"""


def corpus(ids: DataFrame) -> DataFrame:
    """Claims with the columns of the claim view, one for each number in `seq`."""
    h = (F.col("seq") * 7919 + 104729) % 1000003
    popular = h % 100 < 8
    name = lambda kind, usual: F.concat(F.lit(kind), F.when(popular, h % POPULAR).otherwise(usual).cast("string"))
    year = (F.lit(2016) + F.floor(h / 7) % 8).cast("int")
    return ids.select(
        "seq",
        F.concat(F.lit("s"), F.col("seq").cast("string")).alias("fact_id"),
        F.floor(F.col("seq") / PER_DOC).cast("string").alias("doc_id"),
        (F.col("seq") % 40 + 1).cast("int").alias("page"),
        F.concat(F.lit("subject"), F.floor(F.col("seq") / PER_CORPUS).cast("string"), name("_", F.floor(h / 100) % SUBJECTS)).alias("subject"),
        name("measure", F.floor(h / 2500) % MEASURES).alias("measure"),
        F.lit("quantity").alias("value_kind"),
        (F.lit(1000) + h % 9000).cast("decimal(30,8)").alias("value"),
        F.lit("currency").alias("unit"),
        F.lit("INR").alias("currency"),
        F.lit(4).alias("sig_figs"),
        F.lit(None).cast("string").alias("text_value"),
        F.lit("duration").alias("period_kind"),
        F.make_date(year, F.lit(4), F.lit(1)).alias("period_start"),
        F.make_date(year + 1, F.lit(3), F.lit(31)).alias("period_end"),
        F.concat(F.lit("FY"), year.cast("string")).alias("period_label"),
        F.element_at(F.lit(["unknown", "standalone", "consolidated", "unknown"]), (F.floor(h / 3) % 4 + 1).cast("int")).alias("scope"),
        F.lit("asserted").alias("modality"),
        *[F.lit(None).cast("string").alias(c) for c in ("issuer", "segment", "basis")],
        F.lit(1.0).alias("confidence"),
    )
