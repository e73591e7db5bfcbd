"""Contiguous shards of near-equal bytes from a global prefix sum.

Rows are in `order` of the key (then text checksum and size). Key quantiles cut
the rows into ranges; each range's total bytes and rows are summed on the map
side, the few totals are prefix-summed, and a running sum inside each range
gives every row its global byte offset. Shard s takes the rows whose first byte
lies in the s-th of `shards` equal parts of all bytes, so a shard is a
contiguous run of rows and its size is off the mean by less than one row.

No task ever holds more than one range, and the driver sees one total per range
and one row index per shard.

Defined cases: a null text has size 1 and checksum 0; rows with a null key come
first; equal rows stand side by side in any order, as nothing tells them apart;
an empty table gives an empty result; input columns named like output columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 16
#: Ranges at most; bounds what the driver gets and what each join broadcasts.
MAX_RANGES = 2000


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus one (for a separator)."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def byte_shards(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", size: str | None = None, crc: str | None = None) -> DataFrame:
    """`docs` with size, text_crc32, shard and slot (position in its shard).

    `size` and `crc` may name columns that hold these already, so that a caller
    who needs no text doesn't have it shuffled.
    """
    spark = docs.sparkSession
    rows = docs.withColumns({
        "__size": F.col(size) if size else text_size(F.col(text)),
        "__crc": F.col(crc) if crc else F.crc32(F.coalesce(F.col(text), F.lit(""))),
    })
    ranges = max(1, min(MAX_RANGES, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    steps = [i / ranges for i in range(1, ranges)] or [0.5]
    cuts = sorted(set(docs.select(F.percentile_approx(key, steps, 20 * ranges)).first()[0] or []))
    place = F.lit(0) if not cuts else F.coalesce(F.size(F.filter(F.lit(cuts), lambda c: c <= F.col(key))), F.lit(0))
    rows = rows.withColumn("__range", place)

    totals = {r["__range"]: (r["b"], r["n"]) for r in rows.groupBy("__range").agg(F.sum("__size").alias("b"), F.count("*").alias("n")).collect()}
    offsets, total, count = [], 0, 0
    for k in range(len(cuts) + 1):
        offsets.append((k, total, count))
        b, n = totals.get(k, (0, 0))
        total, count = total + b, count + n
    before = spark.createDataFrame(offsets, "`__range` int, `__bytes` long, `__rows` long")

    inside = Window.partitionBy("__range").orderBy(F.col(key).asc_nulls_first(), "__crc", "__size").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def placed(df: DataFrame) -> DataFrame:
        # at most MAX_RANGES rows are broadcast
        df = df.withColumns({"__run": F.sum("__size").over(inside), "__nth": F.row_number().over(inside)}).join(F.broadcast(before), "__range")
        start = F.col("__bytes") + F.col("__run") - F.col("__size")
        return df.withColumns({
            "__shard": F.least(F.floor(start.cast("decimal(38,0)") * shards / F.lit(max(total, 1))).cast("int"), F.lit(shards - 1)),
            "__index": F.col("__rows") + F.col("__nth") - 1,
        })

    slim = rows.select(key, "__size", "__crc", "__range")
    first = {r["__shard"]: r["i"] for r in placed(slim).groupBy("__shard").agg(F.min("__index").alias("i")).collect()}
    starts = F.lit([first.get(s, 0) for s in range(shards)])
    out = placed(rows)
    keep = [c for c in docs.columns if c not in ("size", "text_crc32", "shard", "slot")]
    return out.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col("__size").cast("long").alias("size"),
        F.col("__crc").cast("long").alias("text_crc32"),
        F.col("__shard").alias("shard"),
        (F.col("__index") - F.get(starts, F.col("__shard"))).cast("long").alias("slot"),
    )
