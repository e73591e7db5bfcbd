"""Reading tables, and cutting lineage through the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder for this session below `spark.checkpoint.dir`; where that is unset, below the warehouse, which all executors reach."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return context.getCheckpointDir()


#: Spark removes the shuffle files of a write as soon as it is done.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame) -> DataFrame:
    """`df` written as a table in the shared folder and read again.

    Lost executors then cost a read, not the work before it; nor is that work's shuffle needed any more.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Removes what `saved` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc32_text(column: Column) -> Column:
    """CRC-32 of the column's text form; null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")))


def sample_below(key: Column, rate: float) -> Column:
    """True for about `rate` of the keys, the same ones each time."""
    return F.pmod(F.xxhash64(key.cast("string"), F.lit("sample")), F.lit(1_000_003)) < int(rate * 1_000_003 + 1)
