"""Uploaded files as a table by content: size cap, magic bytes, safe names, and nothing read twice.

A first look lists files by their metadata alone; those seen before (same path, size and time) are left out there, so that a run
over known files reads no body. Each run appends its rows in one commit of Spark's writer, and a run that failed leaves none. Contents are told apart
by SHA-256: a file that is known under another name is a duplicate, whether from this run or an earlier one. Empty files
aren't listed by Spark and have no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as texts
from .scratch import saved

# Bytes of an upload at most, and how a document begins.
MAX_BYTES, MAGIC = 50 * 1024 * 1024, b"%PDF-"
SCHEMA = "path string, modified timestamp, length long, key string, name string, status string, run long"


class Inbox:
    """Files below `folder`, and what is known of them, in a table at `root`."""

    def __init__(self, spark: SparkSession, folder: str, root: str, max_bytes: int = MAX_BYTES, magic: bytes = MAGIC):
        self.spark, self.folder, self.root, self.max_bytes, self.magic = spark, folder, root, max_bytes, magic

    def known(self) -> DataFrame:
        """Every file that was looked at: status is `new`, `duplicate`, `too_large` or `no_document`."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(SCHEMA).parquet(self.root) if there else self.spark.createDataFrame([], SCHEMA)

    def unseen(self) -> DataFrame:
        """(path, modified, length) of the files that weren't looked at yet, from metadata alone."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.folder)
        return files.select("path", F.col("modificationTime").alias("modified"), "length").join(self.known().select("path", "modified", "length"), ["path", "modified", "length"], "left_anti")

    def look(self) -> DataFrame:
        """Looks at the unseen files and keeps what it finds; the rows of this run. Only files within the size cap are read."""
        files = saved(self.unseen())
        known = self.known()
        run = (known.agg(F.max("run")).first()[0] or 0) + 1
        small = [r["path"] for r in files.where(F.col("length") <= self.max_bytes).select("path").collect()]  # Spark lists paths on the driver as well
        body = "path string, key string, fits boolean"
        read = self.spark.createDataFrame([], body)
        if small:
            content = self.spark.read.format("binaryFile").load(small)
            read = content.select("path", F.sha2("content", 256).alias("key"), (F.substring("content", 1, len(self.magic)) == F.lit(bytearray(self.magic))).alias("fits"))
        rows = files.join(read, "path", "left").join(known.where("status = 'new'").select("key", F.lit(True).alias("old")), "key", "left")
        rows = rows.join(read.where("fits").groupBy("key").agg(F.min("path").alias("first")), "key", "left")
        status = F.when(F.col("length") > self.max_bytes, "too_large").when(~F.col("fits"), "no_document").when(F.col("old") | (F.col("first") != F.col("path")), "duplicate").otherwise("new")
        out = rows.select("path", "modified", "length", "key", texts.safe_filename(F.col("path")).alias("name"), status.alias("status"), F.lit(run).cast("long").alias("run"))
        out.write.mode("append").parquet(self.root)
        return self.known().where(F.col("run") == run)


class ParseCache:
    """What was made of a document, by its content's key and the parser's version: only what isn't there is made."""

    def __init__(self, spark: SparkSession, root: str, version: str):
        self.spark, self.root, self.version = spark, root, version

    def read(self, schema) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        rows = self.spark.read.schema(schema).parquet(self.root) if there else self.spark.createDataFrame([], schema)
        return rows.where(F.col("version") == self.version).dropDuplicates(["key"])

    def get(self, rows: DataFrame, parse, schema: str) -> DataFrame:
        """`parse`d rows (key, ...) for every key of `rows`; `parse` turns a DataFrame of the missing ones to one of `schema`, which begins with `key string`."""
        full = f"{schema}, version string"
        missing = rows.join(self.read(full).select("key"), "key", "left_anti").dropDuplicates(["key"])
        parse(missing).withColumn("version", F.lit(self.version)).write.mode("append").parquet(self.root)
        return self.read(full).join(rows.select("key").distinct(), "key", "left_semi").drop("version")
