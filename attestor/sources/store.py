"""A claim store of Parquet tables in versioned snapshots.

Each version is a manifest, `root/manifests/<n>`, that names the folders of every table. A
new version only writes what changes and names the rest again, so that claims, vectors and index texts
share a store. A manifest is written beside its place and renamed to a name that nobody has used, which is one step
in a file system: readers see the old state or the new one, and a writer that loses a race fails.
All access goes through Spark's file systems, so the root may lie in any store that Spark reads.
"""

from __future__ import annotations

import json
import uuid
from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as texts
from ..operators import retrieval

#: Tables and their natural keys.
TABLES = {
    "documents": ["doc_id"],
    "facts": ["fact_id"],
    "fact_evidence": ["fact_id", "doc_id", "page", "span"],
    "relations": ["source_id", "target_id", "relation"],
    "rejected_facts": [],
    "resolution_log": [],
    "measure_registry": ["canonical"],
}

SCHEMAS = {
    "documents": T.StructType().add("doc_id", "string", False).add("filename", "string").add("content_sha256", "string"),
    "measure_registry": T.StructType().add("canonical", "string", False).add("example", "string"),
    "rejected_facts": T.StructType().add("raw_fact", "string").add("doc_id", "string").add("page", "integer").add("reason", "string").add("detail", "string"),
    "resolution_log": T.StructType().add("kind", "string").add("raw", "string").add("canonical", "string").add("tier", "string").add("confidence", "double").add("detail", "string"),
}


class FactStore(ABC):
    """What a store must do; callers may bring their own."""

    supports_incremental_save = False

    @abstractmethod
    def load(self) -> dict[str, DataFrame]: ...

    @abstractmethod
    def save(self, tables: dict[str, DataFrame]) -> None: ...

    def save_new(self, tables: dict[str, DataFrame]) -> None:
        raise NotImplementedError

    def list_rejected(self, reason: str | None = None, limit: int = 100) -> DataFrame:
        rows = self.load()["rejected_facts"]
        return (rows if reason is None else rows.where(F.col("reason") == reason)).limit(limit)

    def resolution_summary(self) -> DataFrame:
        return self.load()["resolution_log"].groupBy("tier").agg(F.count("*").alias("n"))


class ParquetStore(FactStore):
    """Snapshots as described in this module; a missing root is an empty store."""

    supports_incremental_save = True

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}")

    def version(self) -> int:
        """The snapshot that is read; 0 if there is none."""
        if not self._fs.exists(self._path("manifests")):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path("manifests"))]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict[str, list[str]]:
        """The folders of each table, below the root."""
        version = self.version() if version is None else version
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{version}").first()[0]) if version else {}

    def _publish(self, version: int, manifest: dict[str, list[str]]) -> None:
        draft, place = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/{version}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(place) or not self._fs.rename(draft, place):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {version} was written by another ingest meanwhile")

    def _write(self, df: DataFrame, path: str) -> None:
        df.write.parquet(path)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(*paths)

    def commit(self, new: dict[str, DataFrame] | None = None, more: dict[str, DataFrame] | None = None, only: bool = False) -> int:
        """Publishes a version in which the tables of `new` are replaced and those of `more` get further rows.

        The other tables stay, or, with `only`, just those that are no claim tables. Returns the version.
        """
        version = self.version()
        manifest = {k: v for k, v in self.manifest(version).items() if not only or k not in TABLES}
        for added, tables in ((False, new or {}), (True, more or {})):
            for name, df in tables.items():
                folder = f"data/{version + 1}-{uuid.uuid4().hex}/{name}"
                self._write(df, f"{self.root}/{folder}")
                manifest[name] = [*(manifest.get(name, []) if added else []), folder]
        self._publish(version + 1, manifest)
        return version + 1

    def table(self, name: str) -> DataFrame | None:
        paths = self.manifest().get(name)
        return self._read([f"{self.root}/{p}" for p in paths]) if paths else None

    def load(self) -> dict[str, DataFrame]:
        manifest, found = self.manifest(), {}
        for name in TABLES:
            if name in manifest:
                found[name] = self._read([f"{self.root}/{p}" for p in manifest[name]])
            elif name in SCHEMAS:
                found[name] = self.spark.createDataFrame([], SCHEMAS[name])
        return found

    def save(self, tables: dict[str, DataFrame]) -> None:
        """The whole store anew; index tables stay."""
        self.commit(new=tables, only=True)

    def upsert(self, tables: dict[str, DataFrame]) -> None:
        """A new snapshot in which the given rows replace those of the same natural key."""
        old = self.load()
        merged = dict(old)
        for name, new in tables.items():
            keys = TABLES[name]
            if name not in old:
                merged[name] = new
            elif keys:
                merged[name] = old[name].join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)
            else:
                merged[name] = old[name].unionByName(new, allowMissingColumns=True)
        self.save(merged)

    def save_new(self, tables: dict[str, DataFrame]) -> None:
        """Adds one ingest's rows to all tables in one step."""
        self.commit(more=tables)

    def delete_facts(self, fact_ids: DataFrame) -> None:
        """Removes claims with their evidence and relations, in a new snapshot."""
        tables = self.load()
        ids = fact_ids.select("fact_id").distinct()
        for name in ("facts", "fact_evidence"):
            if name in tables:
                tables[name] = tables[name].join(ids, "fact_id", "left_anti")
        if "relations" in tables:
            for side in ("source_id", "target_id"):
                tables["relations"] = tables["relations"].join(ids.withColumnRenamed("fact_id", side), side, "left_anti")
        self.save(tables)


class JsonStore(ParquetStore):
    """The same snapshots as JSON lines, for exchange; always whole."""

    supports_incremental_save = False

    def _write(self, df: DataFrame, path: str) -> None:
        df.write.json(path)
        self.spark.createDataFrame([(df.schema.json(),)], "value string").coalesce(1).write.text(f"{path}.schema")

    def _read(self, paths: list[str]) -> DataFrame:
        parts = [self.spark.read.schema(T.StructType.fromJson(json.loads(self.spark.read.text(f"{p}.schema").first()[0]))).json(p) for p in paths]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        return out


def open_store(spark: SparkSession, root: str, backend: str = "parquet") -> FactStore:
    backends = {"parquet": ParquetStore, "json": JsonStore}
    if backend not in backends:
        raise ValueError(f"unknown backend {backend!r}; one of {sorted(backends)}")
    return backends[backend](spark, root)


def append_rejected(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_rejected(spark: SparkSession, path: str) -> DataFrame:
    """Rejected records; lines that aren't JSON are skipped."""
    schema = T.StructType(SCHEMAS["rejected_facts"].fields).add("_broken", "string")
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.where("_broken is null").drop("_broken")


def migrate(source: FactStore, target: FactStore) -> DataFrame:
    """Copies a store to an empty one and returns the rows that differ (none, if all went well), as JSON."""
    if getattr(target, "version", lambda: 0)():
        raise ValueError("the target holds data already")
    tables = source.load()
    target.save(tables)
    copied = target.load()
    out = None
    for name, df in tables.items():
        rows = lambda d, side: d.select(F.lit(name).alias("table"), F.lit(side).alias("only_in"), F.to_json(F.struct(*sorted(d.columns))).alias("row"))  # noqa: B023, E731
        a, b = rows(df, ""), rows(copied[name], "")
        diff = a.exceptAll(b).withColumn("only_in", F.lit("source")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("target")))
        out = diff if out is None else out.unionByName(diff)
    return out


# --- vectors and lexical index ----------------------------------------------------------------------


class IndexTable:
    """Rows by fact_id in a store, as a log: upserts and deletions add rows, and the last one of an id counts.

    A rewrite of the whole table is only needed to `compact` or `rebuild` it.
    """

    name = "index"

    def __init__(self, store: ParquetStore):
        self.store = store

    def _add(self, rows: DataFrame, deleted: bool) -> None:
        marked = rows.withColumns({"__version": F.lit(self.store.version() + 1), "__deleted": F.lit(deleted)})
        self.store.commit(more={self.name: marked})

    def upsert(self, rows: DataFrame) -> None:
        """Adds rows or replaces those of the same fact_id; of several new ones any stays."""
        self._add(rows.dropDuplicates(["fact_id"]), False)

    def delete(self, ids: DataFrame) -> None:
        """Marks ids as gone; unknown ones do no harm."""
        self._add(ids.select("fact_id").distinct(), True)

    def all(self) -> DataFrame | None:
        """The rows that are there, or null before the first upsert."""
        log = self.store.table(self.name)
        if log is None:
            return None
        columns = [c for c in log.columns if not c.startswith("__")]
        last = log.groupBy("fact_id").agg(F.max_by(F.struct("__deleted", *[c for c in columns if c != "fact_id"]), "__version").alias("r"))
        return last.where("not r.__deleted").select("fact_id", *[F.col(f"r.{c}").alias(c) for c in columns if c != "fact_id"])

    def compact(self) -> None:
        """Drops replaced and deleted rows."""
        rows = self.all()
        if rows is not None:
            self.rebuild(rows)

    def rebuild(self, rows: DataFrame) -> None:
        """The index anew from `rows`."""
        self.store.commit(new={self.name: rows.withColumns({"__version": F.lit(self.store.version() + 1), "__deleted": F.lit(False)})})

    def summary(self) -> DataFrame:
        """Rows by block."""
        return self.all().groupBy("block_key").agg(F.count("*").alias("rows"))


class VectorTable(IndexTable):
    """fact_id, block_key and vector."""

    name = "vectors"

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query, fact_id, score and rank: the k nearest rows of each query's block by cosine, itself left out."""
        return retrieval.top(retrieval.cosine(self.all(), queries, "fact_id", "block_key", "vector"), "fact_id", k)


class LexicalTable(IndexTable):
    """fact_id, block_key and retrieval_text."""

    name = "lexical"

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query, fact_id, score and rank by BM25; `queries` has query, block_key and text."""
        rows = self.all()
        asked = queries.select("query", F.explode(texts.query_tokens(F.col("text"))).alias("term")).distinct()
        hits = retrieval.bm25(retrieval.postings(rows, "fact_id", "retrieval_text"), asked, "fact_id")
        blocks = queries.select("query", "block_key")
        hits = hits.join(rows.select("fact_id", "block_key"), "fact_id").join(blocks, ["query", "block_key"])
        return retrieval.top(hits.where("query <> fact_id"), "fact_id", k)


def missing_embeddings(texts: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Distinct texts whose vectors the cache doesn't hold."""
    return texts.dropDuplicates([key]).join(cache.select(key), key, "left_anti")
