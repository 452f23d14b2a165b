"""Shards by size-tiered compaction under a versioned manifest (DataFrame operations only).

A store is a folder of immutable Parquet shards and of manifests.  ``append`` writes an arrival, as it comes, as small shards: no shuffle, a file for each task.  ``compact`` sorts
the shards below the target into tiers by size (a factor of ``fanout`` apart); a tier with
``fanout`` shards or more is read and written again, coalesced without a shuffle into files
of about the target size.

A manifest is a small Parquet folder under a name of its own.  Its version is committed by one
file, ``v<N>``, that names the folder: written beside the others, then renamed without
overwriting, so that of two writers with the same number one gets an error, and readers see the
old version or the new one.  ``append`` and ``compact`` then start again from the winner's
version.  Nothing is deleted by either: ``vacuum`` removes what no version names that was the
newest within ``retain_s`` seconds, so readers of such a version can finish, and leaves younger
folders alone, which a writer may be about to commit.

Rows pass through unchanged, with all columns and nulls, repeats and texts of any length.  An
empty arrival commits a version without shards; a store without rows reads as an empty table
with the arrival's schema.  ``shard_col`` of ``read`` replaces a column of that name.
"""

from __future__ import annotations

import math
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .state import checkpoint_dir

MANIFEST = "path string, rows long, bytes long, tier int, arrival int"
#: Shards that one compaction job reads at most; a tier with more takes several jobs.
FILES_A_JOB = 10_000
#: Seconds for which ``vacuum`` keeps what was the newest version.
RETAIN_S = 7 * 24 * 3600


class Conflict(RuntimeError):
    """Another writer has committed the version."""


class ShardStore:
    """A folder of shards with manifests. ``target_bytes``: file size that compaction aims at;
    ``fanout``: shards of like size that are merged together, and the ratio of tiers."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, target_bytes: int = 64 << 20, fanout: int = 4):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.target, self.fanout = target_bytes, fanout
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self.conf)
        for d in ("shards", "manifest"):
            self.fs.mkdirs(self._path(d))

    def _path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}")

    def _files(self, where: str) -> dict:
        return {f.getPath().getName(): f for f in self.fs.listStatus(self._path(where))}

    def versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in self._files("manifest") if n[0] == "v" and n[1:].isdigit())

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        return max(self.versions(), default=0)

    def _folder(self, version: int) -> str:
        """Name of a version's manifest folder."""
        stream = self.fs.open(self._path(f"manifest/v{version}"))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/{self._folder(version)}")

    def read(self, version: int | None = None, shard_col: str | None = None) -> DataFrame:
        """All rows of a version, with the shard's path if asked for."""
        paths = [r.path for r in self.manifest(version).select("path").collect()]
        rows = self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        if not shard_col:
            return rows
        shard = rows.metadataColumn("_metadata")["file_path"] if paths else F.lit(None).cast("string")
        kept = [f"`{c}`" for c in rows.drop(shard_col).columns]
        return rows.select(*kept, shard.alias(shard_col))

    def _write(self, rows: DataFrame) -> str:
        """A new folder of shards."""
        where = f"{self.root}/shards/{uuid.uuid4().hex}"
        rows.write.parquet(where)
        return where

    def _listed(self, where: str, arrival: int) -> DataFrame:
        """Manifest rows of a folder just written. Sizes come from the file listing, row counts from the footers."""
        rows = self.spark.read.schema(self.schema).parquet(where)
        file = rows.metadataColumn("_metadata")
        found = rows.select(file["file_path"].alias("path"), file["file_size"].alias("bytes"))
        return found.groupBy("path").agg(F.count(F.lit(1)).alias("rows"), F.max("bytes").alias("bytes")).select("path", "rows", "bytes", self._tier(), F.lit(arrival).alias("arrival"))

    def _tier(self):
        """0 for the smallest; a shard of at least half the target is in the last tier."""
        last = max(1, math.ceil(math.log(64, self.fanout)))
        below = F.floor(F.log(float(self.fanout), F.col("bytes") * 128 / F.lit(float(self.target))))
        return F.when(F.col("bytes") * 2 >= self.target, last).otherwise(F.least(F.greatest(below, F.lit(0)), F.lit(last - 1))).cast("int").alias("tier")

    def _commit(self, rows: DataFrame, base: int) -> int:
        """Puts version base + 1 in place, or raises Conflict if someone else has."""
        name = f"m-{uuid.uuid4().hex}"
        rows.coalesce(1).write.parquet(f"{self.root}/manifest/{name}")
        temp, to = self._path(f"manifest/_{name}"), self._path(f"manifest/v{base + 1}")
        out = self.fs.create(temp, False)
        out.write(name.encode())
        out.close()
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.conf) if to.toUri().getScheme() else self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        never = self.spark.sparkContext._gateway.new_array(rename, 1)
        never[0] = rename.NONE
        try:
            files.rename(temp, to, never)
        except Py4JJavaError as e:
            self.fs.delete(temp, False)
            self.fs.delete(self._path(f"manifest/{name}"), True)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {base + 1} was committed by another writer") from None
            raise
        return base + 1

    def append(self, arrival: DataFrame) -> int:
        where = self._write(arrival)
        while True:
            base = self.version()
            try:
                return self._commit(self.manifest(base).union(self._listed(where, base + 1)), base)
            except Conflict:
                continue

    def compact(self) -> int:
        """Merges every tier that is due; the version after it (the same if none is)."""
        while True:
            base = self.version()
            shards = self.manifest(base)
            due = shards.where(F.col("bytes") * 2 < self.target).groupBy("tier").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= self.fanout).orderBy("tier").first()
            if due is None:
                return base
            run = shards.where(F.col("tier") == due.tier).orderBy("arrival", "path").limit(FILES_A_JOB)
            inputs = run.select("path", "bytes").collect()
            files = max(1, round(sum(r.bytes for r in inputs) / self.target))
            merged = self.spark.read.schema(self.schema).parquet(*[r.path for r in inputs]).coalesce(files)
            where = self._write(merged)
            rest = shards.join(run.select("path"), "path", "left_anti").select(shards.columns)
            try:
                self._commit(rest.union(self._listed(where, base + 1)), base)
            except Conflict:
                self.fs.delete(self.jvm.org.apache.hadoop.fs.Path(where), True)

    def vacuum(self, retain_s: float = RETAIN_S) -> None:
        """Removes versions that have not been the newest for ``retain_s`` seconds, and folders as old that no version left names."""
        oldest = (time.time() - retain_s) * 1000
        there = self._files("manifest")
        versions = self.versions()
        kept = [v for v, after in zip(versions, [*versions[1:], None], strict=True) if after is None or there[f"v{after}"].getModificationTime() > oldest]
        used, folders = set(), set()
        for v in kept:
            folders.add(self._folder(v))
            used |= {r.folder for r in self.manifest(v).select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder")).distinct().collect()}
        for n, f in self._files("shards").items():
            if n not in used and f.getModificationTime() <= oldest:
                self.fs.delete(f.getPath(), True)
        for n, f in there.items():
            named = n in folders or (n[0] == "v" and n[1:].isdigit() and int(n[1:]) in kept)
            if not named and f.getModificationTime() <= oldest:
                self.fs.delete(f.getPath(), True)


def shard(docs: DataFrame, arrivals: int = 4, key: str = "doc_id", target_bytes: int = 64 << 20, fanout: int = 4, root: str | None = None) -> ShardStore:
    """A store that has taken ``docs`` in so many arrivals (by a hash of the key), compacting after
    each.  In a folder of its own (no ``root``), which nobody else reads yet, what compaction has replaced goes at once."""
    spark = docs.sparkSession
    store = ShardStore(spark, root or f"{checkpoint_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}", docs.schema, target_bytes, fanout)
    for k in range(arrivals):
        store.append(docs.where(F.pmod(F.xxhash64(key), F.lit(arrivals)) == k))
        store.compact()
    if root is None:
        store.vacuum(0)
    return store
