"""Sharding: size-tiered compaction of immutable shards under a versioned manifest."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .base import shared_folder


@dataclass(frozen=True)
class ShardConfig:
    """Shards are merged when at least fan_in of a tier are there; a tier spans sizes of factor fan_in, and shards of
    half of target_bytes or more are final. small_bytes: the size that appended shards aim at."""

    target_bytes: int = 128 << 20
    small_bytes: int = 8 << 20
    fan_in: int = 4


@dataclass(frozen=True)
class Shard:
    path: str
    n_bytes: int
    n_rows: int

    def tier(self, config: ShardConfig) -> int:
        tier, size = 0, config.small_bytes
        while self.n_bytes >= size and size < config.target_bytes:
            tier, size = tier + 1, size * config.fan_in
        return tier


class ShardStore:
    """A folder of shards (Parquet files, never changed) and manifests v%010d.json, each a whole list of live shards.

    A version is committed by renaming a finished file to its name without overwriting, which the file system refuses if another
    writer was first; readers take the highest version. Files that no manifest names, of tasks that were lost or writers that failed, are never read. The driver
    handles one line for each shard, never rows.
    """

    def __init__(self, spark: SparkSession, folder: str, config: ShardConfig = ShardConfig()):
        self.spark, self.folder, self.config = spark, folder.rstrip("/"), config
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.path(f"{self.folder}/manifests"))

    def version(self) -> int:
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path(f"{self.folder}/manifests"))]
        return max((int(n[1:11]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        return [Shard(**x) for x in self._manifest(version)["shards"]] if version else []

    def _manifest(self, version: int) -> dict:
        stream = self.fs.open(self.path(f"{self.folder}/manifests/v{version:010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def schema(self) -> StructType:
        return StructType.fromJson(self._manifest(self.version())["schema"])

    def commit(self, base: int, shards: list[Shard], schema: StructType) -> int:
        """Makes `shards` version base + 1; raises if that version is there already."""
        name = self.path(f"{self.folder}/manifests/v{base + 1:010d}.json")
        draft = self.path(f"{self.folder}/manifests/.{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(json.dumps({"version": base + 1, "schema": schema.jsonValue(), "shards": [asdict(s) for s in shards]}).encode()))
        stream.close()
        context = self.spark.sparkContext
        hadoop = context._jvm.org.apache.hadoop.fs
        plain = context._gateway.new_array(hadoop.Options.Rename, 0)  # no option: never onto a file that is there
        try:
            hadoop.FileContext.getFileContext(name.toUri(), context._jsc.hadoopConfiguration()).rename(self.fs.makeQualified(draft), self.fs.makeQualified(name), plain)
        except Py4JJavaError as e:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception.toString()):
                raise RuntimeError(f"version {base + 1} was committed by another writer") from e
            raise
        return base + 1

    def _new_folder(self, base: int) -> str:
        """Where a writer that goes on from version `base` puts its shards; writers that race don't share one."""
        return f"{self.folder}/data/after-{base:010d}-{uuid.uuid4().hex[:12]}"

    def _written(self, rows: DataFrame, files: int, base: int) -> list[Shard]:
        """rows as about so many new shards, without a shuffle: partitions of the scan are joined."""
        at = self._new_folder(base)
        rows.coalesce(files).write.option("compression", "zstd").parquet(at)
        return self._shards_of(at, rows.schema)

    def _shards_of(self, at: str, schema: StructType) -> list[Shard]:
        """The shards in a folder: sizes from the files, row counts from their footers."""
        found = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(at).groupBy(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("b")).agg(F.count("*").alias("n"))
        return [Shard(r.p, r.b, r.n) for r in found.orderBy("p").collect()]

    def append(self, rows: DataFrame, n_bytes: int) -> int:
        """Adds an arrival of about n_bytes as small shards. An arrival without rows commits a version without new shards."""
        base = self.version()
        new = self._written(rows, max(1, -(-n_bytes // self.config.small_bytes)), base)
        return self.commit(base, self.shards(base) + new, rows.schema)

    def append_all(self, rows: DataFrame, arrival: Column, arrivals: int, n_bytes: int) -> int:
        """Appends the rows of which `arrival` is 0, then 1, and so on, and compacts after each. One pass over the rows writes
        them all; each arrival becomes visible by its own commit."""
        base, name = self.version(), "arrival"
        while name in rows.columns:
            name += "_"
        at = self._new_folder(base)
        rows.withColumn(name, arrival).coalesce(max(1, -(-n_bytes // arrivals // self.config.small_bytes))).write.partitionBy(name).option("compression", "zstd").parquet(at)
        new = self._shards_of(at, rows.schema)
        for k in range(arrivals):
            base = self.version()
            self.commit(base, self.shards(base) + [s for s in new if f"/{name}={k}/" in s.path], rows.schema)
            self.compact()
        return self.version()

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """Runs to merge: shards of one tier, if there are fan_in or more."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.n_bytes < self.config.target_bytes // 2:
                tiers.setdefault(s.tier(self.config), []).append(s)
        return [sorted(own, key=lambda s: (s.n_bytes, s.path)) for _, own in sorted(tiers.items()) if len(own) >= self.config.fan_in]

    def compact(self) -> int:
        """Merges each run into shards of about target_bytes, until no run is left; every merge is one job and one version. Old
        shards stay as files for readers of older versions, until vacuum()."""
        while True:
            base = self.version()
            shards = self.shards(base)
            runs = self.plan(shards)
            if not runs:
                return base
            merged = {s.path for s in runs[0]}
            files = max(1, round(sum(s.n_bytes for s in runs[0]) / self.config.target_bytes))
            rows = self.spark.read.schema(self.schema()).parquet(*sorted(merged))
            self.commit(base, [s for s in shards if s.path not in merged] + self._written(rows, files, base), rows.schema)

    def vacuum(self, versions: int = 1) -> None:
        """Deletes files that none of the newest `versions` names; readers of older ones have to be done."""
        newest = self.version()
        tail = lambda path: path.rsplit("/data/", 1)[-1]
        live = {tail(s.path) for v in range(max(1, newest - versions + 1), newest + 1) for s in self.shards(v)}
        files = self.fs.listFiles(self.path(f"{self.folder}/data"), True)
        while files.hasNext():
            f = files.next().getPath()
            if tail(f.toString()) not in live:
                self.fs.delete(f, False)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; Spark's _metadata column tells each row's shard."""
        paths = [s.path for s in self.shards(version)]
        return self.spark.read.schema(self.schema()).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema())


def shard_documents(docs: DataFrame, n_bytes: int, arrivals: int = 4, folder: str | None = None, config: ShardConfig = ShardConfig()) -> ShardStore:
    """Appends the documents as so many arrivals, dealt by a hash of the row, and compacts after each.

    Any column may be null, repeated rows stay repeated, and other columns go along. An empty table gives arrivals without
    rows. n_bytes is the caller's estimate of the documents' size as Parquet; it only sets the number of first shards. A store
    made here has no readers of older versions yet, so their files are deleted; in a folder of the caller's they stay.
    """
    store = ShardStore(docs.sparkSession, folder or f"{shared_folder(docs.sparkSession)}/shards-{uuid.uuid4().hex}", config)
    store.append_all(docs, F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)), F.lit(arrivals)), arrivals, n_bytes)
    if folder is None:
        store.vacuum()
    return store
