"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in the one named by spark.checkpoint.dir. Local mode (tests) has one of its own where that is
    unset; a cluster has to name one."""
    app, named = spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/{app}"
    master = spark.sparkContext.master
    if master.startswith("local-cluster") or not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own_folder[app]


def stored(df: DataFrame, name: str) -> str:
    """Writes df as a Parquet table in the shared folder and returns its path."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, for results that are read more than once: lineage ends there, and a lost
    executor costs one stage at most. Tables stay until forget_tables()."""
    path = stored(df, name)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_made: dict[tuple, str] = {}


def made_once(spark: SparkSession, name: str, of: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """saved(make()), or the table that an earlier call of this application made of the same and that is still there. `of` names all
    that it depends on."""
    key = (spark.sparkContext.applicationId, name, *of)
    if key not in _made or not exists(spark, f"{_made[key]}/_SUCCESS"):
        _made[key] = stored(make(), name)
    return spark.read.parquet(_made[key])


def exists(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def forget_tables(spark: SparkSession) -> None:
    """Deletes this application's tables; results that still read them must be stored first."""
    _made.clear()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(side: DataFrame, rows: int = 100_000) -> DataFrame:
    """A side to be broadcast if it was counted and has at most so many rows; a larger one is shuffled like the other side."""
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side
