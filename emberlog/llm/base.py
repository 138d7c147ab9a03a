"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of a text that separates words: space and \t \n \v \f \r. ``bytes.split()`` splits on just these.
ASCII_SPACE = b" \t\n\r\x0b\x0c"
WORD_SPLIT = r"[\x20\x09-\x0D]+"

_own_folder: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in the one that the cluster names in spark.checkpoint.dir. Where that is unset, one of our own
    in local mode (tests); on a cluster it has to be set, since executors don't share local folders."""
    app, named = spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/{app}"
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own_folder[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts its lineage, and survives the loss of executors. Results that are not yet
    read may need it, so it stays until drop_tables()."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Deletes what written() has left of this application; for when all results have been read or saved."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Carried:
    """The caller's columns under names c0, c1, ... which no operator uses, whatever they are called.

    rows: all columns but `to`, renamed. at(name): the new name of a column. back(): the columns under their own names.
    """

    def __init__(self, docs: DataFrame, to: str | None = None):
        kept = docs.drop(to) if to else docs
        self.names = kept.columns
        self.rows = kept.toDF(*(f"c{i}" for i in range(len(self.names))))

    def at(self, name: str) -> str:
        low = [n.lower() for n in self.names]
        return f"c{self.names.index(name) if name in self.names else low.index(name.lower())}"

    def back(self, **changed: Column) -> list[Column]:
        return [changed.get(f"c{i}", F.col(f"c{i}")).alias(n) for i, n in enumerate(self.names)]


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint only for a side that was counted and is below the limit; beyond it Spark shuffles both sides."""
    return F.broadcast(df) if rows <= limit else df


def row_key(doc_id: str, text: str):
    """A key of a row that also tells rows with a null or repeated id apart, unless their texts are equal too."""
    return F.xxhash64(F.col(doc_id), F.col(text))
