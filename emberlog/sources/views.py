"""Views of a table of events as login, flow, process, name-lookup, label and access events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators.graph import bucketed


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    k = F.get_json_object("props", "$.k").cast("long")
    return rows.select(
        F.floor(micros / 16_000_000).alias("time"), F.col("event_id").alias("seq"), F.concat(F.lit("C"), F.col("user_id") % 20).alias("source"), F.concat(F.lit("U"), F.col("user_id") % 50).alias("user"), F.concat(F.lit("D"), k % 60).alias("dest"), "event_type", "value", "user_id", k.alias("k")
    )


def events_files(spark: SparkSession, sf_dir: str) -> tuple:
    """What tells one state of the events table from another: its files' number, bytes and newest time."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = [f for f in fs.listStatus(path) if f.isFile()]
    return len(files), sum(f.getLen() for f in files), max((f.getModificationTime() for f in files), default=0)


def auth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("time", "seq", "source", "user", "dest")


def unnumbered_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter((F.col("event_type") == "purchase") & (F.col("value") > 60)).select("time", "seq", "user", "source", "dest")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label events, numbered in order: counts of the hours before, and numbers inside each hour."""
    rows = bucketed(unnumbered_labels(spark, sf_dir), F.floor(F.col("time") / 3600), ["time", "seq"], [], n=(F.sum, F.lit(1), "upto"))
    return rows.select((F.col("n") - 1).alias("redteam_index"), "time", "user", "source", "dest")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).filter("event_type = 'click'")
    return e.select("time", "seq", F.col("source").alias("src"), F.col("dest").alias("dst"), (F.lit(4440) + F.col("k") % 10).alias("dst_port"), F.floor(F.col("value") * 100_000).alias("bytes"))


def procs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter("event_type = 'view'").select("time", "seq", "user", F.col("source").alias("computer"), F.col("dest").alias("process"), F.lit("Start").alias("action"))


def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter("event_type = 'signup'").select("time", "seq", F.col("source").alias("src"), F.col("dest").alias("resolved"))


def logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as logins, of which those of the type error fail."""
    return events(spark, sf_dir).select("time", "seq", "source", "dest", "user", (F.col("event_type") != "error").alias("success"))


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select("time", "seq", F.col("user").alias("actor"), F.concat(F.lit("role"), F.col("user_id") % 4).alias("role"), F.col("event_type").alias("action"), F.col("dest").alias("resource"), ((F.col("k") % 11) / 10).alias("criticality"))
