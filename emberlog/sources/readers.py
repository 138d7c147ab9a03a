"""Readers of raw log lines and records: from a DataFrame with the column `value` (as spark.read.text gives) to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def part(cols: Column, i: int) -> Column:
    """The i-th comma-separated field, trimmed; null if it is missing, blank or the token `?`."""
    field = F.trim(F.try_element_at(cols, F.lit(i + 1)))
    return F.when(~field.isin("?", ""), field)


def fields(lines: DataFrame) -> DataFrame:
    """Adds _c, the comma-separated fields. As an explode, through which no filter is pushed: a condition on fields would else make
    and split the line anew for each field that it names."""
    return lines.withColumn("_c", F.explode(F.array(F.split("value", ","))))


def number(x: Column) -> Column:
    return x.try_cast("long")


def text_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Text files, compressed or not, with a total order: file, block, and row in the block (which monotonic ids keep inside one
    partition). Write the result as Parquet before using it twice: compressed text can't be split."""
    rows = spark.read.text(list(paths))
    return rows.select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("seq"))


def auth_strict(lines: DataFrame) -> DataFrame:
    """Successful logins with both hosts: user is the source user, else the destination user, else empty."""
    c = F.col("_c")
    rows = fields(lines).select(
        "*", number(part(c, 0)).alias("time"), F.coalesce(part(c, 1), part(c, 2), F.lit("")).alias("user"), part(c, 3).alias("source"), part(c, 4).alias("dest"), part(c, 5).alias("auth_type"), part(c, 6).alias("logon_type"), part(c, 7).alias("orientation")
    )
    return rows.filter((F.size(c) >= 9) & (F.trim(F.try_element_at(c, F.lit(9))) == "Success") & F.col("time").isNotNull() & F.col("source").isNotNull() & F.col("dest").isNotNull()).drop("value", "_c")


def auth_permissive(lines: DataFrame) -> DataFrame:
    """Every line with its failures: hosts may be null, a bad time is -1, success is a boolean of the lower-cased outcome."""
    c = F.split("value", ",")
    return lines.select(
        "*", F.coalesce(number(part(c, 0)), F.lit(-1)).alias("time"), part(c, 1).alias("src_user"), part(c, 2).alias("dst_user"), part(c, 3).alias("source"), part(c, 4).alias("dest"), F.coalesce(F.lower(part(c, 8)) == "success", F.lit(False)).alias("success")
    ).drop("value")


def auth_tolerant(lines: DataFrame) -> DataFrame:
    """Lines of five fields or more and a time, with the raw line."""
    c = F.col("_c")
    rows = fields(lines).select("*", number(part(c, 0)).alias("time"), part(c, 1).alias("src_user"), part(c, 2).alias("dst_user"), part(c, 3).alias("source"), part(c, 4).alias("dest"))
    return rows.filter((F.size(c) >= 5) & F.col("time").isNotNull()).withColumnRenamed("value", "raw").drop("_c")


def proc(lines: DataFrame) -> DataFrame:
    c = F.split("value", ",")
    return lines.select("*", F.coalesce(number(part(c, 0)), F.lit(-1)).alias("time"), *(part(c, i).alias(n) for i, n in enumerate(("user", "computer", "process", "action"), 1))).drop("value")


def flow(lines: DataFrame) -> DataFrame:
    c = F.split("value", ",")
    whole = lambda i: F.coalesce(number(part(c, i)), F.lit(0))
    return lines.select(
        "*", F.coalesce(number(part(c, 0)), F.lit(-1)).alias("time"), whole(1).alias("duration"), part(c, 2).alias("src"), whole(3).alias("src_port"), part(c, 4).alias("dst"), whole(5).alias("dst_port"), part(c, 6).alias("protocol"), whole(7).alias("packets"), whole(8).alias("bytes")
    ).drop("value")


def dns(lines: DataFrame) -> DataFrame:
    c = F.split("value", ",")
    return lines.select("*", F.coalesce(number(part(c, 0)), F.lit(-1)).alias("time"), part(c, 1).alias("src"), part(c, 2).alias("resolved")).drop("value")


def label_events(lines: DataFrame) -> DataFrame:
    """Labelled events of four fields or more with a time; the caller numbers them in file order."""
    c = F.col("_c")
    rows = fields(lines).select("*", number(part(c, 0)).alias("time"), *(F.trim(F.try_element_at(c, F.lit(i + 1))).alias(n) for i, n in enumerate(("user", "source", "dest"), 1)))
    return rows.filter((F.size(c) >= 4) & F.col("time").isNotNull()).drop("value", "_c")


def json_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; malformed ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def flattened(df: DataFrame) -> DataFrame:
    """Nested structs as columns with dotted names."""

    def walk(schema: T.StructType, path: tuple[str, ...]) -> list[Column]:
        out = []
        for f in schema:
            own = (*path, f.name)
            col = F.col(".".join(f"`{p}`" for p in own))
            out += walk(f.dataType, own) if isinstance(f.dataType, T.StructType) else [col.alias(".".join(own))]
        return out

    return df.select(*walk(df.schema, ()))


def parse_quality(rows: DataFrame, is_signal: Column) -> DataFrame:
    """Counts of a parsed table: events, lines without a time, events with a signal."""
    return rows.agg(F.count("*").alias("events"), F.count_if(F.col("time") < 0).alias("bad_lines"), F.count_if(is_signal & (F.col("time") >= 0)).alias("signal_events"))


def probe(lines: DataFrame, text: str, first: int | None = None, examples: int = 5) -> DataFrame:
    """(n, first_seq, examples) of lines (seq, value) that hold a text, as it is: their number, the first one's place, and the first
    few of them. first: look at so many lines only, in order."""
    seen = lines.select("seq", "value") if first is None else lines.select("seq", "value").orderBy("seq").limit(first)
    hits = seen.filter(F.col("value").contains(text))
    some = hits.orderBy("seq").limit(examples).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]), "|").alias("examples"))
    return hits.agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")).crossJoin(some)
