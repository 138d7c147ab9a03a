"""Outputs of a run as files: JSON lines for episodes and matches, CSV for queues."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame) -> DataFrame:
    """Arrays as text, since CSV has none."""
    joined = lambda f: F.array_join(F.transform(f"`{f.name}`", lambda x: x.cast("string")), "|") if isinstance(f.dataType, T.ArrayType) else F.col(f"`{f.name}`")
    return df.select(*(joined(f).alias(f.name) for f in df.schema))


def save_outputs(folder: str, episodes: DataFrame, matches: DataFrame, near_matches: DataFrame, queues: DataFrame, ranked_limit: int = 10_000) -> list[str]:
    """Writes all_episodes, ranked_episodes (the best accepted ones, in order), suppressed_episodes, matches and near_matches as
    JSON lines, and queues as CSV, one folder for each size. Existing outputs are replaced. Returns the names. The columns of each
    are written too, since an output without rows doesn't tell them."""
    from emberlog.operators.episodes import ranked

    tables = {"all_episodes": episodes, "suppressed_episodes": episodes.filter("suppression_reason is not null"), "matches": matches, "near_matches": near_matches}
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}", compression="gzip")
    best = ranked(episodes, ranked_limit)
    best.coalesce(1).write.mode("overwrite").json(f"{folder}/ranked_episodes", compression="gzip")  # of a fixed size
    flat(queues).write.mode("overwrite").partitionBy("queue_size").csv(f"{folder}/queues", header=True)
    texts = T.StructType([T.StructField(f.name, f.dataType if f.name == "queue_size" else T.StringType()) for f in queues.schema])
    schemas = {**{name: df.schema for name, df in tables.items()}, "ranked_episodes": best.schema, "queues": texts}
    rows = [(name, schema.json()) for name, schema in schemas.items()]
    episodes.sparkSession.createDataFrame(rows, "name string, columns string").coalesce(1).write.mode("overwrite").json(f"{folder}/schemas")
    return list(schemas)


def load_output(spark: SparkSession, folder: str, name: str) -> DataFrame:
    columns = spark.read.schema("name string, columns string").json(f"{folder}/schemas").filter(F.col("name") == name).first()["columns"]
    read = spark.read.schema(T.StructType.fromJson(json.loads(columns)))
    return read.csv(f"{folder}/{name}", header=True) if name == "queues" else read.json(f"{folder}/{name}")
