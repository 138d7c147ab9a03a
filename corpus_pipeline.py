"""A corpus pipeline of five training-data operators, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.base import written
from emberlog.llm.decontamination import decontaminate
from emberlog.llm.jaccard import one_of_each_class
from emberlog.llm.lines import line_dedup
from emberlog.llm.packing import pack
from emberlog.llm.quality import quality_rules
from emberlog.llm.queries import WORD_BPE, public_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents that go to a Python worker at once. Workers and the JVM hold a few batches each, and stay from stage to stage.
BATCH = "2000"


def session(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    return spark


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rejected documents go."""
    session(spark)
    return quality_rules(docs).filter("quality.kept").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines that an earlier line equals or nearly equals go, and documents of which no word is left."""
    session(spark)
    out = line_dedup(docs).withColumn("n_chars", F.when(F.col("lines.n_exact") + F.col("lines.n_near") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.filter("lines.n_exact + lines.n_near = 0 or trim(text) <> ''").select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each group of near duplicates stays."""
    session(spark)
    return one_of_each_class(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a test item go."""
    session(spark)
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: pieces of all remaining documents in windows."""
    session(spark)
    return pack(docs, public_path(WORD_BPE))


STAGES = [("quality_rules", keep_good), ("line_dedup", drop_repeated_lines), ("jaccard_join", keep_one_of_each), ("decontamination", drop_contaminated), ("packing", pack_windows)]

#: Packing needs a tokenizer, which SQL can't express; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
