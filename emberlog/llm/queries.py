"""One query for each training-data operator, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.tiktoken"


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_path(WORD_BPE))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import line_dedup

    docs = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "lines.n_lines", "lines.n_exact", "lines.n_near", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit_language, predict_language

    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    model = fit_language(docs.filter(~held_out))
    return predict_language(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    docs = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "repeats.n_bytes", "repeats.n_removed", "repeats.n_spans", F.sha2("repeats.kept", 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    docs = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", *(f"quality.{n}" for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    docs = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.transform("licenses.places", lambda p: p["start"])
    return docs.select(
        "doc_id",
        "licenses.n_words",
        F.size("licenses.places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join("licenses.base_labels", ",").alias("base_labels"),
        F.array_join("licenses.labels", ",").alias("labels"),
        "licenses.score",
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document read back from the committed shards: its shard, that shard's rows, and the version."""
    from .sharding import shard_documents

    docs = table(spark, sf_dir, "documents")
    # The files' sizes set the number of first shards; no column is read for them.
    files = docs.select("_metadata.file_path", "_metadata.file_size").distinct()
    store = shard_documents(docs, files.agg(F.coalesce(F.sum("file_size"), F.lit(0))).first()[0])
    version = store.version()
    rows = store.read(version).select("*", F.col("_metadata.file_name").alias("shard"), F.col("_metadata.file_size").alias("shard_bytes"))
    return rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang", "source", "n_chars", "shard", "shard_bytes", F.lit(version).cast("long").alias("version"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import length_histogram, suffix_sums

    return suffix_sums(length_histogram(table(spark, sf_dir, "documents"), public_path(BYTE_BPE)))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_dedup, normalised

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))
    return exact_dedup(docs).select("doc_id", "copies.keep_id", "copies.group_size", "copies.kept", "text_sha256")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
