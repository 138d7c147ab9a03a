"""Token counts: an exact histogram of encoded lengths, and what its suffix sums answer."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import written
from .tokens import byte_bpe, loaded

#: Lengths under one heading in the two-level suffix sums; no window runs over all lengths at once.
BLOCK = 1024


def token_length(tokenizer: str):
    """A column function: the number of ids of a text; a null text has none."""

    @F.arrow_udf("long")
    def n_tokens(texts: pa.Array) -> pa.Array:
        encode = loaded(byte_bpe, tokenizer).encode_ordinary
        return pa.array([len(encode(x.as_py() or "")) for x in texts], pa.int64())

    return n_tokens


def length_histogram(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """(length, n_docs): all documents by their exact encoded length, as a table, since whoever sums it reads it more than once.

    Null and empty texts have length 0; repeated rows count each time; an empty table gives no rows; other columns are not read.
    """
    lengths = docs.select(token_length(tokenizer)(F.col(text)).alias("length"))
    return written(lengths.groupBy("length").agg(F.count("*").alias("n_docs")), "lengths")


def suffix_sums(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each length L of the histogram: documents and tokens of at least L and in all, the total if each document were cut
    at L, and the rank from below of the last document of that length.

    Sums run inside blocks of lengths, then over the blocks' totals, so that no task orders all lengths.
    """
    parts = histogram.withColumn("block", F.floor(F.col("length") / block)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    totals = parts.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    totals = totals.select(
        "block",
        F.coalesce(F.sum("b_docs").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("b_tokens").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("b_docs").over(every).alias("n_docs_all"),
        F.sum("b_tokens").over(every).alias("n_tokens_all"),
    )
    down = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    sums = parts.join(totals, "block").select(
        "length",
        "n_docs",
        (F.sum("n_docs").over(down) + F.col("docs_after")).alias("n_docs_ge"),
        (F.sum("tokens").over(down) + F.col("tokens_after")).alias("n_tokens_ge"),
        "n_docs_all",
        "n_tokens_all",
    )
    kept = F.col("n_tokens_all") - F.col("n_tokens_ge") + F.col("length") * F.col("n_docs_ge")
    return sums.withColumn("n_tokens_cut", kept).withColumn("rank_last", F.col("n_docs_all") - F.col("n_docs_ge") + F.col("n_docs"))


def cut_totals(sums: DataFrame, limits: DataFrame, limit: str = "context_limit") -> DataFrame:
    """For any context limits: documents that are longer, and all tokens left when each document is cut there.

    Between two lengths of the histogram the number of longer documents doesn't change, so the next length above answers.
    `limits` is a short list of the caller's.
    """
    above = limits.join(sums, F.col("length") >= F.col(limit), "left").groupBy(limit).agg(F.min_by(F.struct("n_docs_ge", "n_tokens_ge", "n_tokens_all"), "length").alias("s"), F.min("length").alias("at"))
    every = sums.agg(F.max("n_tokens_all").alias("n_tokens_all"))
    ge, tokens = F.coalesce(F.col("s.n_docs_ge"), F.lit(0)), F.coalesce(F.col("s.n_tokens_ge"), F.lit(0))
    return above.join(every).select(limit, ge.alias("n_docs_ge"), (F.col("n_tokens_all") - tokens + F.col(limit) * ge).alias("n_tokens_cut"))


def length_quantiles(sums: DataFrame, fractions: DataFrame, fraction: str = "fraction") -> DataFrame:
    """For each fraction q, the smallest length that at least q of the documents don't exceed."""
    return fractions.join(sums, F.col("rank_last") >= F.ceil(F.col(fraction) * F.col("n_docs_all"))).groupBy(fraction).agg(F.min("length").alias("length"))
