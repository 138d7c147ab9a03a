"""Exact dedup by progressive refinement: length, then the hash of a prefix, then the hash of the whole."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Carried, broadcast_if_small, written

#: The characters that texts may differ by: space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class ExactConfig:
    """prefix: code points of a normalised text that its prefix hash covers. broadcast_rows: survivors of the prefix level, and
    groups, are broadcast up to so many rows, which are counted."""

    prefix: int = 64
    broadcast_rows: int = 1_000_000


def normalised(text: Column) -> Column:
    """The text without BLANKS; a null text is empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def survivors(rows: DataFrame, config: ExactConfig) -> DataFrame:
    """(_n, _p) of rows (_n, _p): lengths and prefix hashes that may hold equal texts. Lengths of one row go first, then prefixes
    of one row.

    One pass over the texts makes both, since a scan costs more than the hash of a short prefix; only counts are shuffled.
    """
    counts = written(rows.groupBy("_n", "_p").agg(F.count("*").alias("_c")), "prefixes")
    lengths = counts.groupBy("_n").agg(F.sum("_c").alias("_rows")).filter("_rows > 1").select("_n")
    return written(counts.filter("_c > 1").join(lengths, "_n", "left_semi").select("_n", "_p"), "survivors")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", config: ExactConfig = ExactConfig(), to: str = "copies") -> DataFrame:
    """Marks documents whose texts are equal without white space. Adds the struct column `to`: keep_id (doc_id of the row of the
    group that stays), group_size and kept.

    The row with the most code points in its original text stays, then the one with the smallest doc_id; a null id comes last.
    Rows that tie in both (repeated rows) are one group, of which exactly one stays.

    Texts are told apart by length first, then by the hash of a prefix, and only those that still share both are hashed whole
    (SHA-256). Groups are aggregated before the shuffle, so a group of any size is a few rows of each task, and rows without a
    copy meet no shuffle at all. If more than broadcast_rows (length, prefix) pairs survive, all rows are hashed before
    they are joined, because a hash is less work than moving texts to be filtered.

    A null or empty text, or one of white space alone, is the empty text, and such rows are copies of one another. Other columns
    stay, whatever their names; a column of the name `to` is replaced. An empty table gives none.
    """
    own = Carried(docs, to)
    key, body = F.col(own.at(doc_id)), F.col(own.at(text))
    plain = normalised(body)
    keyed = own.rows.withColumns({"_n": F.length(plain), "_p": F.xxhash64(F.substring(plain, 1, config.prefix)), "_cp": F.length(F.coalesce(body, F.lit("")))})

    alive = survivors(keyed.select("_n", "_p"), config)
    if alive.count() <= config.broadcast_rows:
        marked = keyed.join(F.broadcast(alive.withColumn("_hit", F.lit(True))), ["_n", "_p"], "left")
        full = marked.withColumn("_f", F.when(F.col("_hit"), F.sha2(plain, 256)))
    else:
        full = keyed.withColumn("_f", F.sha2(plain, 256))

    # Rows that are equal in all that ranks them count as one row with ties, then each group's best.
    ranked = full.filter("_f is not null").groupBy("_f", "_cp", key.alias("_id")).agg(F.count("*").alias("_ties"))
    best = F.min(F.struct((-F.col("_cp")).alias("_less"), F.col("_id").isNull().alias("_none"), F.col("_id"), F.col("_ties")))
    groups = ranked.groupBy("_f").agg(F.sum("_ties").alias("_size"), best.alias("_best")).filter("_size > 1")
    groups = written(groups.select(F.col("_f").alias("_group"), "_size", (-F.col("_best._less")).alias("_most"), F.col("_best._id").alias("_keep"), F.col("_best._ties").alias("_ties")), "groups")

    # A row without a full hash has a key of its own, so that such rows don't lie together where groups are too many to broadcast.
    place = F.coalesce("_f", F.concat_ws(":", "_n", "_p"))
    found = full.join(broadcast_if_small(groups, groups.count(), config.broadcast_rows), place == F.col("_group"), "left")
    first = (F.col("_cp") == F.col("_most")) & key.eqNullSafe(F.col("_keep"))

    def out(rows: DataFrame, kept: Column) -> DataFrame:
        keep_id = F.when(F.col("_group").isNull(), key).otherwise(F.col("_keep"))
        size = F.coalesce("_size", F.lit(1)).cast("long")
        return rows.select(*own.back(), F.struct(keep_id.alias("keep_id"), size.alias("group_size"), kept.alias("kept")).alias(to))

    alone = F.col("_group").isNull()
    if groups.filter("_ties > 1").isEmpty():
        return out(found, alone | first)
    # Rows that tie for the place get a number in a stored table, and the least of each group stays.
    tie = ~alone & first & (F.col("_ties") > 1)
    tied = written(found.filter(tie).withColumn("_at", F.monotonically_increasing_id()), "tied")
    least = tied.groupBy("_group").agg(F.min("_at").alias("_least")).withColumnRenamed("_group", "_of")
    tied = tied.join(broadcast_if_small(least, least.count(), config.broadcast_rows), F.col("_group") == F.col("_of"))
    return out(found.filter(~tie), alone | first).unionAll(out(tied, F.col("_at") == F.col("_least")))
