"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Rows are combined three times, and every combination groups by the *content* beside its digest, so a
digest collision never merges different texts:

1. within the task that read them (the map side of the first aggregation),
2. over (digest, salt), the salt being taken from the reading task, so that a text that fills a third
   of the corpus is merged by ``salts`` tasks,
3. over the salt winners.

Labels go back to the rows by digest, a second hash and the length, which name the contents compared before.
Rows of a group of more than one in ``HOT_SHARE`` of all rows are labelled where they lie, as such groups
are fewer than that number; so no task gathers a hot group.

Defined results: a null text counts as the empty text; texts are equal when equal after each run of
white space becomes one space (no trimming). The row with the smallest id stays; a null id loses to
any other. Where several rows share the smallest id of their group, one of them stays. An empty table
gives an empty result. Columns other than the id and the text are never looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE_SPACE, carried, column, stage, whole_text

#: Tasks over which one hot text is merged before its winners meet.
SALTS = 16
#: Groups of more than one in so many of all rows are labelled where they lie.
HOT_SHARE = 10_000
#: Rows that go (an id and a digest, about 100 bytes) are broadcast up to this number, and joined by a shuffle beyond it.
BROADCAST_ROWS = 200_000


def _normalised(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = F.regexp_replace(whole_text(column(text_col)), WHITE_SPACE, " ")
    d = docs.select(column(id_col).alias("doc_id"), norm.alias("norm"))
    return d.withColumn("digest", F.unhex(F.sha2("norm", 256)))


def text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct text: digest, keep_id, group_size."""
    d = _normalised(docs, id_col, text_col).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = d.groupBy("digest", "salt", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    whole = salted.groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return whole.select("digest", "keep_id", "group_size", F.xxhash64("norm").alias("check"), F.length("norm").alias("n_norm"))


def label_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = stage(text_groups(docs, id_col, text_col, salts), "text-groups")
    keys = ["digest", "check", "n_norm"]
    members = _normalised(docs, id_col, text_col).select("doc_id", "digest", F.xxhash64("norm").alias("check"), F.length("norm").alias("n_norm"))
    # groups of more than one in HOT_SHARE of all rows are fewer than HOT_SHARE, and their rows needn't meet; other groups are small
    rows = groups.agg(F.sum("group_size")).first()[0] or 0
    hot = groups.where(F.col("group_size") * HOT_SHARE > rows).select(*keys, F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size"))
    members = members.join(F.broadcast(hot), keys, "left")
    # a row of a hot group goes where its own digest says, and meets no group there
    members = members.withColumn("meets", F.when(F.col("hot_size").isNull(), F.col("digest")).otherwise(F.unhex(F.md5(F.concat_ws(":", F.hex("digest"), "doc_id")))))
    cold = groups.where(F.col("group_size") * HOT_SHARE <= rows).withColumnRenamed("digest", "meets")
    met = members.join(cold, ["meets", "check", "n_norm"], "left")
    labels = stage(
        met.select("doc_id", F.when(F.col("hot_size").isNull(), F.col("keep_id")).otherwise(F.col("hot_id")).alias("keep_id"), F.coalesce("hot_size", "group_size").alias("group_size"), F.lower(F.hex("digest")).alias("text_sha256")),
        "exact-dedup",
    )
    # repeated rows may share the smallest id: number those few, so that one of them stays
    same = Window.partitionBy("text_sha256", "doc_id").orderBy("keep_id")
    winners = labels.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).withColumn("kept", F.row_number().over(same) == 1)
    others = labels.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).withColumn("kept", F.lit(False))
    return winners.unionByName(others).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever these are called: one row for each distinct text."""
    labels = label_documents(docs, id_col, text_col)
    lost = labels.where(~F.col("kept")).select(F.col("doc_id").alias("lost_id"), F.col("text_sha256").alias("lost_sha"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("tie")).distinct()
    sizes = lost.agg(F.count(F.lit(1)).alias("n"), F.max("tie").alias("ties")).first()
    small = F.broadcast if sizes["n"] <= BROADCAST_ROWS else lambda x: x
    sha = F.sha2(F.regexp_replace(whole_text(column(text_col)), WHITE_SPACE, " "), 256)
    rows = docs.select(carried(docs), column(id_col).alias("id"), sha.alias("sha"))
    same = F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("sha") == F.col("lost_sha"))
    # a row that lost to a smaller id goes; rows that repeat the id that stays are cut to one
    out = rows.join(small(lost.where("not tie")), same, "left_anti")
    if sizes["ties"]:
        ties = lost.where("tie")
        once = out.join(small(ties), same, "left_semi").dropDuplicates(["id", "sha"])
        out = out.join(small(ties), same, "left_anti").unionByName(once)
    return out.select("rest.*")
