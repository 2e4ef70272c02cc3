"""Sharding by rendezvous hashing of record keys over weighted shards.

Each (key, shard) pair has a fixed pseudo-random score, and a record goes to the shard that scores
highest for it. A shard that is added can only win records for itself; one that goes gives back only
its own. A shard of weight w gets a share of w / sum of the weights.

Defined results: a null key hashes as the empty key, and repeated keys go to one shard; a null text
has no bytes. Shards of weight 0 or less get no rows. Slots number the rows of a shard without gaps,
in the order of a hash, then key, checksum and size; rows equal in all of these are interchangeable. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, column, stage, whole_text

SHARDS = 16
#: Hexadecimal digits of the hash by which a shard's rows fall into buckets that number theirs apart: 4096 of them.
BUCKET_DIGITS = 3
#: Bits of the hash that a score is made of, all exact in a double.
SCORE_BITS = 52


def shard_score(key: Column, shard: int, weight: float) -> Column:
    """Weighted rendezvous score, -w / ln(u), where u in (0, 1) is the pair's hash."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, SCORE_BITS // 4)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**SCORE_BITS))
    return F.lit(-float(weight)) / F.ln(u)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    scored = [F.struct(shard_score(key, i, w).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    return F.array_max(F.array(*scored))["shard"]


def assign_shards(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, added: Sequence[float] = (1.0,), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard (with ``added`` shards more)."""
    key, text = F.coalesce(column(id_col).cast("string"), F.lit("")), whole_text(column(text_col))
    rows = docs.select(
        column(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(key, weights).cast("int").alias("shard"),
        shard_of(key, [*weights, *added]).cast("int").alias("grown_shard"),
    )
    # size and checksum are part of the bucket, so that rows that only share a key spread
    name = F.concat_ws(":", F.col("doc_id").cast("string"), "size", "text_crc32")
    rows = stage(rows.withColumn("bucket", F.substring(F.md5(name), 1, BUCKET_DIGITS)), "sharding")
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("i", F.row_number().over(within).cast("long") - 1)
    # starts has at most 4096 rows for each shard, whatever the input
    return numbered.join(F.broadcast(starts), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("i")).alias("slot"), "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, weights: Sequence[float] = (1.0,) * SHARDS, id_col: str = "doc_id", files_per_shard: int = 1) -> None:
    """Write ``docs`` as ``path/shard=N/``, in ``files_per_shard`` files each, with all columns. An input column ``shard`` is an error, as the folders' own name is that."""
    if "shard" in (c.lower() for c in docs.columns):
        raise ValueError("rename the column shard: the folders' names bring one of that name back")
    key = F.coalesce(column(id_col).cast("string"), F.lit(""))
    part = F.pmod(F.xxhash64(*(column(c) for c in docs.columns)), F.lit(files_per_shard))
    out = docs.select(carried(docs), shard_of(key, weights).alias("to"), part.alias("part")).repartition(len(weights) * files_per_shard, "to", "part")
    out.select("rest.*", F.col("to").alias("shard")).write.partitionBy("shard").parquet(path)
