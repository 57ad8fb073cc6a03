"""Weighted rendezvous hashing of stable record keys over shards, in DataFrame operations only.

Each (key, shard) pair has a uniform value u from a hash; a record goes to the shard with the largest
``-weight / ln(u)``.  The value depends on the key and the shard alone, so one more shard only takes the rows
on which it wins; no row moves between old shards.

Slots number the rows of a shard from 0 without gaps.  They are counted in two steps, by a bucket of the row's
hash and then within the bucket, and equal rows are first counted together, so neither a shard nor a much
repeated row is gathered into one task.

Defined results: a null text has size 1 and the checksum of the empty text; a null key is hashed like the
shard number alone; repeated rows get slots of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (0 to len(weights) - 1) of a key under the given weights."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")

    def score(shard: int) -> Column:
        # the top 53 bits of the hash, moved into the open interval (0, 1)
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.lit(float(weights[shard])) / -F.log(u)

    if len(weights) == 1:
        return F.lit(0)
    # ties of two equal doubles go to the smaller shard
    best = F.greatest(*[F.struct(score(s).alias("score"), F.lit(-s).alias("shard")) for s in range(len(weights))])
    return (-best["shard"]).cast("int")


def shard_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: list[float] | None = None, new_weight: float = 1.0, rows_per_bucket: int = 20_000
) -> DataFrame:
    """Rows (id, size, text_crc32, shard, slot, grown_shard) for each input row."""
    weights = weights or [1.0] * 8
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    raw = text.cast("binary")
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32")
    )
    # a power of two, for stable buckets; only their number depends on the table
    many = 64
    total = docs.count()
    while many * rows_per_bucket * len(weights) < total:
        many *= 2
    dealt = rows.withColumns(
        {
            "shard": rendezvous(F.col("id"), weights),
            "grown_shard": rendezvous(F.col("id"), [*weights, new_weight]),
            "bucket": F.pmod(F.xxhash64("id", "text_crc32", "size", F.lit(7)), F.lit(many)).cast("int"),
        }
    )
    same = dealt.groupBy("shard", "bucket", "id", "size", "text_crc32", "grown_shard").agg(F.count("*").alias("copies"))
    sizes = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = same.withColumn("first", F.coalesce(F.sum("copies").over(within), F.lit(0))).join(starts, ["shard", "bucket"])
    return placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).select(
        "id", "size", "text_crc32", "shard", (F.col("start") + F.col("first") + F.col("copy")).alias("slot"), "grown_shard"
    )


def op2_rendezvous_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
