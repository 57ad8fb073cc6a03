"""Exact duplicates: first of each key, suffixes for repeated ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_first(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key.  An aggregate, not a window: copies are dropped before the shuffle."""
    columns = df.columns
    best = F.min(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in columns if c not in order])).alias("r")
    return df.groupBy(key.alias("__key")).agg(best).select(*[F.col(f"r.`{c}`").alias(c) for c in columns])


def duplicate_of(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """(id, first): the smallest id of the rows with the same key."""
    keyed = df.select(F.col(id_col), key.alias("__key"))
    first = keyed.groupBy("__key").agg(F.min(id_col).alias("first"))
    return keyed.join(first, "__key").select(id_col, "first")


def suffix_repeats(df: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """The nth repeat of an id gets ``~n`` from the second on."""
    rn = F.row_number().over(Window.partitionBy(id_col).orderBy(*order))
    return df.withColumn(id_col, F.when(rn > 1, F.concat(F.col(id_col).cast("string"), F.lit("~"), rn)).otherwise(F.col(id_col).cast("string")))


def dedupe_bodies(df: DataFrame, body_key: Column, words: Column, id_col: str, order: list[str], min_words: int = 12) -> DataFrame:
    """Rows of the same body once, where it has at least ``min_words`` words; then suffixes for repeated ids."""
    long = F.coalesce(words >= min_words, F.lit(False))
    rn = F.row_number().over(Window.partitionBy("__key").orderBy(*order))
    # the limit of one a key runs before the shuffle; short bodies aren't moved at all
    first = df.where(long).withColumn("__key", body_key).withColumn("__rn", rn).where(F.col("__rn") == 1).drop("__key", "__rn")
    return suffix_repeats(first.unionByName(df.where(~long)), id_col, order)
