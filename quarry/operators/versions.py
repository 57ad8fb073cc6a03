"""Dated versions of records, staging, and incremental snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rechain(versions: DataFrame, key: str, start: str, end: str, status: str) -> DataFrame:
    """Each version ends at the latest the day before the next one of its key starts.

    Its status is then ``amended``, unless it is declared ``repealed``; the last version keeps what is declared.
    Versions of one start are one version.
    """
    starts = versions.select(key, start).distinct()
    following = starts.withColumn("__next", F.lead(start).over(Window.partitionBy(key).orderBy(start)))
    joined = versions.join(following, [key, start])
    closes = F.date_sub("__next", 1)
    return joined.withColumns(
        {
            end: F.when(F.col("__next").isNotNull(), F.least(F.col(end), closes)).otherwise(F.col(end)),
            status: F.when(F.col("__next").isNull() | (F.col(status) == "repealed"), F.col(status)).otherwise(F.lit("amended")),
        }
    ).drop("__next")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The old rows whose key has no new row, and the new rows."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new.select(*old.columns))


def last_per_key(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The row of each key that is largest by ``order``: an aggregate, so that older rows go before the shuffle."""
    columns = df.columns
    best = F.max(F.struct(*[c if isinstance(c, Column) else F.col(c) for c in order], *[F.col(c).alias(f"__{c}") for c in columns])).alias("r")
    return df.groupBy(*[F.col(k).alias(f"__key_{k}") for k in key]).agg(best).select(*[F.col(f"r.__{c}").alias(c) for c in columns])


def watermark(df: DataFrame, column: str):
    """The latest value pulled so far, or null."""
    return df.agg(F.max(column)).first()[0]


def as_of(facts: DataFrame, versions: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Each fact with the version in force at its time."""
    v = versions.withColumnRenamed(key, "__key")
    inside = (F.col(key) == F.col("__key")) & (F.col(at) >= F.col(start)) & (F.col(end).isNull() | (F.col(at) <= F.col(end)))
    return facts.join(v, inside, "left").drop("__key")


def approve(staged: DataFrame, live: DataFrame, key: list[str], decision: str = "decision") -> DataFrame:
    """The live snapshot after a review: approved rows replace those of their key, rejected and pending ones do nothing."""
    return upsert(live, staged.where(F.col(decision) == "approved").select(*live.columns), key)


def retract(live: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return live.join(gone.select(*key), key, "left_anti")
