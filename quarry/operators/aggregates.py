"""Reports: counters, histograms, shares and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EDGES = [0, 50, 100, 200, 300, 400, 500, 600, 700, 800, 1000]  # fixed values: bin edges of chunk sizes


def bin_of(c: Column, edges: list[int] = EDGES) -> Column:
    out = F.when(F.lit(False), "")
    for lo, hi in zip(edges[:-1], edges[1:]):
        out = out.when(c < hi, f"{lo}-{hi - 1}")
    return out.otherwise(f">={edges[-1]}")


def histogram(df: DataFrame, value: Column, width: int = 30) -> DataFrame:
    """(bin, n, bar): bars scaled to the largest bin."""
    counts = df.groupBy(bin_of(value).alias("bin")).agg(F.count("*").alias("n"))
    peak = counts.agg(F.max("n").alias("__peak"))
    return counts.join(F.broadcast(peak)).select("bin", "n", F.expr(f"repeat('#', cast(round({width} * n / __peak) as int))").alias("bar"))


def top_values(df: DataFrame, key: Column, limit: int | None = None) -> DataFrame:
    counted = df.groupBy(key.alias("value")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "value").limit(limit) if limit else counted


def grouped_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """(dimension, value, n) for each of several keys, in one pass by grouping sets."""
    sets = df.groupingSets([[k] for k in keys], *keys).agg(F.grouping_id().alias("__g"), F.count("*").alias("n"))
    many = len(keys)
    dimension, value = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for i, k in enumerate(keys):
        only = ((1 << many) - 1) ^ (1 << (many - 1 - i))
        dimension = dimension.when(F.col("__g") == only, k)
        value = value.when(F.col("__g") == only, F.col(k).cast("string"))
    return sets.select(dimension.alias("dimension"), value.alias("value"), "n")


def quota(df: DataFrame, by: str, order: list[Column], quotas: Column) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("__rn", rn).where(F.col("__rn") <= quotas).drop("__rn")


def percent(c: Column) -> Column:
    return F.round(100 * F.avg(c), 1)


def severity_rollup(c: Column) -> Column:
    """flagged before repaired before ok."""
    rank = F.max(F.when(c == "flagged", 2).when(c == "repaired", 1).otherwise(0))
    return F.when(rank == 2, "flagged").when(rank == 1, "repaired").otherwise("ok")
