"""Shaping of search results, and joins that check runs, stores and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources import tables
from . import ranking


def one_per_source(ranked: DataFrame, by: str, order: str, source: str, size: str, budget: int, k: int) -> DataFrame:
    """The first hit of each source, best first; one that overflows the budget is passed over; ``k`` at most."""
    first = ranked.withColumn("__n", F.row_number().over(Window.partitionBy(by, source).orderBy(order))).where("__n = 1").drop("__n")
    kept = ranking.greedy_budget(first, by, order, size, budget)
    return kept.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("__n") <= k).drop("__n")


def first_distinct(ranked: DataFrame, by: str, order: str, value: str, n: int) -> DataFrame:
    """(by, value, place): the first ``n`` values that differ, in the order in which they appear."""
    seen = ranked.groupBy(by, value).agg(F.min(order).alias("__first"))
    return seen.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("__first", value))).where(F.col("place") <= n).drop("__first")


def shard_search(docs: DataFrame, queries: DataFrame, shard: Column, id_col: str, text_col: str, query_id: str, query_text: str, k: int, tokens=T.index_terms) -> DataFrame:
    """BM25 with each shard's own statistics, ``k`` a shard, merged by score and cut to ``k``.

    The best ``k`` of all are among the best ``k`` of their shards, so they are taken at once."""
    return ranking.bm25_search(docs, queries, id_col, text_col, query_id, query_text, k, tokens, shard)


def peek(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """``n`` rows in the order of a seeded hash."""
    return df.orderBy(F.sha1(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), id_col).limit(n)


def longest_first(df: DataFrame, size: str, id_col: str, batch: int) -> DataFrame:
    """``batch`` and ``place`` of rows sorted by size, longest first, so that batches are even; by ``id_col`` the order is restored."""
    ordered = tables.shards(df.withColumn("__less", -F.col(size)), ["__less", id_col], batch)
    return ordered.drop("__less").withColumnsRenamed({"shard": "batch", "row": "place"})


def alignment(left: DataFrame, right: DataFrame, position: str, id_col: str) -> DataFrame:
    """One row (matched, only_left, only_right, differing): do both sides hold the same id at each position?"""
    a, b = left.select(F.col(position).alias("p"), F.col(id_col).alias("a")), right.select(F.col(position).alias("p"), F.col(id_col).alias("b"))
    both = a.join(b, "p", "full")
    return both.agg(
        F.count_if(F.col("a") == F.col("b")).alias("matched"),
        F.count_if(F.col("b").isNull()).alias("only_left"),
        F.count_if(F.col("a").isNull()).alias("only_right"),
        F.count_if(F.col("a") != F.col("b")).alias("differing"),
    )


def bundle_faults(stored: DataFrame, bundle: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, fault): ``bad`` is stored but not in the bundle, or differs; ``missing`` is in the bundle but not stored."""
    a, b = stored.select(key, F.col(digest).alias("a")), bundle.select(key, F.col(digest).alias("b"))
    fault = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull() | (F.col("a") != F.col("b")), "bad")
    return a.join(b, key, "full").select(key, fault.alias("fault")).where("fault is not null")


def diagnosis(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rule that holds."""
    out = F.lit(otherwise)
    for name, rule in reversed(rules):
        out = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(out)
    return out


def findings(rollup: DataFrame, by: str, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """(by, finding, value): a row for each threshold rule (name, holds, value) that a group breaks."""
    each = F.array(*[F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(name).alias("finding"), value.cast("double").alias("value"))) for name, holds, value in rules])
    return rollup.select(by, F.explode(F.array_compact(each)).alias("f")).select(by, "f.finding", "f.value")


def coverage(cited: DataFrame, held: DataFrame, law: str, section: str, question: str) -> DataFrame:
    """Per cited law: found, questions that cite it, and the cited sections that are not held, in order."""
    have = held.select(law, section).distinct().withColumn("__held", F.lit(True))
    known = held.select(law).distinct().withColumn("__law", F.lit(True))
    each = cited.join(have, [law, section], "left").join(known, law, "left")
    missing = F.array_sort(F.collect_set(F.when(F.col("__held").isNull(), F.col(section).cast("string"))))
    return each.groupBy(law).agg(F.coalesce(F.max("__law"), F.lit(False)).alias("found"), F.count_distinct(question).alias("questions"), missing.alias("missing"))


def merge_parts(spark, paths: list[str], out: str, rows: int = 2000, file_rows: int = 5_000_000) -> int:
    """All parts in their order, in files of some ``file_rows`` rows and row groups of ``rows``; returns the rows.

    Ranges of the order go to a task each, so no task writes more than its file."""
    df = None
    for n, path in enumerate(paths):
        part = spark.read.parquet(path).withColumn("__part", F.lit(n)).withColumn("__row", F.monotonically_increasing_id())
        df = part if df is None else df.unionByName(part)
    files = max(1, -(-spark.read.parquet(*paths).count() // file_rows))
    df.repartitionByRange(files, "__part", "__row").sortWithinPartitions("__part", "__row").drop("__part", "__row").write.mode("overwrite").option("parquet.block.row.count.limit", rows).parquet(out)
    return spark.read.parquet(out).count()


def row_counts(spark, paths: dict[str, str]) -> DataFrame:
    """(name, rows) of Parquet files, from their footers alone."""
    out = None
    for name, path in paths.items():
        one = spark.read.parquet(path).select().agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def case_search(rankings: list[DataFrame], chunks: DataFrame, k: int, budget: int) -> DataFrame:
    """(query_id, place, id, file, index, hit): excerpts of case files for several rankings of (query_id, rank, id).

    The rankings are fused, the best ``k`` that fit the budget are hits, each with the chunks before and after it in its file, and all
    stand in the order of the files.  ``chunks``: id, file, index, size.
    """
    fused = ranking.fuse(rankings, k).join(chunks, "id")
    hits = ranking.greedy_budget(fused, "query_id", "rank", "size", budget).select("query_id", "id", "file", "index")
    beside = hits.select("query_id", "file", F.explode(F.array(F.col("index") - 1, F.col("index") + 1)).alias("index")).distinct()
    near = beside.join(chunks.select("id", "file", "index"), ["file", "index"]).join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")
    both = hits.withColumn("hit", F.lit(True)).unionByName(near.withColumn("hit", F.lit(False)))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("file", "index", "id")))
