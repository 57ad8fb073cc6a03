"""Scores of answers and of retrieval, and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def item_score(scoring: Column, letter_ok: Column, label_ok: Column, correctness: Column) -> Column:
    """Exact letter 0 or 1; label half and judge half, the label alone without a judge; else the judge's 0 to 2."""
    label = label_ok.cast("double")
    return (
        F.when(scoring == "exact_letter", letter_ok.cast("double"))
        .when(scoring == "label_then_judge", F.coalesce(0.5 * label + 0.25 * correctness, label))
        .otherwise(correctness / 2.0)
    )


def score_report(scored: DataFrame, score: str, keys: list[str]) -> DataFrame:
    """(dimension, value, n, score): overall and by each key, in one pass by grouping sets."""
    from .aggregates import percent

    sets = scored.groupingSets([[k] for k in keys] + [[]], *keys).agg(F.grouping_id().alias("__g"), F.count(score).alias("n"), percent(F.col(score)).alias("score"))
    many, dimension, value = len(keys), F.lit("overall"), F.lit("all")
    for i, k in enumerate(keys):
        only = ((1 << many) - 1) ^ (1 << (many - 1 - i))
        dimension = F.when(F.col("__g") == only, k).otherwise(dimension)
        value = F.when(F.col("__g") == only, F.col(k).cast("string")).otherwise(value)
    return sets.select(dimension.alias("dimension"), value.alias("value"), "n", "score")


def fact_coverage(text: Column, facts: list[str]) -> Column:
    if not facts:
        return F.lit(None).cast("double")
    return sum(F.when(text.rlike(f), 1).otherwise(0) for f in facts) / len(facts)


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, query_id: str = "query_id", id_col: str = "id", rank: str = "rank") -> DataFrame:
    """(query_id, first_rank, found, wanted): where the first relevant row stands and how many are found."""
    wanted = relevant.groupBy(query_id).agg(F.countDistinct(id_col).alias("wanted"))
    hits = ranked.join(relevant.select(query_id, id_col).distinct(), [query_id, id_col]).groupBy(query_id).agg(F.min(rank).alias("first_rank"), F.countDistinct(id_col).alias("found"))
    return wanted.join(hits, query_id, "left").select(query_id, "first_rank", F.coalesce("found", F.lit(0)).alias("found"), "wanted")


def recall_mrr(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        F.count("*").alias("queries"),
        F.avg((F.col("found") > 0).cast("double")).alias("hit_rate"),
        F.avg(F.col("found") / F.col("wanted")).alias("recall"),
        F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))).alias("mrr"),
    )


def baseline_class(group: Column, verdict: Column, fabricated: Column, trapped: Column) -> Column:
    """What an answer without context is; questions of group C have no answer."""
    unanswerable = F.when(trapped | fabricated | verdict.isin("incorrect", "partially_correct"), "hallucination").otherwise("abstained")
    answerable = (
        F.when(verdict == "abstained", "abstained").when(verdict == "correct", "correct_without_context")
        .when(verdict == "partially_correct", "partial_without_context").otherwise("hallucination")
    )
    return F.when(group == "C", unanswerable).otherwise(answerable)


def mean_of_known(*parts: Column) -> Column:
    """Mean of the parts that are not null."""
    known = F.array_compact(F.array(*parts))
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known))


def consistency(scored: DataFrame, group: str, variant: str, score: str) -> DataFrame:
    """(group, variants, consistent, delta): whether all variants score as their source does, and by how much they differ."""
    source = scored.where(F.col(variant).isNull()).select(group, F.col(score).alias("__source"))
    others = scored.where(F.col(variant).isNotNull()).join(source, group)
    return others.groupBy(group).agg(
        F.count("*").alias("variants"), F.bool_and(F.col(score) == F.col("__source")).alias("consistent"), F.avg(F.col(score) - F.col("__source")).alias("delta")
    )


def diagnosis(answered: Column, empty: Column, judged: Column, right: Column, found: Column) -> Column:
    return (
        F.when(~answered, "not_answered").when(empty, "empty_or_error").when(~judged, "not_judged").when(right, "right")
        .when(~found, "source_not_found").otherwise("source_found_answer_wrong")
    )
