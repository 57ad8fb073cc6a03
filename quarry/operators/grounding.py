"""Checks of answers against their sources: citations, numbers, quotations, scripts, and reasons to escalate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def citation_problems(drafts: DataFrame, evidence: DataFrame, claims: DataFrame, draft_id: str = "draft_id", text: str = "text") -> DataFrame:
    """(draft, pos, claim, source, problem): each citation token whose source or claim is not known, or which lacks one.

    ``evidence`` has (draft, source), ``claims`` has (draft, claim); a known pair has no problem (null).
    """
    each = drafts.select(draft_id, F.posexplode(T.citation_tokens(F.col(text))).alias("pos", "t")).select(draft_id, "pos", "t.claim", "t.source")
    e = evidence.select(draft_id, "source", F.lit(True).alias("has_source")).distinct()
    k = claims.select(draft_id, "claim", F.lit(True).alias("has_claim")).distinct()
    joined = each.join(e, [draft_id, "source"], "left").join(k, [draft_id, "claim"], "left")
    problem = (
        F.when(F.col("source").isNull() | F.col("claim").isNull(), "incomplete").when(F.col("has_source").isNull(), "unknown_source").when(F.col("has_claim").isNull(), "unknown_claim")
    )
    return joined.select(draft_id, "pos", "claim", "source", problem.alias("problem"))


def footnotes(citations: DataFrame, draft_id: str, pos: str, source: str) -> DataFrame:
    """Each citation's footnote number: sources are numbered by their first appearance."""
    first = F.min(pos).over(Window.partitionBy(draft_id, source))
    return citations.withColumn("__first", first).withColumn("number", F.dense_rank().over(Window.partitionBy(draft_id).orderBy("__first"))).drop("__first")


def near_miss(unknown: DataFrame, sources: DataFrame, by: str, source: str, key: Column) -> DataFrame:
    """(by, source, repaired): an unknown source id whose law and section are those of exactly one known source."""
    known = sources.select(by, F.col(source).alias("repaired"), key.alias("__key")).distinct()
    one = known.groupBy(by, "__key").agg(F.min("repaired").alias("repaired"), F.count("*").alias("n")).where("n = 1")
    return unknown.select(by, source, key.alias("__key")).join(one, [by, "__key"]).select(by, source, "repaired")


def terms(c: Column) -> Column:
    return F.array_distinct(T.index_terms(c))


def quoted_source(claim: Column, texts: Column, least: int = 4) -> Column:
    """Index of the one text that shares most terms with a claim, beyond those all texts share; numbers weigh double.

    Null where the best has a weight below ``least`` or is not alone.
    """
    bags = F.transform(texts, terms)
    common = F.aggregate(F.slice(bags, 2, 10_000), F.get(bags, 0), lambda a, b: F.array_intersect(a, b))
    weigh = lambda ws: F.aggregate(ws, F.lit(0), lambda s, w: s + F.when(w.rlike(r"^\d"), 2).otherwise(1))
    own = lambda b: F.when(F.size(texts) > 1, F.array_except(b, common)).otherwise(b)
    scores = F.transform(bags, lambda b: weigh(F.array_intersect(terms(claim), own(b))))
    best = F.array_max(scores)
    alone = F.size(F.filter(scores, lambda s: s == best)) == 1
    return F.when((best >= least) & alone, F.array_position(scores, best) - 1).cast("int")


def restates(sentence: Column, source: Column, share: float = 0.8, least: int = 4) -> Column:
    """No number the source lacks, and most of at least ``least`` words are the source's."""
    words = terms(sentence)
    return (F.size(T.unsupported_numbers(sentence, source)) == 0) & (F.size(words) >= least) & (F.size(F.array_intersect(words, terms(source))) >= share * F.size(words))


def states_nothing(sentence: Column) -> Column:
    return (F.size(T.index_terms(sentence)) < 2) | F.trim(sentence).endswith(":")


def is_small_talk(message: Column, attached: Column, request_words: list[str]) -> Column:
    wanted = r"(?iU)\b(?:" + "|".join(request_words) + r")\b"
    return ~attached & (F.length(message) <= 40) & (F.size(T.index_terms(message)) <= 4) & ~message.rlike(wanted)


def foreign_words(c: Column, native: str, allowed: Column) -> Column:
    """Words with letters of another script than the native one, or of several, and not allowed; each once.

    ``native`` is a character class of the answer's letters.
    """
    words = F.array_distinct(F.regexp_extract_all(c, F.lit(r"([\p{L}\p{M}]+)"), F.lit(1)))
    odd = F.filter(words, lambda w: w.rlike(rf"[\p{{L}}&&[^{native}]]"))
    return F.filter(odd, lambda w: ~F.array_contains(allowed, F.lower(w)))


def missing_headings(text: Column, required: list[str]) -> Column:
    heads = F.transform(F.filter(T.lines(text), lambda x: x.rlike(r"^\s*(?:#+|\*\*|\d+[.)])")), lambda x: T.name_key(x))
    return F.filter(F.array(*[F.lit(r) for r in required]), lambda r: ~F.exists(heads, lambda h: F.contains(h, T.name_key(r))))


def duplicates(values: Column) -> Column:
    """Values that occur more than once, in order of appearance."""
    return F.filter(F.array_distinct(values), lambda v: F.size(F.filter(values, lambda w: w == v)) > 1)


def doctrine_matches(queries: DataFrame, cards: DataFrame, query_id: str, text: str, limit: int) -> DataFrame:
    """(query, card, hits): cards with a trigger that occurs; the parts of ``a+b`` must all occur.  Most triggers first.

    A trigger needs its first part's first word in the query, so cards meet queries by a word, not all with all.
    """
    q = queries.select(F.col(query_id), F.lower(text).alias("__t")).withColumn("__w", F.explode(F.array_distinct(T.index_terms(F.col("__t")))))
    k = cards.select(F.col("id").alias("card"), F.explode("triggers").alias("trigger")).withColumn("__w", F.get(T.index_terms(F.col("trigger")), 0))
    met = q.join(k, "__w").where(F.expr("forall(split(lower(trigger), '[+]'), p -> contains(__t, trim(p)))"))
    counted = met.groupBy(query_id, "card").agg(F.countDistinct("trigger").alias("hits"))
    rn = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("hits"), "card"))
    return counted.withColumn("__rn", rn).where(F.col("__rn") <= limit).drop("__rn")


def escalation_reasons(conditions: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in conditions]))


def within_margin(ranked: DataFrame, by: str, score: str, margin: float, floor: float) -> DataFrame:
    """The best row of each query, and others within ``margin`` of it that reach ``floor``."""
    best = F.max(score).over(Window.partitionBy(by))
    return ranked.withColumn("__best", best).where((F.col(score) == F.col("__best")) | ((F.col(score) >= F.col("__best") - margin) & (F.col(score) >= floor))).drop("__best")


def laws_in_play(ranked: DataFrame, by: str, law: str, score: str, margin: float) -> DataFrame:
    """(query, laws): the laws of hits near the best, where there are two or more."""
    near = within_margin(ranked, by, score, margin, float("-inf"))
    return near.groupBy(by).agg(F.array_sort(F.collect_set(law)).alias("laws")).where(F.size("laws") >= 2)
