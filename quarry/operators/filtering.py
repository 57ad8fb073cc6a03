"""Filters that say why a row goes, and line filters over the pages of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def with_reason(df: DataFrame, rules: list[tuple[str, Column]], name: str = "reason") -> DataFrame:
    """A column with the name of the first rule that holds, or null: the row stays."""
    return df.withColumn(name, F.coalesce(*[F.when(rule, F.lit(label)) for label, rule in rules]))


def matching_rules(rules: list[tuple[str, Column]]) -> Column:
    """Names of all rules that hold, in order."""
    if not rules:
        raise ValueError("a rule list must not be empty")
    return F.array_compact(F.array(*[F.when(rule, F.lit(label)) for label, rule in rules]))


def judgment_rules(text: Column, kind: Column, technical: Column, date: Column, keep: list[str], decision: str, cutoff: str, min_chars: int = 1500) -> list[tuple[str, Column]]:
    """The reasons for which a case row goes, in their order."""
    own = T.type_key(kind)
    is_decision = own == T.type_key(F.lit(decision))
    return [
        ("empty_text", text.isNull() | (T.strip(text) == "")),
        ("decision_technical_or_unknown", is_decision & F.coalesce(technical, F.lit(True))),
        ("decision_too_short", is_decision & (F.length(T.strip(text)) < min_chars)),
        ("type_not_kept", ~is_decision & ~own.isin(keep)),
        ("no_valid_date", date.isNull()),
        ("on_or_after_cutoff", date >= F.lit(cutoff).cast("date")),
    ]


def keep_rule(kind: Column, technical: Column, judgment_types: list[str]) -> Column:
    return (
        F.when(kind.isin(judgment_types), "judgment")
        .when(technical.isNull(), "technical_flag_missing")
        .when(technical, "decision_technical")
        .otherwise("decision_non_technical")
    )


def repeated_edge_lines(pages: DataFrame, doc: str, page: str, text: str, share: float) -> DataFrame:
    """Rows (doc, line): lines among the first or last two of at least max(3, share of pages) pages, or that are page numbers.

    Documents of fewer than three pages have none.
    """
    kept = pages.select(doc, page, F.filter(F.transform(T.lines(F.col(text)), T.strip), lambda x: x != "").alias("ls"))
    edges = F.array_distinct(F.concat(F.slice("ls", 1, 2), F.slice("ls", F.greatest(F.size("ls") - 1, F.lit(1)), 2)))
    each = kept.select(doc, page, F.explode(edges).alias("line"))
    count = kept.groupBy(doc).agg(F.countDistinct(page).alias("pages")).where("pages >= 3")
    least = F.greatest(F.lit(3), F.floor(F.col("pages") * F.lit(share)))
    return (
        each.groupBy(doc, "line").agg(F.countDistinct(page).alias("n")).join(count, doc).where((F.col("n") >= least) | F.col("line").rlike(T.PAGE_NUMBER)).select(doc, "line")
    )


def strip_repeated_lines(pages: DataFrame, repeated: DataFrame, doc: str, text: str) -> DataFrame:
    """Pages without the repeated lines of their document and without page numbers."""
    gone = repeated.groupBy(doc).agg(F.collect_set("line").alias("gone"))
    stays = lambda x: ~F.array_contains(F.coalesce("gone", F.array().cast("array<string>")), T.strip(x)) & ~T.strip(x).rlike(T.PAGE_NUMBER)
    return pages.join(gone, doc, "left").withColumn(text, F.array_join(F.filter(T.lines(F.col(text)), stays), "\n")).drop("gone")


def clean_pages(pages: DataFrame, doc: str, page: str, text: str, lang: str, share: float = 0.6) -> DataFrame:
    """Unicode, repeated lines, hyphenation, white space."""
    plain = pages.withColumn(text, T.normalize_unicode(F.col(text)))
    stripped = strip_repeated_lines(plain, repeated_edge_lines(plain, doc, page, text, share), doc, text)
    return stripped.withColumn(text, T.normalize_whitespace(T.dehyphenate(F.col(text), F.col(lang))))


def capped(df: DataFrame, by: list[str], order: list[Column], most: int, only: Column | None = None) -> DataFrame:
    """At most ``most`` rows of each key in order; rows for which ``only`` does not hold all stay."""
    rn = F.row_number().over(Window.partitionBy(*by, *([only] if only is not None else [])).orderBy(*order))
    keep = rn <= most if only is None else (~only | (rn <= most))
    return df.withColumn("__keep", keep).where("__keep").drop("__keep")


def looks_like_block_page(html: Column) -> Column:
    """A page that bars the reader: its title says so, or it is short and says so."""
    words = r"(?i)access denied|attention required|are you a robot|captcha|request blocked|forbidden"
    title = F.regexp_extract(F.substring(html, 1, 4096), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return title.rlike(words) | ((F.length(html) <= 20_000) & html.rlike(words))
