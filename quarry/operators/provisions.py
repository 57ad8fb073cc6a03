"""Laws, sections and amendments: names, numbers, references, and the joins between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from . import joins

# Words by which titles and references name their kind.
TITLE_KINDS = [("basic_law", r"^(?:חוק[ ־-]יסוד|basic law)"), ("ordinance", r"^(?:פקודת|ordinance)"), ("regulation", r"^(?:תקנות|צו|כללי|regulations?|order|rules)")]
REPEALED, IN_FORCE = r"(?i)בטל|repealed", r"(?i)תקף|in force|valid"
SECTION_WORDS = r"(?:[הבלומש]{0,2}סעיפ?י?[םף]?|sections?|§+)"


def classify_title(title: Column) -> Column:
    out = F.when(F.lit(False), "")
    for kind, pattern in TITLE_KINDS:
        out = out.when(F.lower(F.trim(title)).rlike(pattern), kind)
    return out.otherwise("law")


def law_status(validity: Column) -> Column:
    return F.when(validity.rlike(REPEALED), "repealed").when(validity.rlike(IN_FORCE), "in_force").otherwise("unknown")


def in_scope(title: Column, status: Column, excluded: list[str], named: Column) -> Column:
    """Not an excluded title; a repealed law only where a named law has its name and a year of it.  ``named``: array of names."""
    ok = ~title.rlike("|".join(f"(?:{p})" for p in excluded)) if excluded else F.lit(True)
    years = F.regexp_extract_all(title, F.lit(r"\b((?:1[89]|20)\d\d)\b"), F.lit(1))
    key = T.law_key(title)

    def names(n: Column) -> Column:
        other = T.law_key(n)
        own_years = F.regexp_extract_all(n, F.lit(r"\b((?:1[89]|20)\d\d)\b"), F.lit(1))
        return (other != "") & (F.contains(other, key) | F.contains(key, other)) & F.arrays_overlap(years, own_years)

    return ok & ((F.coalesce(status, F.lit("")) != "repealed") | F.exists(named, names))


def section_references(text: Column, own: Column, longest_range: int = 20) -> Column:
    """Numbers after section words, ranges of up to ``longest_range`` written out, without the section's own number."""
    spans = F.regexp_extract_all(text, F.lit(rf"(?i){SECTION_WORDS}\s*(\d+[a-zא-ת]?(?:\s*[-–]\s*\d+)?(?:\s*(?:,|and|ו-?|או|or)\s*\d+[a-zא-ת]?(?:\s*[-–]\s*\d+)?)*)"), F.lit(1))
    parts = F.flatten(F.transform(spans, lambda s: F.regexp_extract_all(s, F.lit(r"(\d+[a-zא-ת]?(?:\s*[-–]\s*\d+)?)"), F.lit(1))))

    def expand(p: Column) -> Column:
        lo, hi = F.regexp_extract(p, r"^(\d+)\s*[-–]", 1).try_cast("int"), F.regexp_extract(p, r"[-–]\s*(\d+)$", 1).try_cast("int")
        return F.when(lo.isNotNull() & (hi >= lo) & (hi - lo <= longest_range), F.transform(F.sequence(lo, hi), lambda n: n.cast("string"))).otherwise(
            F.array(F.regexp_extract(p, r"^(\d+[a-zא-ת]?)", 1))
        )

    return F.array_remove(F.array_distinct(F.flatten(F.transform(parts, expand))), own)


def previous_number(number: Column) -> Column:
    n = F.regexp_extract(number, r"(\d+)$", 1).try_cast("int")
    return F.when(n > 1, F.concat(F.regexp_replace(number, r"\d+$", ""), (n - 1).cast("string")))


def covers(part: Column, expected: Column) -> Column:
    """``6`` covers ``6(a)``: the base is equal and the subsections of the part begin those expected."""
    split = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([^()\s]+)"), F.lit(1))
    return F.slice(split(expected), 1, F.size(split(part))) == split(part)


def holds_section(number: Column, own: Column, inserted: Column, text: Column) -> Column:
    """A chunk holds a section: as its own, as one it inserts, or by naming it."""
    return (own == number) | F.coalesce(inserted == number, F.lit(False)) | F.array_contains(T.cited_sections(text), number)


def amendment_index(chunks: DataFrame, id_col: str, amends: str) -> DataFrame:
    """target key -> (amending chunk, number), from arrays of struct(target_key, number, relation); only ``amends``."""
    each = chunks.select(F.col(id_col).alias("id"), F.explode(amends).alias("a")).where("a.relation = 'amends'")
    return each.groupBy(F.col("a.target_key").alias("target_key")).agg(F.sort_array(F.collect_set(F.struct("id", F.col("a.number").alias("number")))).alias("amendments"))


def fuzzy_law_match(cited: DataFrame, laws: DataFrame, name: str, title: str, least: float = 0.4) -> DataFrame:
    """(name, title, tier): key and year, key alone, base of an amended name, or words of the same year alike by ``least``.

    Candidates of the last tier share the year and a word, so it is a join on both.
    """
    year = lambda c: F.coalesce(T.law_year(c), F.lit(""))
    base = lambda c: T.law_key(F.regexp_replace(c, r"\s*[(\[].*$", ""))
    a = cited.select(F.col(name).alias("name")).distinct().select("name", T.law_key(F.col("name")).alias("k"), year(F.col("name")).alias("y"), base(F.col("name")).alias("b"))
    b = laws.select(F.col(title).alias("title")).distinct().select("title", T.law_key(F.col("title")).alias("k2"), year(F.col("title")).alias("y2"), base(F.col("title")).alias("b2"))
    same = a.join(b, F.col("k") == F.col("k2")).select("name", "title", F.when(F.col("y") == F.col("y2"), 1).otherwise(2).alias("tier"), F.lit(1.0).alias("likeness"))
    bases = a.join(b, F.col("b") == F.col("b2")).select("name", "title", F.lit(3).alias("tier"), F.lit(1.0).alias("likeness"))
    aw, bw = a.withColumn("w", F.split("k", " ")), b.withColumn("w2", F.split("k2", " "))
    shared = aw.withColumn("one", F.explode(F.array_distinct("w"))).join(bw.withColumn("one2", F.explode(F.array_distinct("w2"))), (F.col("one") == F.col("one2")) & (F.col("y") == F.col("y2")))
    alike = shared.select("name", "title", "w", "w2").distinct().withColumn("likeness", joins.jaccard(F.col("w"), F.col("w2"))).where(F.col("likeness") >= least)
    every = same.unionByName(bases).unionByName(alike.select("name", "title", F.lit(4).alias("tier"), "likeness"))
    return every.groupBy("name").agg(F.min(F.struct("tier", (-F.col("likeness")).alias("l"), "title")).alias("m")).select("name", "m.title", "m.tier")


def resolve_by_words(short: Column, titles: Column, least: int = 2) -> Column:
    """Of an array of titles the one that shares most words with a short name, if at least ``least``."""
    words = lambda c: F.split(T.law_key(c), " ")
    scored = F.transform(titles, lambda t: F.struct(F.size(F.array_intersect(words(t), words(short))).alias("n"), t.alias("title")))
    best = F.array_max(scored)
    return F.when(best["n"] >= least, best["title"])


def section_parts(chunks: DataFrame, record: str, section: str, part: str, text: str, budget: int, size: str) -> DataFrame:
    """(record, section, text, parts, whole): the parts of a section in order as one text, or as many as fit."""
    w = Window.partitionBy(record, section).orderBy(part)
    run = chunks.withColumn("__run", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__rn", F.row_number().over(w))
    total = run.withColumn("__n", F.count("*").over(Window.partitionBy(record, section)))
    kept = total.where((F.col("__run") <= budget) | (F.col("__rn") == 1))
    return kept.groupBy(record, section).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(part, text))), lambda x: x[text]), "\n").alias(text),
        F.count("*").alias("parts"),
        (F.count("*") == F.first("__n")).alias("whole"),
    )


def cross_references(hits: DataFrame, chunks: DataFrame, by: str, order: str, record: str, section: str, refs: str, scan: int, limit: int) -> DataFrame:
    """Sections that the first ``scan`` hits of a query refer to in the same record, not hit yet, the first ``limit`` in order."""
    first = hits.where(F.col(order) <= scan).select(by, order, record, F.posexplode(refs).alias("__at", section))
    wanted = first.groupBy(by, record, section).agg(F.min(F.struct(order, "__at")).alias("__o"))
    fresh = wanted.join(hits.select(by, record, section).distinct(), [by, record, section], "left_anti").join(chunks.select(record, section).distinct(), [record, section], "left_semi")
    return fresh.withColumn("__rn", F.row_number().over(Window.partitionBy(by).orderBy("__o"))).where(F.col("__rn") <= limit).select(by, record, section, F.col("__rn").alias("nr"))


def definition_rows(chunks: DataFrame, term: str, text: str, by: str, distance: str) -> DataFrame:
    """Chunks that define a term (quoted, before a dash), the nearest of each law."""
    defines = F.col(text).rlike(rf"[\"״“]{term}[\"״”]\s*[-–—]")
    rn = F.row_number().over(Window.partitionBy(by).orderBy(distance))
    return chunks.where(defines).withColumn("__rn", rn).where("__rn = 1").drop("__rn")


def verification(found_law: Column, sections: Column, have: Column, numbers: Column, known: Column) -> Column:
    """What a gold item's citations come to against the corpus."""
    return (
        F.when(found_law.isNull(), "LAW_MISSING").when(F.size(sections) == 0, "LAW_ONLY")
        .when(F.size(F.array_except(sections, have)) > 0, "SECTION_MISSING")
        .when(F.size(F.array_except(numbers, known)) > 0, "NUMBERS_MISSING").otherwise("VERIFIED")
    )


def ordinal(label: Column) -> Column:
    """Value of a list marker: digits, a Latin letter, or Hebrew numerals summed; null for anything else."""
    bare = F.regexp_replace(label, r"[().\s\"'״׳]", "")
    values = {ch: v for ch, v in zip("אבגדהוזחטיכלמנסעפצקרשת", [*range(1, 10), *range(10, 100, 10), 100, 200, 300, 400])}  # fixed values
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    hebrew = F.aggregate(F.split(bare, ""), F.lit(0), lambda s, ch: s + F.coalesce(F.element_at(table, ch), F.lit(0)))
    return (
        F.when(bare.rlike(r"^\d+$"), bare.try_cast("int")).when(bare.rlike("^[a-z]$"), F.ascii(bare) - 96).when(bare.rlike("^[א-ת]{1,3}$"), hebrew)
    )
