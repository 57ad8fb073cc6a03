"""Functions over citations, labels, dates, amounts and drafts of answers, as column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Month names, and words that open a yes or no.
MONTHS = "january february march april may june july august september october november december".split()
HEBREW_MONTHS = "ינואר פברואר מרץ אפריל מאי יוני יולי אוגוסט ספטמבר אוקטובר נובמבר דצמבר".split()
OPENERS = {"yes": ("yes", "כן"), "no": ("no", "לא")}
CONNECTIVES = ("או", "עד", "ו", "ב", "ל", "מ", "ה", "ש", "כ")


# ---- shapes of rows


def flat_scalars(df, columns: list[str] | None = None):
    """Lists and structs as JSON text, nulls as the empty text: what a store of scalars can hold."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    flat = lambda n: F.to_json(n) if kinds[n] in ("array", "struct", "map") else F.col(n).cast("string") if kinds[n] == "string" else F.col(n)
    return df.select(*[F.coalesce(flat(n), F.lit("")).alias(n) if n in (columns or kinds) and kinds[n] in ("array", "struct", "map", "string") else F.col(n) for n in df.columns])


def from_flat(df, schema: str):
    """The inverse: columns of ``schema`` read back, the empty text as null, other columns left out."""
    from pyspark.sql.types import StructType

    wanted = StructType.fromDDL(schema)

    def read(f) -> Column:
        if f.name not in df.columns:
            return F.lit(None).cast(f.dataType)
        value = F.nullif(F.col(f.name).cast("string"), F.lit(""))
        return F.from_json(value, f.dataType.simpleString()) if f.dataType.typeName() in ("array", "struct", "map") else value.try_cast(f.dataType.simpleString())

    return df.select(*[read(f).alias(f.name) for f in wanted])


def merged_config(base: dict, over: dict) -> dict:
    """``over`` on ``base``, dictionaries key by key."""
    return base | {k: merged_config(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def cut_json_string(raw: str) -> str:
    """The value of a JSON string that may lack its end; an escape that was cut is left out."""
    body = raw.lstrip().removeprefix('"')
    decoder = json.JSONDecoder(strict=False)
    for end in range(len(body), max(-1, len(body) - 7), -1):
        try:
            return decoder.raw_decode('"' + body[:end] + '"')[0]
        except ValueError:
            continue
    return ""


# ---- dates and amounts


def month_name_date(day: Column, month: Column, year: Column) -> Column:
    """A date of a day, a month by number or name, and a year; two digits count from 2000; what is no date is null."""
    name = F.lower(F.trim(month))
    number = F.coalesce(name.try_cast("int"), *[F.when(name.isin(m, h, "ב" + h) | ((F.length(name) >= 3) & F.lit(m).startswith(name)), i) for i, (m, h) in enumerate(zip(MONTHS, HEBREW_MONTHS), 1)])
    full = F.when(year < 100, year + 2000).otherwise(year)
    return F.try_to_date(F.concat_ws("-", F.lpad(full.cast("string"), 4, "0"), F.lpad(number.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")


def gazette_date(c: Column) -> Column:
    """Day, Hebrew month and year of a heading."""
    at = lambda i: F.regexp_extract(c, rf"(\d{{1,2}})\s+ב?({'|'.join(HEBREW_MONTHS)})\s+(\d{{4}})", i)
    return month_name_date(at(1), at(2), at(3).try_cast("int"))


def day_months(c: Column) -> Column:
    """Sorted distinct "day.month" of what looks like a date and can be one."""
    pairs = F.regexp_extract_all(c, F.lit(r"(?<![\d.])(\d{1,2}[./]\d{1,2})(?!\d)"), F.lit(1))
    parts = F.transform(pairs, lambda x: F.split(F.translate(x, "/", "."), "[.]"))
    read = F.transform(parts, lambda p: F.struct(F.get(p, 0).cast("int").alias("d"), F.get(p, 1).cast("int").alias("m")))
    good = F.filter(read, lambda x: x["d"].between(1, 31) & x["m"].between(1, 12))
    return F.array_sort(F.array_distinct(F.transform(good, lambda x: F.concat_ws(".", x["d"].cast("string"), x["m"].cast("string")))))


def amounts(c: Column, least: int = 1000) -> Column:
    """Sorted distinct whole amounts of at least ``least``, thousands separators left out."""
    found = F.regexp_extract_all(c, F.lit(r"(?<![\d./,])(\d{1,3}(?:,\d{3})+|\d+)(?![\d.,/]*\d)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("bigint")), lambda x: x >= least)))


# ---- labels and numbers


def marker_kind(c: Column) -> Column:
    bare = F.regexp_replace(c, r"[()\[\].\s]", "")
    return F.when(bare.rlike("^[0-9]+$"), "digit").when(bare.rlike("^[A-Za-z]{1,3}$"), "latin").when(bare.rlike("^[א-ת]{1,3}$"), "hebrew")


def strip_marker(c: Column) -> Column:
    """A heading without its enumerator and its colon."""
    return F.trim(F.regexp_replace(c, r"^\s*(?:\(?[0-9]{1,3}[.)]|\([A-Za-zא-ת]{1,3}\)|[A-Za-zא-ת][.])\s+|\s*:\s*$", ""))


def clean_section(c: Column) -> Column:
    """A section's number without a leading word, dots and spaces, quotes unified."""
    bare = F.regexp_replace(F.translate(c, "״׳“”’", "\"'\"\"'"), r"^\s*(?:(?:[Ss]ections?|סעיפים|סעיף)\s+)?", "")
    return F.regexp_replace(bare, r"[\s.]+", "")


def range_text(first: Column, last: Column) -> Column:
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))


def part_suffix(part: Column, of: Column, lang: str = "en") -> Column:
    form = "(part %d of %d)" if lang == "en" else "(חלק %d מתוך %d)"
    return F.when(of > 1, F.format_string(" " + form, part, of)).otherwise("")


def name_starts(name: Column, key: Column) -> Column:
    return T.name_key(name).startswith(T.name_key(key))


def join_spaced_numbers(c: Column) -> Column:
    """``116 יז 12`` as ``116יז12``: a section's number, its Hebrew letters and the number after them, unless the letters are a connective."""
    # fixed values: how many digits and letters such a number has, and what may follow it
    letters = rf"(?!(?:{'|'.join(CONNECTIVES)}) )([א-ת]{{1,2}})"
    return F.regexp_replace(c, rf"(?<![\p{{L}}\p{{N}}_])(\d{{2,4}}) {letters} (\d{{1,2}})(?=[.(\s,;:\"״]|$)", "$1$2$3")


def first_numbers(items: Column) -> Column:
    """The first number of each text, once."""
    found = F.transform(items, lambda x: F.regexp_extract(x, r"([0-9]+[A-Za-zא-ת]{0,2})", 1))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def slug(c: Column) -> Column:
    return F.left(F.sha1(c), F.lit(10))


def clean_url(c: Column, hosts: list[str]) -> Column:
    """A document's address with plain slashes; null if its host is not one of ``hosts`` or it is no PDF."""
    plain = F.regexp_replace(F.translate(F.trim(c), "\\", "/"), "(?<!:)/{2,}", "/")
    host = F.lower(F.regexp_extract(plain, "^https?://([^/]+)/", 1))
    return F.when(host.isin(*hosts) & F.lower(plain).endswith(".pdf"), plain)


def normalise_citation(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(c, "״׳“”„’־–—", "\"'\"\"\"'---"), r"\s+", " "))


def unwrap_math(c: Column) -> Column:
    """``$54 %$`` as ``54%``: formulas of one number."""
    return F.regexp_replace(c, r"\$\s*([0-9]+(?:[.,][0-9]+)*)\s*\\?(%?)\s*\$", "$1$2")


# ---- words


def stem_occurs(word: Column, text: Column) -> Column:
    """The word without its last three letters, but of four at least, stands in the text."""
    return F.contains(F.lower(text), F.left(F.lower(word), F.greatest(F.length(word) - 3, F.lit(4))))


def any_listed(point: Column, listed: Column) -> Column:
    """The point holds one of the list, or stands in it, letters and digits alone compared."""
    bare = lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", "")
    return F.exists(listed, lambda x: F.contains(bare(x), bare(point)) | F.contains(bare(point), bare(x)))


def matched(patterns: Column, text: Column) -> Column:
    """The patterns, a column of lists, that the text matches."""
    return F.filter(patterns, lambda p: F.regexp_like(text, p))


def all_match(patterns: Column, text: Column) -> Column:
    return F.forall(patterns, lambda p: F.regexp_like(text, p))


def sentences_with(c: Column, words: list[str]) -> Column:
    return F.filter(T.sentences(c), lambda s: F.lower(s).rlike("|".join(rf"\b{w}\b" for w in words)))


def opener(c: Column) -> Column:
    """struct(label, rest): what a text opens with, yes or no, and the text after it."""
    word = F.lower(F.regexp_extract(c, r"^\s*([\p{L}]+)\s*(?:[,.:;!-]|$)", 1))
    label = F.when(word.isin(*OPENERS["yes"]), "yes").when(word.isin(*OPENERS["no"]), "no")
    rest = F.when(label.isNotNull(), F.regexp_replace(c, r"^\s*[\p{L}]+\s*[,.:;!-]*\s*", "")).otherwise(c)
    return F.struct(label.alias("label"), rest.alias("rest"))


def anonymise(text: Column, names: Column) -> Column:
    """Each name as ``[party i]`` by its place in the list, whole words, longest first; names of two words the other way round too.

    What is put in is not looked at again, so a name may be ``party`` or a number: texts and labels stand in turn, and only texts are cut."""
    numbered = F.transform(names, lambda n, i: F.struct(F.length(n).alias("size"), n.alias("name"), (i + 1).alias("i")))
    turned = F.transform(F.filter(numbered, lambda x: F.size(F.split(x["name"], " ")) == 2), lambda x: F.struct(x["size"].alias("size"), F.array_join(F.reverse(F.split(x["name"], " ")), " ").alias("name"), x["i"].alias("i")))
    longest = F.sort_array(F.filter(F.concat(numbered, turned), lambda x: x["size"] > 0), asc=False)
    quoted = lambda n: F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), n, F.lit(r"\E(?![\p{L}\p{N}])"))

    def cut(parts, x):
        label = F.format_string("[party %d]", x["i"])
        between = lambda s: F.flatten(F.transform(F.split(s, quoted(x["name"]), -1), lambda y, k: F.when(k > 0, F.array(label, y)).otherwise(F.array(y))))
        return F.flatten(F.transform(parts, lambda s, j: F.when(j % 2 == 0, between(s)).otherwise(F.array(s))))

    return F.array_join(F.aggregate(longest, F.array(text), cut), "")


def glossary(df, key: str, value: str, order: str, most: int):
    """(term, translation) of the first ``most`` keys, lower-cased and trimmed; a later row overrides an earlier one."""
    rows = df.select(F.lower(F.trim(key)).alias("term"), F.col(value).alias("translation"), F.col(order).alias("o")).where("term <> ''")
    first = rows.groupBy("term").agg(F.min("o").alias("first"), F.max_by("translation", "o").alias("translation"))
    return first.orderBy("first", "term").limit(most).select("term", "translation")


def prefixed(c: Column, kind: str, model: str) -> Column:
    """Models that were trained with instructions get theirs."""
    return F.concat(F.lit(f"{kind}: "), c) if "e5" in model.lower() else c


def non_finite(vector: Column) -> Column:
    """Vectors that must be encoded again."""
    return F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


# ---- citations in answers


def format_citation(claim: Column, source: Column, relation: Column | None = None) -> Column:
    fields = [F.concat(F.lit("claim="), claim), F.concat(F.lit("source="), source)]
    fields += [] if relation is None else [F.concat(F.lit("relation="), relation)]
    return F.concat(F.lit("[[CITE: "), F.concat_ws(" | ", *fields), F.lit("]]"))


def keyed_citations(c: Column) -> Column:
    """``[[CITE: c1 | s1]]`` as ``[[CITE: claim=c1 | source=s1]]``; keyed ones stay."""
    return F.regexp_replace(c, r"\[\[CITE:\s*([^\]|=]+?)\s*\|\s*([^\]|=]+?)\s*\]\]", "[[CITE: claim=$1 | source=$2]]")


def without_cited_sentences(c: Column, source: Column) -> Column:
    """The text without the sentences that cite the source."""
    return F.array_join(F.filter(T.sentences(c), lambda s: ~(F.contains(s, F.concat(F.lit("source="), source, F.lit("]"))) | F.contains(s, F.concat(F.lit("source="), source, F.lit(" "))))), " ")


def cited_excerpts(text: Column, excerpts: Column) -> Column:
    """The excerpts whose number, from 1, the text cites as ``[n]``, in the order cited, once."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\[([0-9]{1,4})\]"), F.lit(1)), lambda n: n.cast("int"))
    return F.transform(F.filter(F.array_distinct(numbers), lambda n: n.between(1, F.size(excerpts))), lambda n: F.get(excerpts, n - 1))


def evidence_block(number: Column, title: Column, text: Column, note: Column | None = None) -> Column:
    """A source as a prompt shows it."""
    about = F.lit("") if note is None else F.when(F.coalesce(note, F.lit("")) != "", F.concat(F.lit("\n<note>"), note, F.lit("</note>"))).otherwise("")
    return F.concat(F.lit('<source id="'), number.cast("string"), F.lit('" title="'), F.replace(title, F.lit('"'), F.lit("'")), F.lit('">\n'), text, about, F.lit("\n</source>"))


def numbered_block(number: Column, header: Column, text: Column) -> Column:
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), header, F.lit("\n"), text)


def trim_notes(c: Column) -> Column:
    """Working notes up to an answer's heading, without bold marks."""
    notes = F.regexp_extract(c, r"(?ism)\A(.*?)(?:^\s*#*\s*(?:answer|conclusion|תשובה|מסקנה)\s*:?\s*$|\z)", 1)
    return T.strip(F.replace(notes, F.lit("**"), F.lit("")))


def scrub_report(c: Column, banned: list[str]) -> Column:
    """A report without leaked tags and banned names; what wrote it is called the system."""
    out = F.regexp_replace(F.regexp_replace(c, r"</?[a-z_]{2,20}>|<\|[a-z_]+\|>", ""), r"(?i)\b(?:language )?model\b", "system")
    for name in banned:
        out = F.regexp_replace(out, rf"(?i)\b{name}\b", "")
    return F.trim(F.regexp_replace(out, r"[ \t]{2,}", " "))
