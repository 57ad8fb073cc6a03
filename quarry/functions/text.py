"""Text functions over columns, built-in expressions first; Arrow UDFs only where Spark has none (NFC, code pages)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

# Character classes and marks of the languages served.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
HEBREW = "[א-ת]"
SUSPECT = "[À-ÿͰ-Ͽ]"
POINTS = "[֑-ׇֽֿׁׂׅׄ]"
BIDI = "[‎‏‪-‮⁦-⁩﻿]"
EXOTIC_SPACES = "[ \t  -  　]+"
FINALS = ("ךםןףץ", "כמנפצ")
ASCII_QUOTES = ("״׳“”„″‘’′", "\"'\"\"\"\"'''")
QUOTES = "\"'`׳״"
HYPHENATING = ["en", "fr", "es", "it", "de"]
PAGE_NUMBER = r"^\s*[-–—]?\s*\d{1,4}\s*[-–—]?\s*$"
PREFIXES = ["ו", "ה", "ב", "ל", "מ", "ש", "כ", "וה", "וב", "ול", "ומ", "וש", "וכ", "שה", "שב", "של", "מה", "בה", "לה", "כש", "וכש", "ושה", "ובה", "ולה", "ומה", "משה"]


def strip(c: Column) -> Column:
    """Python's ``strip``: all white space at both ends."""
    return F.regexp_replace(c, r"^[\s\u000B\u0085  -   　]+|[\s\u000B\u0085  -   　]+$", "")


def strip_control(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def normalize_unicode(c: Column) -> Column:
    return strip_control(nfc(c))


def normalize_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def dehyphenate(c: Column, lang: Column) -> Column:
    """Words wrapped over a line end are joined in languages that hyphenate."""
    return F.when(lang.isin(HYPHENATING), F.regexp_replace(c, r"(?U)(\w)-\n(\w)", "$1$2")).otherwise(c)


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def normalize_lines(c: Column) -> Column:
    """Line ends unified, direction marks removed, spaces collapsed, lines stripped, one blank line at most."""
    text = F.regexp_replace(F.regexp_replace(nfc(c), "\r\n?|[\x0b\x0c  ]", "\n"), BIDI, "")
    kept = F.array_join(F.transform(lines(F.regexp_replace(text, EXOTIC_SPACES, " ")), strip), "\n")
    return strip(F.regexp_replace(kept, r"\n{3,}", "\n\n"))


def dedupe_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(nfc(c), BIDI, ""), r"(?U)\s+", " "))


#: A pattern that is one class of characters, and what stands in it.
ONE_CLASS = re.compile(r"\[((?:[^\[\]\\^&]|\\p\{\w+\})+)\]|(\\p\{\w+\})")


def count_of(c: Column, pattern: str) -> Column:
    """Number of matches; characters of one class are counted by what stands between them, which makes no list of them."""
    one = ONE_CLASS.fullmatch(pattern)
    if one:
        return F.length(F.regexp_replace(c, f"[^{one[1] or one[2]}]++", ""))
    return F.regexp_count(c, F.lit(pattern))


def letter_count(c: Column) -> Column:
    return count_of(c, r"\p{L}")


def hebrew_ratio(c: Column) -> Column:
    return F.coalesce(count_of(c, HEBREW) / F.nullif(letter_count(c), F.lit(0)), F.lit(0.0))


def looks_mojibake(c: Column, min_chars: int = 3, min_ratio: float = 0.5) -> Column:
    suspects, letters = count_of(c, SUSPECT), letter_count(c)
    return (suspects >= min_chars) & (suspects >= min_ratio * letters) & (count_of(c, HEBREW) < suspects)


def language_by_letters(c: Column, first: int = 5000) -> Column:
    """``he`` or ``en`` by which letters prevail at the beginning; ``unknown`` without either."""
    head = F.substring(c, 1, first)
    he, en = count_of(head, HEBREW), count_of(head, "[A-Za-z]")
    return F.when(en > he, "en").when(he > 0, "he").when(he == 0, "unknown").otherwise("en")


def dominant_rtl(c: Column) -> Column:
    """The right-to-left script of at least half the letters, or null."""
    n = letter_count(c)
    return F.when((n > 0) & (2 * count_of(c, HEBREW) >= n), "he").when((n > 0) & (2 * count_of(c, "[؀-ۿ]") >= n), "ar")


def strip_points(c: Column) -> Column:
    return F.regexp_replace(c, POINTS, "")


def ascii_quotes(c: Column) -> Column:
    return F.translate(c, *ASCII_QUOTES)


def _pointed_or_quoted(c: Column) -> Column:
    """Texts with a Hebrew character or a typographic quotation mark, by two ranges; texts of single bytes have none and are not looked through."""
    return (F.octet_length(c) > F.length(c)) & c.rlike("[\u0590-\u05ff\u2018-\u2033]")


def normalize_for_index(c: Column) -> Column:
    plain = F.translate(strip_points(c), ASCII_QUOTES[0] + "־" + FINALS[0], ASCII_QUOTES[1] + "-" + FINALS[1])
    text = F.when(_pointed_or_quoted(c), plain).otherwise(c)
    return strip(F.regexp_replace(text, r"\t[ \t]*+| [ \t]++", " "))  # single spaces stay as they are


def normalize_for_embedding(c: Column, fold_finals: bool = False) -> Column:
    plain = F.when(_pointed_or_quoted(c), F.translate(strip_points(c), "“”„″‘’′", "\"\"\"\"'''")).otherwise(c)
    text = F.replace(plain, F.lit('"'), F.lit("״"))
    return F.translate(text, *FINALS) if fold_finals else text


def comparable(c: Column) -> Column:
    """Points off, quotes ASCII, one kind of hyphen, single spaces."""
    dashed = F.regexp_replace(ascii_quotes(strip_points(c)), "[־‐-―−]", "-")
    return F.trim(F.regexp_replace(dashed, r"(?U)\s+", " "))


def type_key(c: Column) -> Column:
    """A type name for comparison: quotes unified, spaces, hyphens and underscores one space."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "״“”", '"""'), r"[\s\-_־]+", " "))


def body_key(c: Column) -> Column:
    """Only letters and digits."""
    return F.regexp_replace(strip_points(c), r"(?U)[\W_]+", "")


def name_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(ascii_quotes(c)), r"(?U)[\W_]+", " "))


def law_key(c: Column) -> Column:
    """A title reduced for matching: no year after a comma, no points, quotes or dashes, no article before words."""
    text = F.split_part(F.translate(F.coalesce(c, F.lit("")), "־", " "), F.lit(","), F.lit(1))
    text = F.regexp_replace(strip_points(text), rf"[\p{{Z}}\s\p{{Pd}}\p{{Ps}}\p{{Pe}}{QUOTES}]+", " ")
    text = F.regexp_replace(text, r"\b(?:1[89]|20)\d\d\b", " ")
    words = F.array_remove(F.split(text, r"\s+"), "")
    return F.array_join(F.transform(words, lambda w: F.when(w.startswith("ה") & (F.length(w) > 3), F.substr(w, F.lit(2))).otherwise(w)), " ")


def law_year(c: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(r"(\d{4})"), F.lit(1)), F.lit(-1))


def regex_tokens(c: Column) -> Column:
    """Number of words and single marks."""
    return count_of(c, r"(?U)\w+|[^\w\s]")


def heuristic_tokens(c: Column) -> Column:
    """A model-free estimate: a token for four characters, or 2.5 beyond the European scripts."""
    per = F.when(c.rlike("[֑-￿]"), F.lit(2.5)).otherwise(F.lit(4.0))
    return F.greatest(F.lit(1), F.floor(F.length(c) / per)).cast("int")


def prompt_tokens(c: Column) -> Column:
    other = count_of(c, "[^\x00-ɏ]")
    return F.ceil(other / 1.5 + (F.length(c) - other) / 3 + 8).cast("int")


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), strip), lambda p: p != "")


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def drop_lines(c: Column, patterns: list[str]) -> Column:
    """The text without lines in which any of the patterns is found."""
    any_of = "|".join(f"(?:{p})" for p in patterns)
    return F.array_join(F.filter(lines(c), lambda x: ~x.rlike(any_of)), "\n")


def index_terms(c: Column) -> Column:
    """Words in order, without marks."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def prefix_variants(word: Column) -> Column:
    """The word and its forms without a prefix, as long as three letters remain."""
    forms = [F.when(word.startswith(p) & (F.length(word) - len(p) >= 3), F.substr(word, F.lit(len(p) + 1))) for p in PREFIXES]
    return F.array_distinct(F.array_compact(F.array(word, *forms)))


def case_tokens(c: Column) -> Column:
    """Tokens that keep inner quotes, slashes and dots; words of four letters also without their prefix."""
    found = F.regexp_extract_all(F.lower(F.translate(c, "״׳“”", "\"'\"\"")), F.lit("([0-9A-Za-zא-ת]+(?:[\"'/\\-.][0-9A-Za-zא-ת]+)*)"), F.lit(1))
    prefixed = lambda t: (F.length(t) > 3) & F.left(t, F.lit(1)).isin(*[p for p in PREFIXES if len(p) == 1]) & (F.regexp_replace(t, HEBREW, "") == "")
    pairs = F.transform(found, lambda t: F.when(prefixed(t), F.array(t, F.substr(t, F.lit(2)))).otherwise(F.array(t)))
    return F.flatten(pairs)


def first_sentence_before(c: Column, at: Column) -> Column:
    """The text before a position since the last sentence end or line end."""
    return F.regexp_extract(F.substr(c, F.lit(1), at), r"([^.!?\n]*)$", 1)


def whole_word(c: Column, word: str) -> Column:
    return c.rlike(rf"(?iU)(?<!\w){re.escape(word)}(?!\w)")


def template_tokens_to_space(c: Column) -> Column:
    """Leaked chat control strings become a space."""
    return F.regexp_replace(c, r"<\|[^|>\n]{1,40}\|>|\[/?INST\]|</?s>|<(?:start|end)_of_turn>", " ")


def numbered_items(c: Column) -> Column:
    """Items of a list such as ``1. a 2) b``, without their marks."""
    return F.filter(F.transform(F.split(c, r"(?:^|\s)\d{1,3}[.)]\s+"), lambda x: F.regexp_replace(x, r"^[\s,;.:]+|[\s,;.:]+$", "")), lambda x: x != "")


def _read_number(run: Column) -> Column:
    """The number that a run of digits, commas and points begins with: groups of three after commas as long as they go on, else digits and a fraction."""
    parts = F.split(run, ",")
    first = F.get(parts, 0)
    start = F.struct(first.alias("digits"), first.rlike(r"^\d{1,3}$").alias("open"), F.lit(False).alias("grouped"))

    def take(state: Column, part: Column) -> Column:
        fits = state["open"] & part.rlike(r"^\d{3}(?:\.|$)")
        more = F.concat(state["digits"], F.left(part, F.lit(3)))
        return F.struct(F.when(fits, more).otherwise(state["digits"]).alias("digits"), (fits & (F.length(part) == 3)).alias("open"), (state["grouped"] | fits).alias("grouped"))

    grouped = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), start, take)
    return F.when(grouped["grouped"], grouped["digits"]).otherwise(F.regexp_extract(first, r"^\d+(?:\.\d+)?", 0))


def numbers(c: Column) -> Column:
    """Distinct numbers as written, without the commas of thousands."""
    runs = F.regexp_extract_all(c, F.lit(r"[\d.,]+"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(runs, _read_number), lambda n: n != ""))


SCALES = {"thousand": 1e3, "million": 1e6, "billion": 1e9, "אלף": 1e3, "אלפים": 1e3, "מיליון": 1e6, "מיליארד": 1e9}  # fixed values


def number_values(c: Column) -> Column:
    """Values of the numbers, and the scaled values of numbers that a scale word follows."""
    out = F.transform(numbers(c), lambda n: n.cast("double"))

    def scaled_by(factor: float):
        return lambda run: F.when(_read_number(run) == F.replace(run, F.lit(","), F.lit("")), _read_number(run).cast("double") * factor)

    for word, factor in SCALES.items():
        before = F.regexp_extract_all(c, F.lit(rf"([\d.,]*\d)\s*{word}"), F.lit(1))
        out = F.concat(out, F.array_compact(F.transform(before, scaled_by(factor))))
    return F.array_distinct(out)


def unsupported_numbers(answer: Column, *evidence: Column) -> Column:
    allowed = F.array().cast("array<double>")
    for e in evidence:
        allowed = F.concat(allowed, F.coalesce(number_values(e), F.array().cast("array<double>")))
    return F.filter(numbers(answer), lambda n: ~F.array_contains(allowed, n.cast("double")))


CODE_PAGES = ["latin-1", "cp1252", "cp1253"]


def _redecode(line: str, page: str) -> str:
    return line.encode(page, "replace").decode("cp1255", "replace")


def _repair(text: str | None) -> tuple[str | None, str]:
    """The text with wrongly decoded Hebrew lines repaired, and the code page that served most lines."""
    if text is None:
        return None, "none"
    used: dict[str, int] = {}
    out = []
    for line in text.split("\n"):
        suspects = len(re.findall(SUSPECT, line))
        letters = sum(ch.isalpha() for ch in line)
        if suspects >= 3 and suspects >= 0.5 * letters and len(re.findall(HEBREW, line)) < suspects:
            tried = [(len(re.findall(HEBREW, fixed)) - fixed.count("�") - fixed.count("?"), -i, fixed) for i, fixed in enumerate(_redecode(line, p) for p in CODE_PAGES)]
            gain, at, fixed = max(tried)
            if gain > 0:
                used[CODE_PAGES[-at]] = used.get(CODE_PAGES[-at], 0) + 1
                out.append(fixed)
                continue
            used["unrepaired"] = used.get("unrepaired", 0) + 1
        out.append(line)
    return "\n".join(out), max(sorted(used), key=used.get) if used else "none"


@F.pandas_udf(StructType().add("text", "string").add("method", "string"))
def repair_encoding(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_repair(t) for t in texts], columns=["text", "method"])


JOINERS = ".,:/%-"  # marks within numbers and Latin words (fixed values)
MIRROR = str.maketrans("()[]{}<>", ")(][}{><")


@F.pandas_udf(StringType())
def visual_to_logical(texts: pd.Series) -> pd.Series:
    """Lines stored as displayed, right to left, in reading order; runs of Latin letters and digits keep theirs."""

    def turn(line: str) -> str:
        """From the end of the line on; what reads from left to right is put together in its own order."""
        out, held = [], ""
        for ch in reversed(line):
            if ch.isascii() and ch.isalnum() or held and ch in JOINERS:
                held = ch + held
                continue
            out += [held, ch.translate(MIRROR)]
            held = ""
        return "".join([*out, held])

    return texts.map(lambda t: None if t is None else "\n".join(map(turn, t.split("\n"))))


def looks_visual_order(c: Column) -> Column:
    starts, ends = count_of(c, r"(?<![א-ת])[ךםןףץ][א-ת]+"), count_of(c, r"[א-ת]+[ךםןףץ](?![א-ת])")
    return (starts >= 20) & (starts > 2 * ends)


# Spans that a translation must not touch, in order of precedence (fixed values).
MASKS = [("FORMULA", r"\$[^$\n]+\$"), ("PLACEHOLDER", r"\{[A-Za-z_]\w*\}|%[sd]"), ("UNIT", r"\d+(?:[.,]\d+)?\s?(?:km|kg|cm|mm|mg|ml|%|°C)\b"), ("NUM", r"\d+(?:[.,]\d+)*")]


def _mask(text: str | None) -> tuple[str | None, list[str]]:
    if text is None:
        return None, []
    spans: list[str] = []
    for kind, pattern in MASKS:
        count = 0

        def put(m: re.Match) -> str:
            nonlocal count
            spans.append(m[0])
            count += 1
            return f"[[{kind}_{count - 1}]]"

        parts = re.split(r"(\[\[[A-Z]+_\d+\]\])", text)
        text = "".join(p if i % 2 else re.sub(pattern, put, p) for i, p in enumerate(parts))
    return text, spans


@F.pandas_udf(StructType().add("text", "string").add("spans", ArrayType(StringType())))
def mask_spans(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_mask(t) for t in texts], columns=["text", "spans"])


@F.pandas_udf(StringType())
def unmask(texts: pd.Series, spans: pd.Series) -> pd.Series:
    def back(text: str | None, own) -> str | None:
        if text is None:
            return None
        tokens, order = re.findall(r"\[\[([A-Z]+)_(\d+)\]\]", text), [k for k, _ in MASKS]
        placed = dict(zip(sorted(set(tokens), key=lambda t: (order.index(t[0]), int(t[1]))), own))
        return re.sub(r"\[\[([A-Z]+)_(\d+)\]\]", lambda m: placed.get((m[1], m[2]), m[0]), text)

    return pd.Series([back(t, s) for t, s in zip(texts, spans)])


def cited_sections(c: Column) -> Column:
    """Distinct section numbers named in a text, without subsections."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?:sections?|סעיף|סעיפים|§)\s*(\d+[a-z]?)"), F.lit(1)))


def base_section(c: Column) -> Column:
    return F.regexp_replace(c, r"\(.*$", "")


def mcq_letter(c: Column) -> Column:
    """The letter an answer opens with, or names after ``answer``."""
    first = F.regexp_extract(c, r"^\s*\(?([A-Ea-eא-ה])[).:\s]", 1)
    named = F.regexp_extract(c, r"(?i)(?:answer|תשובה)\s*(?:is)?\s*[:\-]?\s*\(?([A-Ea-eא-ה])\b", 1)
    return F.upper(F.nullif(F.when(first != "", first).otherwise(named), F.lit("")))


def yes_no(c: Column) -> Column:
    word = F.regexp_extract(F.lower(F.substring(c, 1, 40)), r"(?U)^\W*(\w+)", 1)
    return F.when(word.isin("yes", "כן"), "yes").when(word.isin("no", "לא"), "no")


def cell_number(c: Column) -> Column:
    return F.when(c.rlike(r"^\s*-?\d{1,3}(?:,\d{3})+(?:\.\d+)?\s*$|^\s*-?\d+(?:\.\d+)?\s*$"), F.replace(F.trim(c), F.lit(","), F.lit("")).cast("double"))


def citation_tokens(c: Column) -> Column:
    """``[[CITE: claim=1 | source=x]]`` tokens as (claim, source, relation)."""
    bodies = F.regexp_extract_all(c, F.lit(r"\[\[CITE:\s*([^\]]*)\]\]"), F.lit(1))

    def field(b: Column, name: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract(b, rf"(?:^|\|)\s*{name}\s*=\s*\"?([^|\"]*)\"?", 1)), F.lit(""))

    return F.transform(bodies, lambda b: F.struct(field(b, "claim").alias("claim"), field(b, "source").alias("source"), field(b, "relation").alias("relation")))


def strip_citations(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\s*\[\[CITE:[^\]]*\]\]", ""), r"\s+([.,;:])", "$1")


def merge_overlap(first: Column, second: Column, least: int = 20, most: int = 800) -> Column:
    """``second`` without the beginning that repeats the end of ``first``."""
    sizes = F.sequence(F.least(F.length(first), F.length(second), F.lit(most)), F.lit(least), F.lit(-1))
    found = F.filter(sizes, lambda n: F.right(first, n) == F.left(second, n))
    ok = F.least(F.length(first), F.length(second)) >= least
    return F.when(ok & (F.size(found) > 0), F.ltrim(F.substr(second, F.get(found, 0) + 1))).otherwise(second)
