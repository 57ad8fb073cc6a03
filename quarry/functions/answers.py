"""Texts of questions and answers: clauses, citations of cases, replacements, lenient JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Words that open a question's next part, and forms of case numbers and reports.
QUESTION_WORDS = "who what when where which how why whether מי מה מתי איפה איזה איך למה האם כמה".split()
CASE_NUMBER = r"([א-ת]{1,4}[\"״][א-ת]\s*\d{1,6}/\d{2,4}|[A-Z]{2,4}\s?\d{1,6}/\d{2,4})"
REPORT = r"(פ[\"״]ד\s*[א-ת]{1,3}\(\d+\)\s*\d+|\d+\s+[A-Z][A-Za-z.]{1,9}\s+\d+)"


def clauses(question: Column, least_words: int = 3) -> Column:
    """Parts of a question at a conjunction before a question word; none unless there are at least two of enough words."""
    mark = rf"(?i)\s*[,;]?\s+(?:and|or|ו-?)\s*(?=(?:{'|'.join(QUESTION_WORDS)})\b)|(?<=\?)\s+"
    parts = F.filter(F.transform(F.split(question, mark), T.strip), lambda p: F.size(T.index_terms(p)) >= least_words)
    return F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))


def case_citations(c: Column, own: Column | None = None) -> Column:
    """Case numbers, then reports, each once in order of appearance, quotes and spaces unified, without the text's own."""
    unified = F.regexp_replace(F.translate(c, "״“”", '"""'), r"[ \t]+", " ")
    found = F.concat(F.regexp_extract_all(unified, F.lit(CASE_NUMBER), F.lit(1)), F.regexp_extract_all(unified, F.lit(REPORT), F.lit(1)))
    each = F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"\s+", " ")))
    return each if own is None else F.array_remove(each, own)


def replace_words(c: Column, words: dict[str, str]) -> Column:
    """Whole words replaced, the longest first, outside of citation tokens."""
    parts = F.split(c, r"(?=\[\[CITE:)|(?<=\]\])")

    def swap(p: Column) -> Column:
        out = p
        for word in sorted(words, key=len, reverse=True):
            quoted = "".join("\\" + ch if not ch.isalnum() and not ch.isspace() else ch for ch in word)
            out = F.regexp_replace(out, rf"(?U)(?<!\w){quoted}(?!\w)", words[word])
        return F.when(p.startswith("[[CITE:"), p).otherwise(F.regexp_replace(out, " {2,}", " "))

    return F.array_join(F.transform(parts, swap), "")


def json_object(c: Column) -> Column:
    """The JSON text of an answer: plain, fenced, or from the first brace to the last; null where there is none."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    found = F.when(fenced != "", fenced).otherwise(F.nullif(braces, F.lit("")))
    return F.when(F.try_parse_json(found).isNotNull(), found)


def question_with_options(question: Column, options: Column) -> Column:
    """The question and its lettered options, a line each."""
    lettered = F.transform(options, lambda o, i: F.concat(F.char(i + 65), F.lit(") "), o))
    return F.when(F.size(options) > 0, F.concat_ws("\n", question, F.array_join(lettered, "\n"))).otherwise(question)


def conclusion_first(answer: Column) -> Column:
    """A last line such as ``Conclusion: yes`` becomes the opening label."""
    last = F.regexp_extract(answer, r"(?is)\n\s*(?:conclusion|in short|מסקנה|לסיכום)\s*:\s*([^\n]+?)\s*$", 1)
    rest = F.regexp_replace(answer, r"(?is)\n\s*(?:conclusion|in short|מסקנה|לסיכום)\s*:\s*[^\n]+\s*$", "")
    return F.when(last != "", F.concat(last, F.lit("\n"), rest)).otherwise(answer)


def drop_empty_headings(answer: Column) -> Column:
    return F.regexp_replace(answer, r"(?m)(?:\n\s*)*^#+[^\n]*\s*\z", "")


def repeated_sentences_once(answer: Column) -> Column:
    return F.array_join(F.array_distinct(T.sentences(answer)), " ")


def answer_kind(gold: Column, scoring: Column) -> Column:
    return (
        F.when(scoring == "exact_letter", "letter").when(T.yes_no(gold).isNotNull(), "yes_no").when(gold.rlike(r"(?i)cannot be (?:answered|determined)|אין מידע"), "refusal")
        .when(gold.rlike(r"^\s*[\d,.%]+\s*\S{0,12}\s*$"), "value").when(F.size(T.numbered_items(gold)) >= 3, "list").otherwise("rule")
    )


def keep_best_attempt(attempts, by: str, text: str, confidence: str):
    """Of several readings of a page the one of the highest confidence; ties go to the smaller text."""
    return attempts.groupBy(by).agg(F.min(F.struct((-F.col(confidence)).alias("c"), text)).alias("m")).select(by, F.col(f"m.{text}").alias(text), (-F.col("m.c")).alias(confidence))
