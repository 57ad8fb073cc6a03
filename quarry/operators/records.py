"""Records from documents: kinds, headers, titles, sidecars, logs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as T

MAIL_HEADER = r"(?mi)^(?:from|to|cc|date|subject|sent|מאת|אל|תאריך|נושא)\s*:"
QA_LINE = r"(?m)^\s*(?:[QA]|ש|ת)\s*[.:]"
KIND_WORDS = [("judgment", r"(?i)judgment|פסק[ -]דין"), ("contract", r"(?i)agreement|contract|הסכם|חוזה"), ("pleading", r"(?i)statement of (?:claim|defen[cs]e)|כתב (?:תביעה|הגנה)"), ("letter", r"(?i)\bletter\b|מכתב")]  # fixed values


def document_kind(name: Column, text: Column) -> Column:
    """E-mail by suffix or headers, transcript by its questions and answers, then by words of the name, then of the beginning."""
    mail = F.lower(name).endswith(".eml") | (T.count_of(F.substring(text, 1, 800), MAIL_HEADER) >= 3)
    out = F.when(mail, "email").when(T.count_of(F.substring(text, 1, 6000), QA_LINE) >= 6, "transcript")
    for where in (name, F.substring(text, 1, 400)):
        for kind, words in KIND_WORDS:
            out = out.when(where.rlike(words), kind)
    return out.otherwise("document")


def title_of(text: Column, fallback: Column) -> Column:
    """The first line of 4 to 120 characters with three letters that is no mail header; else the fallback."""
    fit = F.filter(F.transform(F.slice(T.lines(text), 1, 60), T.strip), lambda x: F.length(x).between(4, 120) & (T.count_of(x, r"[\p{L}\p{N}]") >= 3) & ~x.rlike(MAIL_HEADER))
    return F.coalesce(F.get(fit, 0), fallback)


def derive_sidecar(path: Column, text: Column, modified: Column) -> Column:
    """struct(law_id, law_name, start, kind, language) where a source brings no description of its own."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"\.[^.]+$", "")
    fit = F.filter(F.transform(F.slice(T.lines(text), 1, 60), T.strip), lambda x: F.length(x).between(4, 160))
    title = F.coalesce(F.get(F.filter(fit, lambda x: x.rlike(r"\b(?:1[89]|20)\d\d\b")), 0), F.get(fit, 0), stem)
    year = F.regexp_extract(title, r"\b((?:1[89]|20)\d\d)\b", 1).try_cast("int")
    start = F.coalesce(dates.first_date(F.substring(text, 1, 600)), F.make_date(year, F.lit(1), F.lit(1)), F.to_date(modified))
    from .provisions import classify_title

    return F.struct(
        F.substring(F.sha1(title), 1, 10).alias("law_id"), title.alias("law_name"), start.alias("start"), classify_title(title).alias("kind"), T.language_by_letters(text).alias("language")
    )


def with_sidecar(sources: DataFrame, sidecars: DataFrame, path: str, text: str, modified: str) -> DataFrame:
    """Sources with the values of their sidecar, or derived ones; a text is looked at only where its sidecar leaves a value open."""
    fields = ["law_id", "law_name", "start", "kind", "language"]
    s = sidecars.select(F.col(path).alias("__path"), *[F.col(c).alias(f"__{c}") for c in fields])
    joined = sources.join(s, F.col(path) == F.col("__path"), "left")
    open_ = F.greatest(*[F.col(f"__{c}").isNull().cast("int") for c in fields]) == 1
    joined = joined.withColumn("__own", F.when(open_, derive_sidecar(F.col(path), F.col(text), F.col(modified))))
    return joined.withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(f"__own.{c}")) for c in fields}).drop("__own", "__path", *[f"__{c}" for c in fields])


def is_case_file(path: Column, suffixes: list[str]) -> Column:
    name = F.regexp_extract(path, r"([^/\\]+)$", 1)
    return F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).isin(suffixes) & ~name.rlike(r"^[.~]|^(?i:readme)|\.meta\.json$")


def matter_of(path: Column) -> Column:
    first = F.split_part(path, F.lit("/"), F.lit(1))
    return F.when(path.contains("/"), first).otherwise("(general)")


def breadcrumb(*parts: Column) -> Column:
    return F.concat_ws(" > ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def context_prefix(citation: Column, kind: Column, date: Column, judges: Column) -> Column:
    parts = F.concat_ws(" | ", F.nullif(citation, F.lit("")), F.nullif(kind, F.lit("")), F.date_format(date, "yyyy-MM-dd"), F.nullif(F.array_join(judges, ", "), F.lit("")))
    return F.concat(F.lit("["), parts, F.lit("]"))


def fit_to_tokens(text: Column, tokens: Column, most: int) -> Column:
    """A proportional cut with five percent to spare."""
    return F.when(tokens > most, F.substr(text, F.lit(1), F.floor(F.length(text) * most / tokens * 0.95).cast("int"))).otherwise(text)


ROLES = re.compile(r"\b(?:appellants?|respondents?|petitioners?|plaintiffs?|defendants?)\b|המערערי?ם?|המשיבי?ם?|העותרי?ם?", re.I)
VERSUS = re.compile(r"^\s*(?:נ\s*ג\s*ד|נגד|v\.?|versus)\s*$", re.I)
JUDGE = re.compile(r"^\s*(?:before|בפני|לפני)\b\s*:?|^\s*(?:the )?(?:hon\.?|honou?rable|כבוד)\b", re.I)
BODY = re.compile(r"^\s*(?:judgment|decision|פסק[- ]דין|החלטה)\s*:?\s*$", re.I)
COURT = re.compile(r"\bcourt\b|בית[- ]ה?משפט|בית[- ]ה?דין", re.I)


def parse_header(text: str, limit: int = 6000) -> dict:
    """Court, judges, parties by side and start of the body of a judgment, line by line."""
    out: dict = {"court": None, "judges": [], "first_side": [], "second_side": [], "body_start": 0}
    at, side = 0, "first_side"
    panel = False
    for line in text[:limit].split("\n"):
        bare = line.strip()
        if BODY.match(line):
            out["body_start"] = at + len(line) + 1
            break
        if VERSUS.match(line):
            side, panel = "second_side", False
        elif bare and out["court"] is None and COURT.search(bare) and len(bare) < 120:
            out["court"] = bare
        elif bare and (JUDGE.match(bare) or (panel and not ROLES.search(bare) and len(bare.split()) <= 5 and not re.match(r"\d", bare))):
            panel = True
            name = re.sub(r"^(?:before|בפני|לפני)\b\s*:?|\b(?:the )?(?:hon\.?|honou?rable|justice|judge|president)\b|כבוד|השופטת?|הנשיאה?", "", bare, flags=re.I).strip(" :,.")
            out["judges"] += [name] * bool(name)
        elif bare and (m := re.match(r"(?:\d+\.\s*)?(.+)", bare)) and (ROLES.search(bare) or re.match(r"\d+\.", bare)):
            panel = False
            name = ROLES.sub("", m[1]).strip(" :,-–")
            out[side] += [name] * bool(name)
        at += len(line) + 1
    out["parsed"] = bool(out["court"] and (out["judges"] or out["first_side"] or out["second_side"]) and out["body_start"])
    return out


def header_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    schema = "id long, court string, judges array<string>, first_side array<string>, second_side array<string>, body_start int, parsed boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.string())
        types = {"court": pa.string(), "judges": lists, "first_side": lists, "second_side": lists, "body_start": pa.int32(), "parsed": pa.bool_()}
        for b in batches:
            rows = [parse_header(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[n] for r in rows], t) for n, t in types.items())], ["id", *types])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, schema)


def trace_report(log: DataFrame) -> DataFrame:
    """(job, calls, seconds, tokens): rows of (job_id, seconds, tokens); those without a job together."""
    return log.groupBy(F.coalesce("job_id", F.lit("(no job)")).alias("job")).agg(F.count("*").alias("calls"), F.sum("seconds").alias("seconds"), F.max("tokens").alias("most_tokens"))


def append_log(df: DataFrame, path: str, ts: str) -> None:
    """One JSON line an entry, a folder a day."""
    df.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").json(path)


def text_quality(pages: DataFrame, id_col: str, text_col: str, failed: Column | None = None, least: int = 200) -> DataFrame:
    """(id, pages, characters, quality, notes) of documents by their pages: low for pages without text, few characters a page or a failure."""
    text = T.strip(F.coalesce(F.col(text_col), F.lit("")))
    rows = pages.select(F.col(id_col).alias("id"), text.alias("text"), (failed if failed is not None else F.lit(None).cast("string")).alias("failed"))
    letters = lambda p: F.sum(T.count_of(F.col("text"), p))
    sums = rows.groupBy("id").agg(
        F.count("*").alias("pages"), F.count_if(F.col("text") == "").alias("scanned"), F.sum(F.length("text")).alias("characters"),
        letters(T.HEBREW).alias("hebrew"), letters(r"\p{L}").alias("letters"), F.max("failed").alias("failed"),
    )
    few = F.col("characters") / F.col("pages") < least
    notes = F.array_compact(
        F.array(
            F.when(F.col("failed").isNotNull(), F.concat(F.lit("reading failed: "), F.col("failed"))),
            F.when(F.col("scanned") > 0, F.format_string("%d pages without text", F.col("scanned"))),
            F.when(few, F.format_string("only %d characters a page", F.floor(F.col("characters") / F.col("pages")))),
            F.when((F.col("characters") > least) & (F.col("hebrew") < 0.3 * F.col("letters")), F.lit("little Hebrew")),
        )
    )
    low = F.col("failed").isNotNull() | (F.col("scanned") > 0) | few
    return sums.select("id", "pages", "characters", F.when(low, "low").otherwise("ok").alias("quality"), notes.alias("notes"))


def case_records(rows: DataFrame, prefix: str = "supreme_court") -> DataFrame:
    """Records of raw case rows with (text, case_number, alternative_number, case_name, document_hash, dates): an id by the given hash or the text's, a title of
    number and name, the first of the dates that is one; what is blank is null."""
    some = lambda *cols: F.coalesce(*[F.nullif(F.trim(F.col(x)), F.lit("")) for x in cols])
    digest = F.coalesce(some("document_hash"), F.sha2(F.coalesce("text", F.lit("")), 256))
    day = F.get(F.filter(F.transform("dates", lambda d: F.try_to_date(F.substring(d, 1, 10), "yyyy-MM-dd")), lambda d: d.isNotNull()), 0)
    number, name = some("case_number", "alternative_number"), some("case_name")
    title = F.coalesce(F.nullif(F.concat_ws(" ", number, name), F.lit("")), F.substring(digest, 1, 16))
    return rows.select(F.concat(F.lit(f"{prefix}:"), digest).alias("id"), title.alias("title"), number.alias("case_number"), name.alias("case_name"), day.alias("decision_date"), "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def lexical_export(chunks: DataFrame, path: str, by: str = "category") -> None:
    """Chunk id, record id and lexical text as JSON lines, a folder for each category."""
    chunks.select(by, "chunk_id", "record_id", "lexical_text").write.mode("overwrite").partitionBy(by).json(path)
