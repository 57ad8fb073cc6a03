"""Reviews of evaluation runs: what became of each question, summaries of groups and calls, scores anew, and tables of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import casts
from . import evaluation
from .retrieval import diagnosis

c = F.col
JUDGE_FAILED = "judge failed"
POINTS = {"correct": 1.0, "partially_correct": 0.5}


def select_split(gold: DataFrame, split: str, verified_only: bool = False) -> DataFrame:
    """Rows of a split of (split, set, verified); ``verified_only`` keeps those of the first set and verified ones."""
    rows = gold.where(c("split") == split)
    return rows.where((c("set") == "v1") | F.coalesce("verified", F.lit(False))) if verified_only else rows


def key_marks(points: Column, correctness: Column, hits: Column, judged: Column) -> Column:
    """A mark for each of ``points`` key points: those hit; all for full marks without a list; null where nothing is known."""
    numbered = F.when(points > 0, F.sequence(F.lit(1), points)).otherwise(F.array().cast("array<int>"))
    marks = F.transform(numbered, lambda n: F.array_contains(hits, n))
    everything = F.transform(numbered, lambda n: F.lit(True))
    return F.when(~judged, None).when(F.coalesce(F.size(hits), F.lit(0)) > 0, marks).when(correctness == 2, everything)


def collect_run(gold: DataFrame, answers: DataFrame, judged: DataFrame, traces: DataFrame) -> DataFrame:
    """One row for each gold question with its answer, judgement, calls, score and diagnosis; each side has an id at most once.

    ``gold``: id, category, scoring, points, letter, label, sources.  ``answers``: id, answer, error, letter, label, retrieved.
    ``judged``: id, correctness, hits, note (failed judgements begin with "judge failed").  ``traces``: job, seconds, done, site, prompt_tokens.
    """
    failed = judged.where(c("note").startswith(JUDGE_FAILED)).select(c("id"), F.lit(True).alias("judge_failed")).distinct()
    good = judged.where(~F.coalesce(c("note").startswith(JUDGE_FAILED), F.lit(False))).select("id", "correctness", "hits", F.lit(True).alias("judged"))
    own = answers.select("id", F.lit(True).alias("answered"), F.trim("answer").alias("answer"), "error", c("letter").alias("said_letter"), c("label").alias("said_label"), "retrieved")
    calls = traces.groupBy(c("job").alias("id")).agg(
        F.round(F.sum(F.coalesce("seconds", F.lit(0.0))), 1).alias("seconds"),
        F.count("*").alias("calls"),
        F.count_if((c("done") == "length") & ~c("site").eqNullSafe("judge")).alias("length_stops"),
        F.max(F.coalesce("prompt_tokens", F.lit(0))).alias("most_prompt"),
    )
    rows = gold.join(own, "id", "left").join(good, "id", "left").join(failed, "id", "left").join(calls, "id", "left")
    flag = lambda x: F.coalesce(c(x), F.lit(False))
    blank = c("error").isNotNull() | (F.coalesce("answer", F.lit("")) == "")
    label_ok = F.when(c("scoring") == "label_then_judge", c("said_label").eqNullSafe(c("label")))
    letter_ok = c("said_letter").eqNullSafe(c("letter"))
    scored = F.when(blank, F.when((c("scoring") != "judge") | flag("judged"), 0.0)).otherwise(evaluation.item_score(c("scoring"), letter_ok, label_ok, c("correctness")))
    rows = rows.withColumns({"score": F.when(flag("answered"), scored), "governing": F.when(flag("answered") & (F.size("sources") > 0), F.arrays_overlap("sources", F.coalesce("retrieved", F.array().cast("array<string>"))))})
    rules = [
        ("not_answered", ~flag("answered")),
        ("empty_or_error", blank),
        ("not_judged", c("score").isNull()),
        ("right", c("score") >= 1),
        ("abstention_failed", c("category") == "abstention"),
        ("wrong_label", ~label_ok),
        ("source_not_found", ~c("governing")),
        ("source_found_answer_wrong", c("governing")),
    ]
    return rows.select(
        "id", "category", "scoring", "answer", "score", "correctness", diagnosis(rules, "answer_wrong").alias("diagnosis"), "governing",
        key_marks(c("points"), c("correctness"), c("hits"), flag("judged")).alias("key_marks"), flag("judge_failed").alias("judge_failed"),
        F.coalesce("seconds", F.lit(0.0)).alias("seconds"), F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("length_stops", F.lit(0)).alias("length_stops"), F.coalesce("most_prompt", F.lit(0)).alias("most_prompt"),
    )


def summary_by(items: DataFrame, by: str) -> DataFrame:
    """(by, n, scored, score, right, partial, wrong, unscored) for each value."""
    s = c("score")
    return items.groupBy(by).agg(
        F.count("*").alias("n"), F.count(s).alias("scored"), F.round(100 * F.avg(s), 1).alias("score"), F.count_if(s >= 1).alias("right"),
        F.count_if((s > 0) & (s < 1)).alias("partial"), F.count_if(s == 0).alias("wrong"), F.count_if(s.isNull()).alias("unscored"),
    )


def call_sites(traces: DataFrame) -> DataFrame:
    """(site, n, length_stops, errors, median_seconds, minutes, most_prompt, most_output) of the calls of (site, done, error, seconds, ...)."""
    seconds = F.coalesce("seconds", F.lit(0.0))
    return traces.groupBy("site").agg(
        F.count("*").alias("n"), F.count_if(c("done") == "length").alias("length_stops"), F.count_if(c("error").isNotNull()).alias("errors"),
        F.round(F.median(seconds), 1).alias("median_seconds"), F.round(F.sum(seconds) / 60, 1).alias("minutes"),
        F.max(F.coalesce("prompt_tokens", F.lit(0))).alias("most_prompt"), F.max(F.coalesce("output_tokens", F.lit(0))).alias("most_output"),
    )


def counters(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, value, n): rows by each value of each dimension, in one pass."""
    sides = F.array(*[F.struct(F.lit(d).alias("dimension"), c(d).cast("string").alias("value")) for d in dimensions])
    return df.select(F.explode(sides).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def first_kept(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in input order."""
    return df.orderBy(*order).limit(n)


def needs_second_look(group: Column, verdict: Column, facts: Column, traps: Column) -> Column:
    """A poor verdict on an answer that holds every fact and no trap is to be checked for a contradiction."""
    return (group != "C") & verdict.isin("incorrect", "partially_correct") & (facts == 1.0) & (F.coalesce(F.size(traps), F.lit(0)) <= 0)


def score_after(group: Column, verdict: Column, fabricated: Column, traps: Column, retrieval: Column, citation: Column) -> Column:
    """struct(score, retrieval, answer, citation): the mean of the parts that are known; questions without an answer (group C) pass or fail.

    With stored parts and a new verdict this scores a saved record again."""
    points = F.lit(0.0)
    for name, value in POINTS.items():
        points = F.when(verdict == name, value).otherwise(points)
    known = F.array_compact(F.array(retrieval, points, citation))
    mean = F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known)
    passed = verdict.isin("correct", "abstained") & ~fabricated & (F.coalesce(F.size(traps), F.lit(0)) <= 0)
    last = group == "C"
    only = lambda x: F.when(~last, x)
    return F.struct(F.when(last, passed.cast("double")).otherwise(mean).alias("score"), only(retrieval).alias("retrieval"), only(points).alias("answer"), only(citation).alias("citation"))


def heading_of(breadcrumb: Column, most: int = 80) -> Column:
    """The last crumb without its section label."""
    words = F.split(F.trim(F.element_at(F.split(breadcrumb, " > "), -1)), r"\s+")
    labelled = F.get(words, 0).isin("סעיף", "section") & (F.size(words) > 1)
    bare = F.regexp_replace(F.array_join(F.slice(words, 3, F.size(words)), " "), "^[—-] *", "")
    return F.left(F.when(labelled, bare).otherwise(F.array_join(words, " ")), F.lit(most))


def contents(chunks: DataFrame, record: str, number: str, breadcrumb: str, order: str, most: int = 300) -> DataFrame:
    """(record, number, heading, place): the first heading of each numbered section, in the order of the numbers, ``most`` a record."""
    rows = chunks.where((F.coalesce(number, F.lit("")) != "") & (c(number) != "preamble") & ~c(number).startswith("schedule:"))
    first = rows.groupBy(c(record).alias("record"), c(number).alias("number")).agg(F.min_by(c(breadcrumb), c(order)).alias("crumb"))
    place = F.row_number().over(Window.partitionBy("record").orderBy(casts.section_sort_key(c("number"))))
    return first.select("record", "number", heading_of(c("crumb")).alias("heading"), place.alias("place")).where(c("place") <= most)


def citation_failures(checks: DataFrame) -> DataFrame:
    """(turn, failures): a line for each failed check of (turn, index, claim, source, ok, problems, verdict, explanation), in order."""
    reasons = F.when(F.size("problems") > 0, F.array_join("problems", "; ")).otherwise(F.concat_ws(": ", "verdict", "explanation"))
    line = F.concat(F.lit("citation #"), (c("index") + 1).cast("string"), F.lit(" ("), c("claim"), F.lit(" -> "), c("source"), F.lit("): "), reasons)
    failed = checks.where(~c("ok")).select("turn", "index", line.alias("line"))
    return failed.groupBy("turn").agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "line"))), lambda x: x["line"]).alias("failures"))


def expanded_citations(texts: DataFrame, evidence: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text): citation tokens with the law, section, dates and kind of the evidence they name; what a token says itself stays.

    ``evidence``: source, law, section, subsection, start, end, kind.  Tokens of unknown sources keep what they have, in the same full form.
    """
    whole = r"\[\[CITE:[^\]]*\]\]"
    pieces = F.split(c(text_col), whole)
    tokens = F.regexp_extract_all(c(text_col), F.lit(whole), F.lit(0))
    rows = texts.select(c(id_col).alias("id"), pieces.alias("pieces"), tokens.alias("tokens"))
    each = rows.select("id", F.posexplode("tokens").alias("at", "token"))
    said = lambda name: F.nullif(F.trim(F.regexp_extract("token", rf"(?:CITE:|\|)\s*{name}\s*=\s*\"?([^|\"\]]*)\"?", 1)), F.lit(""))
    section = F.concat(c("section"), F.coalesce(F.concat(F.lit("("), F.nullif("subsection", F.lit("")), F.lit(")")), F.lit("")))
    dates = F.coalesce(F.concat_ws(" to ", F.when(c("end").isNotNull(), c("start").cast("string")), F.nullif(c("end").cast("string"), F.lit(""))), F.lit(""))
    known = evidence.select(c("source").alias("__source"), "law", section.alias("section"), F.when(c("end").isNull(), "current").otherwise(dates).alias("effective"), c("kind").alias("source_type"))
    met = each.withColumns({n: said(n) for n in ("claim", "source", "relation", "law_said", "section_said")}).join(known, c("source") == c("__source"), "left")
    fields = {"claim": c("claim"), "source": c("source"), "relation": c("relation"), "law": F.coalesce(said("law"), "law"), "section": F.coalesce(said("section"), "section"), "effective": F.coalesce(said("effective"), "effective"), "source_type": F.coalesce(said("source_type"), "source_type")}
    body = F.concat_ws(" | ", *[F.concat(F.lit(f'{n}="'), F.coalesce(v, F.lit("")), F.lit('"')) for n, v in fields.items()])
    full = met.select("id", "at", F.concat(F.lit("[[CITE: "), body, F.lit("]]")).alias("full"))
    listed = full.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "full"))), lambda x: x["full"]).alias("full"))
    joined = rows.join(listed, "id", "left")
    woven = F.transform("pieces", lambda p, i: F.concat(p, F.coalesce(F.get("full", i), F.lit(""))))
    return joined.select("id", F.array_join(woven, "").alias("text"))


def source_parts(source: Column) -> Column:
    """struct(law, own, inserted) of ``law@2026-07-16:6(2)>24א(ט)#p1``."""
    version, rest = F.split_part(source, F.lit(":"), F.lit(1)), F.regexp_replace(F.regexp_extract(source, r"^[^:]*:(.*)$", 1), r"#p.*$", "")
    return F.struct(F.split_part(version, F.lit("@"), F.lit(1)).alias("law"), F.split_part(rest, F.lit(">"), F.lit(1)).alias("own"), F.nullif(F.regexp_extract(rest, r"^[^>]*>(.*)$", 1), F.lit("")).alias("inserted"))


def forbidden_query(url: Column) -> Column:
    """A query that holds a statement end or an aggregation."""
    return url.contains(";") | F.lower(url).contains("aggregate(")


def marginal_title(line: Column) -> Column:
    """At most five words that end no sentence, are not quoted and open no subsection."""
    bare = F.trim(line)
    return (bare != "") & (F.size(F.split(bare, r"\s+")) <= 5) & ~bare.rlike(r"[.;:,–—-]$") & ~bare.rlike(r"^[\"'״׳]") & ~bare.rlike(r"^\([א-ת0-9a-z]{1,3}\)")


def cp1252_bytes(text: Column) -> Column:
    """The text's bytes in code page 1252, its undefined ones as they are; null where a character has none."""
    special = [(bytes([b]).decode("cp1252", "ignore"), chr(b)) for b in range(0x80, 0xA0)]
    pairs = [(a, b) for a, b in special if a and a != b]
    moved = F.translate(text, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    return F.when(moved.rlike(r"^[\x00-\xFF]*$"), F.encode(F.when(moved.rlike(r"^[\x00-\xFF]*$"), moved), "ISO-8859-1"))


def mail_date(text: Column) -> Column:
    """The day of the first Date or Sent header (``Tue, 5 Mar 2024 10:00:00 +0200``); null if there is none."""
    found = F.regexp_extract(text, r"(?mi)^\s*(?:Date|Sent)\s*:\s*(?:[A-Za-z]{3},\s*)?(\d{1,2} [A-Za-z]{3} \d{4})\b", 1)
    return F.try_to_timestamp(F.nullif(F.initcap(found), F.lit("")), F.lit("d MMM yyyy")).cast("date")


def clean_entries(entries: Column, echoed: str, denied: str | None = None) -> Column:
    """Trimmed entries with a letter or digit that repeat no error message and, if ``denied`` is given, deny nothing."""
    kept = F.filter(entries, lambda x: x.rlike(r"(?U)\w") & ~x.rlike(echoed) & (~x.rlike(denied) if denied else F.lit(True)))
    return F.transform(kept, lambda x: F.trim(x))


def contrary_notes(claims: Column, supported: Column, contrary: Column, noted: Column, searched: Column) -> Column:
    """A note for each supported claim without contrary authority that no note names, where a search was made."""
    unnamed = lambda x: ~F.exists(noted, lambda n: n.contains(x))
    missing = F.filter(claims, lambda x: F.array_contains(supported, x) & ~F.array_contains(contrary, x) & unnamed(x))
    return F.when(searched, F.transform(missing, lambda x: F.concat(x, F.lit(": no contrary authority was found (auto-recorded)")))).otherwise(F.array().cast("array<string>"))


def sampling_temperature(creativity: Column, formality: Column, by_creativity: dict[str, float], caps: dict[str, float]) -> Column:
    """The temperature of a level of creativity, no more than the level of formality allows."""
    of = lambda x, values: F.get(F.array(*[F.when(x == k, F.lit(v)) for k, v in values.items()]), 0) if len(values) == 1 else F.coalesce(*[F.when(x == k, F.lit(v)) for k, v in values.items()])
    return F.least(of(creativity, by_creativity), of(formality, caps))


def header_overrides(metadata: DataFrame, parsed: Column, fields: dict[str, str]) -> DataFrame:
    """Values of a parsed header in place of the metadata's where they are not empty."""
    own = {k: F.when(parsed & (F.size(c(v)) > 0 if dict(metadata.dtypes)[v].startswith("array") else F.coalesce(F.trim(c(v)) != "", F.lit(False))), c(v)).otherwise(c(k)) for k, v in fields.items()}
    return metadata.withColumns(own)
