"""Law pages as records: parsed lines become sections, schedules and preambles by windows over each page.

Whatever a line means that depends on lines before it (the heading it stands under, the box or table of contents it is in,
the section it belongs to) is the last value of an event before it, so it is a window over the page's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .joins import two_step_join

c = F.col

# The heading of a table of contents, and marks of repealed laws.
CONTENTS = "תוכן עניינים"
REPEALED = r"\((?:בוטל|בוטלה|בוטלו)\)|(?<![א-ת])(?:הישן|הישנה|הישנות|הישנים)(?![א-ת])"
REPEALED_BOX, REPEALED_CATEGORY = r"\((?:בוטל|בוטלה|בוטלו)(?![א-ת\w])", "בוטל"


def _last(event: Column, by: Window) -> Column:
    return F.last(event, ignorenulls=True).over(by)


def placed_lines(lines: DataFrame) -> DataFrame:
    """The lines that count, with ``in_box``, ``starts`` (a block begins), ``block``, the headings above and ``part`` (0: before the first item)."""
    page = Window.partitionBy("page").orderBy("line")
    before = page.rowsBetween(Window.unboundedPreceding, -1)
    upto = page.rowsBetween(Window.unboundedPreceding, 0)
    heading, section = c("kind") == "heading", c("kind") == "section"
    contents = F.when(heading & ~c("in_div"), c("title").contains(CONTENTS)).when(section & ~c("in_div"), False)
    rows = lines.withColumn("in_contents", F.coalesce(_last(contents, before), F.lit(False)))
    rows = rows.where(~(heading & c("title").contains(CONTENTS)) & (~c("in_contents") | ((heading | section) & ~c("in_div")) | (c("kind") == "row")))

    box = F.when(c("kind") == "box_start", True).when(c("kind") == "box_end", False)
    rows = rows.withColumn("in_box", F.coalesce(_last(box, upto), F.lit(False)))
    writes = ~c("in_box") & ((c("text") != "") | (c("kind") == "item")) & ~c("kind").isin("heading", "title", "signatures")
    event = F.when(heading, "heading").when(c("kind").isin("section", "preamble"), "block").when(writes, "text")
    rows = rows.withColumns({"writes": writes, "event": event, "last_event": _last(event, before)})
    starts = (c("event") == "block") | ((c("event") == "text") & (c("last_event").isNull() | (c("last_event") == "heading")))
    rows = rows.withColumn("starts", F.coalesce(starts, F.lit(False)))
    rows = rows.withColumn("block", F.sum(c("starts").cast("int")).over(upto))
    at = {k: _last(F.when(heading & (c("level") == k), F.struct("line", "title")), upto) for k in (1, 2, 3, 4)}
    rows = rows.withColumns({f"h{k}": v for k, v in at.items()} | {"under": _last(F.when(heading, F.struct("label", "title")), upto)})
    for k in (4, 3, 2):  # a heading holds until one above it
        above = F.greatest(F.lit(-1), *[F.coalesce(c(f"h{j}.line"), F.lit(-1)) for j in range(1, k)])
        rows = rows.withColumn(f"h{k}", F.when(c(f"h{k}.line") > above, c(f"h{k}")))
    item = (c("kind") == "item") & (c("level") == 1) & c("writes")
    within = Window.partitionBy("page", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"opens_part": item, "part": F.sum(item.cast("int")).over(within)})


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _in_order(*of: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(*of)))


def sections(placed: DataFrame) -> DataFrame:
    """(page, block, line, kind, number, title, division, chapter, subchapter, note, intro, subsections, text)."""
    first = F.when(c("kind") == "section", c("label")).when((c("kind") == "preamble") | c("under").isNull(), F.lit("preamble")).otherwise(F.coalesce(F.nullif("under.label", F.lit("")), "under.title"))
    schedule = ~c("kind").isin("section", "preamble") & c("under").isNotNull()
    head = F.struct(
        "line",
        F.when(c("kind") == "section", "section").when(schedule, "schedule").otherwise("preamble").alias("kind"),
        first.alias("number"),
        F.when(c("kind") == "section", c("title")).when(schedule, c("under.title")).alias("title"),
        c("h1.title").alias("division"),
        c("h2.title").alias("chapter"),
        F.nullif(F.concat_ws(" > ", "h3.title", "h4.title"), F.lit("")).alias("subchapter"),
        "note",
    )
    # a block's head is gathered with its parts: rows that stand by page need no other shuffle, as a join by page and block would
    parts = placed.where("starts OR writes AND block > 0").groupBy("page", "block", "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c("writes"), F.struct("line", "text")))), lambda x: x["text"]), "\n").alias("text"),
        F.max(F.when(c("writes") & c("opens_part"), c("label"))).alias("label"),
        F.max("writes").alias("written"),
        F.max(F.when(c("starts"), head)).alias("head"),
    )
    stripped = _strip(c("text"))
    out = parts.groupBy("page", "block").agg(
        F.max("head").alias("head"),
        F.max(F.when(c("written") & (c("part") == 0), stripped)).alias("intro"),
        F.transform(F.array_sort(F.collect_list(F.when(c("written") & (c("part") > 0), F.struct("part", "label", "text")))), lambda x: F.struct(x["label"].alias("label"), x["text"].alias("text"))).alias("subsections"),
    )
    out = out.select("page", "block", "head.*", "intro", "subsections")
    out = out.withColumn("intro", F.coalesce("intro", F.lit("")))
    every = F.concat(F.filter(F.array("intro"), lambda x: x != ""), F.transform("subsections", lambda x: x["text"]))
    return out.withColumn("text", _strip(F.array_join(every, "\n")))


def law_records(pages: DataFrame, lines: DataFrame, id_col: str = "page_id", title_col: str = "title") -> DataFrame:
    """One row a page: title, registry id, citations, sections, whole text, unknown templates with counts, repealed, notes."""
    placed = placed_lines(lines)
    blocks = sections(placed)
    header = F.when(c("kind") == "section", F.concat(c("number"), F.lit("."), F.coalesce(F.concat(F.lit(" "), c("title")), F.lit("")), F.lit("\n"))).otherwise("")
    texts = blocks.select("page", "line", F.concat(header, c("text")).alias("text"))
    texts = texts.unionByName(placed.where("kind = 'heading'").select("page", "line", F.concat(F.lit("\n"), c("title")).alias("text")))
    body = texts.groupBy("page").agg(F.array_join(F.transform(_in_order("line", "text"), lambda x: x["text"]), "\n").alias("body"))
    fields = ("line", "kind", "number", "title", "division", "chapter", "subchapter", "note", "intro", "subsections", "text")
    built = blocks.groupBy("page").agg(F.transform(_in_order(*fields), lambda x: F.struct(*[x[f].alias(f) for f in fields[1:]])).alias("sections"))
    about = placed.groupBy("page").agg(
        F.max_by(F.when(c("kind") == "title", c("title")), F.when(c("kind") == "title", c("line"))).alias("full_title"),
        F.min_by("registry", F.when(c("registry").isNotNull(), c("line"))).alias("registry_id"),
        F.flatten(F.transform(_in_order("line", "citations"), lambda x: x["citations"])).alias("citations"),
        F.max(F.exists("categories", lambda x: x.contains(REPEALED_CATEGORY))).alias("__category"),
        F.max(c("in_box") & c("text").rlike(REPEALED_BOX)).alias("__box"),
    )
    names = placed.select("page", F.explode("unknown").alias("name")).groupBy("page", "name").agg(F.count("*").cast("int").alias("n"))
    unknown = names.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct((-c("n")).alias("minus"), "name"))), lambda x: F.struct(x["name"].alias("name"), (-x["minus"]).alias("n"))).alias("unknown"))
    known = pages.select(c(id_col).cast("long").alias("page"), c(title_col).alias("page_title"))
    out = known.join(about, "page", "left").join(built, "page", "left").join(body, "page", "left").join(unknown, "page", "left")
    title = F.coalesce(F.nullif("full_title", F.lit("")), "page_title")
    whole = _strip(F.regexp_replace(F.concat_ws("\n\n", title, "body"), r"\n{3,}", "\n\n"))
    marked = lambda x: F.coalesce(x.rlike(REPEALED), F.lit(False))
    flag = lambda x: F.coalesce(c(x), F.lit(False))
    has_sections = F.coalesce(F.exists("sections", lambda s: s["kind"] == "section"), F.lit(False))
    listed = F.array_join(F.transform(F.slice("unknown", 1, 8), lambda x: F.concat(x["name"], F.lit("×"), x["n"].cast("string"))), ", ")
    notes = F.array_compact(F.array(F.when(~has_sections, F.lit("no sections: kept as plain text")), F.when(c("unknown").isNotNull(), F.concat(F.lit("unknown templates: "), listed))))
    return out.select(
        "page",
        title.alias("title"),
        "registry_id",
        "citations",
        "sections",
        whole.alias("text"),
        "unknown",
        (marked(c("page_title")) | marked(c("full_title")) | flag("__category") | flag("__box")).alias("repealed"),
        has_sections.alias("parsed"),
        notes.alias("notes"),
    )


def corpus_records(laws: DataFrame, registry: DataFrame, id_col: str = "law_id", name_col: str = "name", date_col: str = "effective_date") -> DataFrame:
    """Law records joined with the registry by id, else by a name that is one law's alone.

    The status is ``repealed`` where the page says so; without a date the year in the title gives the first of January,
    with a note."""
    known = registry.select(c(id_col).alias("__id"), c(name_col).alias("__name"), c(date_col).cast("string").alias("__date"))
    joined = two_step_join(laws, known, "registry_id", "__id", T.name_key(c("title")), T.name_key(c("__name")))
    joined = joined.join(known.select(c("__id").alias("__of"), "__date"), c("matched_id") == c("__of"), "left")
    year = F.nullif(F.regexp_extract("title", r"(?<!\d)(1[89]\d\d|20\d\d)(?!\d)", 1), F.lit(""))
    guessed = c("__date").isNull() & year.isNotNull()
    return joined.select(
        F.concat(F.lit("wikisource:"), c("page").cast("string")).alias("id"),
        *[x for x in laws.columns if x not in ("page", "notes", "repealed")],
        c("matched_id").alias("law_id"),
        c("matched_by").alias("law_id_source"),
        F.when(c("repealed"), "repealed").otherwise("unknown").alias("status"),
        F.coalesce("__date", F.concat(year, F.lit("-01-01"))).alias("effective_date"),
        F.when(guessed, F.array_append("notes", F.lit("effective_date is the year in the title"))).otherwise(c("notes")).alias("notes"),
        F.sha2("text", 256).alias("text_sha256"),
    )
