"""Law pages: wikitext that Spark lays around the lines of the given documents, parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import law_pages, tree_chunks
from ..sources import wikitext
from ._base import Plans, table

P = Plans()
QUERIES, ORACLE = P.queries, P.oracle
c = F.col

#: Lines of a document, without marks of wikitext and with single spaces.
CLEAN = r"[^\p{L}\p{N}.,;:!? \n-]"


def _pages(spark, sf_dir):
    """Seven lines make a heading, a text under it, and a section with nested templates, items and a comment."""
    lines = F.transform(F.split(F.regexp_replace("text", CLEAN, " "), "\n"), lambda x: F.trim(F.regexp_replace(x, " +", " ")))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.filter(lines, lambda x: x != "").alias("lines"))

    def laid(x, i):
        n, r = (i + 1).cast("string"), i % 7
        return (
            F.when(r == 0, F.concat(F.lit("{{ח:קטע2|h"), n, F.lit("|"), x, F.lit("}}")))
            .when(r == 1, x)
            .when(r == 2, F.concat(F.lit("{{ח:סעיף|"), n, F.lit(".|about [[x|"), x, F.lit("]]}} "), x))
            .when(r == 3, F.concat(F.lit("{{ח:ת}} "), x, F.lit(" {{ח:פנימי|x|see\n{{odd|"), n, F.lit("}}}}")))
            .when(r == 4, F.concat(F.lit("{{ח:תת|("), n, F.lit(")}} "), x))
            .when(r == 5, F.concat(F.lit("{{ח:תתת|("), n, F.lit(")}} "), x))
            .otherwise(F.concat(F.lit("{{ח:ת}} "), x, F.lit("<!-- a note -->")))
        )

    text = F.array_join(F.transform("lines", laid), "\n")
    return docs.select(c("doc_id").alias("page_id"), F.concat(F.lit("doc "), c("doc_id").cast("string")).alias("title"), text.alias("text"))


def _lines(spark, pages):
    """The parsed lines, written out and read back: several steps read them, and each would parse the pages anew."""
    from ..streaming.incremental import work_dir

    path = work_dir(spark, "law-lines")
    lines = wikitext.law_lines(pages)
    lines.write.parquet(path)
    return spark.read.schema(lines.schema).parquet(path)


LINES = r"""l AS (SELECT doc_id AS page, unnest(ls) AS x, unnest(range(len(ls)))::INTEGER AS i FROM (SELECT doc_id,
      list_filter(list_transform(string_split(regexp_replace(text, '[^\p{L}\p{N}.,;:!? \n-]', ' ', 'g'), chr(10)), lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))), lambda x: x <> '') AS ls FROM documents)),
    t AS (SELECT page, i, i // 7 AS k, i % 7 AS r, x, CASE i % 7 WHEN 3 THEN x || ' see' || chr(10) || (i + 1) WHEN 4 THEN '(' || (i + 1) || ') ' || x WHEN 5 THEN '(' || (i + 1) || ') ' || x ELSE x END AS shown FROM l),
    b AS (SELECT page, k, CASE WHEN r = 1 THEN 1 ELSE 2 END AS part, string_agg(shown, chr(10) ORDER BY i) AS text, min(i) AS i FROM t WHERE r > 0 GROUP BY ALL),
    s AS (SELECT b.page, b.k, part, CASE part WHEN 1 THEN 'schedule' ELSE 'section' END AS kind, CASE part WHEN 1 THEN 'h' || (7 * b.k + 1) ELSE '' || (7 * b.k + 3) END AS number,
      CASE part WHEN 1 THEN h.x ELSE 'about ' || o.x END AS title, h.x AS chapter, b.text FROM b JOIN t h ON h.page = b.page AND h.i = 7 * b.k LEFT JOIN t o ON o.page = b.page AND o.i = 7 * b.k + 2)"""


@P.add(f"WITH {LINES} SELECT page, row_number() OVER (PARTITION BY page ORDER BY k, part) AS block, kind, number, title, chapter, text FROM s")
def law_page_sections(spark, sf_dir):
    lines = _lines(spark, _pages(spark, sf_dir))
    return law_pages.sections(law_pages.placed_lines(lines)).select("page", "block", "kind", "number", "title", "chapter", "text")


@P.add(
    f"""WITH {LINES}, p AS (SELECT page, 7 * k AS i, chr(10) || x AS piece FROM t WHERE r = 0
      UNION ALL SELECT page, 7 * k + part, CASE part WHEN 2 THEN number || '. ' || title || chr(10) ELSE '' END || text FROM s),
    w AS (SELECT page, string_agg(piece, chr(10) ORDER BY i) AS body, count(*) FILTER (i % 7 = 2) > 0 AS parsed FROM p GROUP BY page),
    u AS (SELECT page, count(*) AS odd FROM t WHERE r = 3 GROUP BY page)
    SELECT d.doc_id AS page, 'doc ' || d.doc_id AS title, CAST(odd AS INTEGER) AS odd, coalesce(parsed, false) AS parsed,
      sha256(trim(regexp_replace(concat_ws(chr(10) || chr(10), 'doc ' || d.doc_id, body), '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) || ' ')) AS text_sha256
    FROM documents d LEFT JOIN w ON w.page = d.doc_id LEFT JOIN u ON u.page = d.doc_id"""
)
def law_page_records(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    odd = F.element_at("unknown", 1)["n"]
    return law_pages.law_records(pages, _lines(spark, pages)).select("page", "title", F.when(c("unknown").isNotNull(), odd).alias("odd"), "parsed", F.sha2("text", 256).alias("text_sha256"))


@P.add()
def law_chunks(spark, sf_dir):
    """Chunks of the law pages; tests/test_tree_chunks.py holds them against the sections they come from."""
    pages = _pages(spark, sf_dir)
    blocks = law_pages.sections(law_pages.placed_lines(_lines(spark, pages)))
    return tree_chunks.law_chunks(pages.select(c("page_id").alias("page"), "title"), blocks, 120, 20)


@P.add()
def case_chunks(spark, sf_dir):
    """Documents as case files of several pages; the same test compares them with a plain version."""
    d = table(spark, sf_dir, "documents")
    text = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 20 == 19, F.concat(x, F.lit("\f"))).otherwise(x)), "\n")
    return tree_chunks.case_chunks(d.select(c("doc_id").cast("string").alias("path"), c("source").alias("matter"), F.when(c("doc_id") % 4 == 0, "email").otherwise("document").alias("kind"), F.lit(None).cast("date").alias("date"), c("lang").alias("title"), text.alias("text")), 200, 30)
