"""Text functions over the whole texts of documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import legal
from ..functions import text as T
from ._base import Plans, table
from .search import TERMS

P = Plans()
QUERIES, ORACLE = P.queries, P.oracle
c = F.col

LETTERS, OTHERS = "abcdefghijklm", "אבגדהוזחטיכלמ"


@P.add(
    r"""WITH t AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Yes, ' WHEN 1 THEN 'no: ' ELSE '' END || coalesce(text, '') AS x FROM conversations), w AS (SELECT *, lower(regexp_extract(x, '^\s*(\p{L}+)\s*(?:[,.:;!-]|$)', 1)) AS word FROM t),
    l AS (SELECT *, CASE WHEN word IN ('yes', 'כן') THEN 'yes' WHEN word IN ('no', 'לא') THEN 'no' END AS label FROM w)
    SELECT conv_id, turn, label, md5(CASE WHEN label IS NULL THEN x ELSE regexp_replace(x, '^\s*\p{L}+\s*[,.:;!-]*\s*', '') END) AS rest FROM l"""
)
def answer_openings(spark, sf_dir):
    start = F.when(c("turn") % 3 == 0, "Yes, ").when(c("turn") % 3 == 1, "no: ").otherwise("")
    o = legal.opener(F.concat(start, F.coalesce("text", F.lit(""))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", o.alias("o")).select("conv_id", "turn", "o.label", F.md5("o.rest").alias("rest"))


@P.add(
    rf"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN translate(text, '{LETTERS}', '{OTHERS}') ELSE text END AS x FROM documents),
    n AS (SELECT doc_id, x, length(regexp_replace(x, '[^א-ת]', '', 'g')) AS he, length(regexp_replace(x, '[^\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(left(x, 5000), '[^א-ת]', '', 'g')) AS he5, length(regexp_replace(left(x, 5000), '[^A-Za-z]', '', 'g')) AS en5 FROM t)
    SELECT doc_id, round(CASE WHEN letters > 0 THEN he / letters ELSE 0 END, 6) AS hebrew, CASE WHEN he5 = 0 AND en5 = 0 THEN 'unknown' WHEN he5 >= en5 THEN 'he' ELSE 'en' END AS lang, list_last(regexp_extract_all(x, '\d{{4}}')) AS year FROM n"""
)
def letter_profile(spark, sf_dir):
    x = F.when(c("doc_id") % 3 == 0, F.translate("text", LETTERS, OTHERS)).otherwise(c("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", x.alias("x"))
    return d.select("doc_id", F.round(T.hebrew_ratio(c("x")), 6).alias("hebrew"), T.language_by_letters(c("x")).alias("lang"), T.law_year(c("x")).alias("year"))


@P.add(
    r"""SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(text, '[\d./,]+'), lambda r: regexp_matches(r, '^(?:\d{1,3}(?:,\d{3})+|\d+)[.,/]*$')),
      lambda r: TRY_CAST(regexp_replace(r, '[.,/]', '', 'g') AS BIGINT)), lambda v: v >= 1000))), ','), '') AS amounts FROM documents"""
)
def text_amounts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(legal.amounts(c("text")).cast("array<string>"), ",").alias("amounts"))


@P.add(
    f"""WITH d AS (SELECT doc_id, {TERMS} AS w FROM documents), n AS (SELECT doc_id, w, list_distinct(w[1:1])[1] AS a, list_filter(w, lambda x: x <> w[1])[1] AS b FROM d)
    SELECT doc_id, md5(array_to_string(list_transform(w, lambda x: CASE WHEN x = a THEN '[party 1]' WHEN x = b THEN '[party 2]' ELSE x END), ' ')) AS text FROM n WHERE b IS NOT NULL"""
)
def anonymised_texts(spark, sf_dir):
    """The first two different words of a text, as the names of its parties, in all of it."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.index_terms(c("text")).alias("w"))
    d = d.withColumn("names", F.slice(F.array_distinct("w"), 1, 2)).where(F.size("names") == 2)
    return d.select("doc_id", F.md5(legal.anonymise(F.array_join("w", " "), c("names"))).alias("text"))


@P.add(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
    m AS (SELECT doc_id, i, CASE i % 5 WHEN 0 THEN '(' || i % 100 || ') ' WHEN 1 THEN '(b) ' WHEN 2 THEN i % 100 || '. ' WHEN 3 THEN 'ב. ' ELSE '' END || line || CASE WHEN i % 2 = 0 THEN ' :' ELSE '' END AS x FROM l)
    SELECT doc_id, i, md5(trim(regexp_replace(x, '^\s*(?:\(?[0-9]{1,3}[.)]|\([A-Za-zא-ת]{1,3}\)|[A-Za-zא-ת][.])\s+|\s*:\s*$', '', 'g'))) AS heading FROM m"""
)
def marked_headings(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    n = (c("i") % 100).cast("string")
    marker = F.when(c("i") % 5 == 0, F.concat(F.lit("("), n, F.lit(") "))).when(c("i") % 5 == 1, "(b) ").when(c("i") % 5 == 2, F.concat(n, F.lit(". "))).when(c("i") % 5 == 3, "ב. ").otherwise("")
    text = F.concat(marker, c("line"), F.when(c("i") % 2 == 0, " :").otherwise(""))
    return lines.select("doc_id", c("i").cast("long").alias("i"), F.md5(legal.strip_marker(text)).alias("heading"))
