"""Grounding checks, records and evidence shaping over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..operators import grounding, joins, provisions, records
from ..sources import tables as sources
from ._base import Plans, table
from .search import BM25, _bm25

P = Plans()
QUERIES, ORACLE = P.queries, P.oracle
c = F.col


@P.add(
    r"""SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(text, '[\p{L}\p{M}]+')), lambda w: regexp_matches(w, '[^\P{L}A-Za-z]') AND NOT list_contains(['que', 'für'], lower(w)))), ' ') AS words FROM documents"""
)
def foreign_script_words(spark, sf_dir):
    allowed = F.array(F.lit("que"), F.lit("für"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(grounding.foreign_words(c("text"), "A-Za-z", allowed)), " ").alias("words"))


@P.add(
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY first) AS INTEGER) AS number FROM (SELECT *, min(l_partkey) OVER (PARTITION BY l_orderkey, l_suppkey) AS first FROM lineitem)"""
)
def footnote_numbers(spark, sf_dir):
    # part keys stand for places in a draft, suppliers for its sources
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return grounding.footnotes(li, "l_orderkey", "l_partkey", "l_suppkey")


@P.add(
    f"""WITH {BM25}, b AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM bm) SELECT query_id, id FROM b WHERE score = best OR (score >= best - 5 AND score >= 10)"""
)
def evidence_within_margin(spark, sf_dir):
    return grounding.within_margin(_bm25(spark, sf_dir), "query_id", "score", 5.0, 10.0).select("query_id", "id")


@P.add(
    f"""WITH {BM25}, b AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM bm JOIN documents ON id = doc_id) SELECT query_id, array_to_string(list_sort(list(DISTINCT source)), ',') AS laws FROM b WHERE score >= best - 8 GROUP BY query_id HAVING count(DISTINCT source) >= 2"""
)
def sources_in_play(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), "source")
    return grounding.laws_in_play(_bm25(spark, sf_dir).join(d, "id"), "query_id", "source", "score", 8.0).withColumn("laws", F.array_join("laws", ","))


CARDS = [("k1", ["the+and"]), ("k2", ["que", "der+die"]), ("k3", ["of", "with+of", "is"]), ("k4", ["nowhere"])]


@P.add(
    """WITH k(card, trigger) AS (VALUES ('k1', 'the+and'), ('k2', 'que'), ('k2', 'der+die'), ('k3', 'of'), ('k3', 'with+of'), ('k3', 'is'), ('k4', 'nowhere')),
    m AS (SELECT item_id, card, count(*) AS hits FROM benchmark, k WHERE len(list_filter(string_split(trigger, '+'), lambda p: NOT contains(lower(text), p))) = 0
    AND list_contains(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), string_split(trigger, '+')[1]) GROUP BY item_id, card)
    SELECT item_id, card, hits FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, card) AS rn FROM m) WHERE rn <= 2"""
)
def card_matches(spark, sf_dir):
    cards = spark.createDataFrame(CARDS, "id string, triggers array<string>")
    return grounding.doctrine_matches(table(spark, sf_dir, "benchmark"), cards, "item_id", "text", 2)


@P.add(
    """SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars < 300 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'translated' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL), ',') AS reasons FROM documents LEFT JOIN (SELECT doc_id AS i, max(toxic) AS toxic FROM labels GROUP BY doc_id) ON doc_id = i"""
)
def escalation_reasons(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    d = table(spark, sf_dir, "documents").join(lab, "doc_id", "left")
    return d.select("doc_id", F.array_join(grounding.escalation_reasons([("short", c("n_chars") < 300), ("translated", c("lang") != "en"), ("toxic", c("toxic") == 1)]), ",").alias("reasons"))


@P.add(
    """SELECT page_id, split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1) AS matter, concat_ws(' > ', nullif(regexp_extract(url, '//([^/]+)/', 1), ''), nullif(regexp_extract(url, '//[^/]+/([a-z]{2})/', 1), '')) AS crumbs FROM pages"""
)
def breadcrumbs(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select(
        "page_id",
        records.matter_of(F.regexp_replace("url", "^[a-z]+://", "")).alias("matter"),
        records.breadcrumb(F.regexp_extract("url", "//([^/]+)/", 1), F.regexp_extract("url", "//[^/]+/([a-z]{2})/", 1)).alias("crumbs"),
    )


@P.add("SELECT CASE WHEN user_id % 5 = 0 THEN '(no job)' ELSE CAST(user_id AS VARCHAR) END AS job, count(*) AS calls, round(sum(value), 4) AS seconds, max(length(props)) AS most_tokens FROM events GROUP BY job")
def trace_report(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.when(c("user_id") % 5 != 0, c("user_id").cast("string")).alias("job_id"), c("value").alias("seconds"), F.length("props").cast("long").alias("tokens"))
    return records.trace_report(log).withColumn("seconds", F.round("seconds", 4))


@P.add("SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS rn FROM part) WHERE rn % 100 = 0")
def spread_sample(spark, sf_dir):
    return sources.shards(table(spark, sf_dir, "part").select("p_partkey"), ["p_partkey"], 100).where("row = 0").select("p_partkey")


@P.add(
    """SELECT a.doc_id AS a, b.doc_id AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS likeness FROM
    (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w FROM documents) a JOIN
    (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w FROM documents) b ON b.doc_id = a.doc_id + 1"""
)
def neighbour_likeness(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", grounding.terms(c("text")).alias("w"))
    nxt = d.select((c("doc_id") - 1).alias("doc_id"), c("doc_id").alias("b"), c("w").alias("v"))
    return d.join(nxt, "doc_id").select(c("doc_id").alias("a"), "b", F.round(joins.jaccard(c("w"), c("v")), 6).alias("likeness"))


@P.add(
    r"""SELECT doc_id, coalesce(list_filter(list_transform(string_split(text, chr(10))[1:60], lambda x: regexp_replace(x, '^[\s\x{0B}\x{85}\x{A0}\x{3000}]+|[\s\x{0B}\x{85}\x{A0}\x{3000}]+$', '', 'g')),
    lambda x: length(x) BETWEEN 4 AND 120 AND len(regexp_extract_all(x, '[\p{L}\p{N}]')) >= 3 AND NOT regexp_matches(x, '(?i)^(?:from|to|cc|date|subject|sent)\s*:'))[1], source) AS title FROM documents"""
)
def document_titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", records.title_of(c("text"), c("source")).alias("title"))


@P.add()
def header_fields(spark, sf_dir):
    return records.header_rows(table(spark, sf_dir, "documents"), "doc_id", "text")


@P.add(
    """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'repealed' ELSE 'unknown' END AS status, CASE WHEN p_size > 1 THEN p_brand || '#' || (p_size - 1) END AS previous, CASE WHEN p_name LIKE 'small%' THEN 'regulation' ELSE 'law' END AS kind FROM part"""
)
def title_kinds(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        provisions.law_status(F.when(c("p_type") == "ECONOMY", "Repealed")).alias("status"),
        provisions.previous_number(F.concat("p_brand", F.lit("#"), "p_size")).alias("previous"),
        provisions.classify_title(F.when(c("p_name").startswith("small"), F.concat(F.lit("Regulations on "), c("p_name"))).otherwise(c("p_name"))).alias("kind"),
    )


@P.add(
    f"""WITH {BM25}, h AS (SELECT query_id, rank, id FROM bm WHERE rank <= 5) SELECT query_id, id FROM h WHERE id % 2 = 0"""
)
def rows_by_id_list(spark, sf_dir):
    hits = _bm25(spark, sf_dir, 5).select("query_id", "id")
    wanted = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(c("doc_id").alias("id"))
    return hits.join(wanted, "id", "left_semi")


