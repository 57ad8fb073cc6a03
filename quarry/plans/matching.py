"""Phrases, containment and notes over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import matching
from ._base import Plans, table
from .search import TERMS

P = Plans()
QUERIES, ORACLE = P.queries, P.oracle
c = F.col

PHRASES = f"""p AS (SELECT item_id, array_to_string(list_slice(ts, 1, 2), ' ') AS phrase FROM (SELECT item_id, {TERMS} AS ts FROM benchmark) WHERE len(ts) >= 2),
    d AS (SELECT doc_id, ' ' || array_to_string({TERMS}, ' ') || ' ' AS words FROM documents)"""


@P.add(
    f"WITH {PHRASES} SELECT DISTINCT doc_id AS id, item_id AS law FROM d JOIN p ON contains(words, ' ' || phrase || ' ') OR contains(words, ' s' || phrase || ' ') OR contains(words, ' re' || phrase || ' ')"
)
def named_phrases(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.slice(T.index_terms(c("text")), 1, 2).alias("short")).where(F.size("short") == 2)
    found = matching.phrase_matches(table(spark, sf_dir, "documents"), asked, "doc_id", T.index_terms(c("text")), "item_id", c("short"), ("s", "re"))
    return found.select("id", c("phrase").alias("law")).distinct()


@P.add(
    f"""WITH g AS (SELECT DISTINCT ts[3] AS term, left(ts[3], 4) AS stem FROM (SELECT {TERMS} AS ts FROM benchmark) WHERE len(ts) >= 3),
    d AS (SELECT doc_id, {TERMS} AS w, {TERMS.replace("lower(text)", "lower(substr(text, 1 + length(text) // 2))")} AS said FROM documents)
    SELECT doc_id AS id, term FROM d JOIN g ON list_contains(w, term) WHERE len(list_filter(said, lambda x: starts_with(x, stem))) = 0"""
)
def missed_terms(spark, sf_dir):
    """Terms of a text that its second half, taken as its translation, does not have."""
    term = F.get(T.index_terms(c("text")), 2)
    glossary = table(spark, sf_dir, "benchmark").select(term.alias("term")).where("term is not null").distinct().withColumn("stem", F.substring("term", 1, 4))
    half = F.substr("text", F.expr("1 + length(text) div 2"))
    pairs = table(spark, sf_dir, "documents").select("doc_id", "text", half.alias("said"))
    return matching.missed_terms(pairs, glossary, "doc_id", "text", "said")


@P.add(
    f"""WITH s AS (SELECT item_id, list_distinct(list_slice({TERMS}, 1, 4)) AS s FROM benchmark), l AS (SELECT doc_id, {TERMS} AS l FROM documents)
    SELECT item_id AS small, doc_id AS large FROM s JOIN l ON len(s) > 0 AND list_has_all(l, s)"""
)
def contained_word_sets(spark, sf_dir):
    small = table(spark, sf_dir, "benchmark").select("item_id", F.slice(T.index_terms(c("text")), 1, 4).alias("s"))
    large = table(spark, sf_dir, "documents").select("doc_id", T.index_terms(c("text")).alias("l"))
    return matching.contained_pairs(small, large, "item_id", "s", "doc_id", "l")


@P.add(
    """WITH e AS (SELECT l_orderkey || '/' || l_linenumber AS id, l_suppkey % 20 AS key, l_partkey % 9 AS a, l_linenumber AS b FROM lineitem), h AS (SELECT p_partkey AS id, p_partkey % 20 AS key, p_size % 9 AS a, CASE WHEN p_partkey % 3 = 0 THEN p_size % 7 END AS b FROM part WHERE p_partkey <= 400)
    SELECT DISTINCT e.id AS expected, h.id AS chunk FROM e JOIN h ON e.key = h.key AND e.a = h.a AND (h.b IS NULL OR h.b = e.b)"""
)
def covering_sections(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("eid"), (c("l_suppkey") % 20).alias("key"), F.concat((c("l_partkey") % 9).cast("string"), F.lit("("), c("l_linenumber").cast("string"), F.lit(")")).alias("label"))
    part = F.when(c("p_partkey") % 3 == 0, F.concat(F.lit("("), (c("p_size") % 7).cast("string"), F.lit(")"))).otherwise("")
    h = table(spark, sf_dir, "part").where("p_partkey <= 400").select("p_partkey", (c("p_partkey") % 20).alias("key"), F.concat((c("p_size") % 9).cast("string"), part).alias("label"))
    return matching.covering(h, e, "p_partkey", "eid", "key", "label")


@P.add(
    """WITH e AS (SELECT o_orderkey AS source, 'law' || o_custkey % 3 AS k, o_custkey % 5 AS law_id, CAST(o_orderkey % 7 AS VARCHAR) AS section, CAST(o_orderdate AS DATE) AS start FROM orders),
    a AS (SELECT s_suppkey % 5 AS law_id, 'by' || s_suppkey % 4 AS law_name, 'law' || s_suppkey % 3 AS k, CAST(s_suppkey % 6 AS VARCHAR) AS number, DATE '1992-01-01' + CAST(s_suppkey * 97 % 2500 AS INTEGER) AS effective, CAST(s_suppkey % 7 AS VARCHAR) AS s1, CAST(s_suppkey % 4 AS VARCHAR) AS s2 FROM supplier WHERE s_suppkey <= 60 AND s_suppkey % 10 <> 0),
    m AS (SELECT source, law_name, number, effective, unnest([s1, s2]) AS s, section IN (s1, s2) AS t FROM e JOIN a ON e.k = a.k AND a.law_id <> e.law_id AND effective > start)
    SELECT source, law_name, number, CAST(min(effective) AS VARCHAR) AS effective, array_to_string(list_sort(list(DISTINCT s)), ',') AS sections, bool_or(t) AS touches,
      CAST(row_number() OVER (PARTITION BY source ORDER BY bool_or(t) DESC, min(effective), law_name, number) AS INTEGER) AS place FROM m GROUP BY source, law_name, number"""
)
def amendment_notes(spark, sf_dir):
    law = lambda x: F.concat(F.lit("law"), (c(x) % 3).cast("string"))
    e = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("source"), (c("o_custkey") % 5).alias("law_id"), law("o_custkey").alias("law_key"), (c("o_orderkey") % 7).cast("string").alias("section"), c("o_orderdate").cast("date").alias("start"))
    s = c("s_suppkey")
    a = table(spark, sf_dir, "supplier").where("s_suppkey <= 60").select(
        (s % 5).alias("law_id"), F.concat(F.lit("by"), (s % 4).cast("string")).alias("law_name"), law("s_suppkey").alias("law_key"), (s % 6).cast("string").alias("number"),
        F.date_add(F.lit("1992-01-01").cast("date"), (s * 97 % 2500).cast("int")).alias("effective"), F.array((s % 7).cast("string"), (s % 4).cast("string")).alias("sections"),
        F.when(s % 10 == 0, "reads_as").otherwise("amends").alias("relation"),
    )
    notes = matching.amendment_notes(e, a, rows_per_part=500)
    return notes.select("source", "law_name", "number", c("effective").cast("string").alias("effective"), F.array_join("sections", ",").alias("sections"), "touches", "place")
