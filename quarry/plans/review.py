"""Reviews, contents and citations over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import records, retrieval, review
from ._base import Plans, table
from .search import BM25, _bm25

P = Plans()
QUERIES, ORACLE = P.queries, P.oracle
c = F.col


def _run(spark, sf_dir):
    """Documents as questions, labels as judgements, events as calls."""
    d = table(spark, sf_dir, "documents")
    k = c("doc_id") % 6
    scoring = F.when(k < 2, "exact_letter").when(k < 4, "label_then_judge").otherwise("judge")
    gold = d.select(c("doc_id").alias("id"), F.when(c("lang") == "es", "abstention").otherwise("law").alias("category"), scoring.alias("scoring"), F.lit(3).alias("points"), F.substring("lang", 1, 1).alias("letter"), F.substring("source", 1, 4).alias("label"), F.when(c("doc_id") % 5 > 0, F.array("source")).otherwise(F.array().cast("array<string>")).alias("sources"))
    answers = d.where("doc_id % 7 > 0").select(c("doc_id").alias("id"), F.when(c("doc_id") % 11 > 0, c("lang")).otherwise(" ").alias("answer"), F.when(c("doc_id") % 13 == 0, "failed").alias("error"), F.when(c("doc_id") % 2 == 0, "e").otherwise("d").alias("letter"), F.substring("source", 1, 4).alias("label"), F.when(c("doc_id") % 3 > 0, F.array("source", "lang")).alias("retrieved"))
    first = table(spark, sf_dir, "labels").groupBy(c("doc_id").alias("id")).agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    judged = first.select("id", (c("q") + c("t")).cast("int").alias("correctness"), F.when(c("t") == 1, F.array(F.lit(2))).otherwise(F.array().cast("array<int>")).alias("hits"), F.when(c("id") % 17 == 0, "judge failed: x").alias("note"))
    traces = table(spark, sf_dir, "events").select((c("user_id") % 1000).alias("job"), c("value").alias("seconds"), F.when(c("event_id") % 9 == 0, "length").otherwise("stop").alias("done"), c("event_type").alias("site"), (c("event_id") % 5000).alias("prompt_tokens"), (c("event_id") % 700).alias("output_tokens"), F.when(c("event_id") % 31 == 0, "e").alias("error"))
    return gold, answers, judged, traces


RUN = """g AS (SELECT doc_id AS id, CASE WHEN lang = 'es' THEN 'abstention' ELSE 'law' END AS category, CASE WHEN doc_id % 6 < 2 THEN 'exact_letter' WHEN doc_id % 6 < 4 THEN 'label_then_judge' ELSE 'judge' END AS scoring, left(lang, 1) = CASE WHEN doc_id % 2 = 0 THEN 'e' ELSE 'd' END AS letter_ok, doc_id % 7 > 0 AS answered,
      doc_id % 11 = 0 OR doc_id % 13 = 0 AS blank, CASE WHEN doc_id % 5 > 0 THEN doc_id % 3 > 0 END AS found FROM documents),
    l AS (SELECT doc_id AS id, max(quality) + max(toxic) AS correctness, max(toxic) AS t FROM labels GROUP BY doc_id HAVING doc_id % 17 <> 0),
    s AS (SELECT g.*, correctness, t, CASE WHEN NOT answered THEN NULL WHEN blank THEN CASE WHEN scoring <> 'judge' OR l.id IS NOT NULL THEN 0.0 END WHEN scoring = 'exact_letter' THEN letter_ok::INT WHEN scoring = 'judge' THEN correctness / 2 ELSE coalesce(0.5 + 0.25 * correctness, 1) END AS score FROM g LEFT JOIN l USING (id)),
    i AS (SELECT *, CASE WHEN NOT answered THEN 'not_answered' WHEN blank THEN 'empty_or_error' WHEN score IS NULL THEN 'not_judged' WHEN score >= 1 THEN 'right' WHEN category = 'abstention' THEN 'abstention_failed' WHEN NOT found THEN 'source_not_found' WHEN found THEN 'source_found_answer_wrong' ELSE 'answer_wrong' END AS diagnosis FROM s)"""


@P.add(
    f"""WITH {RUN}, e AS (SELECT user_id % 1000 AS id, round(sum(value), 1) AS seconds, count(*) AS calls, count(*) FILTER (event_id % 9 = 0 AND event_type <> 'judge') AS stops FROM events GROUP BY 1)
    SELECT i.id, category, score, diagnosis, CASE WHEN correctness IS NULL THEN NULL WHEN t = 1 THEN '0,1,0' WHEN correctness = 2 THEN '1,1,1' END AS marks, round(coalesce(seconds, 0)) AS seconds, coalesce(calls, 0) AS calls, coalesce(stops, 0) AS stops FROM i LEFT JOIN e ON e.id = i.id"""
)
def run_review(spark, sf_dir):
    out = review.collect_run(*_run(spark, sf_dir))
    return out.select("id", "category", "score", "diagnosis", F.array_join(c("key_marks").cast("array<int>").cast("array<string>"), ",").alias("marks"), F.round("seconds").alias("seconds"), "calls", c("length_stops").alias("stops"))


@P.add(f"WITH {RUN} SELECT diagnosis, count(*) AS n, count(score) AS scored, round(100 * avg(score), 1) AS score, count(*) FILTER (score >= 1) AS right, count(*) FILTER (score > 0 AND score < 1) AS partial, count(*) FILTER (score = 0) AS wrong, count(*) FILTER (score IS NULL) AS unscored FROM i GROUP BY diagnosis")
def review_summary(spark, sf_dir):
    return review.summary_by(review.collect_run(*_run(spark, sf_dir)), "diagnosis")


@P.add("SELECT event_type AS site, count(*) AS n, count(*) FILTER (event_id % 9 = 0) AS length_stops, count(*) FILTER (event_id % 31 = 0) AS errors, round(median(value), 1) AS median_seconds, round(sum(value) / 60, 1) AS minutes, max(event_id % 5000) AS most_prompt, max(event_id % 700) AS most_output FROM events GROUP BY event_type")
def call_sites(spark, sf_dir):
    return review.call_sites(_run(spark, sf_dir)[3])


@P.add("SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source UNION ALL SELECT 'size', CAST(n_chars // 1000 AS VARCHAR), count(*) FROM documents GROUP BY n_chars // 1000")
def table_counters(spark, sf_dir):
    return review.counters(table(spark, sf_dir, "documents").withColumn("size", F.expr("n_chars div 1000")), ["lang", "source", "size"])


@P.add(
    """WITH s AS (SELECT l_orderkey AS record, CAST(l_suppkey % 40 AS VARCHAR) || CASE WHEN l_linenumber = 3 THEN 'a' ELSE '' END AS number, l_suppkey % 40 AS n, CASE WHEN l_linenumber = 3 THEN 'a' ELSE '' END AS suffix, l_linenumber, 'about ' || l_partkey AS heading, l_partkey FROM lineitem WHERE l_linenumber <> 5),
    f AS (SELECT record, number, n, suffix, arg_min(heading, l_linenumber * 100000 + l_partkey) AS heading FROM s GROUP BY ALL)
    SELECT record, number, heading, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY record ORDER BY n, suffix) AS place FROM f) WHERE place <= 3"""
)
def law_contents(spark, sf_dir):
    number = F.when(c("l_linenumber") == 5, "preamble").otherwise(F.concat((c("l_suppkey") % 40).cast("string"), F.when(c("l_linenumber") == 3, "a").otherwise("")))
    crumb = F.concat(F.lit("law > section "), number, F.lit(" — about "), c("l_partkey").cast("string"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", number.alias("number"), crumb.alias("crumb"), (c("l_linenumber") * 100_000 + c("l_partkey")).alias("at"))
    return review.contents(rows, "l_orderkey", "number", "crumb", "at", 3)


@P.add(
    """SELECT doc_id AS id, CASE WHEN doc_id % 10 > 0 THEN 'said [[CITE: claim="c1" | source="' || source || '" | relation="supports" | law="' || lang || '" | section="' || (n_chars % 50) || CASE WHEN n_chars % 3 = 0 THEN '(b)' ELSE '' END || '" | effective="' || CASE WHEN doc_id % 4 = 0 THEN '1990-01-01 to 1999-12-31' ELSE 'current' END || '" | source_type="statute"]]; and '
      ELSE 'none and ' END || '[[CITE: claim="c2" | source="nowhere" | relation="" | law="own" | section="" | effective="" | source_type=""]].' AS text FROM documents"""
)
def expanded_citations(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    known = F.concat_ws("/", "source", c("doc_id").cast("string"))
    text = F.concat(F.when(c("doc_id") % 10 > 0, F.concat(F.lit("said [[CITE: claim=c1 | source="), known, F.lit(" | relation=supports]]; and "))).otherwise("none and "), F.lit('[[CITE: claim="c2" | source="nowhere" | law="own"]].'))
    evidence = d.select(known.alias("source"), c("lang").alias("law"), (c("n_chars") % 50).cast("string").alias("section"), F.when(c("n_chars") % 3 == 0, "b").alias("subsection"), F.lit("1990-01-01").cast("date").alias("start"), F.when(c("doc_id") % 4 == 0, F.lit("1999-12-31").cast("date")).alias("end"), F.lit("statute").alias("kind"))
    out = review.expanded_citations(d.select("doc_id", text.alias("text")), evidence, "doc_id", "text")
    return out.select("id", F.regexp_replace("text", r'(source="src\d+)/\d+"', '$1"').alias("text"))


@P.add(
    f"""WITH RECURSIVE {BM25}, sh AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM bm),
    f AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score FROM (SELECT query_id, id, rank FROM bm UNION ALL SELECT * FROM sh) GROUP BY query_id, id),
    c AS (SELECT doc_id AS id, source AS file, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, n_chars AS size FROM documents),
    h AS (SELECT query_id, f.id, file, i, size, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, f.id) AS rank FROM f JOIN c ON c.id = f.id), k AS (SELECT * FROM h WHERE rank <= 12),
    g AS (SELECT query_id, 1 AS rank, size AS spent, true AS kept FROM k WHERE rank = 1
      UNION ALL SELECT k.query_id, k.rank, CASE WHEN g.spent + k.size <= 15000 THEN g.spent + k.size ELSE g.spent END, g.spent + k.size <= 15000 FROM g JOIN k ON k.query_id = g.query_id AND k.rank = g.rank + 1),
    hit AS (SELECT k.query_id, k.id, file, i FROM k JOIN g ON g.query_id = k.query_id AND g.rank = k.rank WHERE kept),
    near AS (SELECT DISTINCT hit.query_id, c.id, c.file, c.i FROM hit JOIN c ON c.file = hit.file AND c.i IN (hit.i - 1, hit.i + 1) WHERE NOT EXISTS (SELECT 1 FROM hit o WHERE o.query_id = hit.query_id AND o.id = c.id)),
    b AS (SELECT *, true AS hit FROM hit UNION ALL SELECT *, false FROM near)
    SELECT query_id, id, file, CAST(i AS INTEGER) AS index, hit, CAST(row_number() OVER (PARTITION BY query_id ORDER BY file, i, id) AS INTEGER) AS place FROM b"""
)
def case_search(spark, sf_dir):
    bm = _bm25(spark, sf_dir)
    by_id = bm.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("id")))
    index = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    chunks = table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), c("source").alias("file"), index.alias("index"), c("n_chars").alias("size"))
    return retrieval.case_search([bm, by_id], chunks, 12, 15_000)


@P.add(
    r"""WITH p AS (SELECT doc_id, trim(unnest(string_split(regexp_replace(text, '[^\P{Z}\n]|[\x00-\x09\x0B-\x1F\x7F-\x9F]', ' ', 'g'), chr(10))), chr(10) || ' ') AS page FROM documents),
    s AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (page = '') AS scanned, sum(length(page))::BIGINT AS characters FROM p GROUP BY doc_id)
    SELECT doc_id AS id, pages, characters, CASE WHEN scanned > 0 OR characters / pages < 200 THEN 'low' ELSE 'ok' END AS quality,
      array_to_string(list_filter([CASE WHEN scanned > 0 THEN scanned || ' pages without text' END, CASE WHEN characters / pages < 200 THEN 'only ' || (characters // pages) || ' characters a page' END, CASE WHEN characters > 200 THEN 'little Hebrew' END], lambda x: x IS NOT NULL), '; ') AS notes FROM s"""
)
def page_text_quality(spark, sf_dir):
    """Lines as pages, all white space in them as spaces."""
    plain = F.regexp_replace("text", r"[\p{Z}&&[^\n]]|[\x00-\x09\x0B-\x1F\x7F-\x9F]", " ")
    pages = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(plain, "\n")).alias("page"))
    return records.text_quality(pages, "doc_id", "page").withColumn("notes", F.array_join("notes", "; "))


@P.add(
    """SELECT 'supreme_court:' || CASE WHEN doc_id % 3 = 0 THEN 'h' || doc_id ELSE sha256(text) END AS id, CASE WHEN doc_id % 5 = 0 THEN source WHEN doc_id % 5 = 1 THEN 'n' || doc_id ELSE 'n' || doc_id || ' ' || source END AS title,
    CASE WHEN doc_id % 5 > 0 THEN 'n' || doc_id END AS case_number, CASE WHEN doc_id % 5 <> 1 THEN source END AS case_name, CASE WHEN doc_id % 4 = 0 THEN '2001-02-03' WHEN doc_id % 4 = 1 THEN '1999-12-31' END AS decision_date, sha256(text) AS text_sha256 FROM documents"""
)
def case_records(spark, sf_dir):
    n, k = c("doc_id").cast("string"), c("doc_id") % 5
    rows = table(spark, sf_dir, "documents").select(
        "text", F.when(k > 1, F.concat(F.lit(" n"), n)).otherwise(" ").alias("case_number"), F.when(k == 1, F.concat(F.lit("n"), n)).alias("alternative_number"), F.when(k != 1, F.concat("source", F.lit(" "))).alias("case_name"),
        F.when(c("doc_id") % 3 == 0, F.concat(F.lit("h"), n)).otherwise("").alias("document_hash"),
        F.when(c("doc_id") % 4 == 0, F.array(F.lit("2001-02-03T10:00:00"), F.lit("1990-01-01"))).when(c("doc_id") % 4 == 1, F.array(F.lit("soon"), F.lit("1999-12-31"))).otherwise(F.array(F.lit(""), F.lit(None).cast("string"))).alias("dates"),
    )
    return records.case_records(rows).withColumn("decision_date", c("decision_date").cast("string")).drop("text")
