"""Citations, labels, coverage and shaped retrieval over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import casts, legal
from ..functions import text as T
from ..operators import retrieval
from ._base import Plans, table
from .search import BM25, TERMS

P = Plans()
QUERIES, ORACLE = P.queries, P.oracle
c = F.col


@P.add("SELECT doc_id, coalesce(nullif(lang, 'en'), '') AS lang, CAST(to_json(string_split(source, '-')) AS VARCHAR) AS source, n_chars FROM documents")
def flat_scalars(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.nullif("lang", F.lit("en")).alias("lang"), F.split("source", "-").alias("source"), "n_chars")
    return legal.flat_scalars(d)


@P.add("SELECT 'orders' AS name, count(*) AS rows FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'pages', count(*) FROM pages")
def file_row_counts(spark, sf_dir):
    return retrieval.row_counts(spark, {n: f"{sf_dir}/{n}.parquet" for n in ("orders", "part", "pages")})


@P.add(
    """SELECT count(*) FILTER (WHERE a = b) AS matched, count(*) FILTER (WHERE b IS NULL) AS only_left, count(*) FILTER (WHERE a IS NULL) AS only_right, count(*) FILTER (WHERE a <> b) AS differing
    FROM (SELECT doc_id AS p, doc_id AS a FROM documents) x FULL JOIN (SELECT doc_id AS p, CASE WHEN quality = 1 THEN doc_id ELSE -doc_id END AS b FROM labels) y ON x.p = y.p"""
)
def id_alignment(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", F.when(c("quality") == 1, c("doc_id")).otherwise(-c("doc_id")).alias("own"))
    return retrieval.alignment(table(spark, sf_dir, "documents").select("doc_id", c("doc_id").alias("own")), lab, "doc_id", "own")


@P.add("SELECT lang, source, CAST(place AS INTEGER) AS place FROM (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY f, source) AS place FROM (SELECT lang, source, min(doc_id) AS f FROM documents GROUP BY lang, source)) WHERE place <= 3")
def first_sources(spark, sf_dir):
    return retrieval.first_distinct(table(spark, sf_dir, "documents"), "lang", "doc_id", "source", 3)


@P.add(
    f"""WITH RECURSIVE {BM25}, h AS (SELECT query_id, n_chars, rank AS r, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM
    (SELECT query_id, rank, n_chars, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS n FROM bm JOIN documents ON id = doc_id) WHERE n = 1),
    g AS (SELECT query_id, 1 AS rank, n_chars AS spent, true AS kept FROM h WHERE rank = 1
    UNION ALL SELECT h.query_id, h.rank, CASE WHEN g.spent + h.n_chars <= 6000 THEN g.spent + h.n_chars ELSE g.spent END, g.spent + h.n_chars <= 6000 FROM g JOIN h ON h.query_id = g.query_id AND h.rank = g.rank + 1)
    SELECT query_id, CAST(r AS INTEGER) AS rank FROM (SELECT g.query_id, h.r, row_number() OVER (PARTITION BY g.query_id ORDER BY h.r) AS n FROM g JOIN h ON g.query_id = h.query_id AND g.rank = h.rank WHERE kept) WHERE n <= 4"""
)
def one_hit_a_source(spark, sf_dir):
    from .search import _bm25

    about = table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), "source", "n_chars")
    return retrieval.one_per_source(_bm25(spark, sf_dir).join(about, "id"), "query_id", "rank", "source", "n_chars", 6000, 4).select("query_id", "rank")


SHARD_BM25 = f"""q AS (SELECT DISTINCT item_id AS query_id, unnest({TERMS}) AS term FROM benchmark), d AS (SELECT doc_id AS id, doc_id % 3 AS sh, {TERMS} AS ts FROM documents),
    s AS (SELECT sh, count(*) AS n, avg(len(ts)) AS average FROM d GROUP BY sh), p AS (SELECT id, sh, len(ts) AS length, unnest(ts) AS term FROM d),
    tf AS (SELECT sh, term, id, count(*) AS tf, any_value(length) AS length FROM p WHERE term IN (SELECT term FROM q) GROUP BY sh, term, id), df AS (SELECT sh, term, count(*) AS df FROM tf GROUP BY sh, term),
    w AS (SELECT tf.term, id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average)) AS w FROM tf JOIN df ON tf.term = df.term AND tf.sh = df.sh JOIN s ON s.sh = tf.sh),
    sc AS (SELECT query_id, id, sum(w) AS score FROM w JOIN q ON w.term = q.term GROUP BY query_id, id)"""


@P.add(f"WITH {SHARD_BM25} SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM sc) WHERE rank <= 10")
def bm25_shards(spark, sf_dir):
    found = retrieval.shard_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), c("doc_id") % 3, "doc_id", "text", "item_id", "text", 10)
    return found.withColumn("score", F.round("score", 6))


@P.add("SELECT doc_id, lang FROM documents ORDER BY sha1('7:' || doc_id), doc_id LIMIT 20")
def random_peek(spark, sf_dir):
    return retrieval.peek(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 20, 7)


@P.add("SELECT doc_id, CAST((rn - 1) // 32 AS INTEGER) AS batch, CAST((rn - 1) % 32 AS INTEGER) AS place FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rn FROM documents)")
def longest_first_batches(spark, sf_dir):
    return retrieval.longest_first(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 32).select("doc_id", "batch", "place")


@P.add(
    """SELECT o_orderkey, array_to_string(list_filter([day(o_orderdate) || '.' || month(o_orderdate)], lambda x: x <> '3.2'), ',') AS dates, CASE WHEN o_orderkey > 0 THEN CAST(o_orderkey * 1000 AS VARCHAR) ELSE '' END AS sums FROM orders"""
)
def dates_and_amounts(spark, sf_dir):
    text = F.concat(F.lit("due "), F.dayofmonth("o_orderdate").cast("string"), F.lit("/"), F.month("o_orderdate").cast("string"), F.lit("/1999, not 45.12, for "), F.format_number(c("o_orderkey") * 1000, 0), F.lit(" or 12"))
    known = F.array(F.lit("3.2"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.array_except(legal.day_months(text), known), ",").alias("dates"), F.array_join(legal.amounts(text).cast("array<string>"), ",").alias("sums"))


@P.add("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def month_name_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day = F.when(c("o_orderkey") % 5 == 0, F.lit(32)).otherwise(F.dayofmonth("o_orderdate"))
    name = F.when(c("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MMMM")).otherwise(F.month("o_orderdate").cast("string"))
    return o.select("o_orderkey", legal.month_name_date(day.cast("string"), name, F.year("o_orderdate")).cast("string").alias("day"))


@P.add("SELECT p_partkey, left(sha1(p_name), 10) AS slug, CASE p_size % 3 WHEN 0 THEN 'digit' WHEN 1 THEN 'latin' ELSE 'hebrew' END AS kind, p_name AS heading, CAST(p_size AS VARCHAR) || 'a' AS section, CASE WHEN p_size > 25 THEN ' (part 2 of 3)' ELSE '' END AS suffix, CASE WHEN p_size = 7 THEN '7' ELSE '7-' || p_size END AS span FROM part")
def labels_and_slugs(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    size = c("p_size").cast("string")
    marker = F.when(c("p_size") % 3 == 0, F.concat(F.lit("("), size, F.lit(")"))).when(c("p_size") % 3 == 1, "(b)").otherwise("(ב)")
    return p.select(
        "p_partkey",
        legal.slug(c("p_name")).alias("slug"),
        legal.marker_kind(marker).alias("kind"),
        legal.strip_marker(F.concat(marker, F.lit(" "), c("p_name"), F.lit(" :"))).alias("heading"),
        legal.clean_section(F.concat(F.lit("Section "), size, F.lit(" a."))).alias("section"),
        legal.part_suffix(F.lit(2), F.when(c("p_size") > 25, 3).otherwise(1)).alias("suffix"),
        legal.range_text(F.lit(7), c("p_size")).alias("span"),
    )


@P.add(
    """SELECT s_suppkey, '[[CITE: claim=c' || s_suppkey || ' | source=s' || s_nationkey || ']]' AS token, 'A fact. [[CITE: claim=c' || s_suppkey || ' | source=s' || s_nationkey || ']]' AS keyed, 'Kept.' AS rest FROM supplier"""
)
def citation_forms(spark, sf_dir):
    claim, source = F.concat(F.lit("c"), c("s_suppkey").cast("string")), F.concat(F.lit("s"), c("s_nationkey").cast("string"))
    token = legal.format_citation(claim, source)
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        token.alias("token"),
        legal.keyed_citations(F.concat(F.lit("A fact. [[CITE: "), claim, F.lit(" | "), source, F.lit(" ]]"))).alias("keyed"),
        legal.without_cited_sentences(F.concat(F.lit("Kept. Gone "), token, F.lit(".")), source).alias("rest"),
    )


@P.add("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS label, CASE turn % 3 WHEN 2 THEN 'Perhaps, so' ELSE 'so' END AS rest FROM conversations")
def answer_openers(spark, sf_dir):
    said = F.when(c("turn") % 3 == 0, "Yes, so").when(c("turn") % 3 == 1, "no: so").otherwise("Perhaps, so")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", legal.opener(said).alias("o")).select("conv_id", "turn", "o.label", "o.rest")


@P.add("SELECT p_partkey, array_to_string(list_filter(['^[a-m]', '[aeiou]{2}', 'x$'], lambda p: regexp_matches(p_name, p)), ' ') AS hits, regexp_matches(p_name, '^[a-m]') AND regexp_matches(p_name, 'e') AS states, contains(lower(p_name), left('chocolate', 6)) AS stem FROM part")
def patterns_and_stems(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.array_join(legal.matched(F.array(F.lit("^[a-m]"), F.lit("[aeiou]{2}"), F.lit("x$")), c("p_name")), " ").alias("hits"),
        legal.all_match(F.array(F.lit("^[a-m]"), F.lit("e")), c("p_name")).alias("states"),
        legal.stem_occurs(F.lit("chocolate"), c("p_name")).alias("stem"),
    )


@P.add(
    """SELECT source, finding, value FROM (SELECT source, unnest([CASE WHEN n >= 2 AND good < 0.8 THEN 'weak' END, CASE WHEN bad > 0 THEN 'toxic' END, CASE WHEN n < 5 THEN 'few' END]) AS finding, unnest([good, bad, CAST(n AS DOUBLE)]) AS value FROM
    (SELECT source, count(*) AS n, round(avg(quality), 6) AS good, round(avg(toxic), 6) AS bad FROM documents JOIN labels ON documents.doc_id = labels.doc_id GROUP BY source)) WHERE finding IS NOT NULL"""
)
def label_findings(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    rollup = d.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("good"), F.round(F.avg("toxic"), 6).alias("bad"))
    return retrieval.findings(rollup, "source", [("weak", (c("n") >= 2) & (c("good") < 0.8), c("good")), ("toxic", c("bad") > 0, c("bad")), ("few", c("n") < 5, c("n"))])


@P.add(
    """SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'not_judged' WHEN n_chars < 100 THEN 'empty_or_error' WHEN quality = 1 AND toxic = 0 THEN 'right' WHEN toxic = 1 THEN 'wrong_label' ELSE 'source_not_found' END AS outcome
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY outcome"""
)
def run_diagnosis(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").withColumn("judged", F.lit(True))
    rules = [("not_judged", c("judged").isNull()), ("empty_or_error", c("n_chars") < 100), ("right", (c("quality") == 1) & (c("toxic") == 0)), ("wrong_label", c("toxic") == 1)]
    d = table(spark, sf_dir, "documents").join(lab, "doc_id", "left")
    return d.select(retrieval.diagnosis(rules, "source_not_found").alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


@P.add(
    """SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'missing' ELSE 'bad' END AS fault FROM (SELECT p_partkey, p_name AS h FROM part WHERE p_size > 5) a
    FULL JOIN (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN '' ELSE p_name END AS h FROM part WHERE p_size < 40) b ON a.p_partkey = b.p_partkey WHERE a.p_partkey IS NULL OR b.p_partkey IS NULL OR a.h <> b.h"""
)
def bundle_faults(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    stored = p.where("p_size > 5").select("p_partkey", c("p_name").alias("h"))
    bundle = p.where("p_size < 40").select("p_partkey", F.when(c("p_size") % 7 == 0, "").otherwise(c("p_name")).alias("h"))
    return retrieval.bundle_faults(stored, bundle, "p_partkey", "h")


@P.add(
    """SELECT l_partkey, bool_or(k.p IS NOT NULL) AS found, count(DISTINCT l_orderkey) AS questions, coalesce(array_to_string(list_sort(list(DISTINCT CAST(l_linenumber AS VARCHAR)) FILTER (WHERE h.p IS NULL)), ','), '') AS missing FROM lineitem
    LEFT JOIN (SELECT DISTINCT l_partkey AS p, l_linenumber AS n FROM lineitem WHERE l_discount < 0.05 AND l_partkey % 4 > 0) h ON h.p = l_partkey AND h.n = l_linenumber
    LEFT JOIN (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_discount < 0.05 AND l_partkey % 4 > 0) k ON k.p = l_partkey GROUP BY l_partkey"""
)
def citation_coverage(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber", "l_orderkey", "l_discount")
    held = lines.where("l_discount < 0.05 AND l_partkey % 4 > 0")
    return retrieval.coverage(lines, held, "l_partkey", "l_linenumber", "l_orderkey").withColumn("missing", F.array_join("missing", ","))


@P.add("SELECT doc_id, '<source id=\"' || doc_id || '\" title=\"' || source || '\">' || chr(10) || lang || CASE WHEN lang <> 'en' THEN chr(10) || '<note>translated</note>' ELSE '' END || chr(10) || '</source>' AS block, '[' || doc_id || '] ' || source || chr(10) || lang AS plain, 'query: ' || lang AS asked FROM documents")
def evidence_blocks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        legal.evidence_block(c("doc_id"), c("source"), c("lang"), F.when(c("lang") != "en", "translated")).alias("block"),
        legal.numbered_block(c("doc_id"), c("source"), c("lang")).alias("plain"),
        legal.prefixed(c("lang"), "query", "multilingual-e5-large").alias("asked"),
    )


@P.add("SELECT term, translation FROM (SELECT lower(trim(p_brand)) AS term, min(p_partkey) AS f, arg_max(p_type, p_partkey) AS translation FROM part GROUP BY term) ORDER BY f, term LIMIT 12")
def glossary_terms(spark, sf_dir):
    return legal.glossary(table(spark, sf_dir, "part"), "p_brand", "p_type", "p_partkey", 12)


@P.add("SELECT n_nationkey, '[party 1] and [party 2] v. [party 1]' AS text FROM nation")
def anonymised_parties(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region").withColumnsRenamed({"r_regionkey": "n_regionkey"})
    names = F.array(F.concat(F.lit("Mr "), c("n_name")), F.concat(F.lit("Ms "), c("n_name"), F.lit(" "), c("r_name")))
    text = F.concat(F.lit("Mr "), c("n_name"), F.lit(" and Ms "), c("n_name"), F.lit(" "), c("r_name"), F.lit(" v. "), c("n_name"), F.lit(" Mr"))
    return n.join(F.broadcast(r), "n_regionkey").select("n_nationkey", legal.anonymise(text, names).alias("text"))


@P.add("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE o_orderstatus END AS first, 2 AS items, 'https://h/' || o_orderstatus || '/' || o_orderkey || '.pdf' AS url, '62' AS base, CAST(year(o_orderdate) AS VARCHAR) AS law_year, 0.0 AS hebrew, false AS odd FROM orders")
def cast_profile(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select(
        "o_orderkey",
        casts.iso_date(F.concat(day, F.lit("T10:00:00"))).alias("day"),
        casts.first_value(F.when(c("o_orderkey") % 3 == 0, "x").otherwise(" "), c("o_orderstatus")).alias("first"),
        F.size(casts.as_list(F.concat(F.lit("['"), c("o_orderstatus"), F.lit("', 'b']")))).alias("items"),
        casts.source_url("https://h/", c("o_orderstatus"), F.concat(c("o_orderkey").cast("string"), F.lit(".pdf"))).alias("url"),
        T.base_section(F.concat(F.lit("62("), c("o_orderstatus"), F.lit(")"))).alias("base"),
        T.law_year(F.concat(F.lit("Law "), day)).alias("law_year"),
        T.hebrew_ratio(c("o_orderstatus")).alias("hebrew"),
        T.looks_mojibake(c("o_orderstatus")).alias("odd"),
    )
