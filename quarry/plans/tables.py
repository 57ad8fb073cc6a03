"""Filters, duplicates, joins, reports and versions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import aggregates, chunking, dedupe, filtering, joins, ranking, versions
from ..sources import tables as sources
from ._base import Plans, table

P = Plans()
QUERIES, ORACLE = P.queries, P.oracle
c = F.col

REASONS = """CASE WHEN trim(text) = '' THEN 'empty_text' WHEN n_chars < 200 THEN 'too_short' WHEN lang NOT IN ('en', 'fr', 'de') THEN 'language_not_kept'
    WHEN source = 'src3' THEN 'source_excluded' END"""


def _reasons(docs):
    rules = [
        ("empty_text", F.trim("text") == ""),
        ("too_short", c("n_chars") < 200),
        ("language_not_kept", ~c("lang").isin("en", "fr", "de")),
        ("source_excluded", c("source") == "src3"),
    ]
    return filtering.with_reason(docs, rules)


@P.add(f"SELECT doc_id, {REASONS} AS reason FROM documents")
def filter_with_reason(spark, sf_dir):
    return _reasons(table(spark, sf_dir, "documents")).select("doc_id", "reason")


@P.add(
    f"""WITH r AS (SELECT lang, source, coalesce({REASONS}, 'kept') AS reason FROM documents)
    SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM r GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM r GROUP BY source UNION ALL SELECT 'reason', reason, count(*) FROM r GROUP BY reason"""
)
def filter_report(spark, sf_dir):
    rows = _reasons(table(spark, sf_dir, "documents")).withColumn("reason", F.coalesce("reason", F.lit("kept")))
    return aggregates.grouped_counts(rows, ["lang", "source", "reason"])


@P.add(
    """SELECT doc_id, concat_ws(',', CASE WHEN n_chars > 5000 THEN 'long' END, CASE WHEN lang <> 'en' THEN 'foreign' END, CASE WHEN contains(text, '@') THEN 'address' END) AS rules FROM documents"""
)
def matching_rules(spark, sf_dir):
    rules = [("long", c("n_chars") > 5000), ("foreign", c("lang") != "en"), ("address", c("text").contains("@"))]
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(filtering.matching_rules(rules), ",").alias("rules"))


@P.add("""SELECT min(doc_id) AS doc_id, md5(trim(regexp_replace(nfc_normalize(text), '[\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'))) AS key
    FROM documents GROUP BY key""")
def exact_dedupe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("key", F.md5(T.dedupe_key(c("text"))))
    return dedupe.keep_first(docs.select("doc_id", "key"), c("key"), ["doc_id"])


@P.add("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents")
def duplicate_of(spark, sf_dir):
    return dedupe.duplicate_of(table(spark, sf_dir, "documents"), F.sha2("text", 256), "doc_id")


@P.add(
    """SELECT CASE WHEN rn > 1 THEN p_name || '~' || rn ELSE p_name END AS p_name, p_partkey FROM (SELECT p_name, p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part)"""
)
def suffix_repeated_ids(spark, sf_dir):
    return dedupe.suffix_repeats(table(spark, sf_dir, "part").select("p_name", "p_partkey"), "p_name", ["p_partkey"])


@P.add(
    r"""WITH p AS (SELECT source, doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\s\x{0B}\x{85}\x{A0}\x{3000}]+|[\s\x{0B}\x{85}\x{A0}\x{3000}]+$', '', 'g')), lambda x: x <> '') AS ls FROM documents),
    e AS (SELECT DISTINCT source, doc_id, unnest(list_distinct(list_concat(ls[1:2], ls[greatest(len(ls) - 1, 1):len(ls)]))) AS line FROM p),
    n AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY source HAVING count(DISTINCT doc_id) >= 3)
    SELECT e.source, e.line FROM e JOIN n ON e.source = n.source GROUP BY e.source, e.line, n.pages
    HAVING count(DISTINCT doc_id) >= greatest(3, CAST(floor(n.pages * 0.01) AS BIGINT)) OR regexp_matches(e.line, '^\s*[-–—]?\s*\d{1,4}\s*[-–—]?\s*$')"""
)
def repeated_edge_lines(spark, sf_dir):
    return filtering.repeated_edge_lines(table(spark, sf_dir, "documents"), "source", "doc_id", "text", 0.01)


@P.add(
    """WITH b AS (SELECT CASE WHEN n < 50 THEN '0-49' WHEN n < 100 THEN '50-99' WHEN n < 200 THEN '100-199' WHEN n < 300 THEN '200-299' WHEN n < 400 THEN '300-399' WHEN n < 500 THEN '400-499' WHEN n < 600 THEN '500-599'
    WHEN n < 700 THEN '600-699' WHEN n < 800 THEN '700-799' WHEN n < 1000 THEN '800-999' ELSE '>=1000' END AS bin FROM (SELECT len(string_split_regex(text, '[ \\n]+')) AS n FROM documents)),
    k AS (SELECT bin, count(*) AS n FROM b GROUP BY bin) SELECT bin, n, repeat('#', CAST(round(30 * n / (SELECT max(n) FROM k)) AS INTEGER)) AS bar FROM k"""
)
def size_histogram(spark, sf_dir):
    return aggregates.histogram(table(spark, sf_dir, "documents"), F.size(F.split("text", r"[ \n]+")))


@P.add("SELECT lang, source, count(*) AS n, count(DISTINCT text) AS texts, min(n_chars) AS shortest, max(n_chars) AS longest, median(n_chars) AS middle FROM documents GROUP BY lang, source")
def collection_report(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(
        F.count("*").alias("n"), F.countDistinct("text").alias("texts"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"), F.median("n_chars").alias("middle")
    )


@P.add("SELECT lang AS value, count(*) AS n FROM documents GROUP BY lang")
def language_counts(spark, sf_dir):
    return aggregates.top_values(table(spark, sf_dir, "documents"), c("lang"))


@P.add(
    """SELECT source, lang FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS rn FROM documents GROUP BY source, lang) WHERE rn = 1"""
)
def dominant_language(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return counts.groupBy("source").agg(F.min(F.struct((-c("n")).alias("o"), "lang")).alias("m")).select("source", "m.lang")


@P.add(
    """SELECT s_suppkey, coalesce(a.n_nationkey, b.id) AS matched_id, CASE WHEN a.n_nationkey IS NOT NULL THEN 'id' WHEN b.id IS NOT NULL THEN 'name' ELSE 'none' END AS matched_by
    FROM (SELECT s_suppkey, s_nationkey + 12 AS ref, 'nation ' || s_nationkey AS label FROM supplier) s LEFT JOIN nation a ON s.ref = a.n_nationkey
    LEFT JOIN (SELECT lower(replace(n_name, '_', ' ')) AS k, min(n_nationkey) AS id FROM nation GROUP BY k HAVING count(DISTINCT n_nationkey) = 1) b ON s.label = b.k"""
)
def two_step_registry_join(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (c("s_nationkey") + 12).alias("ref"), F.concat(F.lit("Nation_"), c("s_nationkey")).alias("label"))
    found = joins.two_step_join(s, table(spark, sf_dir, "nation"), "ref", "n_nationkey", T.name_key(c("label")), T.name_key(c("n_name")))
    return found.select("s_suppkey", "matched_id", "matched_by")


@P.add("SELECT p_brand || ' ' || p_type || ' ' || p_size AS key, min(p_partkey) AS id FROM part GROUP BY key HAVING count(DISTINCT p_partkey) = 1")
def unique_lookup(spark, sf_dir):
    return joins.unique_lookup(table(spark, sf_dir, "part"), F.concat_ws(" ", "p_brand", "p_type", "p_size"), "p_partkey")


@P.add(
    """WITH a AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS named FROM part UNION SELECT DISTINCT p_name FROM part WHERE p_size = 7), b AS (SELECT DISTINCT p_name AS title FROM part),
    p AS (SELECT named, title, named = title AS exact FROM a JOIN b ON contains(' ' || title || ' ', ' ' || named || ' ') OR contains(' ' || named || ' ', ' ' || title || ' '))
    SELECT named, title, exact FROM p WHERE exact OR named NOT IN (SELECT named FROM p WHERE exact)"""
)
def exact_else_contains(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    named = p.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("named")).union(p.where("p_size = 7").select("p_name")).distinct()
    pairs = joins.contains_join(named, p.select(c("p_name").alias("title")).distinct(), "named", "title")
    return joins.exact_else_contains(pairs, "named").select("named", "title", "exact")


@P.add(
    """SELECT a.o_orderkey, count(*) AS later, min(b.o_orderdate) AS next_change FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate > a.o_orderdate WHERE b.o_orderstatus = 'P' GROUP BY a.o_orderkey"""
)
def interval_changes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    changes = o.where("o_orderstatus = 'P'").select("o_custkey", c("o_orderdate").alias("changed"))
    found = joins.interval_join(o.select("o_orderkey", "o_custkey", "o_orderdate"), changes, "o_custkey", "o_orderdate", "changed")
    return found.groupBy("o_orderkey").agg(F.count("*").alias("later"), F.min("changed").alias("next_change"))


@P.add("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.05)")
def unmatched_registry_rows(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 49 AND l_discount > 0.05").select(c("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(used, "p_partkey", "left_anti")


@P.add(
    """SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS covered FROM customer WHERE c_acctbal > 0"""
)
def semi_join_flag(spark, sf_dir):
    having = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(c("o_custkey").alias("c_custkey"), F.lit(True).alias("hit")).distinct()
    return table(spark, sf_dir, "customer").where("c_acctbal > 0").join(having, "c_custkey", "left").select("c_custkey", F.coalesce("hit", F.lit(False)).alias("covered"))


@P.add(
    """WITH h AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_discount >= 0.1), k AS (SELECT DISTINCT l_orderkey, l_linenumber + d AS l_linenumber FROM h, (VALUES (-1), (1)) v(d))
    SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, sum(l_quantity) AS quantity FROM lineitem SEMI JOIN k USING (l_orderkey, l_linenumber) ANTI JOIN h USING (l_orderkey, l_linenumber) GROUP BY ALL"""
)
def neighbour_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    hits = li.where("l_discount >= 0.1").select("l_orderkey", "l_linenumber").distinct()
    return joins.neighbours(hits, li, "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("quantity"))


@P.add(
    """SELECT number, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS ids FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\\b\\d{3}\\b'))) AS number FROM documents) GROUP BY number"""
)
def number_index(spark, sf_dir):
    found = joins.section_index(table(spark, sf_dir, "documents"), "doc_id", F.regexp_extract_all("text", F.lit(r"\b(\d{3})\b"), F.lit(1)))
    return found.withColumn("ids", F.array_join(c("ids").cast("array<string>"), ","))


@P.add(
    """WITH o AS (SELECT o_orderkey, md5(o_orderstatus || o_orderpriority) AS h FROM orders WHERE o_orderkey % 10 <> 0), n AS (SELECT o_orderkey, md5(CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END || o_orderpriority) AS h FROM orders WHERE o_orderkey % 10 <> 1)
    SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'gone' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS action FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey"""
)
def incremental_actions(spark, sf_dir):
    # the two states of an index are made from one table
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderkey % 10 <> 0").select("o_orderkey", F.md5(F.concat("o_orderstatus", "o_orderpriority")).alias("h"))
    new = o.where("o_orderkey % 10 <> 1").select("o_orderkey", F.md5(F.concat(F.when(c("o_orderkey") % 7 == 0, "X").otherwise(c("o_orderstatus")), c("o_orderpriority"))).alias("h"))
    return joins.changed_records(old, new, "o_orderkey", "h")


@P.add(
    """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""
)
def last_write_wins(spark, sf_dir):
    return versions.last_per_key(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@P.add(
    """WITH live AS (SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 3 <> 0), s AS (SELECT p_partkey, upper(p_name) AS p_name, p_size + 1 AS p_size FROM part WHERE p_partkey % 2 = 0 AND p_size > 10)
    SELECT * FROM s UNION ALL SELECT * FROM live WHERE p_partkey NOT IN (SELECT p_partkey FROM s)"""
)
def approve_staged_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    live = p.where("p_partkey % 3 <> 0")
    staged = p.where("p_partkey % 2 = 0").select("p_partkey", F.upper("p_name").alias("p_name"), (c("p_size") + 1).alias("p_size"), F.when(c("p_size") > 10, "approved").otherwise("rejected").alias("decision"))
    return versions.approve(staged, live, ["p_partkey"])


@P.add(
    """WITH v AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS start_day, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 400 END AS end_day, CASE o_orderstatus WHEN 'P' THEN 'repealed' ELSE 'current' END AS status FROM orders),
    s AS (SELECT o_custkey, start_day, lead(start_day) OVER (PARTITION BY o_custkey ORDER BY start_day) AS nxt FROM (SELECT DISTINCT o_custkey, start_day FROM v))
    SELECT o_orderkey, o_custkey, start_day, CASE WHEN nxt IS NOT NULL THEN least(end_day, nxt - 1) ELSE end_day END AS end_day, CASE WHEN nxt IS NULL OR status = 'repealed' THEN status ELSE 'amended' END AS status FROM v JOIN s USING (o_custkey, start_day)"""
)
def version_rechain(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("start_day", F.to_date("o_orderdate"))
    v = o.select("o_orderkey", "o_custkey", "start_day", F.when(c("o_orderstatus") == "F", F.date_add("start_day", 400)).alias("end_day"), F.when(c("o_orderstatus") == "P", "repealed").otherwise("current").alias("status"))
    return versions.rechain(v, "o_custkey", "start_day", "end_day", "status").select("o_orderkey", "o_custkey", "start_day", "end_day", "status")


@P.add(
    """WITH v AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, max(o_orderkey) AS version FROM orders GROUP BY 1, 2), w AS (SELECT o_custkey, version, d AS start_day, lead(d) OVER (PARTITION BY o_custkey ORDER BY d) - 1 AS end_day FROM v)
    SELECT e.event_id, w.version FROM (SELECT event_id, user_id, CAST(ts AS DATE) + CAST(user_id * 30 - 9000 AS INTEGER) AS at FROM events) e LEFT JOIN w ON e.user_id = w.o_custkey AND e.at >= w.start_day AND (w.end_day IS NULL OR e.at <= w.end_day)"""
)
def as_of_version(spark, sf_dir):
    v = table(spark, sf_dir, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("start_day")).agg(F.max("o_orderkey").alias("version"))
    v = v.withColumn("end_day", F.date_sub(F.lead("start_day").over(Window.partitionBy("o_custkey").orderBy("start_day")), 1)).withColumnRenamed("o_custkey", "user_id")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.date_add(F.to_date("ts"), (c("user_id") * 30 - 9000).cast("int")).alias("at"))
    return versions.as_of(e, v, "user_id", "at", "start_day", "end_day").select("event_id", "version")


@P.add(
    """SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS exchange FROM conversations"""
)
def question_answer_pairs(spark, sf_dir):
    return chunking.sessions(table(spark, sf_dir, "conversations"), "conv_id", "turn", c("role") == "user", "exchange").select("conv_id", "turn", "exchange")


@P.add(
    """SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS shape, sum(length(text)) AS chars FROM conversations GROUP BY conv_id"""
)
def conversation_shape(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return t.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">").alias("shape"), F.sum(F.length("text")).alias("chars"))


@P.add(
    """SELECT user_id, event_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events)"""
)
def event_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = e.withColumn("fresh", F.when(c("ts") - F.lag("ts").over(w) > F.expr("INTERVAL 6 HOURS"), 1).otherwise(0))
    return gap.select("user_id", "event_id", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("session"))


@P.add(
    """SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha1('seed:' || doc_id)) AS rn FROM documents) WHERE rn <= CASE lang WHEN 'en' THEN 20 ELSE 5 END"""
)
def quota_selection(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return aggregates.quota(d, "lang", [F.sha1(F.concat(F.lit("seed:"), c("doc_id").cast("string")))], F.when(c("lang") == "en", 20).otherwise(5))


@P.add("SELECT p_partkey, CAST((row_number() OVER (ORDER BY p_name, p_partkey) - 1) // 500 AS INTEGER) AS shard, CAST((row_number() OVER (ORDER BY p_name, p_partkey) - 1) % 500 AS INTEGER) AS row FROM part")
def fixed_size_shards(spark, sf_dir):
    return sources.shards(table(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"], 500).select("p_partkey", "shard", "row")


@P.add(
    """SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY day"""
)
def pivot_by_arm(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return e.groupBy("day").agg(*[F.count_if(c("event_type") == x).alias(x) for x in ("click", "error", "view")])


@P.add(
    """SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 'flagged' WHEN bool_or(event_type = 'click') THEN 'repaired' ELSE 'ok' END AS quality FROM events GROUP BY user_id"""
)
def severity_rollup(spark, sf_dir):
    kind = F.when(c("event_type") == "error", "flagged").when(c("event_type") == "click", "repaired").otherwise("ok")
    return table(spark, sf_dir, "events").withColumn("k", kind).groupBy("user_id").agg(aggregates.severity_rollup(c("k")).alias("quality"))


@P.add(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber, l_suppkey) AS rn FROM lineitem) WHERE rn <= 2"""
)
def most_per_section(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return filtering.capped(li, ["l_orderkey"], [F.desc("l_extendedprice"), c("l_partkey"), c("l_linenumber"), c("l_suppkey")], 2).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@P.add(
    """SELECT l_orderkey, rn AS pos FROM (SELECT l_orderkey, row_number() OVER w AS rn, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber, l_suppkey ROWS UNBOUNDED PRECEDING) AS run FROM lineitem
    WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber, l_suppkey)) WHERE run <= 60 OR rn = 1"""
)
def prefix_within_budget(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_linenumber", "l_suppkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", F.row_number().over(w).alias("pos"))
    return ranking.prefix_budget(li, "l_orderkey", "pos", "l_quantity", 60).select("l_orderkey", "pos")


@P.add("SELECT doc_id, len(string_split(text, chr(10))) - 1 AS last_line, length(text) - length(regexp_extract(text, '[^\\n]*$')) AS last_start FROM documents")
def line_offsets(spark, sf_dir):
    each = chunking.line_offsets(table(spark, sf_dir, "documents"), "doc_id", "text")
    return each.groupBy(c("id").alias("doc_id")).agg(F.max("line_no").cast("long").alias("last_line"), F.max("start").cast("long").alias("last_start"))


@P.add()
def packed_paragraphs(spark, sf_dir):
    return chunking.per_document(table(spark, sf_dir, "documents"), "doc_id", "text", lambda t: [(x,) for x in chunking.pack_paragraphs(t, 200, 40)], "text string")


@P.add()
def judgment_chunks(spark, sf_dir):
    schema = "char_start long, char_end long, tokens int, is_holding boolean, text string"
    return chunking.per_document(table(spark, sf_dir, "documents"), "doc_id", "text", lambda t: chunking.chunk_judgment(t, 120, 180, 30), schema)


@P.add()
def page_chunks(spark, sf_dir):
    return chunking.per_document(table(spark, sf_dir, "documents"), "doc_id", "text", lambda t: chunking.page_chunks([(t, "")], 400), "lang string, text string")


@P.add()
def section_chunks(spark, sf_dir):
    return chunking.per_document(table(spark, sf_dir, "documents"), "doc_id", "text", chunking.section_rows, "number string, title string, text string")
