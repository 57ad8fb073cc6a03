"""Text functions over the document, page and conversation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import casts, dates, hashing
from ..functions import text as T
from ..operators import aggregates, filtering
from ..sources import markup
from ._base import Plans, table

P = Plans()
QUERIES, ORACLE = P.queries, P.oracle
c = F.col

WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
STRIP_SQL = rf"'^{WS}|{WS}$'"


@P.add(
    rf"""SELECT doc_id, md5(t) AS text_md5, length(t) AS n FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(nfc_normalize(text), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), {STRIP_SQL}, '', 'g') AS t FROM documents)"""
)
def normalize_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("t", T.normalize_whitespace(T.normalize_unicode(c("text"))))
    return d.select("doc_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("n"))


@P.add(
    r"""SELECT doc_id, lang, length(text) - length(CASE WHEN lang IN ('en','fr','es','it','de') THEN regexp_replace(replace(text, ' ', '-' || chr(10)), '([\p{L}\p{M}\p{N}_])-\n([\p{L}\p{M}\p{N}_])', '\1\2', 'g') ELSE text END) AS lost
    FROM documents"""
)
def dehyphenate(spark, sf_dir):
    # the given texts hold no wrapped words; every space stands for one
    d = table(spark, sf_dir, "documents").withColumn("w", F.replace(c("text"), F.lit(" "), F.lit("-\n")))
    return d.select("doc_id", "lang", (F.length("text") - F.length(T.dehyphenate(c("w"), c("lang")))).cast("long").alias("lost"))


@P.add(
    r"""SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[$%*#]{2}') OR regexp_matches(x, '(?i)licen[cs]e'))) AS dropped,
    md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT (regexp_matches(x, '[$%*#]{2}') OR regexp_matches(x, '(?i)licen[cs]e'))), chr(10))) AS text_md5 FROM documents"""
)
def drop_boilerplate_lines(spark, sf_dir):
    kept = T.drop_lines(c("text"), [r"[$%*#]{2}", r"(?i)licen[cs]e"])
    d = table(spark, sf_dir, "documents").withColumn("kept", kept)
    gone = F.size(F.filter(T.lines(c("text")), lambda x: x.rlike(r"[$%*#]{2}") | x.rlike("(?i)licen[cs]e")))
    return d.select("doc_id", gone.cast("long").alias("dropped"), F.md5("kept").alias("text_md5"))


@P.add(
    r"""SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}\p{Pc}]+|[^\p{L}\p{M}\p{N}\p{Pc}\s\x{0B}]')) AS regex_tokens,
    greatest(1, CAST(floor(length(text) / CASE WHEN regexp_matches(text, '[\x{0590}-\x{FFFF}]') THEN 2.5 ELSE 4.0 END) AS BIGINT)) AS guessed_tokens,
    len(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS words FROM documents"""
)
def token_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        T.regex_tokens(c("text")).cast("long").alias("regex_tokens"),
        T.heuristic_tokens(c("text")).cast("long").alias("guessed_tokens"),
        F.size(T.index_terms(c("text"))).cast("long").alias("words"),
    )


@P.add(
    r"""SELECT doc_id, len(regexp_extract_all(text, '\p{L}')) AS letters, len(regexp_extract_all(text, '[א-ת]')) AS hebrew, len(regexp_extract_all(text, '[À-ÿͰ-Ͽ]')) AS suspects,
    CASE WHEN len(regexp_extract_all(substr(text, 1, 5000), '[A-Za-z]')) = 0 AND len(regexp_extract_all(substr(text, 1, 5000), '[א-ת]')) = 0 THEN 'unknown'
    WHEN len(regexp_extract_all(substr(text, 1, 5000), '[א-ת]')) >= len(regexp_extract_all(substr(text, 1, 5000), '[A-Za-z]')) THEN 'he' ELSE 'en' END AS script FROM documents"""
)
def script_profile(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        T.letter_count(c("text")).cast("long").alias("letters"),
        T.count_of(c("text"), T.HEBREW).cast("long").alias("hebrew"),
        T.count_of(c("text"), T.SUSPECT).cast("long").alias("suspects"),
        T.language_by_letters(c("text")).alias("script"),
    )


@P.add(
    r"""SELECT doc_id, len(list_filter(list_transform(string_split_regex(text, '\n[ \t\n\r\f\x{0B}]*\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '')) AS paragraphs,
    len(string_split(text, chr(10))) AS lines FROM documents"""
)
def split_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(T.paragraphs(c("text"))).cast("long").alias("paragraphs"), F.size(T.lines(c("text"))).cast("long").alias("lines"))


@P.add(
    r"""SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[\d.,]+'), lambda r: CASE WHEN regexp_matches(r, '^\d{1,3}(?:,\d{3})+(?:[^\d]|$)')
      THEN replace(regexp_extract(r, '^(\d{1,3}(?:,\d{3})+)(?:[^\d]|$)', 1), ',', '') ELSE regexp_extract(r, '^\d+(?:\.\d+)?') END), lambda x: x <> ''))), ' '), '') AS numbers FROM documents WHERE regexp_matches(text, '\d')"""
)
def numbers_in_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(c("text").rlike(r"\d"))
    return d.select("doc_id", F.array_join(F.array_sort(T.numbers(c("text"))), " ").alias("numbers"))


@P.add(
    r"""SELECT conv_id, turn, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(text, '\d+')), lambda n: NOT list_contains(said, n))), ',') AS unsupported FROM (
    SELECT a.conv_id, a.turn, a.text, coalesce(u.said, []) AS said FROM conversations a LEFT JOIN (SELECT conv_id, list_distinct(flatten(list(regexp_extract_all(text, '\d+')))) AS said FROM conversations WHERE role <> 'assistant' GROUP BY conv_id) u
    ON a.conv_id = u.conv_id WHERE a.role = 'assistant')"""
)
def unsupported_numbers(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    # digits alone, as these texts hold no decimals
    found = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(r"(\d+)"), F.lit(1)))
    said = turns.where("role <> 'assistant'").select("conv_id", F.explode(found(c("text"))).alias("n")).distinct().groupBy("conv_id").agg(F.collect_list("n").alias("said"))
    rows = turns.where("role = 'assistant'").join(said, "conv_id", "left")
    kept = F.array_except(found(c("text")), F.coalesce("said", F.array().cast("array<string>")))
    return rows.select("conv_id", "turn", F.array_join(F.array_sort(kept), ",").alias("unsupported"))


@P.add(
    """SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS name_key, trim(regexp_replace(p_brand, '[ _-]+', ' ', 'g')) AS type_key,
    substr(sha1(p_name), 1, 12) AS short_id, CAST(CAST('0x' || substr(sha1(CAST(p_partkey AS VARCHAR)), 1, 15) AS BIGINT) % 4 = 1 AS BOOLEAN) AS in_shard FROM part"""
)
def keys_and_shards(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", T.name_key(c("p_name")).alias("name_key"), T.type_key(c("p_brand")).alias("type_key"), hashing.short_id(c("p_name")).alias("short_id"), hashing.in_shard(c("p_partkey"), 1, 4).alias("in_shard"))


@P.add(
    """SELECT o_orderkey, CAST(split_part(o_orderpriority, '-', 1) AS INTEGER) AS priority, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS ymd, strftime(o_orderdate, '%Y-%m-%d') AS iso,
    CASE WHEN o_orderstatus = 'F' THEN true WHEN o_orderstatus = 'O' THEN NULL ELSE NULL END AS final, CAST(strftime(o_orderdate + INTERVAL 12 HOUR, '%Y-%m-%d') AS DATE) + 1 AS next_midnight FROM orders"""
)
def lenient_casts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select(
        "o_orderkey",
        casts.as_int(F.split_part(c("o_orderpriority"), F.lit("-"), F.lit(1))).alias("priority"),
        casts.ymd(c("day")).alias("ymd"),
        casts.ymd_to_iso(casts.ymd(c("day"))).alias("iso"),
        casts.as_bool(F.when(c("o_orderstatus") == "F", "Yes")).alias("final"),
        dates.parse_date(F.concat(c("day"), F.lit(" 19:00")), shifted_midnight=True).alias("next_midnight"),
    )


@P.add(
    """SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END, CASE WHEN o_orderdate >= TIMESTAMP '1996-01-01' THEN make_date(CAST(year(o_orderdate) AS BIGINT), 1, 1) END) AS decided,
    CASE WHEN o_orderstatus = 'F' THEN 'first' WHEN o_orderdate >= TIMESTAMP '1996-01-01' THEN 'Year' END AS source FROM orders"""
)
def resolve_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day = F.when(c("o_orderstatus") == "F", dates.parse_date(F.date_format("o_orderdate", "dd/MM/yyyy")))
    year = F.when(c("o_orderdate") >= F.lit("1996-01-01").cast("timestamp"), F.year("o_orderdate"))
    chosen = dates.resolve_date([("first", day)], year, F.lit(None).cast("date"), "1948-01-01")
    return o.withColumn("r", chosen).select("o_orderkey", c("r.date").alias("decided"), c("r.source").alias("source"))


@P.add(
    r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title, length(html) AS size,
    regexp_matches(substr(html, 1, 4096), '(?i)<title[^>]*>[^<]*(?:captcha|forbidden|access denied)') AS blocked FROM pages"""
)
def page_profile(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select(
        "page_id",
        F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("host"),
        F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"),
        F.length("html").cast("long").alias("size"),
        filtering.looks_like_block_page(c("html")).alias("blocked"),
    )


@P.add(
    r"""SELECT page_id, md5(t) AS text_md5 FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html,
    '<(?:script|style)\b.*?</(?:script|style)>|<!--.*?-->', ' ', 'gsi'), '</(?:p|div|h[1-6]|li|tr|ul|ol|table|nav|article|section|header|footer|title|head)>|<br[^>]*>', chr(10), 'gi'), '<[^>]*>', '', 'gs'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\r\f\x{0B}]+', ' ', 'g')) AS t FROM pages)"""
)
def html_to_text(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("t", F.trim(F.regexp_replace(markup.html_to_text(c("html")), r"\s+", " ")))
    return p.select("page_id", F.md5("t").alias("text_md5"))


@P.add(
    """WITH w AS (SELECT unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS value FROM documents)
    SELECT value, count(*) AS n FROM w GROUP BY value ORDER BY n DESC, value LIMIT 50"""
)
def top_words(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(T.index_terms(c("text"))).alias("w"))
    return aggregates.top_values(words, c("w"), 50)


@P.add()
def encoding_repair(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("r", T.repair_encoding(c("text")))
    return d.groupBy(c("r.method").alias("method")).agg(F.count("*").alias("n"))


@P.add("SELECT doc_id, md5(text) AS text_md5, true AS restored FROM documents")
def mask_and_restore(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("m", T.mask_spans(c("text")))
    back = d.select("doc_id", "text", T.unmask(c("m.text"), c("m.spans")).alias("back"))
    return back.select("doc_id", F.md5("back").alias("text_md5"), (c("back") == c("text")).alias("restored"))


@P.add(
    r"""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '^\s*\(?[A-Ea-e][).:\s]') THEN upper(regexp_extract(text, '^\s*\(?([A-Ea-e])[).:\s]', 1)) END AS letter,
    CASE lower(regexp_extract(substr(text, 1, 40), '^[^\p{L}\p{N}_]*([\p{L}\p{M}\p{N}_]+)', 1)) WHEN 'yes' THEN 'yes' WHEN 'no' THEN 'no' END AS label FROM conversations WHERE role = 'assistant'"""
)
def answer_labels(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return turns.select("conv_id", "turn", T.mcq_letter(c("text")).alias("letter"), T.yes_no(c("text")).alias("label"))
