"""Text of marked-up sources: HTML, wiki XML dumps, e-mail, paged text."""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]  # fixed values
BREAKS = r"(?i)</(?:p|div|h[1-6]|li|tr|ul|ol|table|nav|article|section|header|footer|title|head)>|<br[^<>]*>"


def html_to_text(html: Column) -> Column:
    """Scripts and comments out, block ends as line ends, tags out, the common entities decoded; no Python."""
    text = F.regexp_replace(html, r"(?is)<(?:script|style)\b.*?(?:</(?:script|style)>|\z)|<!--.*?(?:-->|\z)", " ")
    text = F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), r"(?s)<[^<>]*>", "")
    for name, value in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(value))
    return text


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """(title, namespace, page_id, redirect, revision, timestamp, text) of a MediaWiki dump; bz2 is read as it is."""
    schema = "title string, ns int, id long, redirect struct<_title:string>, revision struct<id:long, timestamp:string, text:string>"
    raw = spark.read.format("xml").option("rowTag", "page").option("valueTag", "_VALUE").schema(schema).load(path)
    return raw.select("title", F.col("ns").alias("namespace"), F.col("id").alias("page_id"), F.col("redirect").isNotNull().alias("redirect"), F.col("revision.id").alias("revision"), F.col("revision.timestamp").alias("timestamp"), F.col("revision.text").alias("text"))


def content_pages(pages: DataFrame, template: str) -> DataFrame:
    """Pages of the main namespace that are no redirects and use the template."""
    return pages.where((F.col("namespace") == 0) & ~F.col("redirect") & F.col("text").contains("{{" + template))


def logical_lines(text: Column) -> Column:
    """Lines of wikitext, with templates and tables that run over lines as one."""
    joined = F.regexp_replace(text, r"\n(?=[^{}\n]*\}\})", " ")
    return F.filter(F.split(joined, "\n"), lambda x: F.trim(x) != "")


def form_feed_pages(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, page, text): pages of a text divided by form feeds."""
    return df.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), "\f")).alias("page", "text"))


def read_mail(raw: bytes | None) -> dict:
    """Headers, body and attachments; what can't be read is empty, with the reason why."""
    empty = {"headers": {}, "body": "", "is_html": False, "attachments": [], "reason": "no content"}
    if not raw:
        return empty
    try:
        return _mail(raw) | {"reason": None}
    except (LookupError, ValueError, AttributeError, KeyError) as why:
        return empty | {"reason": f"{type(why).__name__}: {why}"}


def _mail(raw: bytes) -> dict:
    m = email.message_from_bytes(raw, policy=email.policy.default)
    body = m.get_body(preferencelist=("plain", "html"))
    names = [p.get_filename() or "" for p in m.iter_attachments()]
    return {
        "headers": {k: str(m[k]) for k in ("From", "To", "Cc", "Date", "Subject") if m[k]},
        "body": body.get_content() if body is not None else "",
        "is_html": body is not None and body.get_content_subtype() == "html",
        "attachments": names,
    }


def mail_messages(files: DataFrame) -> DataFrame:
    """(path, headers, body, attachments, reason) of e-mail files of (path, content), as the binary source gives them."""
    schema = "path string, headers map<string,string>, body string, is_html boolean, attachments array<string>, reason string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [read_mail(x) for x in b.column(1).to_pylist()]
            kinds = {"headers": pa.map_(pa.string(), pa.string()), "body": pa.string(), "is_html": pa.bool_(), "attachments": pa.list_(pa.string()), "reason": pa.string()}
            cols = [pa.array([list(r[n].items()) if n == "headers" else r[n] for r in rows], t) for n, t in kinds.items()]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["path", *kinds])

    read = files.select("path", "content").mapInArrow(run, schema)
    return read.withColumn("body", F.when(F.col("is_html"), html_to_text(F.col("body"))).otherwise(F.col("body"))).drop("is_html")
