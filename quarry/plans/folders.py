"""A folder of files derived from the documents, indexed, changed and indexed again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folders
from ..sources.store import BucketedTable
from ..streaming.incremental import work_dir
from ._base import Plans, table

P = Plans()
QUERIES, ORACLE = P.queries, P.oracle
c = F.col


def _files(spark, sf_dir, second: bool):
    """Documents as files.  Of ten, the second time one is gone, one changed, one renamed, one described anew and one is new."""
    kind, number = c("doc_id") % 10, c("doc_id").cast("string")
    d = table(spark, sf_dir, "documents").where(kind != (0 if second else 9))
    name = F.when((kind == 2) & F.lit(second), F.concat(number, F.lit("-new.txt"))).otherwise(F.concat(number, F.lit(".txt")))
    text = F.when((kind == 1) & F.lit(second), F.concat("text", F.lit("\nchanged"))).otherwise(c("text"))
    files = d.select(F.concat_ws("/", F.lit("f"), "source", name).alias("path"), F.timestamp_seconds(F.lit(0)).alias("modified"), text.alias("text"), "doc_id", "lang")
    day = F.date_add(F.lit("1900-01-01").cast("date"), F.col("doc_id").cast("int") + F.when((kind == 3) & F.lit(second), 20_000).otherwise(0))
    own = files.select("path", F.concat(F.lit("law"), (c("doc_id") % 50).cast("string")).alias("law_id"), F.concat(F.lit("law "), number).alias("law_name"), day.alias("start"), F.lit("law").alias("kind"), c("lang").alias("language"))
    return folders.described(files.select("path", "modified", "text"), own)


def _indexed(spark, sf_dir):
    index = folders.FolderIndex(spark, work_dir(spark, "folders"), 4)
    index.run(_files(spark, sf_dir, False))
    return index, index.run(_files(spark, sf_dir, True), prune=True)


FILES = """f AS (SELECT doc_id, doc_id % 10 AS k, 'f/' || source || '/' || doc_id || '.txt' AS was, 'f/' || source || '/' || doc_id || CASE WHEN doc_id % 10 = 2 THEN '-new' ELSE '' END || '.txt' AS path,
    'law' || doc_id % 50 AS law_id, DATE '1900-01-01' + CAST(doc_id + CASE WHEN doc_id % 10 = 3 THEN 20000 ELSE 0 END AS INTEGER) AS start, text FROM documents)"""


@P.add(
    f"""WITH {FILES} SELECT path, CASE k WHEN 0 THEN 'retracted' WHEN 1 THEN 'indexed' WHEN 2 THEN 'renamed' WHEN 3 THEN 'indexed' WHEN 9 THEN 'indexed' ELSE 'unchanged' END AS action,
    CASE WHEN k = 2 THEN was END AS before, CASE WHEN k <> 0 THEN law_id END AS law_id, CASE WHEN k <> 0 THEN CAST(start AS VARCHAR) END AS start FROM f"""
)
def folder_actions(spark, sf_dir):
    return _indexed(spark, sf_dir)[1].select("path", "action", "before", "law_id", c("start").cast("string").alias("start"))


@P.add(
    f"""WITH {FILES} SELECT law_id, CAST(start AS VARCHAR) AS start, CAST(CAST(lead(start) OVER w - INTERVAL 1 DAY AS DATE) AS VARCHAR) AS "end", CASE WHEN lead(start) OVER w IS NULL THEN 'current' ELSE 'amended' END AS status,
    CASE WHEN k = 1 THEN text || chr(10) || 'changed' ELSE text END AS text FROM f WHERE k <> 0 AND (trim(text) <> '' OR k = 1) WINDOW w AS (PARTITION BY law_id ORDER BY start)"""
)
def folder_versions(spark, sf_dir):
    chunks = _indexed(spark, sf_dir)[0].chunks
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n")
    texts = chunks.read(["text"]).groupBy("law_id", "start").agg(whole.alias("text"))
    # all chunks of a version have its end and status
    return texts.join(chunks.read(["meta"]).select("law_id", "start", "end", "status").distinct(), ["law_id", "start"]).select("law_id", c("start").cast("string").alias("start"), c("end").cast("string").alias("end"), "status", "text")


@P.add(
    """SELECT doc_id, 1 AS scan, CASE doc_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE CASE WHEN doc_id % 2 = 0 THEN 'rejected' ELSE 'pending' END END AS status FROM documents
    UNION ALL SELECT doc_id, 2, 'pending' FROM documents WHERE doc_id % 2 = 0"""
)
def staged_uploads(spark, sf_dir):
    """Uploads are staged, two in three decided, half of them uploaded with another text, and all scanned twice more."""
    d = table(spark, sf_dir, "documents")
    first = d.select(c("doc_id").cast("string").alias("path"), F.sha2(F.concat(F.lit("1"), "text"), 256).alias("sha"), "doc_id")
    second = first.withColumn("sha", F.when(c("doc_id") % 2 == 0, F.concat(F.lit("again"), "sha")).otherwise(c("sha")))
    staged = BucketedTable(spark, work_dir(spark, "staged"), ["path", "sha"], folders.STAGED, 4)
    folders.scan_uploads(first, staged)
    said = first.where("doc_id % 3 < 2").select("path", "sha", F.when(c("doc_id") % 3 == 0, "approved").otherwise("rejected").alias("status"), F.lit("me").alias("reviewer"), F.lit("").alias("reason"))
    folders.review(staged, said)
    folders.scan_uploads(second, staged)
    folders.scan_uploads(second, staged)
    return staged.read().select(c("path").cast("long").alias("doc_id"), F.when(c("sha").startswith("again"), 2).otherwise(1).alias("scan"), "status")
