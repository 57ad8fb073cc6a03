"""Incremental runs with file streams: upserts into snapshots, windowed totals, done markers.

Snapshots are bucketed tables that know the last batch they took; a batch that is run again changes nothing, so a restart
leaves what one run would have left.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import versions
from ..sources.store import BucketedTable


def work_dir(spark: SparkSession, name: str) -> str:
    """A folder that all executors share: below spark.checkpoint.dir, or one of our own where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/quarry-{name}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The rows as of the last complete version."""
    return BucketedTable.open(spark, root).read()


def file_stream(spark: SparkSession, source: str, per_batch: int | None = None) -> DataFrame:
    """The parquet files of a folder, or one file, as a stream."""
    fs, p = _fs(spark, source)
    reader = spark.readStream.schema(spark.read.parquet(source).schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    if fs.getFileStatus(p).isFile():
        return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return reader.parquet(source)


def _each_batch(stream: DataFrame, root: str, write) -> None:
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination()


def run_upserts(spark: SparkSession, source: str, root: str, key: list[str], order: list[str], per_batch: int = 4, buckets: int = 16) -> None:
    """Read the files that are new since the last run; the last row of each key by ``order`` wins.

    A batch reads and writes the buckets of its keys only; a batch that is run again changes nothing.
    """
    stream = file_stream(spark, source, per_batch)
    kept = BucketedTable(spark, root, key, {"rows": [x for x in stream.columns if x not in key]}, buckets)
    last = lambda old, new: versions.last_per_key(old.unionByName(new), key, order)
    _each_batch(stream, root, lambda batch, number: kept.upsert(versions.last_per_key(batch, key, order), number, last))


def windowed_totals(spark: SparkSession, source: str, root: str, width: str, buckets: int = 4) -> DataFrame:
    """Counts and sums by kind and window.  Each batch adds to the totals of its windows, however late its rows come."""
    stream = file_stream(spark, source).withColumn("ts", F.col("ts").cast("timestamp"))
    key = ["event_type", "day"]
    kept = BucketedTable(spark, root, key, {"totals": ["n", "total"]}, buckets)
    add = lambda old, new: old.unionByName(new).groupBy(*key).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.where("event_type is not null AND ts is not null").groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        kept.upsert(rows.select("event_type", F.col("w.start").alias("day"), "n", "total"), number, add)

    _each_batch(stream, root, write)
    return kept.read().select("event_type", "day", "n", "total")


def mark_done(spark: SparkSession, root: str, stage: str, config: str, rows: int) -> None:
    row = json.dumps({"stage": stage, "config": config, "rows": rows})
    spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/{stage}.done")


def is_done(spark: SparkSession, root: str, stage: str, config: str) -> bool:
    """The stage has been finished under the same configuration."""
    fs, p = _fs(spark, f"{root}/{stage}.done/_SUCCESS")
    return fs.exists(p) and json.loads(spark.read.text(f"{root}/{stage}.done").first()[0])["config"] == config


def changed_since(source: DataFrame, column: str, since) -> DataFrame:
    return source if since is None else source.where(F.col(column) >= F.lit(since))
