"""Tables in and out: schemas with aliases, JSON lines, shards, state snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def resolve_columns(names: list[str], aliases: dict[str, list[str]]) -> dict[str, list[str]]:
    """Logical field -> columns there are for it, in the aliases' order: the exact name first, then any case."""
    lower: dict[str, list[str]] = {}
    for n in names:
        lower.setdefault(n.lower(), []).append(n)
    out = {}
    for field, wanted in aliases.items():
        found = [n for w in wanted for n in ([w] if w in names else lower.get(w.lower(), []))]
        out[field] = list(dict.fromkeys(found))
    return out


def check_required(resolved: dict[str, list[str]], required: list[str], one_of: list[str] = ()) -> None:
    missing = [f for f in required if not resolved.get(f)]
    if missing:
        raise ValueError(f"missing required fields: {', '.join(missing)}")
    if one_of and not any(resolved.get(f) for f in one_of):
        raise ValueError(f"needs one of: {', '.join(one_of)}")


def logical(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """One column per logical field: the first non-blank of its columns.  Other columns are never read."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    out: list[Column] = []
    for field, found in resolve_columns(df.columns, aliases).items():
        kinds = {fields[n] for n in found}
        if not found:
            out.append(F.lit(None).cast("string").alias(field))
        elif len(kinds) == 1 and not kinds & {"string"}:
            out.append(F.coalesce(*[F.col(f"`{n}`") for n in found]).alias(field))
        else:
            out.append(F.coalesce(*[F.when(F.trim(F.col(f"`{n}`").cast("string")) != "", F.col(f"`{n}`").cast("string")) for n in found]).alias(field))
    return df.select(*out)


def schema_report(df: DataFrame, resolved: dict[str, list[str]]) -> str:
    used = {n for found in resolved.values() for n in found}
    lines = ["| column | type | used for |", "|---|---|---|"]
    for f in df.schema:
        uses = [k for k, v in resolved.items() if f.name in v]
        lines.append(f"| {f.name} | {f.dataType.simpleString()} | {', '.join(uses)} |")
    return "\n".join([*lines, "", f"unused: {', '.join(n for n in df.columns if n not in used)}"])


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Strict: a line that does not fit stops the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, shard_rows: int | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.option("maxRecordsPerFile", shard_rows) if shard_rows else writer).json(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def shards(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """``shard`` and ``row``: rows in order, exactly ``size`` to a shard but for the last.

    Ranges of the order are numbered by the counts of the ranges before, so no task gets all rows.
    """
    many = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a stated number of partitions, so that both reads below number the same ranges alike
    ranged = df.repartitionByRange(many, *order).withColumn("__p", F.spark_partition_id())
    counts = ranged.groupBy("__p").agg(F.count("*").alias("n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    rn = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1 + F.col("__start")
    return ranged.join(F.broadcast(starts), "__p").withColumn("__rn", rn).withColumns({"shard": F.floor(F.col("__rn") / size).cast("int"), "row": F.pmod("__rn", F.lit(size)).cast("int")}).drop("__p", "__start", "__rn")


def run_manifest(df: DataFrame, script: str, config: str) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.max(F.lit(script)).alias("script"), F.max(F.lit(config)).alias("config_hash"))


def append_missing(done: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The new rows whose key is not done yet."""
    return new.join(done.select(key), key, "left_anti")
