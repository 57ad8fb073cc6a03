"""Joins with registries and between versions, sections and neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from .matching import phrase_matches


def unique_lookup(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """(key, id) for keys that name exactly one id."""
    return (
        df.select(key.alias("key"), F.col(id_col).alias("id")).where("key is not null AND key <> ''").groupBy("key")
        .agg(F.min("id").alias("id"), F.max("id").alias("__last")).where("id = __last").select("key", "id")
    )


def two_step_join(df: DataFrame, registry: DataFrame, id_col: str, reg_id: str, name_key: Column, reg_key: Column) -> DataFrame:
    """Each row with ``matched_id`` and ``matched_by``: by id where the registry has it, else by a name that is one id's alone."""
    ids = registry.select(F.col(reg_id).alias("__by_id")).distinct()
    names = unique_lookup(registry, reg_key, reg_id).select(F.col("key").alias("__key"), F.col("id").alias("__by_name"))
    joined = df.withColumn("__k", name_key).join(ids, F.col(id_col) == F.col("__by_id"), "left").join(names, F.col("__k") == F.col("__key"), "left")
    return joined.withColumns(
        {
            "matched_id": F.coalesce("__by_id", "__by_name"),
            "matched_by": F.when(F.col("__by_id").isNotNull(), "id").when(F.col("__by_name").isNotNull(), "name").otherwise("none"),
        }
    ).drop("__k", "__by_id", "__key", "__by_name")


def contains_join(named: DataFrame, titles: DataFrame, named_key: str, title_key: str) -> DataFrame:
    """Pairs of which one key holds the other (or equals it), by whole words; ``exact`` marks equal keys.

    Different keys are looked for in one another as phrases: all of one side at once in each of the other, so that a word which
    begins many keys brings no pairs together.
    """
    n = named.where(F.col(named_key) != "").withColumn("__n", F.xxhash64(named_key))
    t = titles.where(F.col(title_key) != "").withColumn("__t", F.xxhash64(title_key))
    of_n, of_t = n.select("__n", F.col(named_key).alias("__k")).distinct(), t.select("__t", F.col(title_key).alias("__k")).distinct()
    words = F.split("__k", " ")
    held = phrase_matches(of_t, of_n, "__t", words, "__n", words).select(F.col("phrase").alias("__n"), F.col("id").alias("__t"))
    holds = phrase_matches(of_n, of_t, "__n", words, "__t", words).select(F.col("id").alias("__n"), F.col("phrase").alias("__t"))
    padded = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    both = n.join(held.union(holds).distinct(), "__n").join(t, "__t")
    sure = F.contains(padded(title_key), padded(named_key)) | F.contains(padded(named_key), padded(title_key))
    return both.where(sure).drop("__n", "__t").distinct().withColumn("exact", F.col(named_key) == F.col(title_key))


def exact_else_contains(pairs: DataFrame, by: str) -> DataFrame:
    """Of the pairs of a name, the exact ones where there are any, else all."""
    best = F.max("exact").over(Window.partitionBy(by))
    return pairs.withColumn("__any", best).where(F.col("exact") | ~F.col("__any")).drop("__any")


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def interval_join(versions: DataFrame, changes: DataFrame, key: str, start: str, changed: str) -> DataFrame:
    """Each version with the changes to its key that came into force after its start."""
    c = changes.withColumnRenamed(key, "__key")
    return versions.join(c, (F.col(key) == F.col("__key")) & (F.col(changed) > F.col(start))).drop("__key")


def neighbours(hits: DataFrame, chunks: DataFrame, file: str, index: str) -> DataFrame:
    """The chunks before and after each hit in its file, without the hits."""
    keys = hits.select(file, F.explode(F.array(F.col(index) - 1, F.col(index) + 1)).alias(index)).distinct()
    return chunks.join(keys, [file, index], "left_semi").join(hits.select(file, index), [file, index], "left_anti")


def section_index(chunks: DataFrame, id_col: str, numbers: Column) -> DataFrame:
    """number -> ids of the chunks that hold or mention it."""
    each = chunks.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(numbers)).alias("number"))
    return each.groupBy("number").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def changed_records(old: DataFrame, new: DataFrame, key: str, hash_col: str) -> DataFrame:
    """(key, action): new, changed, unchanged or gone, from one full outer join of hashes."""
    o, n = old.select(key, F.col(hash_col).alias("__old")), new.select(key, F.col(hash_col).alias("__new"))
    return o.join(n, key, "full_outer").select(
        key,
        F.when(F.col("__old").isNull(), "new").when(F.col("__new").isNull(), "gone").when(F.col("__old") == F.col("__new"), "unchanged").otherwise("changed").alias("action"),
    )


def similar_pairs(vectors: DataFrame, by: list[str], id_col: str, vector: str, low: float, high: float, block: int = 512) -> DataFrame:
    """Pairs i < j within a key (a law version) whose dot product is within [low, high].

    Vectors stand in blocks of some ``block`` by hash; blocks of a key meet each other and are multiplied, so a key of n vectors
    makes (n / block)^2 / 2 rows, not n^2, and tasks of a bounded size whatever the key holds.  Null vectors and ids are left out, and rows of one id are no pair.
    """
    rows = vectors.select(*by, F.col(id_col).alias("__id"), F.col(vector).cast("array<double>").alias("__v")).where("__id is not null and __v is not null")
    many = rows.groupBy(*by).agg(F.ceil(F.count("*") / block).cast("int").alias("__many"))
    packs = rows.join(many, by).groupBy(*by, F.pmod(F.xxhash64("__id"), F.col("__many")).cast("int").alias("__b")).agg(F.collect_list("__id").alias("ids"), F.collect_list("__v").alias("vs"))
    other = packs.select(*by, F.col("__b").alias("__c"), F.col("ids").alias("ids2"), F.col("vs").alias("vs2"))
    same = F.col("__b") == F.col("__c")
    met = packs.join(other, by).where("__b <= __c").select(*by, "ids", "vs", *[F.when(~same, F.col(x)).alias(x) for x in ("ids2", "vs2")], same.alias("same"))
    fields = {f.name: f for f in met.schema.fields}
    id_type = fields["ids"].dataType.elementType
    schema = StructType([fields[k] for k in by] + [StructField("a", id_type), StructField("b", id_type), StructField("similarity", DoubleType())])
    names = [*by, "a", "b", "similarity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                same = at["same"][r].as_py()
                # a block meets itself in one list: the other copy of it may stand in another order
                left, right = (at[n][r].values for n in ("ids", "ids" if same else "ids2"))
                x, y = (at[n][r].values.flatten().to_numpy(zero_copy_only=False).reshape(len(at[n][r]), -1) for n in ("vs", "vs" if same else "vs2"))
                s = x @ y.T
                i, j = np.nonzero((s >= low) & (s <= high))
                if same:
                    i, j = i[i < j], j[i < j]
                a, b = left.take(pa.array(i)), right.take(pa.array(j))
                apart, turned = pc.not_equal(a, b), pc.greater(a, b)
                columns = [*(pa.repeat(at[k][r], len(i)) for k in by), pc.if_else(turned, b, a), pc.if_else(turned, a, b), pa.array(s[i, j])]
                yield pa.RecordBatch.from_arrays([x.filter(apart) for x in columns], names)

    return met.mapInArrow(run, schema)
