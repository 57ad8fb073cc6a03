"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame operations only.

Words are runs of letters and digits, lower-cased; shingles are five words.  A window of similarity 0.8 must share
a shingle with its item, so windows are laid only where a text holds a shingle of some item: they have that item's
size, and begin at each offset of a shared shingle and at all places between two offsets that lie within a quarter of the
item, since insertions move the best start.  That keeps the windows in proportion to the overlaps, not to the corpus.
Windows of equal content are fingerprinted once.  Fingerprints of windows and of the items they were laid for meet when
one of ``radius + 1`` blocks is equal, which holds for every pair within ``radius`` bits; pairs within the radius are
verified by the exact similarity of their weighted shingles (weight: occurrences; sum of minima over sum of maxima).  The
join is keyed by item and block, so its pairs are at most the windows, whatever the number of items.

Benchmark shingles are broadcast, one row each with all its places, up to ``broadcast_shingles`` places of them; beyond,
hashes of shingles, without their words, are joined by a shuffle.  Equal texts are looked at once from there on.

Defined results: null or empty texts hold no words and match nothing; an item of fewer than five words
matches only a document that consists of just these words (inside longer texts it says nothing); repeated rows are judged alike; a null id is kept; empty tables give an empty
result; very long texts are read whole; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import free_names, materialise

SHINGLE = 5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))


def shingle_starts(words: Column, shingle: int) -> Column:
    """Positions of shingles; none without words, one with fewer words than a shingle."""
    last = F.greatest(F.size(words) - shingle, F.lit(0))
    return F.when(F.size(words) > 0, F.sequence(F.lit(0), last))


def shingle_hash(words: Column, start: Column, shingle: int) -> Column:
    return F.xxhash64(*[F.get(words, start + i) for i in range(shingle)])


def _weighted(rows: DataFrame, key: str, words: str, shingle: int) -> DataFrame:
    """(key, fp, marks): SimHash fingerprint, and shingles made distinct by their occurrence number."""
    each = rows.select(key, words, F.explode(shingle_starts(F.col(words), shingle)).alias("at")).select(
        key, shingle_hash(F.col(words), F.col("at"), shingle).alias("h")
    )
    counted = each.groupBy(key, "h").agg(F.count("*").alias("n"))
    sums = [F.sum(F.when(F.getbit("h", F.lit(b)) == 1, F.col("n")).otherwise(-F.col("n"))).alias(f"s{b}") for b in range(64)]
    marks = F.flatten(F.collect_list(F.transform(F.sequence(F.lit(1).cast("long"), F.col("n")), lambda i: F.xxhash64("h", i)))).alias("marks")
    bits = F.lit(0).cast("long")
    for b in range(64):
        bits = bits.bitwiseOR(F.when(F.col(f"s{b}") > 0, F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return counted.groupBy(key).agg(*sums, marks).select(key, bits.alias("fp"), "marks")


def _blocks(fp: Column, radius: int) -> Column:
    """The fingerprint's radius + 1 blocks, each with its number."""
    many = radius + 1
    edges = [64 * i // many for i in range(many + 1)]
    parts = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long")) for lo, hi in zip(edges[:-1], edges[1:])]
    return F.explode(F.array(*[F.struct(F.lit(i).alias("nr"), p.alias("bits")) for i, p in enumerate(parts)]))


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(text_hash(text_col).alias("hash"), words_of(F.col(f"`{text_col}`")).alias("words"))


def window_starts(hits: DataFrame) -> DataFrame:
    """(hash, ik, start, size) from hits (hash, n, ik, size, offset): starts at offsets, and between near ones."""
    of = Window.partitionBy("hash", "ik").orderBy("offset")
    gap = F.coalesce(F.col("next") - F.col("offset"), F.lit(1))
    last = F.col("offset") + F.when(gap <= F.floor(F.col("size") / 4), gap - 1).otherwise(0)
    starts = hits.withColumn("next", F.lead("offset").over(of)).withColumn("at", F.explode(F.sequence("offset", last)))
    inside = F.greatest(F.least(F.col("at"), F.col("n") - F.col("size")), F.lit(0))
    return starts.select("hash", "ik", "size", inside.cast("int").alias("start")).distinct()


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    similarity: float = 0.8, radius: int = 20, shingle: int = SHINGLE, broadcast_shingles: int = 1_000_000, broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """Rows (id, hash, item_id, similarity, distance, start_word, n_words): the best window of each document and item that match.

    A document is its id and its text's hash, so that rows of one id, or without one, are told apart.  Texts that hold a
    shingle are found again by their hash, broadcast up to ``broadcast_rows`` of them and joined by a shuffle beyond.
    """

    def bounded(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= broadcast_rows else df

    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), words_of(F.col(f"`{item_text_col}`")).alias("iw")).where(F.size("iw") > 0)
    keyed = items.select("item_id", "iw", F.xxhash64("iw").alias("ik"))
    contents_of = keyed.dropDuplicates(["ik"]).select("ik", "iw")
    places = contents_of.select("ik", "iw", F.size("iw").alias("size"), F.explode(shingle_starts(F.col("iw"), shingle)).alias("q")).select(
        shingle_hash(F.col("iw"), F.col("q"), shingle).alias("h"), "ik", "size", "q"
    )
    anchors = places.groupBy("h").agg(F.collect_list(F.struct("ik", "size", "q")).alias("places"))
    if places.count() <= broadcast_shingles:
        anchors = F.broadcast(anchors)
    placed = (
        _texts(docs, text_col)
        .select("hash", "words", F.size("words").alias("n"), F.explode(shingle_starts(F.col("words"), shingle)).alias("at"))
        .select("hash", "n", "at", shingle_hash(F.col("words"), F.col("at"), shingle).alias("h"))
    )
    hits = placed.join(anchors, "h").select("hash", "n", "at", F.explode("places").alias("p"))
    hits = hits.select("hash", "n", F.col("p.ik").alias("ik"), F.col("p.size").alias("size"), (F.col("at") - F.col("p.q")).alias("offset")).distinct()
    starts = materialise(window_starts(hits), "leak-starts")
    holding = starts.select("hash").distinct()
    words = materialise(_texts(docs, text_col).join(bounded(holding), "hash", "left_semi").dropDuplicates(["hash"]), "leak-texts")
    windows = materialise(
        starts.join(words, "hash").select("hash", "ik", "start", F.slice("words", F.col("start") + 1, F.col("size")).alias("ww")).withColumn("wk", F.xxhash64("ww")), "leak-windows"
    )
    left = materialise(_weighted(windows.dropDuplicates(["wk"]).select("wk", "ww"), "wk", "ww", shingle), "leak-prints")
    right = _weighted(contents_of, "ik", "iw", shingle).withColumnsRenamed({"fp": "ifp", "marks": "imarks"})
    laid = windows.select("wk", "ik").distinct()
    a = laid.join(left, "wk").select("wk", "ik", "fp", F.size("marks").alias("n"), _blocks(F.col("fp"), radius).alias("block"))
    b = right.select("ik", "ifp", F.size("imarks").alias("m"), _blocks(F.col("ifp"), radius).alias("block"))
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp")))
    near = (
        a.join(b, ["ik", "block"])
        .where((F.least("n", "m") >= F.lit(similarity) * F.greatest("n", "m")) & (distance <= radius))
        .select("wk", "ik", distance.alias("distance"))
        .distinct()
    )
    shared = F.size(F.array_intersect("marks", "imarks"))
    verified = (
        near.join(left.select("wk", "marks"), "wk")
        .join(right.select("ik", "imarks"), "ik")
        .withColumn("similarity", shared / (F.size("marks") + F.size("imarks") - shared))
        .where(F.col("similarity") >= similarity)
        .select("wk", "ik", "similarity", "distance")
    )
    best = F.max(F.struct("similarity", (-F.col("distance")).alias("d"), (-F.col("start")).alias("s"), F.size("ww").alias("n_words"))).alias("best")
    found = windows.join(verified, ["wk", "ik"]).groupBy("hash", "ik").agg(best)
    found = materialise(found.join(keyed.select("ik", "item_id"), "ik").groupBy("hash", "item_id").agg(F.max("best").alias("best")), "leak-found")
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_hash(text_col).alias("hash"))
    rows = ids.join(bounded(found), "hash").distinct()
    return rows.select(
        "id", "hash", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.d")).cast("int").alias("distance"), (-F.col("best.s")).alias("start_word"), F.col("best.n_words").alias("n_words")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000, **options) -> DataFrame:
    """The documents without those that have a leak; columns as they are.

    The list of those that go is broadcast up to ``broadcast_rows`` of them and joined by a shuffle beyond.
    """
    leak_id, leak_hash = free_names(docs, "__leak", "__hash")
    found = leaks(docs, benchmark, id_col, text_col, **options).select(F.col("id").alias(leak_id), F.col("hash").alias(leak_hash)).distinct()
    gone = materialise(found, "leaks")
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(leak_id)) & (text_hash(text_col) == F.col(leak_hash))
    return docs.join(F.broadcast(gone) if gone.count() <= broadcast_rows else gone, same, "left_anti")


def op3_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("hash").withColumnRenamed("id", "doc_id")
