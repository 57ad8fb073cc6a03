"""Target-distribution importance resampling over hashed n-grams, with overlap chunking of long texts.

Each n-gram (1 to n words) counts in one of ``buckets`` hash buckets.  The log ratio of a bucket's share in the target texts
to its share in all texts is its gain; a document's weight is the mean gain of its features; adding Gumbel noise that
depends on the id alone and taking the largest sums draws documents without replacement in proportion to their weights.

Long texts are cut at word boundaries into chunks of some ``chunk_chars`` characters.  A chunk carries the n - 1 words that
follow it, and owns the features that start in it, so each feature of the text counts once.  Chunks of texts that have
several are dealt over all partitions, and counts and gains of chunks are summed by document.  Chunks are cut in DataFrame
operations; their words are counted in Arrow batches, on the bytes of the text.

What goes to all tasks: one gain for each bucket, and the number of documents by score.  Scores are whole thousandths of a
logarithm; with counts below 10^15 and noise between -3,100 and 23,000 fewer than 100,000 values can occur, whatever the table holds.
Ranks come from the counts by score (in two steps, so no task sees all of them) and the order within one score.

Defined results: a null text has no words, weight 0 and no rank; a null id is noised as the empty id and comes after others
of its score; repeated rows of one id and text are each a document (they are summed together and dealt out again); a
text without words or features has weight 0; without target texts the target counts are zero; an empty table gives an
empty result; texts of any length count whole; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import id_and_text, materialise, table

#: Characters (ASCII) between words; all other characters are of words.
BETWEEN = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same for the bytes of a text in lower case.
WORD = re.compile(rb"[0-9a-z\x80-\xFF]+")
TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
TARGET_SEED = 2024


def pieces_of(text: Column, chunk_chars: int) -> Column:
    """The text from word to word in pieces of at least ``chunk_chars`` characters, each to the end of its last word."""
    return F.regexp_extract_all(text, F.lit(f"(?s)[^{BETWEEN}].{{0,{chunk_chars - 1}}}[^{BETWEEN}]*+"), F.lit(0))


def chunks(docs: DataFrame, n: int, chunk_chars: int = 65_536, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, key, size, chunk, owned, carried): the words that a chunk owns and up to n - 1 that follow them."""
    rows = id_and_text(docs, id_col, text_col)
    rows = rows.select("id", F.xxhash64("text").alias("key"), F.length("text").alias("size"), "text")
    short = rows.where(F.col("size") <= chunk_chars).select("id", "key", "size", F.lit(0).alias("chunk"), F.col("text").alias("owned"), F.lit("").alias("carried"))
    cut = rows.where(F.col("size") > chunk_chars).withColumn("pieces", pieces_of(F.translate("text", UPPER, LOWER), chunk_chars))
    if n > 1:
        # a piece may hold fewer words than are carried, so the starts of the n - 1 next ones are joined
        start = f"^(?:[^{BETWEEN}]++[{BETWEEN}]*+){{1,{n - 1}}}"
        cut = cut.withColumn("starts", F.transform("pieces", lambda p: F.regexp_extract(p, start, 0)))
        laid = F.transform("pieces", lambda p, i: F.struct(p.alias("owned"), F.array_join(F.slice("starts", i + 2, n - 1), " ").alias("carried")))
    else:
        laid = F.transform("pieces", lambda p: F.struct(p.alias("owned"), F.lit("").alias("carried")))
    cut = cut.select("id", "key", "size", F.posexplode_outer(laid).alias("chunk", "laid"))
    cut = cut.select("id", "key", "size", F.coalesce("chunk", F.lit(0)).alias("chunk"), F.coalesce("laid.owned", F.lit("")).alias("owned"), F.coalesce("laid.carried", F.lit("")).alias("carried"))
    return short.unionByName(cut.repartition("id", "key", "chunk"))


def grams_of(owned: bytes, carried: bytes, n: int) -> tuple[int, list[bytes]]:
    """The number of a chunk's own words, and the features that start at them."""
    words = WORD.findall(owned.translate(TO_LOWER))
    if n == 1:
        return len(words), words
    every = words + WORD.findall(carried.translate(TO_LOWER))[: n - 1]
    return len(words), [b" ".join(every[i : i + size]) for size in range(1, n + 1) for i in range(min(len(words), len(every) - size + 1))]


class Buckets(dict):
    """gram -> bucket, kept while there is room."""

    def __init__(self, buckets: int, most: int = 1_000_000):
        super().__init__()
        self.buckets, self.most = buckets, most

    def __missing__(self, gram: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        at = self[gram] = zlib.crc32(gram) % self.buckets
        return at

    def of(self, grams: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, grams), np.int64, len(grams))


def bucket_counts(docs: DataFrame, n: int, buckets: int, chunk_chars: int, id_col: str, text_col: str) -> dict[int, int]:
    """Features by bucket: counted by partition, then summed, so at most ``buckets`` rows come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for owned, carried in zip(batch.column(0), batch.column(1)):
                total += np.bincount(known.of(grams_of(owned.as_py(), carried.as_py(), n)[1]), minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], ["bucket", "n"])

    rows = chunks(docs, n, chunk_chars, id_col, text_col).select(F.col("owned").cast("binary").alias("owned"), F.col("carried").cast("binary").alias("carried"))
    return {r.bucket: r.n for r in rows.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """floor(1000 ln(target share / source share)) of each bucket, with one added to every count."""
    s, t = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1) * s / ((source.get(b, 0) + 1) * t))) for b in range(buckets)]


def floor_mean(total: Column, n: Column) -> Column:
    """total / n rounded down, in whole numbers."""
    return F.when(n > 0, ((total - F.pmod(total, n)) / n).cast("long")).otherwise(F.lit(0).cast("long"))


def noise(id_: Column, seed: int) -> Column:
    """floor(1000 g) of a Gumbel value g that depends on the id and the seed alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighed(docs: DataFrame, of_bucket: list[int], n: int, seed: int, chunk_chars: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, key, size, copies, n_features, n_words, weight, score): one for each id and text, with its number of rows."""
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gain = Buckets(len(of_bucket)), np.array(of_bucket, np.int64)
        for batch in batches:
            made = []
            for owned, carried in zip(batch.column(4), batch.column(5)):
                words, grams = grams_of(owned.as_py(), carried.as_py(), n)
                made.append((words, len(grams), int(gain[known.of(grams)].sum())))
            sums = np.array(made, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), *(pa.array(sums[:, i]) for i in range(3))], ["id", "key", "size", "first", "words", "features", "gain"])

    rows = chunks(docs, n, chunk_chars, id_col, text_col)
    first = (F.col("chunk") == 0).cast("int").alias("first")
    rows = rows.select("id", "key", "size", first, F.col("owned").cast("binary").alias("owned"), F.col("carried").cast("binary").alias("carried"))
    rows = rows.mapInArrow(weigh, "id long, key long, size int, first int, words long, features long, gain long")
    summed = rows.groupBy("id", "key", "size").agg(
        F.sum("first").alias("copies"), F.sum("features").alias("features"), F.sum("words").alias("words"), F.sum("gain").alias("gain")
    )
    one = lambda c: F.expr(f"{c} div copies")
    summed = summed.select("id", "key", "size", "copies", one("features").alias("n_features"), one("words").alias("n_words"), one("gain").alias("gain"))
    summed = summed.withColumn("weight", floor_mean(F.col("gain"), F.col("n_features"))).drop("gain")
    return summed.withColumn("score", F.col("weight") + noise(F.col("id"), seed))


def resample(
    docs: DataFrame,
    target: DataFrame,
    n: int = 2,
    buckets: int = 10_000,
    percent: int = 10,
    least_words: int = 20,
    seed: int = TARGET_SEED,
    chunk_chars: int = 65_536,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """Rows (id, n_features, n_words, weight, score, rank) for each input row; the rank of the rows not drawn is null.

    Of the rows with ``least_words`` words or more, ``percent`` in a hundred are drawn, rounded down.
    """
    if n < 1 or not 1 <= chunk_chars <= 1 << 24:
        raise ValueError("n must be 1 or more, chunk_chars between 1 and 2^24")
    source = bucket_counts(docs, n, buckets, chunk_chars, id_col, text_col)
    wanted = bucket_counts(target.select(F.lit(0).alias("id"), F.col(f"`{target_text}`").alias("text")), n, buckets, chunk_chars, "id", "text")
    rows = materialise(weighed(docs, gains(source, wanted, buckets), n, seed, chunk_chars, id_col, text_col), "resampling")

    may = F.col("n_words") >= least_words
    drawn = rows.where(may).agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first().n * percent // 100
    by_score = rows.where(may).groupBy("score").agg(F.sum("copies").alias("many")).withColumn("coarse", F.floor(F.col("score") / 256))
    higher = lambda *by: Window.partitionBy(*by).orderBy(F.desc("coarse" if not by else "score")).rowsBetween(Window.unboundedPreceding, -1)
    coarse = by_score.groupBy("coarse").agg(F.sum("many").alias("many")).select("coarse", F.coalesce(F.sum("many").over(higher()), F.lit(0)).alias("above"))
    starts = by_score.join(F.broadcast(coarse), "coarse").select(F.col("score").alias("of"), (F.col("above") + F.coalesce(F.sum("many").over(higher("coarse")), F.lit(0))).alias("start"))
    starts = starts.where(F.col("start") < drawn)

    placed = rows.join(F.broadcast(starts), (F.col("score") == F.col("of")) & may, "left").drop("of")
    within = Window.partitionBy("score").orderBy(F.asc_nulls_last("id"), "n_features", "weight", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.where("start IS NOT NULL").withColumn("first", F.col("start") + F.coalesce(F.sum("copies").over(within), F.lit(0)))
    out = first.unionByName(placed.where("start IS NULL").withColumn("first", F.lit(None).cast("long")))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    rank = F.col("first") + F.col("copy")
    return out.select("id", "n_features", "n_words", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=1)
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


#: The query in SQL: the checksum of each different word by the bits of its polynomial, byte by byte.
ORACLE = r"""
WITH polynomial AS (
  SELECT list(v ORDER BY i) AS t
  FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))
), words AS (
  SELECT 's' AS side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 't', item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), spelt AS (
  SELECT word, hex(encode(word)) AS hx FROM (SELECT DISTINCT word FROM words)
), hashed AS (
  SELECT word, xor(list_reduce([4294967295]::BIGINT[] || list_transform(range(0, length(hx) // 2),
           lambda i: (16 * (instr('0123456789ABCDEF', substr(hx, 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(hx, 2 * i + 2, 1)) - 1)::BIGINT),
         lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
  FROM spelt, polynomial
), counted AS (
  SELECT bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM words JOIN hashed USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counted
), weights AS (
  SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS g FROM words JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 's' GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features, CASE WHEN n > 0 THEN (g - ((g % n) + n) % n) // n ELSE 0 END::BIGINT AS weight,
         list_reduce([0]::BIGINT[] || list_transform(range(1, 9), lambda i: (instr('0123456789abcdef', substr(sha256('2024:' || d.doc_id), i, 1)) - 1)::BIGINT), lambda a, b: 16 * a + b) AS h
  FROM documents d LEFT JOIN weights w ON w.doc_id = d.doc_id
), finished AS (
  SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score FROM scored
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (n_features >= 20) OVER () AS many FROM finished
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * many // 100 THEN r END AS rank FROM ranked
"""
