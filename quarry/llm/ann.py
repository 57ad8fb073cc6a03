"""Approximate nearest neighbours by inner product through an inverted multi-index.

Two codebooks are fitted on the two halves of a bounded sample of vectors (``train_rows``); every vector is indexed under
its pair of centroids.  A query visits centroid pairs by their summed distance (the inner product of its halves with both
centroids, negated: the measure itself) with a heap until the visited cells hold the share ``probe`` of the index, and
reranks what they hold by the exact inner product in double precision.

Where ``probe`` is not given it is measured: for 200 vectors of the sample, held out of the candidates one by one, the
share of the sample that has to be visited to find ``recall`` of their nearest neighbours.  Clustered vectors need a few
hundredths, random directions most of the index; a larger index needs less than its sample.

Equal vectors are indexed once, with their ``k + 1`` smallest ids, which is all that ties can ask for; so a much repeated
vector costs no more than any other.  The number of codes grows with the root of the vectors.  The index is stored as
blocks of bounded size, keyed by first centroid and a salt; a query reaches a block once, with bit masks of the second
centroids that it visits there, and queries meet blocks in packs.

Defined results: vectors that are null, zero, or hold nulls or non-finite values take no part; shorter vectors count as
filled up with zeros (the inner product runs over the common part); ties go to the smaller id; a query is never its own
neighbour; a null id takes no part; queries with fewer than ``k`` candidates get all of them; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialise

BLOCK, PACK, CELL = 2048, 256, 16  # vectors of a block, queries of a pack, vectors of a cell on average


def codebook(points: np.ndarray, size: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means; an empty centroid moves to the point that is worst served."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), size, replace=len(points) < size)].astype(np.float64)
    for _ in range(rounds):
        gap = (centres**2).sum(1) - 2 * points @ centres.T
        nearest = gap.argmin(1)
        counts = np.bincount(nearest, minlength=size)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        worst = np.argsort(-gap[np.arange(len(points)), nearest] - (points**2).sum(1))
        for empty, point in zip(np.flatnonzero(counts == 0), worst):
            sums[empty], counts[empty] = points[point], 1
        centres = sums / counts[:, None]
    return centres


def multi_sequence(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> np.ndarray:
    """Bit masks (first centroids x words of 64 second centroids): cells by summed distance until they hold ``wanted`` vectors."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    da, db = first[a].tolist(), second[b].tolist()
    ordered = counts[np.ix_(a, b)].tolist()
    found = 0
    heap = [(da[0] + db[0], 0, 0)]
    done = [0] * len(da)  # a cell is queued once its neighbours with one smaller index have been visited
    while heap and found < wanted:
        _, i, j = heapq.heappop(heap)
        found += ordered[i][j]
        done[i] = j + 1
        if i + 1 < len(da) and done[i + 1] == j:
            heapq.heappush(heap, (da[i + 1] + db[j], i + 1, j))
        if j + 1 < len(db) and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
    place = np.empty(len(db), np.int64)
    place[b] = np.arange(len(db))
    visited = place[None, :] < np.array(done)[:, None]  # of each first centroid its nearest second ones
    words = -(-len(db) // 64)
    bits = np.zeros((len(da), words * 64), bool)
    bits[a, : len(db)] = visited
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(len(da), words)


def needed_share(points: np.ndarray, half: int, books: tuple[np.ndarray, np.ndarray], k: int, recall: float, seed: int) -> float:
    """The share of ``points`` that queries among them visit to find ``recall`` of their ``k`` nearest, on average."""
    n, codes = len(points), len(books[0])
    if n <= 2 * k:
        return 1.0
    cell = [((c**2).sum(1) - 2 * y @ c.T).argmin(1) for c, y in zip(books, (points[:, :half], points[:, half:]))]
    counts = np.zeros((codes, codes), np.int64)
    np.add.at(counts, (cell[0], cell[1]), 1)
    chosen = np.random.default_rng(seed).choice(n, min(200, n), replace=False)
    shares = []
    for q in chosen:
        scores = points @ points[q]
        scores[q] = -np.inf
        near = np.argpartition(-scores, k - 1)[:k]
        order = -(books[0] @ points[q, :half])[:, None] - (books[1] @ points[q, half:])[None, :]
        before = np.sort(order, axis=None)
        held = np.cumsum(counts.ravel()[np.argsort(order, axis=None, kind="stable")])
        reached = held[np.searchsorted(before, order[cell[0][near], cell[1][near]])] / n
        shares.append(reached)
    # all of them together: the share at which ``recall`` of the neighbours have been reached
    return float(min(1.0, np.quantile(np.concatenate(shares), recall) * 1.02))


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def usable(vector: Column) -> Column:
    """The vector is finite throughout, and not zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", probe: float | None = None, recall: float = 0.95, train_rows: int = 20_000, max_codes: int = 1024, seed: int = 7
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` nearest found for each row for which ``is_query`` holds."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    given = vectors.schema[vector_col].dataType
    kind = "array<float>" if given.simpleString() == "array<float>" else "array<double>"  # floats are exact as doubles later
    raw = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast(kind).alias("vec"), is_query.alias("asks"))
    rows = raw.where(F.col("id").isNotNull() & usable(F.col("vec")))
    sizes = rows.agg(F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most"), F.count_if("asks").alias("asks")).first()
    if not sizes["most"] or not sizes["asks"]:
        return spark.createDataFrame([], schema)
    dims, asks = sizes["most"], sizes["asks"]
    half = max(1, dims // 2)
    if sizes["least"] < dims:
        rows = rows.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0.0).cast(kind[6:-1]), F.lit(dims) - F.size("vec"))))
    # equal vectors once: the group limit runs before the shuffle, so a hot vector sends k + 1 rows a partition
    order = Window.partitionBy("vec").orderBy("id")
    firsts = rows.select("id", "vec").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    distinct = materialise(firsts.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")), "ann-vectors")
    total = distinct.count()
    share = min(1.0, train_rows / total)
    sample = distinct.where(F.pmod(F.xxhash64("vec", F.lit(seed)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).select("vec").toArrow()
    if sample.num_rows == 0:
        sample = distinct.select("vec").limit(train_rows).toArrow()
    points = _vectors(sample.column(0).combine_chunks(), dims).astype(np.float64)
    codes = 2
    while codes < max_codes and codes * codes * CELL < total:
        codes *= 2
    books = (codebook(points[:, :half], codes, seed), codebook(points[:, half:], codes, seed + 1))
    if probe is None:
        probe = needed_share(points, half, books, k, recall, seed)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column(0), dims).astype(np.float64)
            if len(x):
                i, j = (((c**2).sum(1) - 2 * y @ c.T).argmin(1).astype(np.int32) for c, y in zip(books, (x[:, :half], x[:, half:])))
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), batch.column(0), batch.column(1)], ["i", "j", "vec", "ids"])

    index = materialise(distinct.mapInArrow(assign, f"i int, j int, vec {kind}, ids array<long>"), "ann-index")
    counts = np.zeros((codes, codes), np.int64)
    for i, j, n in index.groupBy("i", "j").count().collect():  # at most codes * codes rows
        counts[i, j] = n
    wanted = max(int(np.ceil(probe * total)), 10 * k)
    salts = np.maximum(1, -(-counts.sum(1) // (BLOCK // 2))).astype(int)
    salt_of = F.get(F.lit([int(x) for x in salts]), F.col("i"))
    salted = index.withColumn("salt", F.pmod(F.xxhash64("vec"), salt_of).cast("int"))
    blocks = salted.groupBy("i", "salt").agg(F.collect_list(F.struct("j", "vec", "ids")).alias("block"))
    tasks = int(min(10_000, max(1, -(-asks // PACK))))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column(1), dims).astype(np.float64)
            for at in range(0, len(x), PACK):
                part = x[at : at + PACK]
                masks = np.array([multi_sequence(-f, -s, counts, wanted) for f, s in zip(part[:, :half] @ books[0].T, part[:, half:] @ books[1].T)])
                q, i = np.nonzero(masks.any(axis=2))
                many = salts[i]
                q, i, first = np.repeat(q, many), np.repeat(i, many), np.repeat(np.cumsum(many) - many, many)
                salt = np.arange(len(i)) - first  # a query goes to each block of a centroid that it visits
                rows_of = pa.array(q + at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(i.astype(np.int32)), pa.array(salt.astype(np.int32)), batch.column(0).take(rows_of), pa.array(list(masks[q, i].view(np.int64)), pa.list_(pa.int64())), batch.column(1).take(rows_of)],
                    ["i", "salt", "query_id", "mask", "vec"],
                )

    asked = rows.where("asks").select("id", "vec").repartition(tasks, "id")
    visits = asked.mapInArrow(visit, f"i int, salt int, query_id long, mask array<long>, vec {kind}")
    packs = max(1, -(-asks // PACK))
    packed = visits.groupBy("i", "salt", F.pmod(F.xxhash64("query_id"), F.lit(packs)).alias("pack")).agg(F.collect_list(F.struct("query_id", "mask", "vec")).alias("queries"))

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = -(-codes // 64)
        for batch in batches:
            for block, queries in zip(batch.column(0), batch.column(1)):
                block, queries = block.values, queries.values
                j = block.field("j").to_numpy().astype(np.uint64)
                x = _vectors(block.field("vec"), dims).astype(np.float64)
                q = _vectors(queries.field("vec"), dims).astype(np.float64)
                masks = _vectors(queries.field("mask"), words).view(np.uint64)
                visited = (masks[:, (j >> np.uint64(6)).astype(np.int64)] >> (j & np.uint64(63))[None, :]) & np.uint64(1) == 1
                scores = np.where(visited, q @ x.T, -np.inf)
                if scores.shape[1] > k + 1:
                    edge = np.partition(scores, -(k + 1), axis=1)[:, -(k + 1)]
                    visited &= scores >= (edge - 1e-9 * np.maximum(1, np.abs(edge)))[:, None]
                rows_at, cols_at = np.nonzero(visited)
                exact = np.zeros(len(rows_at))
                for d in range(dims):  # in a fixed order, so that equal vectors get equal scores
                    exact += q[rows_at, d] * x[cols_at, d]
                yield pa.RecordBatch.from_arrays(
                    [queries.field("query_id").take(pa.array(rows_at)), pa.array(exact), block.field("ids").take(pa.array(cols_at))], ["query_id", "score", "ids"]
                )

    found = blocks.join(packed, ["i", "salt"]).select("block", "queries")
    hits = found.mapInArrow(rerank, "query_id long, score double, ids array<long>")
    single = hits.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    # a repeated query row finds the same neighbours once more; a neighbour counts once, before the shuffle too
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = single.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_inverted_multi_index(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
