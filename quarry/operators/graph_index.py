"""A stored graph index for vectors: neighbour graphs of hash shards, searched best-first, results merged.

Each shard, of a bounded number of vectors, gets a graph by itself: a vector's nearest neighbours in the shard, the nearest of a
random sample as links between regions, and the reverse of both.  A search starts from the entry points nearest to the query and goes on
from the best vector not yet expanded until the ``beam`` best found are all expanded; queries go side by side.  The best of all
shards are merged.  New vectors are a new segment.

Vectors that are null, zero, of another length or hold null or non-finite components take no part.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.store import _path

c = F.col
NODE = "shard int, place int, id long, vector array<float>, links array<int>, entry boolean"


def neighbour_graph(x: np.ndarray, degree: int, sample: int, seed: int, block: int = 1024) -> list[np.ndarray]:
    """Links of each row of unit vectors: two thirds to its nearest rows, the others to the nearest of a sample, and back."""
    n, near = len(x), max(1, 2 * degree // 3)
    chosen = np.random.default_rng(seed).choice(n, min(sample, n), replace=False)
    pairs = []
    for at in range(0, n, block):
        own = np.arange(at, min(at + block, n))
        scores = x[own] @ x.T
        scores[np.arange(len(own)), own] = -np.inf
        for cols, many in ((None, near), (chosen, degree - near)):
            part = scores if cols is None else scores[:, cols]
            many = min(many, part.shape[1])
            top = np.argpartition(-part, many - 1, axis=1)[:, :many]
            to = top if cols is None else cols[top]
            pairs.append(np.stack([np.repeat(own, many), to.reshape(-1)], 1))
    edges = np.concatenate(pairs)
    edges = np.unique(np.concatenate([edges, edges[:, ::-1]]), axis=0)
    edges = edges[edges[:, 0] != edges[:, 1]]
    return np.split(edges[:, 1].astype(np.int32), np.searchsorted(edges[:, 0], np.arange(1, n)))


def best_first(x: np.ndarray, links: list[np.ndarray], entries: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, scores, visited): the ``beam`` best rows found for each query (-1 where fewer), and how many rows each looked at."""
    n, many, width = len(x), len(queries), max(beam, 1)
    degree = np.array([len(v) for v in links], np.int64)
    first, ends = np.cumsum(degree) - degree, np.concatenate([np.empty(0, np.int32), *links]).astype(np.int64)
    seen = np.zeros((many, n), bool)
    seen[:, entries] = True
    scores = queries @ x[entries].T
    places = np.full((many, width), -1, np.int64)
    best = np.full((many, width), -np.inf, np.float32)
    order = np.argsort(-scores, axis=1)[:, :width]
    places[:, : order.shape[1]] = entries[order]
    best[:, : order.shape[1]] = np.take_along_axis(scores, order, 1)
    worst = best.min(1)
    done = places < 0  # expanded, or nothing there
    active = np.arange(many)
    while len(active):
        waiting = ~done[active]
        active = active[waiting.any(1)]
        if not len(active):
            break
        at = np.where(~done[active], best[active], -np.inf).argmax(1)
        done[active, at] = True
        # links side by side, however many each row has; only rows not yet looked at are scored
        node = places[active, at]
        each = degree[node]
        query = np.repeat(active, each)
        to = ends[np.arange(each.sum()) + np.repeat(first[node] - np.cumsum(each) + each, each)]
        fresh = ~seen.reshape(-1)[query * n + to]
        query, to = query[fresh], to[fresh]
        seen.reshape(-1)[query * n + to] = True
        found = np.empty(len(to), np.float32)
        for i in range(0, len(to), 1 << 16):  # what is gathered at once is bounded
            found[i : i + (1 << 16)] = np.einsum("gd,gd->g", queries[query[i : i + (1 << 16)]], x[to[i : i + (1 << 16)]])
        better = found > worst[query]
        query, to, found = query[better], to[better], found[better]
        if not len(query):
            continue
        own, count = np.unique(query, return_counts=True)
        row = np.repeat(np.arange(len(own)), count)
        column = np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
        more = np.full((len(own), count.max()), -np.inf, np.float32)
        places_more = np.full(more.shape, -1, np.int64)
        more[row, column], places_more[row, column] = found, to
        both = np.concatenate([best[own], more], 1)
        keep = np.argpartition(-both, width - 1, axis=1)[:, :width]
        best[own] = np.take_along_axis(both, keep, 1)
        places[own] = np.take_along_axis(np.concatenate([places[own], places_more], 1), keep, 1)
        done[own] = np.take_along_axis(np.concatenate([done[own], places_more < 0], 1), keep, 1)
        worst[own] = best[own].min(1)
    return places, best, seen.sum(1)


def _usable(vector: Column, dims: int) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == dims) & finite & F.exists(vector, lambda v: v != 0)


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class GraphIndex:
    def __init__(self, spark: SparkSession, root: str, dims: int, shard_rows: int = 20_000, degree: int = 24, entries: int = 64):
        self.spark, self.root, self.dims, self.shard_rows, self.degree, self.entries = spark, root.rstrip("/"), dims, shard_rows, degree, entries

    def _segments(self) -> list[str]:
        fs, p = _path(self.spark, self.root)
        names = sorted(s.getPath().toString() for s in fs.listStatus(p)) if fs.exists(p) else []
        return [n for n in names if fs.exists(_path(self.spark, f"{n}/_SUCCESS")[1])]

    def add(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> None:
        """Append the vectors as a segment of its own shards, each built by one task."""
        degree, entries, dims = self.degree, self.entries, self.dims
        rows = vectors.select(c(id_col).cast("long").alias("id"), c(vector_col).cast("array<float>").alias("vector")).where(_usable(c("vector"), dims))
        shards = max(1, math.ceil(rows.count() / self.shard_rows))

        def build(part: pd.DataFrame) -> pd.DataFrame:
            x = _unit(part["vector"])
            links = neighbour_graph(x, degree, 4 * degree + entries, int(part["shard"].iloc[0])) if len(x) > 1 else [np.empty(0, np.int32)]
            first = np.random.default_rng(7).choice(len(x), min(entries, len(x)), replace=False)
            entry = np.zeros(len(x), bool)
            entry[first] = True
            return pd.DataFrame({"shard": part["shard"], "place": np.arange(len(x), dtype=np.int32), "id": part["id"], "vector": list(x), "links": links, "entry": entry})

        dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
        path = f"{self.root}/s{len(self._segments()):06d}"
        dealt.groupBy("shard").applyInPandas(build, NODE).write.mode("overwrite").parquet(path)

    def search(self, queries: DataFrame, k: int, query_id: str = "query_id", vector_col: str = "embedding", beam: int = 96, pack: int = 1024) -> DataFrame:
        """(query_id, rank, id, score, visited): the ``k`` best found by cosine, and how many vectors were looked at for the query.

        A stated set of queries meets every shard in packs of ``pack``."""
        asked = queries.select(c(query_id).cast("long").alias("query_id"), c(vector_col).cast("array<float>").alias("q")).where(_usable(c("q"), self.dims))
        packs = max(1, math.ceil(asked.count() / pack))
        asked = asked.withColumn("pack", F.pmod(F.xxhash64("query_id"), F.lit(packs)).cast("int"))
        found = None
        for segment in self._segments():
            nodes = self.spark.read.schema(NODE).parquet(segment)
            shards = self.spark.read.schema(NODE).parquet(segment).select("shard").distinct()
            sides = nodes.withColumn("pack", F.explode(F.array(*[F.lit(i) for i in range(packs)])))
            each = asked.join(F.broadcast(shards))  # a stated query set against all shards
            beam_ = max(beam, k)

            def look(graph: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
                if graph.empty or some.empty:
                    return pd.DataFrame({"query_id": [], "id": [], "score": [], "visited": []}).astype({"query_id": "int64", "id": "int64", "score": "float64", "visited": "int64"})
                graph = graph.sort_values("place")
                x = np.array(graph["vector"].tolist(), np.float32)
                entries = np.flatnonzero(graph["entry"].to_numpy())
                places, scores, visited = best_first(x, graph["links"].tolist(), entries, _unit(some["q"]), beam_)
                order = np.argsort(-scores, axis=1)[:, :k]
                places, scores = np.take_along_axis(places, order, 1), np.take_along_axis(scores, order, 1)
                ok = places >= 0
                many = places.shape[1]
                return pd.DataFrame({"query_id": np.repeat(some["query_id"].to_numpy(), many)[ok.reshape(-1)], "id": graph["id"].to_numpy()[places[ok]], "score": scores[ok].astype(float), "visited": np.repeat(visited, many)[ok.reshape(-1)]})

            part = sides.groupBy("shard", "pack").cogroup(each.groupBy("shard", "pack")).applyInPandas(look, "query_id long, id long, score double, visited long")
            part = part.withColumn("segment", F.lit(segment))
            found = part if found is None else found.unionByName(part)
        if found is None:
            raise ValueError("the index has no segment")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        total = F.sum(F.when(c("first") == 1, c("visited"))).over(Window.partitionBy("query_id"))
        marked = found.withColumn("first", F.row_number().over(Window.partitionBy("query_id", "segment", "visited").orderBy("id")))
        ranked = marked.withColumns({"rank": F.row_number().over(order), "looked_at": total})
        return ranked.where(c("rank") <= k).select("query_id", "rank", "id", "score", c("looked_at").alias("visited"))
