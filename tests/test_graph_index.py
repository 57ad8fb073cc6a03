import numpy as np
import pytest

from quarry.operators.graph_index import GraphIndex, best_first, neighbour_graph
from quarry.plans import search


def clustered(n, seed, dims=32, clusters=60):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(1).normal(size=(clusters, dims))
    return (centres[rng.integers(0, clusters, n)] + 0.35 * rng.normal(size=(n, dims))).astype(np.float32)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_search_finds_neighbours_with_a_small_share_looked_at():
    x, q = unit(clustered(5000, 2)), unit(clustered(60, 3))
    links = neighbour_graph(x, 24, 160, 0)
    places, scores, visited = best_first(x, links, np.arange(0, 5000, 80), q, 96)
    true = np.argsort(-(q @ x.T), axis=1)[:, :20]
    top = np.take_along_axis(places, np.argsort(-scores, axis=1)[:, :20], 1)
    recall = np.mean([len(set(a) & set(b)) / 20 for a, b in zip(true, top)])
    assert recall >= 0.95 and visited.mean() < 0.25 * 5000
    assert all(j in links[i] or i in links[j] for i in range(0, 5000, 500) for j in links[i])


def test_segments_shards_and_odd_vectors(spark, tmp_path):
    x = clustered(3000, 4)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 32), (9003, [1.0] * 3), (9004, [float("nan")] * 32)]
    index = GraphIndex(spark, str(tmp_path / "g"), 32, shard_rows=700)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index.add(df.where("vec_id < 2000"))
    index.add(df.where("vec_id >= 2000"))
    q = clustered(40, 5)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(99, None)], "query_id long, embedding array<float>")
    got = index.search(asked, 20, pack=16).collect()
    true = np.argsort(-(unit(q) @ unit(x).T), axis=1)[:, :20]
    found = {i: {r.id for r in got if r.query_id == i} for i in range(40)}
    assert np.mean([len(found[i] & set(true[i].tolist())) / 20 for i in range(40)]) >= 0.95
    assert {r.query_id for r in got} == set(range(40)) and all(len(v) == 20 for v in found.values())
    assert all(r.visited < 3000 for r in got) and max(r.id for r in got) < 3000
    few = GraphIndex(spark, str(tmp_path / "f"), 32)
    with pytest.raises(ValueError, match="no segment"):
        few.search(asked, 3)
    few.add(df.where("vec_id < 2"))
    assert few.search(asked.where("query_id = 0"), 5).count() == 2


def test_query_recall_on_the_given_vectors(spark, sf_dir):
    from pyspark.sql import functions as F

    got = {(r.query_id, r.id) for r in search.graph_topk(spark, sf_dir).collect()}
    want = {(r.query_id, r.id) for r in search._dense(spark, sf_dir).where(F.col("rank") <= 10).collect()}
    assert len(got & want) >= 0.95 * len(want)


def test_links_are_not_padded_to_the_widest():
    import tracemalloc

    x = unit(clustered(4000, 6))
    links = [np.array([j for j in (i - 1, i + 1) if 0 <= j < 2000], np.int32) for i in range(2000)]
    links += [np.arange(2001, 4000, dtype=np.int32)] + [np.array([2000], np.int32)] * 1999  # a hub that the search doesn't reach
    q = unit(clustered(100, 7))
    tracemalloc.start()
    places, scores, visited = best_first(x, links, np.array([0, 1000]), q, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8e6 and places.max() < 2000
    assert np.allclose(np.einsum("ad,abd->ab", q, x[places])[places >= 0], scores[places >= 0], atol=1e-5)
    assert best_first(x, [np.empty(0, np.int32)] * 4000, np.array([5]), q, 3)[0].max() == 5
