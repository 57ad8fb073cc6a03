import numpy as np
from pyspark.sql import functions as F

from quarry.llm.ann import multi_sequence, nearest


def brute(rows, k):
    good = [(i, np.array(v + [0.0] * (8 - len(v)), np.float32).astype(float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in good:
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_everything_probed_is_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(600)]
    rows += [(600 + i, rows[3][1]) for i in range(300)] + [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [None] * 8), (1080, [1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    expected = brute(rows, 20)
    got = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0, probe=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert got.keys() == expected.keys()
    for q, found in got.items():
        assert [i for i, _ in found] == [i for i, _ in expected[q]]
        assert np.allclose([s for _, s in found], [s for _, s in expected[q]], atol=1e-12)


def test_recall_with_the_usual_parameters(spark):
    x = np.random.default_rng(5).normal(size=(6000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    hits = 0
    got = {}
    for r in nearest(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -9
        hits += len(found & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.9 * 20 * 60


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (20, [1.0, 2.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 20, 5.0), (0, 2, 3, 1.5), (20, 1, 0, 5.0), (20, 2, 3, 1.5)]
    assert nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_cells_are_visited_by_summed_distance():
    rng = np.random.default_rng(0)
    a, b, counts = rng.random(9), rng.random(9), rng.integers(0, 5, (9, 9))
    order = sorted((a[i] + b[j], i, j) for i in range(9) for j in range(9))
    masks = multi_sequence(a, b, counts, 60)[:, 0]
    total, expected = 0, np.zeros(9, np.uint64)
    for _, i, j in order:
        if total >= 60:
            break
        total += counts[i, j]
        expected[i] |= np.uint64(1 << j)
    assert (masks == expected).all()


def test_doubles_keep_their_precision_and_single_numbers_have_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [1.05000000010]), (2, [1.05000000015]), (3, [-2.0])], "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id, r.score) for r in nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(1, 2, 1.05000000015), (2, 1, 1.0500000001), (3, 3, -2.0)]


def test_clustered_vectors_are_found_in_a_small_share(spark):
    from quarry.llm.ann import codebook, needed_share

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(300, 16))
    x = centres[rng.integers(0, 300, 9000)] + 0.1 * rng.normal(size=(9000, 16))
    books = (codebook(x[:, :8], 16, 1), codebook(x[:, 8:], 16, 2))
    assert needed_share(x, 8, books, 20, 0.95, 1) < 0.35
    y = rng.normal(size=(3000, 64))
    y /= np.linalg.norm(y, axis=1)[:, None]
    assert needed_share(y, 32, (codebook(y[:, :32], 16, 1), codebook(y[:, 32:], 16, 2)), 20, 0.95, 1) > 0.5
    # more than 64 codes: masks of two words
    a, b, counts = rng.random(100), rng.random(100), np.ones((100, 100), int)
    masks = multi_sequence(a, b, counts, 700)
    order = sorted((a[i] + b[j], i, j) for i in range(100) for j in range(100))[:700]
    assert masks.shape == (100, 2) and {(i, j) for _, i, j in order} == {(i, j) for i in range(100) for j in range(100) if int(masks[i, j // 64]) >> (j % 64) & 1}
