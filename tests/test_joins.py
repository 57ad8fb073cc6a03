import numpy as np
import pytest

from quarry.operators import joins, retrieval


@pytest.mark.parametrize("block", [512, 7])
def test_similar_pairs_by_blocks(spark, block):
    rng = np.random.default_rng(3)
    rows = [(k, f"c{i}", rng.normal(size=4).tolist()) for k in ("a", "b") for i in range(60 if k == "a" else 3)] + [("a", "null", None), ("z", "alone", [1.0] * 4)]
    got = joins.similar_pairs(spark.createDataFrame(rows, "k string, id string, v array<double>"), ["k"], "id", "v", 0.5, 2.0, block).collect()
    want = {(k, min(i, j), max(i, j)): float(np.dot(v, w)) for n, (k, i, v) in enumerate(rows) for k2, j, w in rows[n + 1 :] if k == k2 and v and w and 0.5 <= np.dot(v, w) <= 2.0}
    assert len(got) == len(want) and all(abs(want[r.k, r.a, r.b] - r.similarity) < 1e-9 for r in got)


def test_rows_of_one_id_are_no_similar_pair(spark):
    rows = [("k", 1, [1.0, 0.0]), ("k", 1, [0.6, 0.8]), ("k", 2, [0.6, 0.8]), ("k", None, [1.0, 0.0])]
    for block in (512, 1):
        got = joins.similar_pairs(spark.createDataFrame(rows, "k string, id long, v array<double>"), ["k"], "id", "v", 0.5, 2.0, block).collect()
        assert sorted((r.a, r.b, round(r.similarity, 6)) for r in got) == [(1, 2, 0.6), (1, 2, 1.0)]


@pytest.mark.parametrize("block", [512, 7])
def test_similar_pairs_do_not_depend_on_the_order_of_rows(spark, block):
    """Blocks are put together twice, as after a shuffle of several executors in different orders."""
    vectors = np.random.default_rng(5).normal(size=(60, 4))
    df = spark.createDataFrame([("k", i, v.tolist()) for i, v in enumerate(vectors)], "k string, id long, v array<double>").coalesce(1)
    mixed = df.mapInPandas(lambda parts: (p.sample(frac=1, random_state=np.random.default_rng()) for p in parts), df.schema)
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = joins.similar_pairs(mixed, ["k"], "id", "v", 0.5, 2.0, block).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if 0.5 <= vectors[i] @ vectors[j] <= 2.0}
    assert sorted((r.a, r.b) for r in got) == sorted(want)


def test_parts_merge_in_order(spark, tmp_path):
    for n in range(3):
        spark.range(n * 10, n * 10 + 10).coalesce(1).write.parquet(str(tmp_path / f"p{n}"))
    paths = [str(tmp_path / f"p{n}") for n in (2, 0, 1)]
    assert retrieval.merge_parts(spark, paths, str(tmp_path / "one")) == 30
    assert retrieval.merge_parts(spark, paths, str(tmp_path / "many"), file_rows=8) == 30
    for name, files in (("one", 1), ("many", 4)):
        found = sorted((tmp_path / name).glob("*.parquet"))
        ids = [r.id for f in found for r in spark.read.parquet(str(f)).collect()]
        assert ids == [*range(20, 30), *range(20)] and len(found) == files
