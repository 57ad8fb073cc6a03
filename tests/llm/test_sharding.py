from collections import Counter, defaultdict
import zlib

from quarry.llm.sharding import shard_rows


def test_shards_slots_and_growth(spark):
    rows = [(i, f"text {i % 50}", 1) for i in range(3000)] + [(7, "text 7", 2)] * 900 + [(8, None, 0), (None, "", 0), (None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = shard_rows(df).collect()
    assert len(got) == len(rows)
    assert Counter((r.id, r.size, r.text_crc32) for r in got) == Counter((i, len(t or "") + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert set(slots) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    per_key = {(r.id, r.shard, r.grown_shard) for r in got}
    assert len(per_key) == 3001
    moved = sum(r.grown_shard == 8 for r in got if r.id != 7)
    assert 3000 / 9 * 0.7 < moved < 3000 / 9 * 1.3


def test_weights_and_tables_without_rows(spark):
    df = spark.createDataFrame([(i, "x") for i in range(6000)], "doc_id long, text string")
    n = Counter(r.shard for r in shard_rows(df, weights=[1.0, 3.0]).collect())
    assert 2.6 < n[1] / n[0] < 3.4
    assert shard_rows(df.limit(0)).count() == 0


def test_one_id_with_many_texts(spark):
    rows = [(5, f"text {i}", i) for i in range(5000)] + [(5, "x" * 200_000, 0)]
    got = shard_rows(spark.createDataFrame(rows, "doc_id long, text string, slot int")).collect()
    assert len({r.shard for r in got}) == 1 and sorted(r.slot for r in got) == list(range(5001))
    assert sorted(r.size for r in got)[-1] == 200_001
