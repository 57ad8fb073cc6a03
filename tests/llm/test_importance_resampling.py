import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from quarry.llm.importance_resampling import BETWEEN, ORACLE, chunks, grams_of, op12_importance_resampling, resample

WORD = re.compile(f"[^{BETWEEN}]+")


def grams(text, n):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + s]) for s in range(1, n + 1) for i in range(len(words) - s + 1)]


def plain(rows, target, n, buckets, percent, least):
    hashed = lambda text: [zlib.crc32(g.encode()) % buckets for g in grams(text, n)[1]]
    s, t = Counter(b for _, x in rows for b in hashed(x)), Counter(b for x in target for b in hashed(x))
    S, T = s.total() + buckets, t.total() + buckets
    out = []
    for i, text in rows:
        of = [math.floor(1000 * math.log((t[b] + 1) * S / ((s[b] + 1) * T))) for b in hashed(text)]
        weight = sum(of) // len(of) if of else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(of), grams(text, n)[0], weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    may = sorted((r for r in out if r[2] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[5] = k + 1
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)] + ["É", "straße", "٣x", "𝒳y"]
    text = lambda n: "".join(rng.choice(vocab).upper() + rng.choice([" ", "  ", ",\n", "; ", "/-"]) for _ in range(n))
    rows = [(i, text(rng.choice([0, 3, 19, 20, 21, 60]))) for i in range(300)]
    rows += [(400, text(5000)), (401, "x" * 3000 + " " + "y" * 2500 + " z"), (402, " " * 4000), (403, "one" + " " * 5000 + "two three"), (404, None), (405, "")]
    rows += [(500, text(30))] * 7 + [(None, text(40)), (None, text(40))] + [(None, "a b c " * 20)] * 3 + [(77, text(50)), (78, text(25))]
    return rows, [text(40) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize(("n", "chunk"), [(1, 100), (2, 64), (3, 37), (3, 1), (2, 65_536)])
def test_equals_the_plain_version_however_texts_are_cut(spark, n, chunk):
    rows, target = corpus()
    docs = spark.createDataFrame([(i, t, 9, "k") for i, t in rows], "doc_id long, text string, score int, key string").repartition(7)
    bench = spark.createDataFrame([(t, 0) for t in target], "text string, id int")
    got = [list(r) for r in resample(docs, bench, n=n, buckets=500, chunk_chars=chunk).collect()]
    assert sorted(got, key=key) == sorted(plain(rows, target, n, 500, 10, 20), key=key)
    ranks = sorted(r[5] for r in got if r[5] is not None)
    assert ranks == list(range(1, len(ranks) + 1)) and ranks


def test_chunks_carry_the_words_that_follow(spark):
    docs = spark.createDataFrame([(1, "aa bb cc dd ee ff gg")], "doc_id long, text string")
    got = [(r.owned, r.carried.split()) for r in chunks(docs, 3, 4).orderBy("chunk").collect()]
    assert [WORD.findall(o) for o, _ in got] == [["aa", "bb"], ["cc", "dd"], ["ee", "ff"], ["gg"]]
    assert [c[:2] for _, c in got] == [["cc", "dd"], ["ee", "ff"], ["gg"], []]
    assert sum(len(grams_of(o.encode(), " ".join(c).encode(), 3)[1]) for o, c in got) == 7 + 6 + 5


def test_draws_what_is_like_the_target(spark):
    rng = random.Random(1)
    kinds = {"law": ["court", "judge", "appeal", "claim"], "cook": ["bake", "salt", "oven", "dough"]}
    rows = [(i, " ".join(rng.choice(kinds["law" if i % 2 else "cook"]) for _ in range(40))) for i in range(2000)]
    target = [(" ".join(rng.choice(kinds["law"]) for _ in range(40)),) for _ in range(300)]
    got = resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(target, "text string")).where("rank IS NOT NULL").collect()
    assert len(got) == 200 and sum(r.id % 2 for r in got) >= 190


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert resample(docs.limit(0), docs).count() == 0
    assert [r["rank"] for r in resample(docs, docs.limit(0)).collect()] == [None]


def test_query_against_sql_and_plain_version(spark, sf_dir):
    import duckdb

    got = sorted(map(tuple, op12_importance_resampling(spark, sf_dir).collect()), key=key)
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    assert got == sorted(db.sql(ORACLE).fetchall(), key=key)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    bench = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert got == sorted(((r[0], r[1], *r[3:]) for r in plain(docs, bench, 1, 10_000, 10, 20)), key=key)
