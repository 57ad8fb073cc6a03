import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import periodic_runs
from quarry.llm.periodic_runs import WORD, collapse, least_overlap, op13_periodic_runs, runs_of, surviving_segments, word_ids


def brute(words, least=12):
    """Every stretch of every period, the smallest period of equal stretches."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q):
                best.setdefault((i, length), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in best.items())


def dropped(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=7), st.integers(1, 9)), max_size=12), st.sampled_from([4, 5, 12]))
def test_runs_of_small_alphabets_are_those_of_brute_force(parts, least):
    words = [c for word, times in parts for c in word * times]
    got = [tuple(r) for r in runs_of(words, least).tolist()]
    assert sorted(got) == brute(words, least) and got == sorted(got, key=lambda r: (r[0], r[2]))
    assert collapse(words, runs_of(words, least)) == dropped(words, got)


def test_long_and_planted_texts():
    rng = random.Random(3)
    for n in (40, 700, 3000):
        words = [f"w{int(rng.expovariate(0.05))}" for _ in range(n)]
        at, p = rng.randrange(n // 2), 1 + n // 9
        words = [w if i < at else words[at + (i - at) % p] for i, w in enumerate(words)]
        words[5:5] = ["x"] * 30
        assert [tuple(r) for r in runs_of(words).tolist()] == brute(words)
    alike = ["a"] * 200_000
    assert runs_of(alike).tolist() == [[0, 200_000, 1]] and collapse(alike, runs_of(alike)) == "a"
    fibonacci = "b", "a"
    while len(fibonacci[1]) < 900:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    assert [tuple(r) for r in runs_of(list(fibonacci[1])).tolist()] == brute(list(fibonacci[1]))


def test_masking_keeps_words_of_repeated_grams_only():
    assert [least_overlap(x) for x in (12, 11, 4)] == [6, 6, 2]
    words = [f"u{i}" for i in range(500)] + ["p", "q", "r", "s"] * 5 + [f"v{i}" for i in range(500)]
    assert surviving_segments(word_ids(words), 12) == [(500, 520)]
    assert not surviving_segments(np.arange(1000), 12)


def test_rows_of_every_kind(spark):
    text = "one two three four " * 4
    rows = [(1, text, 1), (1, text, 2), (2, None, 0), (3, "", 0), (None, "a " * 12, 0), (4, "a " * 11, 0), (5, "  \t\n", 0), (6, "é x " * 13, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = sorted((r.id is None, r.id or 0, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(df).collect())
    assert got == [
        (False, 1, [(0, 16, 4)], "one two three four"), (False, 1, [(0, 16, 4)], "one two three four"), (False, 2, [], ""), (False, 3, [], ""),
        (False, 4, [], " ".join("a" * 11)), (False, 5, [], ""), (False, 6, [(0, 13, 1)], "é x"), (True, 0, [(0, 12, 1)], "a"),
    ]
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    got = {r.doc_id: r for r in op13_periodic_runs(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    planted = 0
    for d in docs:
        words = WORD.findall(d.text or "")
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        r = got[d.doc_id]
        if n > 4000:  # too long for the plain version
            continue
        runs = brute(words)
        planted += h % 10 == 0 and bool(runs)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in sorted(runs, key=lambda x: (x[0], x[2]))).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(dropped(words, runs).encode()).hexdigest()
    assert planted > 5
