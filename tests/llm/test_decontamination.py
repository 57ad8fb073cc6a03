import random
import re
from collections import Counter

from quarry.llm.decontamination import decontaminate, leaks, window_starts


def shingles(words):
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def similarity(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def tokens(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def brute(docs, items):
    out = {}
    for i, text in docs:
        words = tokens(text)
        for k, item in items:
            iw = tokens(item)
            if not words or not iw:
                continue
            if len(iw) < 5 and words != iw:  # too short to look for inside a text
                continue
            goal = shingles(iw)
            best = max(similarity(shingles(words[s : s + len(iw)]), goal) for s in range(max(1, len(words) - len(iw) + 1)))
            if best >= 0.8:
                out[i, k] = max(best, out.get((i, k), 0))
    return out


def test_leaks_match_all_windows(spark):
    rng = random.Random(4)
    vocab = ["w%d" % i for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([3, 20, 35, 59]))) for i in range(25)] + [(99, ""), (98, None), (97, "same same same same same same same")]
    docs = []
    for i in range(120):
        body = text(rng.choice([0, 2, 30, 300]))
        if i % 3 == 0:
            passage = items[rng.randrange(25)][1].split()
            kind = rng.randrange(4)
            if kind == 1:
                passage = [w.upper() + "," for w in passage]
            elif kind == 2:
                passage[0] = "other"
            elif kind == 3:
                passage = passage[: len(passage) // 2]
            body = " ".join([body, *passage, text(5)])
        docs.append((i, body))
    docs += [(200, items[3][1]), (200, items[3][1]), (201, None), (202, ""), (203, "same " * 9)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, size string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = brute(docs, items)
    assert len(expected) > 20
    for limit in (1_000_000, 0):
        got = {(r.id, r.item_id): r.similarity for r in leaks(frame, bench, broadcast_shingles=limit).collect()}
        assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)
    kept = decontaminate(frame, bench)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in expected}


def test_rows_without_an_id_are_told_apart(spark):
    frame = spark.createDataFrame([(None, "a b c d e f"), (None, "clean words stand in this one"), (7, "A, B c d e f!"), (7, "other text of the same id here")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert sorted(r.text for r in decontaminate(frame, bench).collect()) == ["clean words stand in this one", "other text of the same id here"]


def test_without_rows(spark):
    frame = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert leaks(frame.limit(0), bench).count() == 0
    assert leaks(frame, bench.limit(0)).count() == 0
    assert leaks(frame, bench).count() == 1


def test_recall_by_band_against_every_start(spark):
    """Passages with substituted, inserted and removed words; all starts of all windows are tried on the other side."""
    rng = random.Random(11)
    vocab = ["w%d" % i for i in range(600)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([25, 60, 120])))) for i in range(30)]
    docs, expected = [], {}
    for i in range(600):
        item = items[rng.randrange(30)]
        words = item[1].split()
        for _ in range(rng.randint(0, 1 + len(words) // 30)):
            at, kind = rng.randrange(len(words)), rng.randrange(3)
            if kind == 0:
                words[at] = "new"
            elif kind == 1:
                words.insert(at, "new")
            else:
                del words[at]
        around = [rng.choice(vocab) for _ in range(20)]
        docs.append((i, " ".join(around[:10] + words + around[10:])))
        expected |= brute(docs[-1:], [item])
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.id, r.item_id): r.similarity for r in leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1.01)):
        band = [k for k, v in expected.items() if low <= v < high]
        found = [k for k in band if k in got]
        assert len(band) >= 8 and len(found) >= 0.98 * len(band)
    assert got.keys() <= expected.keys()


def test_candidates_grow_with_the_windows_and_not_with_the_items(spark):
    """Twice the documents and items: twice the windows, and no more pairs than windows."""
    rng = random.Random(2)

    def windows(n):
        items = [(i, " ".join(f"i{i}w{rng.randrange(999)}" for _ in range(20))) for i in range(n)]
        docs = [(i, "before " + items[i % n][1] + " common words that all of them have here") for i in range(3 * n)]
        hits = [(1, 9, i, 20, o) for i, _ in items for o in (5, 7, 40)]
        laid = window_starts(spark.createDataFrame(hits, "hash long, n int, ik long, size int, offset int")).count()
        found = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
        assert found.count() == 3 * n
        return laid

    one, two = windows(20), windows(40)
    assert two == 2 * one
