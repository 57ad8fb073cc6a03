import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import language_id
from quarry.llm.language_id import DIMS, FILTERS, WIDEST, WINDOW, Network, gradient, held_out, identify, learn, op11_language_id, sample, softmax_log, train


def some_weights(classes=3, seed=0):
    return train(np.frombuffer(random.Random(seed).randbytes(20 * WINDOW), np.uint8).reshape(-1, WINDOW), np.arange(20) % classes, classes, updates=2, seed=seed)


def plain(weights, text):
    """One window after the other, one filter after the other."""
    widths = [w for w, many in FILTERS.items() for _ in range(many)]
    many = -(-(len(text) + WIDEST - 1) // WINDOW)
    raw = text + bytes(many * WINDOW + WIDEST - len(text))
    total, size = 0.0, 0
    for k in range(many):
        pooled = []
        for f, width in enumerate(widths):
            values = [sum(weights["bytes"][raw[i + o]] @ weights["filters"][o * DIMS : (o + 1) * DIMS, f] for o in range(width)) for i in range(k * WINDOW, (k + 1) * WINDOW)]
            pooled.append(max(0.0, max(values) + weights["floor"][f]))
        here = WINDOW if k < many - 1 else max(1, len(text) - k * WINDOW)
        total = total + here * softmax_log((np.array(pooled) @ weights["out"] + weights["base"])[None])[0]
        size += here
    return np.exp(softmax_log((total / size)[None])[0])


def test_tables_equal_the_plain_network():
    weights = some_weights()
    texts = [b"", b"a", b"some words " * 40, bytes(range(256)) * 3, b"x" * (WINDOW - 1), b"y" * WINDOW, b"zu " * 70]
    got = Network(weights).texts(texts)
    for t, p in zip(texts, got):
        assert np.allclose(p, plain(weights, t), atol=1e-4)
    assert np.allclose(Network(weights).texts(texts * 30)[-len(texts) :], got, atol=1e-5)


def test_slopes_are_those_of_small_steps():
    weights = {k: v.astype(np.float64) for k, v in some_weights().items()}
    rng = np.random.default_rng(1)
    windows, labels = rng.integers(1, 256, (6, WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])

    def loss():
        net = Network(weights)
        return -softmax_log(np.log(net.texts([bytes(w[: WINDOW - WIDEST + 1]) for w in windows])))[np.arange(6), labels].mean()

    short = windows.copy()
    short[:, WINDOW - WIDEST + 1 :] = 0
    slopes = gradient(weights, short, labels)
    widths = np.repeat(list(FILTERS), list(FILTERS.values()))
    for name, at in [("floor", (3,)), ("out", (5, 1)), ("base", (2,)), ("filters", (DIMS - 1, 9)), ("filters", (1, 20)), ("bytes", (int(short[0, 9]), 2))]:
        assert name != "filters" or at[0] < widths[at[1]] * DIMS
        old, step = weights[name][at], 1e-4
        values = []
        for move in (step, -step):
            weights[name][at] = old + move
            values.append(loss())
        weights[name][at] = old
        assert slopes[name][at] == pytest.approx((values[0] - values[1]) / (2 * step), rel=0.05, abs=2e-3)


def test_held_out_accuracy_on_the_given_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r.doc_id: r for r in docs.collect()}
    got = op11_language_id(spark, sf_dir).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    tested = [r for r in got if r.held_out]
    assert len(tested) > 30 and sum(r.lang_pred == truth[r.doc_id].lang for r in tested) / len(tested) >= 0.97


def test_rows_of_every_kind(spark):
    rng = random.Random(2)
    word = {"aa": lambda: "".join(rng.choice("bcdaei") for _ in range(5)), "bb": lambda: "".join(rng.choice("xyzouw") for _ in range(5)), "ру": lambda: "".join(rng.choice("абвгде") for _ in range(5))}
    rows = [(i, " ".join(w() for _ in range(rng.choice([3, 30, 300]))), lang, 0.5) for i, (lang, w) in enumerate(list(word.items()) * 100)]
    copies = [(5000 + i, "a copied text of one language bcd", "aa", 0.0) for i in range(400)] + [(None, "bcd ade", "aa", 0.0)] * 50
    odd = [(9001, None, "aa", 0.0), (9002, "", "aa", 0.0), (9003, "12 --- ;", "bb", 0.0), (9004, "ДЕБГА ВГДЕА БВГДА", None, 0.0), (9005, " ".join(word["bb"]() for _ in range(60_000)), None, 0.0), (None, "XYZOU WUXYO", None, 0.0)]
    docs = spark.createDataFrame(rows + copies + odd, "doc_id long, text string, lang string, score double").repartition(5)
    chosen = sample(docs, "doc_id", "text", "lang", 40, 2).collect()
    assert {r.lang for r in chosen} <= {"aa", "bb", "ру"} and len({r.lang for r in chosen}) == 2 and len(chosen) == len({(r.lang, r.key) for r in chosen}) == 80
    got = identify(docs, learn(docs)).collect()
    assert len(got) == docs.count()
    of = {r.id: r for r in got}
    assert [of[i].lang_pred for i in (9001, 9002, 9003, 9004, 9005)] == ["und", "und", "und", "ру", "bb"]
    assert of[9003].score == 0 and {r.lang_pred for r in got if r.id is None} == {"aa", "bb"}
    assert sum(of[i].lang_pred == lang for i, _, lang, _ in rows) >= 295
    assert docs.where(held_out(F.col("doc_id"))).where("doc_id IS NULL").count() == 0


def test_without_rows_or_labels(spark):
    docs = spark.createDataFrame([(1, "a text", None)], "doc_id long, text string, lang string")
    model = learn(docs)
    assert [tuple(r) for r in identify(docs, model).collect()] == [(1, "und", 0.0)]
    assert identify(docs.limit(0), learn(docs.limit(0))).count() == 0
    one = learn(spark.createDataFrame([(i, "text", "xx") for i in range(4)], "doc_id long, text string, lang string"))
    assert [tuple(r) for r in identify(docs, one).collect()] == [(1, "xx", 1.0)]
    assert language_id.UNKNOWN == "und"
