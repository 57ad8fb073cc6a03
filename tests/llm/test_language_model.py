import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm.language_model import ALPHA, BANDS, BEFORE, CLASSES, OWN_ID, SLOTS_OF, score, train


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def plain_scores(data, model):
    """Scores by plain loops over tokens: only the class softmax's table, topics and weights are taken from the model."""
    head = {w: i for i, w in enumerate(model["head"])}
    slot = lambda w: zlib.crc32(w.encode()) % SLOTS_OF if w is not None else 0

    def cls(w):
        if w is None:
            return CLASSES
        i = head.get(w.encode())
        return int(model["head_class"][i]) if i is not None else 3 + 3 * model["suffixes"].get(w.encode()[-3:], 0)

    counts, pairs, joint, ends = Counter(), (Counter(), Counter()), Counter(), 0
    for i, words in data:
        if not held(i):
            full = [None, None, *words]
            for at, w in enumerate(words, 2):
                counts[w] += 1
                pairs[0][w, slot(full[at - 1])] += 1
                pairs[1][w, slot(full[at - 2])] += 1
            for at in range(2, len(full) + 1):
                joint[cls(full[at]) if at < len(full) else 0, slot(full[at - 1]), slot(full[at - 2])] += 1
            ends += 1
    by_class = {}
    for w in counts:
        by_class.setdefault(cls(w), []).append(w)
    room = {c: sum(counts[w] for w in ws) + ALPHA * (len(ws) + 1) for c, ws in by_class.items()}
    share = {}
    for c in range(CLASSES):
        total = sum(n for k, n in joint.items() if k[0] == c) + SLOTS_OF
        for s in range(SLOTS_OF):
            share[0, c, s] = (sum(n for k, n in joint.items() if k[0] == c and k[1] == s) + 1) / total
            share[1, c, s] = (sum(n for k, n in joint.items() if k[0] == c and k[2] == s) + 1) / total

    def pull(w, c, s1, s2):
        weight = [model["weights"][k][sum(counts[w] >= b for b in BANDS) - 1] for k in (0, 1)]
        return sum(weight[k] * math.log((pairs[k][w, s] + 1) / (counts[w] * share[k, c, s] + 1)) for k, s in enumerate((s1, s2)))

    z = {}

    def log_z(c, s1, s2):
        if (c, s1, s2) not in z:
            z[c, s1, s2] = math.log10(sum((counts[w] + ALPHA) / room[c] * math.exp(pull(w, c, s1, s2)) for w in by_class.get(c, ())) + (ALPHA / room[c] if c in room else 1))
        return z[c, s1, s2]

    for i, words in data:
        full, total = [None, None, *words], 0.0
        for at in range(2, len(full) + 1):
            w, one, two = full[at] if at < len(full) else None, full[at - 1], full[at - 2]
            c = cls(w) if w is not None else 0
            before = BEFORE - 1 if one is None else head[one.encode()] if head.get(one.encode(), OWN_ID) < OWN_ID else OWN_ID + cls(one)
            total += float(model["table"][before * (CLASSES + 1) + cls(two), c])
            if w is None:
                total += math.log10((ends + ALPHA) / (ends + 2 * ALPHA))
            else:
                s1, s2 = slot(one), slot(two)
                known = pull(w, c, s1, s2) / math.log(10) if counts[w] else 0
                total += math.log10((counts[w] + ALPHA) / room.get(c, ALPHA)) + known - log_z(c, s1, s2)
        yield i, round(total, 3)


@pytest.mark.parametrize("head", [100_000, 40])
def test_counts_base_and_score_match_plain_loops(spark, sf_dir, head):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("length(text) < 3000").limit(60)
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "A\x0ba B é"), (-3, "A\x0ba B é"), (None, "only here"), (-9, "unseen words all")], "doc_id long, text string")
    rows = docs.unionByName(extra).cache()
    data = [(r.doc_id, tokens(r.text)) for r in rows.collect()]
    counts, ends = Counter(), 0
    for i, words in data:
        if not held(i):
            counts.update(words)
            ends += 1
    total, types = sum(counts.values()) + ends, len(counts) + 1
    model = train(rows, head=head)
    assert model["n_tokens"] == total and model["n_types"] == types
    floor = math.log10(total + 0.1 * (types + 1))
    expected = Counter()
    for i, words in data:
        cs = [counts[w] for w in words] + [ends]
        expected[i, len(cs), sum(c > 0 for c in cs), round(sum(math.log10(c + 0.1) - floor for c in cs), 5)] += 1
    got = score(rows, model).collect()
    assert Counter((r.id, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == expected
    found, want = (sorted(((-5 if i is None else i), x) for i, x in pairs) for pairs in (((r.id, r.score) for r in got), plain_scores(data, model)))
    for (i, x), (j, y) in zip(found, want):
        assert i == j and abs(x - y) < 2e-3 * max(1, abs(y) / 100)


def test_held_out_text_and_copies(spark, sf_dir):
    """Better than the base on text that was not learnt from; updates help; a text that was seen scores above one that was not."""
    import random

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rng = random.Random(5)
    made = [" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60)) for _ in range(40)]
    ids = [i for i in range(10_000, 20_000) if held(i)][:40]
    others = [i for i in range(30_000, 40_000) if not held(i)][:20]
    seen = spark.createDataFrame([*zip(ids, made), *zip(others, made[:20])], "doc_id long, text string")
    rows = docs.unionByName(seen)
    model = train(rows)
    got = {r.id: r for r in score(rows, model).collect()}
    out = [r for i, r in got.items() if held(i) and i < 10_000]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    for likes in (model["likelihoods"], model["slot_likelihoods"]):
        assert max(likes) > likes[0]
    gain = [(got[i].score - got[i].base_score) / got[i].n_tokens for i in ids]
    assert min(gain[:20]) > max(gain[20:])


def test_probabilities_sum_to_one(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(rows, head=500)
    table = 10 ** model["table"].astype(float)
    assert table.shape[1] == CLASSES and np.allclose(table.sum(axis=1), 1, atol=1e-3)
    room = model["class_tokens"] + 0.1 * (model["class_types"] + 1)
    # each class: its words' shares and one unknown word's make one
    assert np.allclose((model["class_tokens"] + 0.1 * model["class_types"] + 0.1) / room, 1)
    assert model["class_tokens"].sum() == model["n_tokens"] and model["class_types"].sum() == model["n_types"]
    assert (model["joint"].sum(axis=(1, 2)) == model["class_tokens"]).all() and np.isfinite(model["rooms"]).all()


def test_without_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    model = train(df)
    assert score(df, model).count() == 0
    one = score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).first()
    assert one.n_tokens == 3 and one.n_known == 0 and abs(one.base_score) < 1e-9
