import random

import numpy as np
import pytest
import xxhash

from quarry.llm.simhash_dedup import components, fingerprint_bytes, fingerprint_links, near_duplicates


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps):
    """Union of all pairs within four bits: fingerprint -> smallest fingerprint of its component."""
    left, out = sorted(fps), {}
    while left:
        todo = [left.pop(0)]
        root = todo[0]
        while todo:
            a = todo.pop()
            out[a] = root
            near = [b for b in left if (a ^ b).bit_count() <= 4]
            left = [b for b in left if b not in set(near)]
            todo += near
    return out


@pytest.mark.parametrize("text", ["", " \n\t", "One two", "a b c d", "ÀB c D e F g", "x " * 500, "one\x0btwo three four five six seven"])
def test_fingerprint_matches_the_plain_definition(text):
    assert fingerprint_bytes(text.encode()) == plain_fingerprint(text)


def test_groups_match_all_pairs(spark):
    rng = random.Random(3)
    vocab = ["w%d" % i for i in range(300)]
    docs = []
    for _ in range(60):
        base = [rng.choice(vocab) for _ in range(rng.choice([2, 40, 200]))]
        docs.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 5])):
            changed = list(base)
            changed[rng.randrange(len(changed))] = "zz"
            docs.append(" ".join(changed))
    docs += ["", None, "   ", docs[0], docs[0]]
    rows = [(i, t, i) for i, t in enumerate(docs)] + [(0, docs[0], 5), (None, docs[1], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    roots = plain_groups({plain_fingerprint(t) for t in docs})
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            r = roots[plain_fingerprint(t)]
            smallest[r] = min(smallest.get(r, i), i)
    expected = sorted((-1 if i is None else i, plain_fingerprint(t), smallest[roots[plain_fingerprint(t)]]) for i, t, _ in rows)
    for max_list in (4096, 3):
        got = sorted((-1 if r.id is None else r.id, r.fp & (2**64 - 1), r.component) for r in near_duplicates(df, max_list=max_list).collect())
        assert got == expected


@pytest.mark.parametrize("max_list", [4096, 8])
def test_a_dense_group_is_one_component(spark, max_list):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**62), 2**62)
    fps = {int(base)}
    now = int(base)
    for _ in range(120):  # a chain of steps of up to four bits
        for bit in rng.choice(64, 4, replace=False):
            now ^= 1 << int(bit)
        now = int(np.array([now & (2**64 - 1)], np.uint64).view(np.int64)[0])
        fps.add(now)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = components(fingerprint_links(df, 4, max_list)).collect()
    assert {r.v for r in got} | {r.root for r in got} == fps and len({r.root for r in got}) == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).count() == 0
