import random

import pytest

import corpus_pipeline
from quarry.llm.shingle_dedup import prefix_length, similar_groups


def plain_set(text):
    words = (text or "").lower().split()
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def plain_kept(texts):
    """Smallest id of each component of all pairs with a similarity of 0.8 or more."""
    left, kept = sorted(texts), set()
    sets = {i: plain_set(t) for i, t in texts.items()}
    while left:
        todo = [left.pop(0)]
        kept.add(todo[0])
        while todo:
            a = sets[todo.pop()]
            near = [i for i in left if len(a & sets[i]) >= 0.8 * len(a | sets[i])]
            left = [i for i in left if i not in set(near)]
            todo += near
    return kept


@pytest.mark.parametrize(("max_list", "hubs"), [(32, 1), (8, 2), (2, 1), (1, 2)])
def test_groups_match_brute_force(spark, max_list, hubs):
    rng, texts = random.Random(5), ["", None, " \n", "one two", "One  two", "one two three"]
    vocab = ["w%d" % i for i in range(500)]
    for n in (8, 40, 120, 300):
        for _ in range(12):
            base = [rng.choice(vocab) for _ in range(n)]
            texts.append(" ".join(base))
            for _ in range(rng.choice([1, 4])):
                for _ in range(rng.randint(1, max(1, n // 25))):
                    base[rng.randrange(n)] = rng.choice(vocab)  # copies of copies: chains
                texts.append(" ".join(base))
    base = [rng.choice(vocab) for _ in range(150)]
    for _ in range(60):  # one large group, its members less alike than each is to the first
        copy = list(base)
        for i in rng.sample(range(150), 3):
            copy[i] = rng.choice(vocab)
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    rows = dict(enumerate(texts))
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    found = similar_groups(df, max_list=max_list, hubs=hubs).collect()
    assert len(found) == len(rows) and {r.id for r in found if r.keep} == plain_kept(rows)


def test_stage_drops_every_pair_at_eight_tenths(spark):
    # with 4 bits of a SimHash distance this pair stayed
    docs = corpus_pipeline.table(spark, "/root/testdata/sf0.001", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "/root/testdata/sf0.001").collect()}
    a, b = plain_set(texts[1]), plain_set(texts[177])
    assert len(a & b) >= 0.8 * len(a | b) and kept == plain_kept(texts) and 177 not in kept


def test_prefixes_of_alike_sets_meet():
    for n in range(1, 200):
        for m in range(n, int(n / 0.8) + 2):
            for both in range(1, n + 1):
                if both >= 0.8 * (n + m - both):
                    # even if all that is not shared comes first, a shared one is in both prefixes
                    assert n - both < prefix_length(n, 0.8) and m - both < prefix_length(m, 0.8)


def test_a_family_of_copies_makes_few_pairs(spark):
    from quarry.llm import shingle_dedup as S

    rng = random.Random(9)
    base = ["b%d" % i for i in range(150)]
    texts = [" ".join(base)]
    for _ in range(1200):
        copy = list(base)
        for i in rng.sample(range(150), rng.choice([1, 2, 4, 6, 8])):
            copy[i] = "e%d" % rng.randrange(10**6)
        texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = []
    similar, apart = S._similar, S._apart
    try:
        S._similar = lambda pairs, *a: (made.append(pairs.count()), similar(pairs, *a))[1]
        found = similar_groups(df).collect()
    finally:
        S._similar, S._apart = similar, apart
    assert {r.id for r in found if r.keep} == plain_kept(dict(enumerate(texts)))
    assert sum(made) < 25 * len(texts)  # all pairs are 600 a text


def test_the_simhash_index_finds_candidates_and_similarity_decides(spark, monkeypatch):
    import numpy as np

    from quarry.llm import shingle_dedup as S
    from quarry.llm import simhash_dedup

    # no two texts share a min-hash key here: what is found is found by the index of fingerprints
    rng = np.random.default_rng(3)
    monkeypatch.setattr(S, "band_keys", lambda hashes: rng.integers(-(2**63), 2**63, S.BANDS))
    base = [f"b{i}" for i in range(300)]
    texts = [" ".join(base), " ".join(base[:-1] + ["end"]), " ".join([*base, *base[:40]]), "a b c d e f", "other words stand here now"]
    asked, index = [], simhash_dedup.fingerprint_links
    monkeypatch.setattr(simhash_dedup, "fingerprint_links", lambda fps, radius: (asked.append(radius), index(fps, radius))[1])
    found = similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), radius=6).collect()
    a, b = (simhash_dedup.fingerprint_of(S.shingle_hashes(texts[i].encode())) for i in (0, 1))
    assert asked == [6] and (a ^ b).bit_count() <= 6
    assert {r.id for r in found if r.keep} == plain_kept(dict(enumerate(texts))) and 1 not in {r.id for r in found if r.keep}
