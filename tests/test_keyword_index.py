import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.operators import keyword_index as K
from quarry.operators.ranking import B, K1

def plain_scores(docs: list[tuple[int, list[str]]], groups: list[list[str]]) -> dict[int, float]:
    """BM25 by the definition, for small lists: each group counts by its best form."""
    n, average = len(docs), sum(len(t) for _, t in docs) / max(1, len(docs))
    df = {t: sum(t in set(ts) for _, ts in docs) for g in groups for t in g}
    out = {}
    for id_, ts in docs:
        norm = K1 * (1 - B + B * len(ts) / (average or 1.0))
        score = sum(max((math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * ts.count(t) * (K1 + 1) / (ts.count(t) + norm) for t in g if t in ts), default=0.0) for g in groups)
        if score > 0:
            out[id_] = score
    return out


def top(scores, k):
    return sorted(((round(s, 9), i) for i, s in scores.items()), key=lambda x: (-x[0], x[1]))[:k]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_words_and_their_forms(spark):
    got = one(spark, K.word_groups(F.lit('בהיוועדות של כ"ב 116 יז 12(ג) ו־1,200.5 Law')))
    assert [set(g) for g in got] == [{"בהיוועדות", "היוועדות", "יוועדות"}, {"כב"}, {"116יז12"}, {"ג"}, {"ו"}, {"1,200.5"}, {"law"}]
    assert {"היוועדות", "יוועדות"} <= set(one(spark, K.index_terms(F.lit("בהיוועדות"))))
    assert one(spark, K.query_groups(F.lit("כ״ב כב"))) == [["כב"]]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    vocab = ["thing", "rething", "thearly", "early", "dealt", "unalt"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    docs = [(i, " ".join(rng.choice(vocab[: 6 + int(rng.expovariate(0.02)) % 300]) for _ in range(rng.choice([0, 5, 40, 200])))) for i in range(1500)]
    return docs, [(n, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 8])))) for n in range(25)] + [(99, ""), (98, "nowhere"), (97, "thing thing rething")]


@pytest.mark.parametrize("shard", [65_536, 100])
def test_stored_index_equals_the_definition(spark, tmp_path, monkeypatch, corpus, shard):
    monkeypatch.setattr(K, "SHARD", shard)
    monkeypatch.setattr(K, "BLOCK", 16)
    docs, queries = corpus
    options = {"prefixes": ("re", "the", "un"), "stop": ("dealt",)}
    index = K.KeywordIndex(spark, str(tmp_path / "k"), lambda t: K.index_terms(t, **options), lambda t: K.query_groups(t, **options), 4)
    df = spark.createDataFrame(docs, "id long, text string")
    for part in range(3):
        index.add(df.where(F.col("id") % 3 == part), "id", "text")
    index.add(df, "id", "text")  # all known: an empty segment
    assert [s["n"] for s in index.segments()] == [500, 500, 500, 0]
    asked = spark.createDataFrame(queries, "q long, text string")
    groups = {r.q: r.g for r in asked.select("q", K.query_groups(F.col("text"), **options).alias("g")).collect()}
    terms = [(r.id, r.t) for r in df.select("id", K.index_terms(F.col("text"), **options).alias("t")).collect()]
    got = {}
    for r in index.search(asked, "q", "text", 10).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((round(r.score, 9), r.id))
    for q, g in groups.items():
        want = top(plain_scores(terms, g), 10)
        assert [i for _, i in got.get(q, [])] == [i for _, i in want] and all(math.isclose(a[0], b[0], abs_tol=1e-8) for a, b in zip(got.get(q, []), want))
    assert index.postings_read(asked, "q", "text", 10) < index.postings_read(asked, "q", "text", 10, full=True)


def test_blocks_that_cannot_matter_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 32)
    rng = random.Random(8)
    docs = [(i, " ".join(["common"] * rng.choice([1, 1, 1, 2, 6]) + [f"only{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}"] + ["fill"] * rng.choice([5, 30, 90]))) for i in range(4000)]
    index = K.KeywordIndex(spark, str(tmp_path / "k"), K.index_terms, K.query_groups, 4)
    index.add(spark.createDataFrame(docs, "id long, text string"), "id", "text")
    asked = spark.createDataFrame([(1, "common"), (2, "common onlyab"), (3, "fill common")], "q long, text string")
    few, every = (sorted((r.query_id, r.rank, r.id, round(r.score, 9)) for r in index.search(asked, "q", "text", 5, full=f).collect()) for f in (False, True))
    assert few == every and len(few) == 15
    alone = asked.where("q = 1")
    assert index.postings_read(alone, "q", "text", 5) < 0.1 * index.postings_read(alone, "q", "text", 5, full=True)
    assert index.postings_read(asked, "q", "text", 5) < 0.8 * index.postings_read(asked, "q", "text", 5, full=True)


def test_an_index_without_segments(spark, tmp_path):
    index = K.KeywordIndex(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="no segment"):
        index.search(spark.createDataFrame([(1, "a")], "q long, text string"), "q", "text", 3)


def test_counts_of_few_words_at_a_time_and_repeated_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "SHARD", 40)
    monkeypatch.setattr(K, "BLOCK", 8)
    monkeypatch.setattr(K, "TOKENS", 50)
    docs = [(i, " ".join(["common"] * (1 + i % 5) + [f"w{chr(97 + i % 26)}"] * (i % 3))) for i in range(200)] + [(500, None), (501, ""), (502, "rare rare"), (503, "word " * 200 + "rare")]
    index = K.KeywordIndex(spark, str(tmp_path / "k"), K.T.index_terms, K.one_form_groups, 4)
    assert index.add(spark.createDataFrame([*docs, (502, "rare")], "id long, text string"), "id", "text")["n"] == 204
    asked = spark.createDataFrame([(1, "common wc"), (2, "rare")], "q long, text string")
    got = sorted((r.query_id, r.rank, r.id, round(r.score, 6)) for r in index.search(asked, "q", "text", 6).collect())
    assert [i for q, _, i, _ in got if q == 2] == [502, 503]
    # the documents' postings are all there, each in one block, and no row carries the list that blocks are cut from
    blocks = spark.read.schema(K.POSTINGS).parquet(index.segments()[0]["path"] + "/postings").where("term = 'common'").collect()
    assert sorted(p.id for b in blocks for p in b.postings) == list(range(200)) and {b.df for b in blocks} == {200} and max(len(b.postings) for b in blocks) == 8
    assert len({b.shard for b in blocks}) == 5 and all(b.n == len(b.postings) and b.most == max(p.tf for p in b.postings) for b in blocks)


def test_a_search_shuffles_no_row_for_each_query_and_word(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "PACK", 7)
    docs = [(i, f"copy of many {'more' * (i % 2)}") for i in range(300)] + [(900 + i, f"w{chr(97 + i % 26)} other") for i in range(60)] + [(None, "nameless")]
    index = K.KeywordIndex(spark, str(tmp_path / "k"), K.T.index_terms, K.one_form_groups, 4)
    index.add(spark.createDataFrame(docs, "id long, text string"), "id", "text")
    asked = spark.createDataFrame([(q, "copy of many" if q % 2 else "nameless other wc") for q in range(20)] + [(30, "absent")], "q long, text string")
    found = index.search(asked, "q", "text", 4)
    assert not re.search(r"Exchange hashpartitioning\(query_id#\d+L?, id#", found._jdf.queryExecution().executedPlan().toString())
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    # of equal scores the smallest ids, from whatever task; queries of several packs
    assert got == {q: [0, 2, 4, 6] if q % 2 else [None, 902, 928, 954] for q in range(20)}
