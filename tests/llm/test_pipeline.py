import numpy as np
from test_decontamination import brute

import corpus_pipeline
from quarry.llm import toxicity


def plain_groups(texts, least=0.8):
    """id -> smallest id of those reachable by links of five-word shingles that are 0.8 alike, over all pairs."""
    sets = {}
    for i, t in texts.items():
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            words = words.replace(c, " ")
        words = [w for w in words.split(" ") if w]
        sets[i] = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))
    by_set = {}
    for i in sorted(sets):
        by_set.setdefault(sets[i], []).append(i)
    left, root = sorted(by_set, key=lambda s: by_set[s][0]), {}
    while left:
        todo, left = [left[0]], left[1:]
        first = by_set[todo[0]][0]
        while todo:
            a = todo.pop()
            root |= dict.fromkeys(by_set[a], first)
            near = [b for b in left if len(a & b) >= least * len(a | b)]
            left = [b for b in left if b not in set(near)]
            todo += near
    return root


def test_stages_match_plain_versions(spark, sf_dir):
    docs = corpus_pipeline.table(spark, sf_dir, "documents")
    labels = corpus_pipeline.table(spark, sf_dir, "labels")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.learn(docs, labels)
    lexicon = toxicity.Lexicon(model["terms"], model["stems"], set(model["known"]))
    score = {i: 1 / (1 + np.exp(-np.dot(toxicity.features(*lexicon.hits(t)), model["weights"]))) for i, t in texts.items()}
    clean = {i: t for i, t in texts.items() if score[i] < 0.7}
    one = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == set(clean)
    single = {i: clean[i] for i in set(plain_groups(clean).values())}
    two = corpus_pipeline.drop_near_duplicates(spark, one, sf_dir)
    assert two.columns == docs.columns and sorted(r.doc_id for r in two.collect()) == sorted(single)
    items = [(r.item_id, r.text) for r in corpus_pipeline.table(spark, sf_dir, "benchmark").collect()]
    leaked = {i for i, _ in brute(list(single.items()), items)}
    three = corpus_pipeline.drop_benchmark_leaks(spark, two, sf_dir)
    assert three.columns == docs.columns and {r.doc_id for r in three.collect()} == set(single) - leaked
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(single) - leaked


def test_repeated_and_null_rows(spark, sf_dir):
    rows = [(1, "a b c d e f g", "en", "s", 1)] * 3 + [(2, "a b c d e f g", None, None, None), (None, "a b c d e f g", "en", "s", 1), (None, "other words stand here", "en", "s", 1), (None, "other words stand here", "en", "s", 1), (4, None, "en", "s", 0), (5, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect())
    assert kept == [(-1, "other words stand here"), (1, "a b c d e f g"), (4, None)]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_clashing_columns_and_long_texts_stay(spark, sf_dir):
    # names that the operators use inside, as columns of the documents
    names = ["id", "hash", "v", "key", "keep", "component", "rep", "root", "size", "n", "text_hash", "score", "__id", "__hash"]
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, long), (4, long + " end"), (5, None)]
    docs = spark.createDataFrame([(*r, *[k] * len(names)) for k, r in enumerate(rows)], ["doc_id", "text", *names]).selectExpr("CAST(doc_id AS long) AS doc_id", "text", *[f"`{n}`" for n in names])
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert kept.columns == docs.columns and sorted(tuple(r)[:3] + (r.score,) for r in kept.select("doc_id", "id", "hash", "score").collect()) == [(1, 0, 0, 0), (3, 2, 2, 2), (5, 4, 4, 4)]
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_benchmark_leaks):
        left = stage(spark, docs, sf_dir)
        assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {1, 2, 3, 4, 5}
    packed = corpus_pipeline.pack(spark, kept, sf_dir).collect()
    assert {r.doc_id for r in packed} == {1, 3, 5} and all(r.length <= 2048 for r in packed)
