import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm.toxicity import Automaton, Lexicon, choose_terms, copy_groups, edits, in_training, learn, score_documents
from pyspark.sql import functions as F

TERMS = {"moron": 4.0, "idiot": 4.0, "worthless": 4.0, "scum": 3.0}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


AUTOMATON = Automaton(TERMS)


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(sorted(TERMS)), st.lists(st.tuples(st.integers(0, 9), st.sampled_from("abmorx")), max_size=3), st.text(alphabet="idotmrnwh", max_size=9))
def test_automaton_finds_what_is_within_the_edits(term, changes, other):
    changed = list(term)
    for at, ch in changes:
        if at < len(changed):
            changed[at] = ch
        else:
            changed.insert(at // 2, ch)
    for token in ("".join(changed), other, term[1:], term + "s"):
        near = [(distance(token, t), t) for t in TERMS if edits(t) and distance(token, t) <= edits(t)]
        assert AUTOMATON.match(token) == (min(near) if near else None)


def make(spark):
    rng = random.Random(1)
    vocab = ["".join(rng.choice(["ba", "lo", "ti", "re", "sun", "ek"]) for _ in range(3)) for _ in range(400)] + ["oron"] * 3
    bad = ["idiot", "worthless", "moron"] + ["zarkan" + e for e in ("a", "o", "is", "ek")]
    docs, labels = [], []
    for i in range(1500):
        words = [rng.choice(vocab) for _ in range(rng.choice([4, 60, 300]))]
        toxic = rng.random() < 0.12
        if toxic:
            for _ in range(1 + len(words) // 30):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(words), 1.0))
        labels.append((i, int(toxic)))
    return docs, labels


def test_learns_terms_stems_and_keeps_usual_words(spark):
    docs, labels = make(spark)
    extra = [(5000, "you idiott", 0.0), (5001, "it says \"idiot\" in the " + "long " * 60, 0.0), (5002, "", 0.0), (5003, None, 0.0), (None, "a clean text", 0.0), (5004, "oron oron oron", 0.0), (5005, "zarkanunseen", 0.0), (5006, "x" * 100_000, 0.0), (5007, "idiot " + "long " * 60, 0.0)]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string, score double")
    marks = spark.createDataFrame(labels + labels[:50] + [(7000, None), (None, 1)], "doc_id long, toxic int")
    model = learn(df, marks)
    assert {"idiot", "worthless", "moron"} <= set(model["terms"]) and any(s.startswith("zark") for s in model["stems"])
    scored = {r.id: r for r in score_documents(df, model).collect()}
    assert len(scored) == len(docs) + len(extra)
    truth = dict(labels)
    held = {r.doc_id for r in df.where(~in_training(F.col("doc_id"))).select("doc_id").collect()}
    assert all((scored[i].score >= 0.7) == bool(truth[i]) for i in held if i < 1500)
    s = {i: scored[i].score for i in scored}
    assert s[5000] >= 0.5 and s[5005] >= 0.7 and s[5007] > s[5001]
    assert max(s[i] for i in (5002, 5003, 5004, 5006, None)) < 0.5
    h = scored[5000].hits[0]
    assert (h.kind, h.term, h.start, h.end) == ("misspelt", "idiot", 4, 10)
    assert scored[5001].hits[0].kind == "quoted"


def test_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = learn(df, none)
    assert 0 <= score_documents(df, model).first().score <= 1
    assert score_documents(df.limit(0), model).count() == 0
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert 0 <= score_documents(df, learn(df, one)).first().score <= 1


def test_quotations_of_any_length_and_misspelt_stems():
    lexicon = Lexicon({"idiot": 4.0, "scum": 3.0}, {"zarkan": 4.0}, {"sum"})
    far = 'he wrote "' + "long words " * 500 + "idiot " + "and more " * 500 + '" again idiot'
    assert [h[2] for h in lexicon.hits(far)[0]] == ["quoted", "term"]
    kinds = {t: (lexicon.look(t) or ("", ""))[:2] for t in ("zarkanish", "zrkanish", "zarcanolopex", "scumm", "sum", "sxyum", "zapan")}
    assert kinds == {
        "zarkanish": ("stem", "zarkan"), "zrkanish": ("misspelt", "zarkan"), "zarcanolopex": ("misspelt", "zarkan"), "scumm": ("misspelt", "scum"),
        "sum": ("", ""), "sxyum": ("", ""), "zapan": ("", ""),
    }
    assert not lexicon.hits("“" * 100_000)[0]


def test_all_significant_terms_are_taken():
    counts = [(f"bad{i}", False, 40.0, 0.0) for i in range(6000)] + [("zark", True, 60.0, 0.0), ("zarkan", False, 30.0, 0.0), ("zarkit", False, 30.0, 0.0)]
    terms, stems = choose_terms(counts, 100.0, 900.0, 20_000)
    assert len(terms) == 6002 and set(stems) == {"zark"} and terms["zarkan"] == stems["zark"]


def test_edited_copies_make_no_terms(spark):
    docs, labels = make(spark)
    rng = random.Random(2)
    rare = [f"only{chr(97 + i // 26)}{chr(97 + i % 26)}here" for i in range(300)]
    for i in range(60):  # copies of one toxic text, two words of each changed
        words = list(rare)
        for _ in range(2):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        docs.append((8000 + i, " ".join([*words, "idiot moron"]), 0.0))
        labels.append((8000 + i, 1))
    docs += [(9000, f"version {n} of one id", 0.0) for n in range(50)]
    labels.append((9000, 0))
    model = learn(spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {"idiot", "worthless", "moron"} <= set(model["terms"])
    assert not [t for t in [*model["terms"], *model["stems"]] if t.startswith("only")]


@given(st.lists(st.lists(st.integers(0, 12), min_size=3, max_size=3), max_size=12))
def test_copy_groups_are_the_components_of_shared_keys(rows):
    left, want = list(range(len(rows))), [0] * len(rows)
    while left:
        first, todo = left[0], [left.pop(0)]
        while todo:
            a = todo.pop()
            want[a] = first
            near = [b for b in left if set(rows[a]) & set(rows[b])]
            left = [b for b in left if b not in near]
            todo += near
    assert copy_groups(np.array(rows, np.int64).reshape(-1, 3)).tolist() == want
