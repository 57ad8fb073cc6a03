"""Queries that SQL can't express, against plain versions over the given tables."""

import hashlib
import re

import numpy as np
import pytest

from quarry.plans import search, tables

TOKEN = re.compile(r"\w+|[^\w\s]")


def size(text):
    return len(TOKEN.findall(text))


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def by_document(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.id, []).append(r)
    return {i: sorted(rs, key=lambda r: r["index"]) for i, rs in out.items()}


def plain_groups(units, budget, overlap):
    """Line by line: what is open, and what is carried over."""
    groups, current = [], []
    total = lambda xs: sum(n for _, n in xs)
    for unit in units:
        if current and total(current) + unit[1] > budget:
            groups.append(current)
            carried = []
            for x in reversed(current):
                if total(carried) + x[1] > overlap or total(carried) + x[1] + unit[1] > budget:
                    break
                carried.insert(0, x)
            current = carried
        current = [*current, unit]
    return groups + [current] * bool(current)


def test_packed_paragraphs(spark, sf_dir, docs):
    got = by_document(tables.packed_paragraphs(spark, sf_dir))
    tested = 0
    for i, text in docs.items():
        lines = [x.strip() for x in (text or "").split("\n") if x.strip()]
        if any(size(x) > 200 for x in lines):
            continue  # sentences of long lines are tested below
        want = ["\n".join(u for u, _ in g) for g in plain_groups([(x, size(x)) for x in lines], 200, 40)]
        assert [r.text for r in got.get(i, [])] == want
        tested += len(want) > 1
    assert tested > 10


def test_nothing_is_lost_or_too_large(spark, sf_dir, docs):
    letters = lambda x: re.sub(r"\s", "", x)
    pages = by_document(tables.page_chunks(spark, sf_dir))
    for i, text in docs.items():
        assert letters("".join(r.text for r in pages.get(i, []))) == letters(text or "")
    judged = by_document(tables.judgment_chunks(spark, sf_dir))
    for i, text in docs.items():
        at = 0
        for r in judged.get(i, []):
            assert text[r.char_start : r.char_end] == r.text and r.tokens == size(r.text) and r.char_start <= max(at, r.char_start)
            assert not text[at : r.char_start].strip() or r.char_start < at
            assert r.tokens <= 180 or len(r.text.split()) == 1
            at = r.char_end
        assert not text[at:].strip()
    sections = by_document(tables.section_chunks(spark, sf_dir))
    for i, text in docs.items():
        numbers = [int(re.match(r"\d+", r.number)[0]) for r in sections.get(i, []) if r.number]
        assert numbers == sorted(numbers) and (not numbers or numbers[0] <= 10)
        assert len(letters("".join(r.text for r in sections.get(i, [])))) <= len(letters(text or ""))


def test_hashed_vectors(spark, sf_dir, docs):
    for r in search.hashed_vectors(spark, sf_dir).collect():
        text, v = docs[r.id] or "", np.zeros(64)
        for i in range(max(1, len(text) - 2)):
            v[int.from_bytes(hashlib.blake2b(text[i : i + 3].encode(), digest_size=4).digest(), "little") % 64] += 1
        assert np.allclose(r.vector, v / np.linalg.norm(v), atol=1e-6)


def test_marginal_relevance(spark, sf_dir):
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    pool, got = {}, {}
    for r in search._dense(spark, sf_dir).collect():
        pool.setdefault(r.query_id, {})[r.id] = r.score
    for r in search.marginal_relevance(spark, sf_dir).collect():
        got.setdefault(r.query_id, {})[r.pick] = r.id
    cos = lambda a, b: vectors[a] @ vectors[b] / np.linalg.norm(vectors[a]) / np.linalg.norm(vectors[b])
    for q, scores in pool.items():
        picked = []
        while len(picked) < min(8, len(scores)):
            value = {i: 0.7 * s - 0.3 * max((cos(i, p) for p in picked), default=0.0) for i, s in scores.items() if i not in picked}
            best = max(value.values())
            now = got[q][len(picked) + 1]
            assert value[now] >= best - 1e-6
            picked.append(now)
