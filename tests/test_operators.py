"""Chunkers, sources and the operators that the given tables do not reach."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking, evaluation, filtering, joins, ranking, versions
from quarry.sources import markup, tables
from quarry.streaming import incremental

lines = st.lists(st.text(alphabet="ab .1\n(", max_size=60), max_size=12).map("\n".join)


@settings(max_examples=150, deadline=None)
@given(lines, st.integers(3, 40))
def test_packed_paragraphs_keep_all_and_fit(text, budget):
    groups = chunking.pack_paragraphs(text, budget, 0)
    assert "".join("".join(groups).split()) == "".join(text.split())
    for g in groups:
        assert chunking.tokens(g) <= budget or len(g) <= max(2 * budget, 200)


@settings(max_examples=150, deadline=None)
@given(lines, st.integers(5, 30))
def test_judgment_chunks_cover_the_text_within_the_budget(text, most):
    chunks = chunking.chunk_judgment(text, most // 2, most, most // 4)
    covered = set()
    for a, b, n, _, piece in chunks:
        assert text[a:b] == piece and n == chunking.tokens(piece)
        covered |= set(range(a, b))
    assert all(i in covered for i, ch in enumerate(text) if not ch.isspace())
    # word groups that cannot be cut any more are the only ones beyond the budget
    assert all(n <= most or len(piece.split()) == 1 for _, _, n, _, piece in chunks)


def test_overlap_headings_and_operative_part():
    text = "\n\n".join(f"Paragraph {i} has some words in it." for i in range(12)) + "\n\nDecision\n\nWe allow the appeal."
    chunks = chunking.chunk_judgment(text, 20, 40, 9, holding=frozenset({"Decision"}))
    assert len(chunks) > 3 and chunks[1][0] < chunks[0][1]
    assert chunks[-1][3] and chunks[-1][4].startswith("Decision") and not chunks[-2][3]


def test_page_chunks_keep_languages_apart():
    out = chunking.page_chunks([("One two. Three four.\n\nFive.", "en"), ("Uno. Dos.", "es"), ("Tres.", "es")], 1000)
    assert out == [("en", "One two. Three four. Five."), ("es", "Uno. Dos. Tres.")]
    assert len(chunking.page_chunks([("A sentence here. " * 50, "en")], 20)) > 5


def test_sections_and_subsections():
    rows = chunking.section_rows("Preamble\nShort title\n1. This law.\nmore\nMeanings\n2. In this law (a) one (b) two\n2019. no section\n3. Three")
    assert [(n, t) for n, t, _ in rows] == [(None, ""), ("1", "Short title"), ("2", "Meanings"), ("3", "")]
    assert chunking.subsections("intro (1) one (2) two (a) x (3) three") == [("", "intro"), ("1", "one"), ("2", "two (a) x"), ("3", "three")]


def test_header_and_footer_lines(spark):
    pages = [(1, p, f"Report 7\nbody {p} line\nmore {p}\n- {p} -", "en") for p in range(1, 5)] + [(2, 1, "Report 7\nalone", "en")]
    df = spark.createDataFrame(pages, "doc long, page long, text string, lang string")
    got = {(r.doc, r.page): r.text for r in filtering.clean_pages(df, "doc", "page", "text", "lang").collect()}
    assert got[1, 2] == "body 2 line\nmore 2" and got[2, 1] == "Report 7\nalone"


def test_case_filter_reasons(spark):
    rows = [("", "J", None, "2000-01-01"), ("x" * 2000, "D", None, "2000-01-01"), ("short", "D", False, "2000-01-01"), ("x", "other", False, "2000-01-01"), ("x", "J", None, None), ("x", "J", None, "2030-01-01"), ("x", "J", True, "2000-01-01")]
    df = spark.createDataFrame(rows, "text string, kind string, technical boolean, d string").withColumn("d", F.to_date("d"))
    rules = filtering.judgment_rules(F.col("text"), F.col("kind"), F.col("technical"), F.col("d"), ["J"], "D", "2020-01-01")
    got = [r.reason for r in filtering.with_reason(df, rules).collect()]
    assert got == ["empty_text", "decision_technical_or_unknown", "decision_too_short", "type_not_kept", "no_valid_date", "on_or_after_cutoff", None]


def test_aliases_and_reports(spark):
    df = spark.createDataFrame([(" ", "b", 3), (None, None, 4)], "Text string, html_text string, Year int")
    aliases = {"text": ["text", "html_text"], "year": ["Year"], "court": ["court"]}
    resolved = tables.resolve_columns(df.columns, aliases)
    assert resolved == {"text": ["Text", "html_text"], "year": ["Year"], "court": []}
    assert [tuple(r) for r in tables.logical(df, aliases).collect()] == [("b", 3, None), (None, 4, None)]
    tables.check_required(resolved, ["text"], ["year"])
    with pytest.raises(ValueError):
        tables.check_required(resolved, ["court"])
    assert "| Year | int | year |" in tables.schema_report(df, resolved)


def test_json_lines_and_shards(spark, tmp_path):
    df = spark.range(25).withColumn("t", F.concat(F.lit("é"), F.col("id")))
    tables.write_jsonl(df.coalesce(1), str(tmp_path / "j"), 10)
    assert len(list((tmp_path / "j").glob("*.json"))) == 3
    assert tables.read_jsonl(spark, str(tmp_path / "j"), "id long, t string").count() == 25
    got = tables.shards(df, ["id"], 10).orderBy("id").collect()
    assert [(r.shard, r.row) for r in got] == [(i // 10, i % 10) for i in range(25)]
    tables.write_parquet(df.withColumn("year", F.col("id") % 3), str(tmp_path / "p"), ["year"])
    assert sorted(p.name for p in (tmp_path / "p").glob("year=*")) == ["year=0", "year=1", "year=2"]


def test_wiki_dump_and_mail(spark, tmp_path):
    page = "<page><title>T{n}</title><ns>{ns}</ns><id>{n}</id>{r}<revision><id>9</id><timestamp>2024</timestamp><text>{{{{law}}}}\nx</text></revision></page>"
    xml = "<mediawiki>" + page.format(n=1, ns=0, r="") + page.format(n=2, ns=4, r="") + page.format(n=3, ns=0, r='<redirect title="T1"/>') + "</mediawiki>"
    (tmp_path / "d.xml").write_text(xml)
    pages = markup.wiki_pages(spark, str(tmp_path / "d.xml"))
    assert pages.count() == 3 and [r.page_id for r in markup.content_pages(pages, "law").collect()] == [1]
    (tmp_path / "m.eml").write_bytes(b"From: a@x\r\nTo: b@x\r\nDate: Mon, 1 Jan 2024 10:00:00 +0000\r\nSubject: Hi\r\nContent-Type: text/html\r\n\r\n<p>Hello <b>you</b></p>")
    files = spark.read.format("binaryFile").load(str(tmp_path / "m.eml"))
    m = markup.mail_messages(files).first()
    assert m.headers["Subject"] == "Hi" and m.body.strip() == "Hello you"


def test_rank_shapes(spark):
    ranked = spark.createDataFrame([(1, r, s) for r, s in enumerate([5, 9, 3, 2, 1], 1)], "q long, rank int, size int")
    assert sorted(r.rank for r in ranking.greedy_budget(ranked, "q", "rank", "size", 10).collect()) == [1, 3, 4]
    assert sorted(r.rank for r in ranking.prefix_budget(ranked, "q", "rank", "size", 15).collect()) == [1, 2]
    pool = spark.createDataFrame([(1, 1, [1.0, 0.0], 0.9), (1, 2, [1.0, 0.0], 0.89), (1, 3, [0.0, 1.0], 0.5)], "q long, id long, v array<double>, rel double")
    got = [r.id for r in ranking.maximal_marginal_relevance(pool, "q", "id", "v", "rel", 2, 0.5).orderBy("pick").collect()]
    assert got == [1, 3]


def test_joins_and_versions(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, h string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, h string")
    assert {r.k: r.action for r in joins.changed_records(old, new, "k", "h").collect()} == {1: "gone", 2: "changed", 3: "new"}
    assert sorted(map(tuple, versions.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, versions.retract(old, new, ["k"]).collect())) == [(1, "a")]
    assert versions.watermark(old, "k") == 2
    a = spark.createDataFrame([("sale law",), ("nothing",)], "n string")
    b = spark.createDataFrame([("sale law",), ("sale law apartments",), ("the sale law",)], "t string")
    pairs = joins.contains_join(a, b, "n", "t")
    assert pairs.count() == 3 and [tuple(r) for r in joins.exact_else_contains(pairs, "n").collect()] == [("sale law", "sale law", True)]


def test_evaluation_helpers(spark):
    ranked = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 12)], "query_id long, rank int, id long")
    relevant = spark.createDataFrame([(1, 11), (1, 99), (2, 5)], "query_id long, id long")
    m = evaluation.recall_mrr(evaluation.retrieval_metrics(ranked, relevant)).first()
    assert (m.queries, m.hit_rate, m.recall, m.mrr) == (2, 0.5, 0.25, 0.25)
    row = spark.createDataFrame([("a b", 1.0, None)], "t string, x double, y double").select(
        evaluation.fact_coverage(F.col("t"), ["a", "z"]).alias("c"), evaluation.mean_of_known(F.col("x"), F.col("y")).alias("m")
    ).first()
    assert (row.c, row.m) == (0.5, 1.0)


def test_incremental_runs_continue(spark, tmp_path):
    src, root = tmp_path / "src", str(tmp_path / "run")
    first = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k long, v long, t string").coalesce(1)
    first.write.parquet(str(src))
    incremental.run_upserts(spark, str(src), root, ["k"], ["v"])
    spark.createDataFrame([(1, 2, "c"), (3, 1, "d")], "k long, v long, t string").coalesce(1).write.mode("append").parquet(str(src))
    incremental.run_upserts(spark, str(src), root, ["k"], ["v"])
    assert sorted(map(tuple, incremental.snapshot(spark, root).collect())) == [(1, 2, "c"), (2, 1, "b"), (3, 1, "d")]
    incremental.mark_done(spark, root, "clean", "h1", 3)
    assert incremental.is_done(spark, root, "clean", "h1") and not incremental.is_done(spark, root, "clean", "h2")
    assert json.dumps(T.CODE_PAGES)


def test_the_library_stands_without_the_llm_folder():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[1] / "quarry"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "quarry.llm" not in p.read_text() and "import llm" not in p.read_text() and ".llm" not in p.read_text(), p


def test_bm25_shuffles_no_postings(spark):
    docs = spark.createDataFrame([(i, i % 2, f"alpha beta w{i}" if i % 3 else "beta") for i in range(60)] + [(7, 1, "gamma gamma"), (90, 0, None), (91, 1, "")], "id long, sh int, t string")
    asked = spark.createDataFrame([(1, "Alpha alpha w7"), (2, "beta gamma"), (3, "nowhere"), (4, None)], "q long, t string")
    whole = ranking.bm25_search(docs, asked, "id", "t", "q", "t", 5)
    # nothing is joined after the texts are scored, and the passes of single queries give what one pass gives
    assert "Join" not in whole.filter("rank > 0")._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    rows = lambda df: sorted((r.query_id, r.rank, r.id, round(r.score, 9)) for r in df.collect())
    assert rows(whole) == rows(ranking.bm25_search(docs, asked, "id", "t", "q", "t", 5, pack=1))
    # both rows of id 7 are one document, as in a grouping by id
    assert [i for q, _, i, _ in rows(whole) if q == 2][0] == 7 and {q for q, *_ in rows(whole)} == {1, 2}
    by_shard = ranking.bm25_search(docs, asked, "id", "t", "q", "t", 5, shard=docs["sh"])
    assert rows(by_shard) != rows(whole) and {r.query_id for r in by_shard.collect()} == {1, 2}


def test_dense_search_holds_tiles_and_few_copies():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    x = rng.standard_normal((6000, 16)).astype(np.float32)
    x[1000:5000] = x[0]  # copies
    vectors = lambda v: pa.ListArray.from_arrays(np.arange(0, v.size + 1, 16), v.reshape(-1))
    asked = pa.table({"query_id": np.arange(4000), "q": vectors(x[np.arange(4000) % 1000])})
    batches = [pa.record_batch([pa.array(np.arange(6000)[i : i + 3000]), vectors(x[i : i + 3000])], ["id", "v"]) for i in (3000, 0)]
    tracemalloc.start()
    found = next(ranking._nearest(asked, 5)(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6 and found.num_rows < 3 * 5 * 4000  # all scores of a batch, and all copies of a vector, are more
    d = found.to_pandas()
    d["r"] = d["score"].round(9)
    got = d.sort_values(["query_id", "r", "id"], ascending=[True, False, True]).groupby("query_id")["id"].agg(lambda s: list(s)[:5])
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for q in (0, 1, 17, 999, 3003):
        s = np.round(u @ u[q % 1000], 9)
        assert got[q] == sorted(range(6000), key=lambda i: (-s[i], i))[:5]
    assert got[0] == [0, 1000, 1001, 1002, 1003]
