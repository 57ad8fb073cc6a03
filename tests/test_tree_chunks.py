import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.operators import law_pages, tree_chunks
from quarry.operators.chunking import tokens
from quarry.operators.tree_chunks import Unit, case_units, messages, pack_case, provision_units, split_units
from quarry.plans import laws
from quarry.sources import wikitext


def plain_pack(units, budget, overlap):
    """Unit by unit: what is open, what was carried."""
    groups, current, fresh = [], [], 0
    size = lambda us: sum(u.tokens for u in us)
    for u in units:
        if u.heading and fresh and fresh >= 0.35 * budget:
            groups.append(current)
            current, fresh = [], 0
        elif fresh and size(current) + u.tokens > budget:
            groups.append(current)
            carried = []
            for x in reversed(current):
                if x.heading or size(carried) + x.tokens > overlap:
                    break
                carried.insert(0, x)
            while carried and size(carried) + u.tokens > budget:
                carried.pop(0)
            current, fresh = carried, 0
        current = [*current, u]
        fresh += u.tokens
    return groups + [current] * bool(fresh)


UNITS = st.lists(st.tuples(st.integers(1, 12), st.booleans()), max_size=40).map(lambda xs: [Unit(f"u{i}", 1 + i // 7, h and n < 4, "", "", n) for i, (n, h) in enumerate(xs)])


@settings(max_examples=400, deadline=None)
@given(UNITS, st.integers(12, 40), st.integers(0, 15))
def test_packing_equals_the_plain_version(units, budget, overlap):
    assert pack_case(units, budget, overlap) == plain_pack(units, budget, overlap)


def test_units_messages_and_provisions():
    units = case_units("A heading\n1. first point.\n\fFrom: a\nTo: b\nbody one.\nFrom: c\nSubject: d\nbody two.")
    assert [(u.page, u.heading, u.label, u.section) for u in units[:2]] == [(1, True, "", "A heading"), (1, False, "1", "A heading")]
    assert [(m, [u.text for u in us]) for m, us in messages(units)][1:] == [("From: a ; To: b", ["body one."]), ("From: c ; Subject: d", ["body two."])]
    assert [u.tokens <= 10 for u in split_units([Unit("one two three. " * 9, 1, False, "", "", 36)], 10)] == [True] * 5
    assert provision_units(["opening", "(א) one", "more", "(ב) two"], 3) == [("א", "opening\n(א) one\nmore"), ("ב", "opening\n(ב) two")]
    assert provision_units(["x " * 100, "(א) one"], 3) == [(None, ("x " * 100).strip()), ("א", "(א) one")] and provision_units(["(א) a"], 50) == [(None, "(א) a")]


def test_law_chunks_keep_every_word_under_its_header(spark, sf_dir):
    pages = laws._pages(spark, sf_dir)
    blocks = law_pages.sections(law_pages.placed_lines(wikitext.law_lines(pages))).cache()
    named = pages.select(F.col("page_id").alias("page"), "title")
    got = tree_chunks.law_chunks(named, blocks, 60, 0).collect()
    assert len({(r.page, r.chunk_id) for r in got}) == len(got)
    said = {}
    for r in sorted(got, key=lambda r: (r.page, r.number, int(r.subsection or 0), r.part)):
        assert r.text.startswith(r.header) and r.header.startswith(f"doc {r.page}") and (r.kind != "section" or f"> {r.number}. " in r.header + " ")
        assert (r.parts > 1) == (f"(part {r.part} of {r.parts})" in r.text)
        said.setdefault((r.page, r.number), []).append(r.text.split("\n\n", 1)[1])
    for b in blocks.collect():
        want, have = (Counter(re.sub(r"\s", "", x)) for x in (b.text, " ".join(said.get((b.page, b.number), []))))
        # short openings go with each subsection and sentences beyond the room are cut by length, but nothing is lost
        assert want <= have
    # within the room that the header leaves, but for pieces cut by length
    assert all(r.tokens <= max(60 - tokens(r.header), 50) or len(r.text.split("\n\n", 1)[1]) <= 200 for r in got)


def test_case_chunks_against_units(spark, sf_dir):
    got = laws.case_chunks(spark, sf_dir).collect()
    files = {}
    for r in got:
        files.setdefault(r.path, []).append(r)
    assert len(files) > 100
    for rows in files.values():
        rows.sort(key=lambda r: r.chunk)
        assert [r.chunk for r in rows] == list(range(rows[0].chunks)) and all(r.page_start <= r.page_end for r in rows)
        assert all(a.page_start <= b.page_start for a, b in zip(rows, rows[1:])) and all(r.text.startswith("Matter: ") for r in rows)


def test_law_chunks_shuffle_the_lines_once(spark, sf_dir):
    """Beside the titles: blocks, their parts and the numbers of repeated ids come where a page's lines stand."""
    plan = laws.law_chunks(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(page#\d+L, \d+\)", plan)) <= 2 and plan.count("Exchange hashpartitioning") <= 2 and "SinglePartition" not in plan


def test_repeated_ids_of_law_chunks_are_numbered(spark):
    rows = [(p, b, "section", n, None, "x " * size, "", []) for p in (1, 2) for b, (n, size) in enumerate([("5", 3), ("5", 200), ("6", 2), ("5", 4), ("5", 120), (None, 1)])]
    blocks = spark.createDataFrame(rows, "page long, block long, kind string, number string, title string, text string, intro string, subsections array<struct<label:string,text:string>>")
    blocks = blocks.withColumns({k: F.lit(None).cast("string") for k in ("division", "chapter", "subchapter")}).repartition(3)
    got = tree_chunks.law_chunks(spark.createDataFrame([(1, "a"), (2, "b")], "page long, title string"), blocks, 100).collect()
    for p in (1, 2):
        ids = sorted(r.chunk_id for r in got if r.page == p and r.chunk_id)
        assert ids == sorted([f"{p}:5", f"{p}:5~2", f"{p}:6", *[f"{p}:5#p{i}" for i in (1, 2)], *[f"{p}:5#p{i}~2" for i in (1, 2)]])
        assert [r.part for r in got if r.page == p and r.chunk_id is None] == [1]
        assert len(next(r for r in got if r.chunk_id == f"{p}:5~2").text.split("\n\n")[1].split()) == 4
