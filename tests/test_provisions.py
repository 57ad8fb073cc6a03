"""Laws, citations and records on small rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from quarry.operators import grounding as G
from quarry.operators import provisions as P
from quarry.operators import records as R


def one(spark, expr, values, kinds):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)))
    return df.select(expr(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize(
    "f, given, want",
    [
        (P.classify_title, "חוק יסוד: הכנסת", "basic_law"), (P.classify_title, "תקנות התעבורה", "regulation"), (P.classify_title, "Ordinance of ports", "ordinance"), (P.classify_title, "חוק המכר", "law"),
        (P.law_status, "בטל", "repealed"), (P.law_status, "in force", "in_force"), (P.law_status, None, "unknown"),
        (P.previous_number, "12", "11"), (P.previous_number, "5a3", "5a2"), (P.previous_number, "1", None),
        (P.ordinal, "(7)", 7), (P.ordinal, "(c)", 3), (P.ordinal, 'ט"ו', 15), (P.ordinal, "?", None),
        (G.states_nothing, "Therefore:", True), (G.states_nothing, "It holds.", False),
        (R.matter_of, "smith/letter.pdf", "smith"), (R.matter_of, "letter.pdf", "(general)"),
    ],
)
def test_scalars(spark, f, given, want):
    assert one(spark, f, [given], ["string"]) == want


def test_section_references_and_cover(spark):
    refs = lambda t, o: one(spark, P.section_references, [t, o], ["string", "string"])
    assert refs("under sections 3, 5-7 and section 9a", "6") == ["3", "5", "7", "9a"]
    assert refs("sections 1-90", "0") == ["1"]
    cov = lambda a, b: one(spark, P.covers, [a, b], ["string", "string"])
    assert cov("6", "6(a)") and cov("6(a)", "6(a)") and not cov("6(b)", "6(a)") and not cov("6(a)", "6")
    held = lambda *v: one(spark, P.holds_section, v, ["string"] * 4)
    assert held("5", "5", None, "") and held("5", "2", "5", "") and held("5", "2", None, "see section 5") and not held("5", "2", None, "x")


def test_scope(spark):
    f = lambda t, s, n: one(spark, lambda a, b, c: P.in_scope(a, b, ["draft"], c), [t, s, n], ["string", "string", "array<string>"])
    assert f("Sale Law", "in_force", []) and not f("Sale Law draft", "in_force", [])
    assert not f("Rules, 1984", "repealed", ["Rules, 2018"]) and f("Rules, 1984", "repealed", ["Rules, 1984"])


def test_law_matching(spark):
    cited = spark.createDataFrame([("Sale Law, 1968",), ("Sale Law, 1990",), ("Sale Law (amended), 1968",), ("Water Supply Rules 1955",), ("Unknown thing",)], "n string")
    laws = spark.createDataFrame([("Sale Law, 1968",), ("Water Rules 1955",)], "t string")
    got = {r["name"]: (r.title, r.tier) for r in P.fuzzy_law_match(cited, laws, "n", "t").collect()}
    assert got["Sale Law, 1968"] == ("Sale Law, 1968", 1) and got["Sale Law, 1990"][1] == 2 and got["Sale Law (amended), 1968"] == ("Sale Law, 1968", 3)
    assert got["Water Supply Rules 1955"] == ("Water Rules 1955", 4) and "Unknown thing" not in got
    assert one(spark, P.resolve_by_words, ["income tax", ["property tax law", "income tax law"]], ["string", "array<string>"]) == "income tax law"


def test_amendments_parts_and_references(spark):
    chunks = spark.createDataFrame([("c1", [("k", "3", "amends"), ("k", "4", "reads_as")]), ("c2", [("k", "5", "amends")])], "id string, amends array<struct<target_key:string,number:string,relation:string>>")
    assert [tuple(x) for x in P.amendment_index(chunks, "id", "amends").first().amendments] == [("c1", "3"), ("c2", "5")]
    parts = spark.createDataFrame([(1, "7", 2, "b", 5), (1, "7", 1, "a", 5), (1, "8", 1, "x", 50)], "r long, s string, p int, t string, n int")
    got = {r.s: (r.t, r.parts, r.whole) for r in P.section_parts(parts, "r", "s", "p", "t", 8, "n").collect()}
    assert got == {"7": ("a", 1, False), "8": ("x", 1, True)}
    hits = spark.createDataFrame([(1, 1, 9, "2", ["4", "5"]), (1, 2, 9, "4", ["6"])], "q long, rank int, r long, s string, refs array<string>")
    store = spark.createDataFrame([(9, "5"), (9, "6"), (9, "4")], "r long, s string")
    assert [(x.s, x.nr) for x in P.cross_references(hits, store, "q", "rank", "r", "s", "refs", 4, 5).orderBy("nr").collect()] == [("5", 1), ("6", 2)]
    defs = spark.createDataFrame([("L", '"tax" - a levy', 0.4), ("L", '"tax" - another', 0.2), ("M", "tax is", 0.1)], "law string, t string, d double")
    assert [r.d for r in P.definition_rows(defs, "tax", "t", "law", "d").collect()] == [0.2]


def test_verification(spark):
    kinds = ["string", "array<string>", "array<string>", "array<string>", "array<string>"]
    v = lambda *a: one(spark, P.verification, a, kinds)
    assert v(None, ["1"], [], [], []) == "LAW_MISSING" and v("a", [], [], [], []) == "LAW_ONLY"
    assert v("a", ["1"], ["2"], [], []) == "SECTION_MISSING" and v("a", ["1"], ["1"], ["9"], []) == "NUMBERS_MISSING" and v("a", ["1"], ["1"], ["9"], ["9"]) == "VERIFIED"


def test_citations(spark):
    drafts = spark.createDataFrame([(1, "A [[CITE: claim=c1 | source=s1]] b [[CITE: claim=c9 | source=s1]] c [[CITE: claim=c1 | source=zz]] d [[CITE: source=s1]]")], "draft_id long, text string")
    evidence = spark.createDataFrame([(1, "s1")], "draft_id long, source string")
    claims = spark.createDataFrame([(1, "c1")], "draft_id long, claim string")
    got = [r.problem for r in G.citation_problems(drafts, evidence, claims).orderBy("pos").collect()]
    assert got == [None, "unknown_claim", "unknown_source", "incomplete"]
    cites = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "b")], "d long, p int, s string")
    assert [r.number for r in G.footnotes(cites, "d", "p", "s").orderBy("p").collect()] == [1, 2, 1]
    unknown = spark.createDataFrame([(1, "L:5#p9")], "d long, s string")
    known = spark.createDataFrame([(1, "L:5#p1"), (1, "L:6#p1")], "d long, s string")
    assert G.near_miss(unknown, known, "d", "s", F.split_part("s", F.lit("#"), F.lit(1))).first().repaired == "L:5#p1"


def test_grounding_functions(spark):
    q = lambda c, t: one(spark, G.quoted_source, [c, t], ["string", "array<string>"])
    assert q("the fine is 500 for late payment", ["the law of sale", "the fine of 500 applies to late payment"]) == 1
    assert q("nothing alike", ["the law", "the fine"]) is None
    r = lambda a, b: one(spark, G.restates, [a, b], ["string", "string"])
    assert r("the fine is five", "well the fine is five indeed") and not r("the fine is 7 now", "the fine is now")
    assert one(spark, lambda t, a: G.foreign_words(t, "A-Za-z", a), ["hello мир wоrld שלום", ["שלום"]], ["string", "array<string>"]) == ["мир", "wоrld"]
    assert one(spark, lambda t: G.missing_headings(t, ["Facts", "Law"]), ["# The facts\ntext\n"], ["string"]) == ["Law"]
    assert one(spark, G.duplicates, [["a", "b", "a"]], ["array<string>"]) == ["a"]
    assert one(spark, lambda m, a: G.is_small_talk(m, a, ["what", "find"]), ["hi there", False], ["string", "boolean"])
    assert not one(spark, lambda m, a: G.is_small_talk(m, a, ["what", "find"]), ["what is it", False], ["string", "boolean"])
    assert one(spark, lambda a, b: G.escalation_reasons([("x", a), ("y", b)]), [True, None], ["boolean", "boolean"]) == ["x"]


def test_cards_and_margins(spark):
    queries = spark.createDataFrame([(1, "a sale of a defective car")], "q long, t string")
    cards = spark.createDataFrame([("k1", ["sale+defective"]), ("k2", ["sale", "car"]), ("k3", ["rent"])], "id string, triggers array<string>")
    assert [(r.card, r.hits) for r in G.doctrine_matches(queries, cards, "q", "t", 2).orderBy(F.desc("hits")).collect()] == [("k2", 2), ("k1", 1)]
    ranked = spark.createDataFrame([(1, "L", 0.9), (1, "M", 0.85), (1, "N", 0.2)], "q long, law string, s double")
    assert G.within_margin(ranked, "q", "s", 0.1, 0.3).count() == 2
    assert G.laws_in_play(ranked, "q", "law", "s", 0.1).first().laws == ["L", "M"]


def test_records(spark):
    kind = lambda n, t: one(spark, R.document_kind, [n, t], ["string", "string"])
    assert kind("a.eml", "") == "email" and kind("a.txt", "From: x\nTo: y\nDate: z\n") == "email"
    assert kind("a.txt", "Q. one\nA. two\n" * 4) == "transcript" and kind("Lease agreement.txt", "") == "contract" and kind("a.txt", "x") == "document"
    header = "Supreme Court\nBefore: Justice A. Levi\nJustice B. Cohen\n1. John Doe, appellant\nv.\nJane Roe, respondent\nJudgment\nThe text."
    got = R.parse_header(header)
    assert got["court"] == "Supreme Court" and got["judges"] == ["A. Levi", "B. Cohen"] and got["first_side"] == ["John Doe"] and got["second_side"] == ["Jane Roe"] and got["parsed"]
    docs = spark.createDataFrame([(1, header), (2, None)], "i long, t string")
    assert {r.id: r.parsed for r in R.header_rows(docs, "i", "t").collect()} == {1: True, 2: False}
    side = spark.createDataFrame([("a/law.txt", "Sale Law, 1968\nIn force 5.3.1969", datetime.datetime(2020, 1, 1))], "path string, text string, modified timestamp")
    none = spark.createDataFrame([], "path string, law_id string, law_name string, start date, kind string, language string")
    row = R.with_sidecar(side, none, "path", "text", "modified").first()
    assert row.law_name == "Sale Law, 1968" and str(row.start) == "1969-03-05" and row.kind == "law" and row.language == "en"
    assert one(spark, lambda p: R.is_case_file(p, [".pdf", ".txt"]), ["m/.hidden.pdf"], ["string"]) is False
    assert one(spark, lambda c, d: R.context_prefix(c, F.lit("Judgment"), d, F.array(F.lit("Levi"))), ["1/05", datetime.date(2005, 1, 2)], ["string", "date"]) == "[1/05 | Judgment | 2005-01-02 | Levi]"
    assert one(spark, lambda t: R.fit_to_tokens(t, F.lit(100), 50), ["x" * 200], ["string"]) == "x" * 95
    log = spark.createDataFrame([("j", 1.0, 5), (None, 2.0, 7)], "job_id string, seconds double, tokens int")
    assert {r.job for r in R.trace_report(log).collect()} == {"j", "(no job)"}
