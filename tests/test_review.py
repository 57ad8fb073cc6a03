import datetime

from pyspark.sql import functions as F

from quarry.operators import review as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_small_rules(spark):
    lit, arr = F.lit, lambda *x: F.array(*map(F.lit, x))
    empty = F.array().cast("array<string>")
    none = F.lit(None).cast("double")
    cases = [
        (R.heading_of(lit("law > section 5 — Good faith")), "Good faith"), (R.heading_of(lit("law > Title")), "Title"),
        (R.forbidden_query(lit("x?$filter=a;b")), True), (R.forbidden_query(lit("x?$apply=Aggregate(a)")), True), (R.forbidden_query(lit("x?$top=5")), False),
        (R.marginal_title(lit(" Good faith ")), True), (R.marginal_title(lit("It ends.")), False), (R.marginal_title(lit("(א) x")), False), (R.marginal_title(lit('"quoted')), False), (R.marginal_title(lit("one two three four five six")), False), (R.marginal_title(lit(" ")), False),
        (R.cp1252_bytes(lit("a€é\x81")), bytearray(b"a\x80\xe9\x81")), (R.cp1252_bytes(lit("א")), None), (R.cp1252_bytes(lit("")), bytearray()),
        (R.mail_date(lit("To: x\nDate: Tue, 5 Mar 2024 10:00:00 +0200")), datetime.date(2024, 3, 5)), (R.mail_date(lit("Date: soon")), None),
        (R.needs_second_look(lit("A"), lit("incorrect"), lit(1.0), empty), True), (R.needs_second_look(lit("C"), lit("incorrect"), lit(1.0), empty), False), (R.needs_second_look(lit("A"), lit("incorrect"), lit(1.0), arr("t")), False),
        (R.score_after(lit("A"), lit("partially_correct"), lit(False), empty, lit(1.0), none)["score"], 0.75), (R.score_after(lit("C"), lit("abstained"), lit(False), empty, none, none)["score"], 1.0), (R.score_after(lit("C"), lit("abstained"), lit(True), empty, none, none)["score"], 0.0),
        (R.key_marks(lit(3), lit(2), F.array().cast("array<int>"), lit(True)), [True] * 3), (R.key_marks(lit(3), lit(1), arr(2), lit(True)), [False, True, False]), (R.key_marks(lit(3), lit(1), F.array().cast("array<int>"), lit(True)), None), (R.key_marks(lit(3), lit(2), arr(1), lit(False)), None),
        (R.clean_entries(arr(" a ", "],", "error: x", "no conflict"), "^error", "^no "), ["a"]),
        (R.contrary_notes(arr("c1", "c2", "c3", "c4"), arr("c1", "c2", "c3"), arr("c2"), arr("about c3"), lit(True)), ["c1: no contrary authority was found (auto-recorded)"]), (R.contrary_notes(arr("c1"), arr("c1"), empty, empty, lit(False)), []),
        (R.sampling_temperature(lit("high"), lit("formal"), {"high": 0.9, "low": 0.1}, {"formal": 0.3}), 0.3),
    ]
    for column, want in cases:
        got = one(spark, column)
        assert (round(got, 6) if isinstance(got, float) else got) == want, (column, got)
    assert tuple(one(spark, R.source_parts(lit("law-x@2026-07-16:6(2)>24א(ט)#p1")))) == ("law-x", "6(2)", "24א(ט)")
    assert tuple(one(spark, R.source_parts(lit("law-x@2026-07-16:6")))) == ("law-x", "6", None)


def test_failures_splits_overrides_and_first_rows(spark):
    checks = spark.createDataFrame([(1, 1, "c2", "s2", False, [], "unsupported", "why"), (1, 0, "c1", "s1", False, ["a", "b"], "", ""), (1, 2, "c3", "s3", True, [], "", "")], "turn int, index int, claim string, source string, ok boolean, problems array<string>, verdict string, explanation string")
    assert R.citation_failures(checks).first().failures == ["citation #1 (c1 -> s1): a; b", "citation #2 (c2 -> s2): unsupported: why"]
    gold = spark.createDataFrame([(1, "dev", "v1", None), (2, "dev", "v2", True), (3, "dev", "v2", None), (4, "test", "v1", True)], "id int, split string, set string, verified boolean")
    assert [r.id for r in R.select_split(gold, "dev", True).orderBy("id").collect()] == [1, 2] and R.select_split(gold, "dev").count() == 3
    rows = spark.createDataFrame([(1, True, ["x"], ["h"]), (2, True, ["x"], []), (3, False, ["x"], ["h"])], "id int, ok boolean, judges array<string>, header array<string>")
    assert [r.judges for r in R.header_overrides(rows, F.col("ok"), {"judges": "header"}).orderBy("id").collect()] == [["h"], ["x"], ["x"]]
    assert [r.id for r in R.first_kept(gold, ["id"], 2).collect()] == [1, 2]


def test_text_quality_and_lexical_export(spark, tmp_path):
    from quarry.operators import records

    pages = spark.createDataFrame([(1, "א" * 300, None), (1, "", None), (2, "x" * 250, None), (3, "", "broken"), (4, "א" * 250, None)], "d int, t string, f string")
    got = {r.id: (r.quality, r.notes) for r in records.text_quality(pages, "d", "t", F.col("f")).collect()}
    assert got[1] == ("low", ["1 pages without text", "only 150 characters a page"]) and got[2] == ("ok", ["little Hebrew"]) and got[4] == ("ok", [])
    assert got[3][0] == "low" and got[3][1][0] == "reading failed: broken"
    chunks = spark.createDataFrame([("laws", "c1", "r1", "t"), ("court", "c2", "r2", "u")], "category string, chunk_id string, record_id string, lexical_text string")
    records.lexical_export(chunks, str(tmp_path / "x"))
    assert sorted(tuple(r) for r in spark.read.json(str(tmp_path / "x")).select("category", "chunk_id", "lexical_text").collect()) == [("court", "c2", "u"), ("laws", "c1", "t")]
