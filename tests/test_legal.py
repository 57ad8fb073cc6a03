"""Citations, dates, labels and amending clauses on small rows."""

import re

import pytest
from pyspark.sql import functions as F

from quarry.functions import legal
from quarry.functions import text as T
from quarry.operators import amendments, dedupe, retrieval
from quarry.plans import text as text_plans
from quarry.sources import markup

CLAUSE = """Amendment of section 5: after section 5 of the principal law, insert:
"5A. A seller shall state the price.
(1) in writing;
5B. A buyer may ask for it."
In section 9, the word "ten" shall be deleted."""


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_insertions_and_targets():
    found = amendments.find_insertion(CLAUSE)
    assert found.after == "5" and [p[0] for p in found.provisions] == ["5A", "5B"] and found.rest.startswith("In section 9")
    assert found.provisions[0][1].startswith("A seller shall state the price.") and "in writing" in found.provisions[0][1]
    assert amendments.target_sections(CLAUSE) == ["5", "5A", "5B"]
    assert amendments.target_sections("In sections 3, 4a and 7(b), as in section 9 of the Sale Law: x") == ["3", "4a", "7(b)"]
    lost = amendments.find_insertion("After section 12 insert:\nWhoever sells is a seller.")
    assert lost.provisions == [("12A", "Whoever sells is a seller.")]
    assert amendments.find_insertion("nothing here") is None
    assert amendments.find_insertion('אחרי סעיף 7 יבוא:\n"7א. מוכר ימסור הודעה."').provisions[0][0] == "7א"


def test_amended_laws_and_relations():
    preamble = "Passed by the Knesset\nSale Law (Amendment No. 3)\nLease Law (Amendment No. 12 - Temporary Provision)\nother text"
    toc = amendments.amended_laws(preamble)
    assert toc == [("Sale Law", 3, False), ("Lease Law", 12, True)]
    assert amendments.reduce_preamble(preamble).count("\n") == 2
    got = amendments.extract_amendment("Amendment of the Lease Law", "In section 4: delete", toc)
    assert got == {"target": "Lease Law", "number": 12, "sections": ["4"], "temporary": True, "relation": "amends"}
    assert amendments.extract_amendment(None, "section 2 shall be read as if", toc[:1])["relation"] == "reads_as"
    assert amendments.extract_amendment(None, "x", toc) is None
    assert amendments.replaced_subsection("In place of subsection (b) substitute: \"new text\"") == ("(b)", "new text")
    assert amendments.applied_with_changes("The provisions of the Sale Law shall apply mutatis mutandis.") == "Sale Law"
    assert amendments.strip_signatures("It is law.\nDan Levi\nPrime Minister") == "It is law." and amendments.strip_signatures("It is law.\na b") == "It is law.\na b"


def test_amendment_rows(spark):
    df = spark.createDataFrame([(1, CLAUSE), (2, None), (3, ""), (4, "In section 3: x")], "id long, text string")
    got = {(r.id, r.label): r.sections for r in amendments.amendment_rows(df, "id", "text").collect()}
    assert got == {(1, "5A"): "5,5A,5B", (1, "5B"): "5,5A,5B", (4, None): "3"}


@pytest.mark.parametrize(
    "column, want",
    [
        (lambda: legal.join_spaced_numbers(F.lit("בסעיף 116 יז 12(ג) ובסעיף 116 יז 10; 3 of 10, 15 ב 12, 62 עד 64")), "בסעיף 116יז12(ג) ובסעיף 116יז10; 3 of 10, 15 ב 12, 62 עד 64"),
        (lambda: legal.unwrap_math(F.lit("of $54 %$ or $x+1$")), "of 54% or $x+1$"),
        (lambda: legal.normalise_citation(F.lit("ע״א  12–3")), 'ע"א 12-3'),
        (lambda: legal.clean_url(F.lit("https://h.il\\a//b.PDF"), ["h.il"]), "https://h.il/a/b.PDF"),
        (lambda: legal.clean_url(F.lit("https://x.il/b.pdf"), ["h.il"]), None),
        (lambda: legal.first_numbers(F.array(F.lit("12a b 3"), F.lit("x"), F.lit("12a"))), ["12a"]),
        (lambda: legal.name_starts(F.lit("Sale Law, 1968"), F.lit("sale law")), True),
        (lambda: legal.any_listed(F.lit("The Price!"), F.array(F.lit("the price is due"))), True),
        (lambda: legal.trim_notes(F.lit("a **note**\nAnswer:\nyes")), "a note"),
        (lambda: legal.scrub_report(F.lit("The model <think>said Acme</think> so"), ["acme"]), "The system said so"),
        (lambda: legal.gazette_date(F.lit("ניתן ביום 5 במרץ 2003")).cast("string"), "2003-03-05"),
        (lambda: legal.month_name_date(F.lit("5"), F.lit("Sep"), F.lit(24)).cast("string"), "2024-09-05"),
        (lambda: legal.cited_excerpts(F.lit("as [2] and [1] and [2] or [9]"), F.array(F.lit("a"), F.lit("b"))), ["b", "a"]),
        (lambda: legal.non_finite(F.array(F.lit(1.0), F.lit(float("nan")))), True),
        (lambda: legal.sentences_with(F.lit("Pay now. Or wait. He pays."), ["pay"]), ["Pay now."]),
        (lambda: legal.opener(F.lit("כן, מותר")).getField("label"), "yes"),
        (lambda: legal.anonymise(F.lit("Dan Levi sued Levi Dan and Levi"), F.array(F.lit("Dan Levi"), F.lit("Levi"))), "[party 1] sued [party 1] and [party 2]"),
        (lambda: legal.anonymise(F.lit("sued party 1, party 2 and sued"), F.array(F.lit("sued"), F.lit("party"), F.lit("1"))), "[party 1] [party 2] [party 3], [party 2] 2 and [party 1]"),
    ],
)
def test_expressions(spark, column, want):
    assert one(spark, column()) == want


def test_python_helpers_and_flat_rows(spark):
    assert legal.merged_config({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 9}, "e": 1}) == {"a": {"b": 9, "c": 2}, "d": 3, "e": 1}
    assert legal.cut_json_string('"a \\"q\\" \\u05d') == 'a "q" ' and legal.cut_json_string('"done" , 1').startswith("done")
    df = spark.createDataFrame([(1, ["a", "b"], None), (2, None, "x")], "id long, l array<string>, t string")
    flat = legal.flat_scalars(df)
    assert [tuple(r) for r in flat.orderBy("id").collect()] == [(1, '["a","b"]', ""), (2, "", "x")]
    assert [tuple(r) for r in legal.from_flat(flat, "id long, l array<string>, t string").orderBy("id").collect()] == [(1, ["a", "b"], None), (2, None, "x")]


def test_numbers_of_whole_texts_by_a_plain_scan(spark, sf_dir):
    def plain(text):
        found, at = set(), 0
        while m := re.compile("[0-9]").search(text, at):
            a = m.start()
            if a and text[a - 1] in "0123456789.,":
                at = a + 1
                continue
            b = a
            while b < len(text) and text[b].isascii() and text[b].isdigit():
                b += 1
            end = b
            if b - a <= 3:  # thousands
                while re.fullmatch(",[0-9]{3}", text[end : end + 4]):
                    end += 4
                while end > b and text[end : end + 1].isascii() and text[end : end + 1].isdigit():
                    end -= 4
            if end == b and re.match("[.][0-9]", text[b : b + 2]):
                end = b + 1
                while end < len(text) and text[end].isascii() and text[end].isdigit():
                    end += 1
            found.add(text[a:end].replace(",", ""))
            at = end
        return found

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = {r.doc_id: set(r.numbers.split(" ")) - {""} for r in text_plans.numbers_in_text(spark, sf_dir).collect()}
    assert rows == {i: plain(t) for i, t in texts.items() if re.search("[0-9]", t)}


def test_mail_that_cannot_be_read_and_bodies_once(spark):
    assert markup.read_mail(None)["reason"] == "no content"
    bad = markup.read_mail(b"Content-Type: text/plain; charset=no-such\r\n\r\nx")
    assert bad["body"] == "" and bad["reason"].startswith("LookupError")
    html = spark.createDataFrame([("a<script>x<p>" + "<" * 50_000,)], "h string").select(markup.html_to_text(F.col("h")).alias("x")).first().x
    assert html.strip() == "a"
    df = spark.createDataFrame([(1, "long body"), (2, "long body"), (3, "s"), (4, "s"), (5, None)], "id long, b string")
    got = dedupe.dedupe_bodies(df, F.col("b"), F.length("b"), "id", ["id"], 5)
    assert sorted(r.id for r in got.collect()) == ["1", "3", "4", "5"]


def test_parts_are_merged_in_order(spark, tmp_path):
    for n in range(3):
        spark.range(n * 10, n * 10 + 10).coalesce(1).write.parquet(str(tmp_path / f"p{n}"))
    assert retrieval.merge_parts(spark, [str(tmp_path / f"p{n}") for n in (2, 0, 1)], str(tmp_path / "out")) == 30
    assert [r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [*range(20, 30), *range(20)]
    assert T.CODE_PAGES
