"""Text functions on small rows in the languages that the given tables lack."""

import re

import pytest
from pyspark.sql import functions as F

from quarry.functions import casts, dates, hashing
from quarry.functions import text as T


def one(spark, f, *values, kinds=None):
    kinds = kinds or ["string"] * len(values)
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize(
    "f, given, want",
    [
        (T.strip_points, "שָׁלוֹם־עוֹלָם", "שלום־עולם"),
        (T.normalize_for_index, "חוק־יסוד  ״כבוד״ האדם", 'חוק-יסוד "כבוד" האדמ'),
        (T.normalize_for_embedding, 'תשכ"ב', "תשכ״ב"),
        (T.law_key, "חוק הכשרות המשפטית, התשכ״ב–1962", "חוק כשרות משפטית"),
        (T.law_key, None, ""),
        (T.law_year, "חוק 1948 ותיקון 2003", "2003"),
        (T.language_by_letters, "שלום ab", "he"),
        (T.language_by_letters, "123", "unknown"),
        (T.hebrew_ratio, "שלab", 0.5),
        (T.hebrew_ratio, "12", 0.0),
        (T.looks_mojibake, "çå÷ éñåã", True),
        (T.looks_mojibake, "חוק יסוד", False),
        (T.normalize_whitespace, "  a \t b\n\n\n\nc  ", "a b\n\nc"),
        (T.normalize_unicode, "é\x00\x07x", "éx"),
        (T.dedupe_key, "a‏  b\n", "a b"),
        (T.normalize_lines, "a\r\n  b \x0c\n\n\n\nc‎", "a\n b\n\nc".replace("\n b", "\nb")),
        (T.visual_to_logical, "קוח 123", "123 חוק"),
        (T.base_section, "62(c)", "62"),
        (T.cited_sections, "see section 5a, Sections 12 and section 5a", ["5a", "12"]),
        (T.numbers, "1,250 and 3.5 or 1,250", ["1250", "3.5"]),
        (T.number_values, "2.5 million", [2.5, 2500000.0]),
        (T.cell_number, " 1,250 ", 1250.0),
        (T.cell_number, "x", None),
        (T.yes_no, "Yes, it is", "yes"),
        (T.yes_no, "perhaps", None),
        (T.mcq_letter, "The answer is (c)", "C"),
        (T.mcq_letter, "b) because", "B"),
        (T.strip_citations, "A fact [[CITE: claim=1 | source=x]] .", "A fact."),
        (T.template_tokens_to_space, "a<|im_end|>b", "a b"),
        (T.numbered_items, "1. a, 2) b; 3. c", ["a", "b", "c"]),
        (T.case_tokens, 'ע"א 1234/05 הבית', ['ע"א', "1234/05", "הבית", "בית"]),
        (T.prefix_variants, "הבית", ["הבית", "בית"]),
        (T.paragraphs, "a\n\n b \n \n\nc", ["a", "b", "c"]),
        (T.dominant_rtl, "שלום a", "he"),
        (casts.as_bool, " Yes ", True),
        (casts.as_bool, "לא", False),
        (casts.as_bool, "maybe", None),
        (casts.as_int, "12.7", 12),
        (casts.as_int, "x", None),
        (casts.as_list, "['a', 'b']", ["a", "b"]),
        (casts.as_list, "a; b,c", ["a", "b,c"]),
        (casts.as_list, None, []),
        (casts.as_str, "  ", None),
        (casts.iso_date, "1709251200000", "2024-03-01"),
        (casts.iso_date, "2024-03-01T10:00", "2024-03-01"),
        (casts.ymd, "2024-03-01", 20240301),
        (casts.ymd_to_iso, "20240301", "2024-03-01"),
        (casts.ymd_to_iso, "x", ""),
        (dates.parse_year, "2003-07", 2003),
    ],
)
def test_scalar(spark, f, given, want):
    assert one(spark, f, given) == want


def test_two_columns(spark):
    assert one(spark, T.dehyphenate, "exam-\nple", "en") == "example"
    assert one(spark, T.dehyphenate, "exam-\nple", "he") == "exam-\nple"
    assert one(spark, T.unsupported_numbers, "18 or 2,500,000 or 7", "2.5 million and 18%") == ["7"]
    assert one(spark, T.merge_overlap, "x" * 30 + "the end of a first part", "the end of a first part goes on") == "goes on"
    assert one(spark, casts.first_value, " ", "b") == "b"
    assert one(spark, lambda p, n: casts.source_url("https://h/", p, n), "a\\b//", "c d.pdf") == "https://h/a/b/c%20d.pdf"
    assert one(spark, lambda p, n: casts.source_url("https://h/", p, n), None, None) is None


@pytest.mark.parametrize(
    "given, shifted, want",
    [
        ("2003-07-08T19:00", True, "2003-07-09"), ("2003-07-09 03:00", True, "2003-07-09"), ("2003-07-08T19:00", False, "2003-07-08"), ("8/7/2003", False, "2003-07-08"),
        ("20030708", False, "2003-07-08"), ("2003-07-08T23:30:00Z", False, "2003-07-09"), ("2003-02-30", False, None), ("soon", False, None), (None, False, None),
    ],
)
def test_dates(spark, given, shifted, want):
    got = one(spark, lambda c: dates.parse_date(c, shifted), given)
    assert (str(got) if got else None) == want


def test_date_choice(spark):
    pick = lambda a, b, y, case: one(spark, lambda p, q, r, s: dates.resolve_date([("a", dates.parse_date(p)), ("b", dates.parse_date(q))], r, dates.parse_date(s), "1948-01-01"), a, b, y, case)
    assert tuple(map(str, pick("1920-01-01", "2003-05-01", "2003", "1900-01-01"))) == ("2003-05-01", "b")
    assert tuple(map(str, pick("2001-01-01", None, "2004", "2003-01-01"))) == ("2004-01-01", "Year")
    assert pick(None, None, "1900", None) is None
    assert str(one(spark, dates.first_date, "on 31.2.2020 or 5.3.2021 or 2022-01-01")) == "2021-03-05"


def test_citations_masks_and_encoding(spark):
    got = one(spark, T.citation_tokens, 'x [[CITE: claim=c1 | source="s 1"]] y [[CITE: source=s2 | relation=supports]]')
    assert [tuple(g) for g in got] == [("c1", "s 1", None), (None, "s2", "supports")]
    text = "cost $x+1$ of 5 kg for {name} 12 times 3"
    m = one(spark, T.mask_spans, text)
    assert "[[FORMULA_0]]" in m.text and "[[UNIT_0]]" in m.text and "[[NUM_1]]" in m.text
    df = spark.createDataFrame([(m.text, m.spans)], "t string, s array<string>")
    assert df.select(T.unmask("t", "s").alias("x")).first().x == text
    line = "חוק יסוד כבוד האדם וחירותו"
    r = one(spark, T.repair_encoding, line.encode("cp1255").decode("latin-1") + "\nplain")
    assert (r.text, r.method) == (line + "\nplain", "latin-1")
    assert one(spark, T.repair_encoding, None).method == "none"


def test_hashes(spark):
    a, b = (one(spark, hashing.record_hash, "x", v) for v in ("y", None))
    assert a != b and len(a) == 64
    assert hashing.config_hash({"a": 1, "b": 2}) == hashing.config_hash({"b": 2, "a": 1})
    assert one(spark, hashing.signature(b"k"), "text") != one(spark, hashing.signature(b"j"), "text")


def test_characters_of_a_class_are_counted_without_a_list_of_them(spark):
    odd = ["", None, "אב גd 12", "a\nb\r\n𐐷é^-]", "no-digits", "Ã¤Â", "שלום " * 50]
    df = spark.createDataFrame([(x,) for x in odd], "x string")
    for pattern in (r"\p{L}", T.HEBREW, "[A-Za-z]", T.SUSPECT, "[؀-ۿ]", "[^\x00-ɏ]", r"[\p{L}0-9]"):
        slow = F.regexp_count("x", F.lit(pattern))
        assert all(r[0] == r[1] for r in df.select(T.count_of(F.col("x"), pattern), slow).collect()), pattern
    assert "regexp_count" not in str(T.letter_count(F.col("x"))) + str(T.hebrew_ratio(F.col("x"))) + str(T.language_by_letters(F.col("x")))
    assert [r[0] for r in df.select(T.hebrew_ratio(F.col("x"))).collect()] == [0.0, 0.0, 0.75, 0.0, 0.0, 0.0, 1.0]


def test_normal_forms_translate_once(spark):
    odd = ["", None, " a  b\tc \t d ", "“שלום”  ׳ץ׳ ־ ף", "plain text, nothing to do", "\t\tx\t", "''׳׳ ״", "ךםןףץ„″‘’′"]
    df = spark.createDataFrame([(x,) for x in odd], "x string")
    c = F.col("x")
    slow = F.translate(F.translate(T.ascii_quotes(T.strip_points(c)), "־", "-"), *T.FINALS)
    was = T.strip(F.regexp_replace(slow, r"[ \t]+", " "))
    shown = F.replace(F.translate(T.strip_points(c), "“”„″‘’′", "\"\"\"\"'''"), F.lit('"'), F.lit("״"))
    assert all(r[0] == r[1] and r[2] == r[3] for r in df.select(T.normalize_for_index(c), was, T.normalize_for_embedding(c), shown).collect())
    assert str(T.normalize_for_index(c)).count("translate(") == 1


def test_normal_forms_of_marked_and_plain_texts(spark):
    texts = ["", " ", "a  b\t c ", "plain", " é  x ", 'שָׁלוֹם "ab" ״כ״', "“q” ‘r’ „s‟ ′t″", "מלך־ם ", "é 'x'", "\n\ny\n", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    points = re.compile(T.POINTS)
    marks = str.maketrans(T.ASCII_QUOTES[0] + "־" + T.FINALS[0], T.ASCII_QUOTES[1] + "-" + T.FINALS[1])
    for r in df.select("t", T.normalize_for_index(F.col("t")).alias("x"), T.normalize_for_embedding(F.col("t")).alias("e")).collect():
        if r.t is None:
            assert r.x is None and r.e is None
            continue
        bare = points.sub("", r.t)
        assert r.x == re.sub(r"\t[ \t]*| [ \t]+", " ", bare.translate(marks)).strip()
        assert r.e == bare.translate(str.maketrans("“”„″‘’′", "\"\"\"\"'''")).replace('"', "״")
