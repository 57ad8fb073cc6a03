import pytest
from pyspark.sql import functions as F

from quarry.functions import answers as A


@pytest.mark.parametrize(
    "f, given, want",
    [
        (A.clauses, "Who signs the deed, and when does the term begin?", ["Who signs the deed", "when does the term begin?"]),
        (A.clauses, "Who signs the deed?", []),
        (A.case_citations, 'ראו ע״א 1234/05 וגם ע"א 1234/05 ו 12 F.Supp 345', ['ע"א 1234/05', "12 F.Supp 345"]),
        (lambda c: A.replace_words(c, {"tax": "levy", "income tax": "revenue"}), "income tax and tax [[CITE: claim=tax]] taxes", "revenue and levy [[CITE: claim=tax]] taxes"),
        (A.json_object, 'Here: {"a": 1} done', '{"a": 1}'),
        (A.json_object, "```json\n{\"a\": [1]}\n``` {", '{"a": [1]}'),
        (A.json_object, "none {", None),
        (A.conclusion_first, "Because.\nConclusion: yes", "yes\nBecause."),
        (A.drop_empty_headings, "Text\n\n## Conclusion\n", "Text"),
        (A.repeated_sentences_once, "One. Two. One.", "One. Two."),
        (lambda c: A.answer_kind(c, F.lit("judge")), "Yes, always", "yes_no"),
        (lambda c: A.answer_kind(c, F.lit("judge")), "1,250 NIS", "value"),
        (lambda c: A.answer_kind(c, F.lit("judge")), "1. a 2. b 3. c", "list"),
    ],
)
def test_answers(spark, f, given, want):
    assert spark.createDataFrame([(given,)], "t string").select(f(F.col("t")).alias("x")).first().x == want


def test_options_and_attempts(spark):
    df = spark.createDataFrame([("Q?", ["x", "y"])], "q string, o array<string>")
    assert df.select(A.question_with_options(F.col("q"), F.col("o")).alias("x")).first().x == "Q?\nA) x\nB) y"
    tries = spark.createDataFrame([(1, "a", 0.4), (1, "b", 0.9)], "p long, t string, c double")
    assert [tuple(r) for r in A.keep_best_attempt(tries, "p", "t", "c").collect()] == [(1, "b", 0.9)]
