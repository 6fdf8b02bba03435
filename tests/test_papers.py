"""Whole papers on fixtures: which marks count, which figures, what is rescued."""

from quillmark.operators import papers as pp

ZONES = [("verbal_ability", 1, 30), ("general_awareness", 31, 50), ("numerical_ability", 51, 70), ("reasoning", 71, 100)]


def paper(spark, *lines):
    return spark.createDataFrame([("p", "\n".join(lines))], "paper string, text string")


def asked(n, mark):
    return [f"{mark(i)} What is the name of thing number {i} in this list?\n(a) one (b) two" for i in n]


def test_forms_stop_at_twenty(spark):
    """Twenty by the first form: those of the second don't count, though a number would be new."""
    rows = pp.cascade(paper(spark, *asked(range(1, 21), lambda i: f"{i}."), *asked([40], lambda i: f"Q.{i}")), "paper", "text").collect()
    assert sorted(r.qnum for r in rows) == list(range(1, 21)) and {r.kind for r in rows} == {pp.PLAIN}
    assert all(r.confidence == 1.0 and len(r.options) == 2 for r in rows)


def test_mixed_forms_and_roman_numbers(spark):
    mixed = pp.cascade(paper(spark, *asked(range(1, 6), lambda i: f"{i}."), *asked(range(6, 11), lambda i: f"[{i}]")), "paper", "text").collect()
    assert sorted(r.qnum for r in mixed) == list(range(1, 11)) and len({r.form for r in mixed}) == 2
    roman = pp.cascade(paper(spark, *asked([1, 2, 3], lambda i: ["i.", "ii.", "iii."][i - 1])), "paper", "text").collect()
    assert {(r.qnum, r.kind) for r in roman} == {(1, pp.ROMAN), (2, pp.ROMAN), (3, pp.ROMAN)}
    assert {r.confidence for r in roman} == {0.8}


def test_one_number_once_and_short_texts(spark):
    rows = pp.cascade(paper(spark, "1. What is the first of these two?", "1. What is the second of these two?", "2. Short"), "paper", "text").collect()
    assert [(r.qnum, r.question) for r in rows] == [(1, "What is the first of these two?")]


def test_gap_is_read_again(spark):
    text = paper(spark, "61. What is the sum of the first numbers?", "(a) one", "(b) two", "6Z~ What is the product of some numbers here?", "63. What is the least of these numbers?")
    found = pp.cascade(text, "paper", "text")
    assert sorted(r.qnum for r in found.collect()) == [61, 63]
    got = pp.rescued(found, text, ZONES, "paper", "text").collect()
    assert [(r.qnum, r.section, r.question_type, r.confidence) for r in got] == [(62, "numerical_ability", "math_inferred", 0.35)]
    assert "What is the product of some numbers here?" in got[0].question and "(a) one" not in got[0].question


def test_three_ways_to_a_figure(spark):
    text = paper(spark, "71.", "(a) p", "(b) q", "(c) r", "(d) s", "72. Which figure completes the pattern shown in the series?", "73. Odd one", "(a) p", "(b) q", "74. What is the capital of that country, by law?")
    got = {r.qnum: r for r in pp.figure_questions(text, "paper", "text").collect()}
    assert {n: r.method for n, r in got.items()} == {71: "minimal_text", 72: "keyword", 73: "short_text"}
    assert got[71].options == ["p", "q", "r", "s"] and (got[71].first_line, got[71].last_line) == (0, 4)


def test_papers_without_text(spark):
    none = spark.createDataFrame([("a", None), ("b", ""), ("c", "no marks at all")], "paper string, text string")
    empty = spark.createDataFrame([], "paper string, text string")
    for docs in (none, empty):
        assert pp.read_paper(docs, ZONES, "paper", "text").count() == 0
