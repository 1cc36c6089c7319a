"""Grading of mathematical answers."""

import pandas as pd
import pytest

from rolloom.functions import grading as g
from rolloom.functions import scores


@pytest.mark.parametrize(
    "given,truth,same",
    [
        ("\\frac{1}{2}", "0.5", True), ("0.5", "1/2", True), ("2/4", "1/2", False), ("1/2", "\\dfrac12", True), ("7 3/4", "31/4", True), ("31/4", "7+3/4", True),
        ("12,345", "12345", True), ("12,34", "1234", False), ("1e5", "100000", True), ("3+4", "7", False), ("7.0", "7", True), ("50\\%", "50", True), ("5 cm^2", "5", True), ("$5$ million", "5*10^6", True),
        ("(1, 2)", "(1,2)", True), ("(1, 2)", "(1, 2, 3)", False), ("[1,2)", "(1,2)", False), ("(0.5,3]", "(\\frac{1}{2}, 3]", True), ("(1,000,2)", "(1000,2)", True), ("1 or 2", "1,2", False),
        ("2x+1", "1+x*2", True), ("x^2-1", "(x-1)(x+1)", True), ("x-y", "y-x", False), ("a+b+c", "c+b+a", False), ("x/0", "1", False), ("x^{12}", "x^12", False), ("\\frac{x^{9}}{1}", "x^9", True), ("x^20", "x^19*x", False),
        ("2\\sqrt{2}", "\\sqrt{8}", True), ("\\sqrt{2}/2", "1/\\sqrt{2}", True), ("\\sqrt{2}\\sqrt{3}", "\\sqrt{6}", True), ("\\sqrt{-1}", "1", False), ("2\\pi", "pi*2", True), ("-\\infty", "-\\infty", True),
        ("\\text{Yes}", "yes", True), ("30^\\circ", "30", True), ("", "1", False), (None, "1", False), ("1", None, False), ("((((", "1", False), ("(" * 5000, "1", False), ("9" * 500, "1", False),
    ],
)
def test_answers(given, truth, same):
    assert g.grade_answer(given, truth) is same


@pytest.mark.parametrize(
    "text,named,answer",
    [
        ("So. The answer is $\\boxed{\\frac{3}{4}}$. Thanks", True, "\\frac{3}{4}"), ("We get x = 12", True, "12"), ("12 is the answer, I think", True, "12"), ("Answer: 5", True, "5"), ("none of it", False, "none of it"),
        ("The answer is maybe", False, "maybe"), ("\\boxed{1} then \\boxed{{2}}", True, "{2}"), ("\\boxed{7", False, "\\boxed{7"), ("", False, ""),
    ],
)
def test_stated(text, named, answer):
    assert g.stated_answer(text) == (named, answer)


def test_parts_and_intervals():
    assert g.tuple_parts("(1,234, 5)") == ["1234", "5"] and g.tuple_parts("[(1),2]") == ["[(1),2]"] and g.tuple_parts("") == []
    named = {"Interval(1, 2)": "[1, 2]", "Interval.Ropen(1,2)": "[1,2)", "Interval.Lopen(1,2)": "(1,2]", "Interval.open(1,2)": "(1,2)", "Interval.closed(1,2)": "Interval.closed(1,2)"}
    assert {k: g.interval_form(k) for k in named} == named
    assert g.grade_response("Step 2: \\boxed{6.28}", "2\\pi") == (True, True, "6.28")
    assert g.grade_response("\\boxed{6.2}", "2\\pi") == (False, False, "6.2") and g.grade_response(None, None) == (True, True, "")
    assert g.close_answers("Interval.open(1, 2)", "(1,2)") and g.close_answers("\\sqrt{2}", "1.41421")


def test_fractions_with_and_without_braces():
    cases = {"\\frac12": "\\frac{1}{2}", "\\frac1{72}": "\\frac{1}{72}", "\\frac{1}2": "\\frac{1}2", "\\frac1\\frac23": "\\frac1\\frac23", "a\\frac12b": "a\\frac{1}{2}b", "\\frac{": "\\frac{"}
    assert {k: scores._braced_fractions(k) for k in cases} == cases
    for bad in ("\\frac", "1\\frac", "\\frac\\frac12"):
        with pytest.raises(ValueError):
            scores._braced_fractions(bad)


def test_in_batches(spark):
    rows = spark.createDataFrame([("It is 5", "5"), (None, "5"), ("x", None)], "t string, g string")
    assert [r.g.correct for r in rows.select(g.response_grade("t", "g").alias("g")).collect()] == [True, False, False]
    assert [r.g for r in rows.select(g.grade_udf("t", "g").alias("g")).collect()] == [False, False, False]


def test_near_values_and_parts():
    assert g.close_answers("(85,14102)", "(85, 14101)") and not g.close_answers("(85,14102)", "(85, 14101)", near_parts=False)
    assert g.close_answers("(1,3)", "[1, 3.0)", near_parts=False) and g.close_answers("14102", "14101", near_parts=False)
    assert g.close_answers("\\frac{10000}{5}", "1999 4/5") and not g.close_answers("\\frac{9995}{5}", "1998 4/5")  # on the bound, and beyond
    assert g.numeric_value("1/4") == 0.25 and g.numeric_value("x") is None and g.numeric_value("9" * 390) is None


def test_answers_are_graded_once(spark, monkeypatch):
    rows = [("It is 5", "5", "5"), ("It is 5", "6", "5"), ("Step 2: \\boxed{7} is", "7", "8"), (None, None, ""), (None, "", None), ("x", "x", None), ("The answer is (1,20001)", "(1,20001)", "(1,20002)")]
    for near in (True, False):
        made = g.answer_grades(near).func(*(pd.Series(x, dtype=object) for x in zip(*rows, strict=True)))
        assert made.to_dict("split")["data"] == [[*g.grade_response(t, truth, near), g.grade_answer(a, truth)] for t, a, truth in rows]
    sent = spark.createDataFrame(rows, "t string, a string, g string").select(g.answer_grades(False)("t", "a", "g").alias("x"))
    assert [[*r.x] for r in sent.collect()] == made.to_dict("split")["data"]
    calls, whole = [], g.grade_answer
    monkeypatch.setattr(g, "grade_answer", lambda *x: calls.append(x) or whole(*x))
    assert g.answer_grades().func(*(pd.Series([x] * 50) for x in rows[0])).strict.all() and len(calls) == 1


@pytest.mark.parametrize("text", ["5", "-5", "1/2", "-1/2+3", "5.25", "3-0.5-2/4", "7+3/4", "1/0", "0/5", "00/7", "1-2/3.5", "5.", ".5", "1+", "", "--1", "1/2/3"])
def test_plain_sums_as_expressions(text):
    x = g._plain(text)
    try:
        top, below = g._Reader(text).whole()
        assert x is None or g.Fraction(*x) == g.Fraction(g._constant(top), g._constant(below))
    except ValueError:
        assert x is None or x[1] == 0
    assert (x is None) == (text in ("1-2/3.5", "5.", ".5", "1+", "", "--1", "1/2/3"))
