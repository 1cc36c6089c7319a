"""Equality of mathematical answers: plain text forms, tuples and intervals, and exact
arithmetic of what is left.

Numbers are fractions, letters are unknowns and square roots of whole numbers are kept
apart by their radicand, so two expressions are equal exactly if their difference is the
empty sum. Nothing is evaluated that is not one of these."""

from __future__ import annotations

import math
import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scores import NUMERALS, balanced_from, math_equal, tex_normal

#: Fixed wordings of the answer form.
SIGNS = (("\\%", "%"), ("\\$", "$"), ("$", ""), ("%", ""), (" or ", " , "), (" and ", " , "), ("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12"))
UNITS = ("degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard", "liter")
TEX_NAMES = {"pi": "pi", "infty": "inf", "cup": "U", "cdot": "*", "times": "*", "%": "%", "$": "$"}
#: Fixed wordings around an answer: what it follows, what follows it, and what else may lead in.
BEFORE = ("answer:", "answer is", "answers are")
AFTER = ("is answer", "is the answer", "are answers", "are the answers")
LEAD_IN = ("be ", "is ", "are ", "=", ": ", "get ", "be\n", "is\n", "are\n", ":\n", "get\n")
INTERVALS = {"Interval": "[]", "Interval.Ropen": "[)", "Interval.Lopen": "(]", "Interval.open": "()"}
BRACKETS = "()[]"
_TEXT = re.compile(r"^\\text\{(.+?)\}$")
_UNIT, _UNITS = re.compile("|".join(UNITS)), [re.compile(unit + r"(es)?(s)? *(\^[0-9]+)?") for unit in UNITS]
_ARG = r"\s*(?:\{([^{}]*)\}|([^\s{}\\]))"
_FRACTION_OF, _ROOT_OF = re.compile(rf"\\frac{_ARG}{_ARG}"), re.compile(rf"\\sqrt{_ARG}")
_THOUSANDS = re.compile(r"(\d),(\d\d\d)(?!\d)")


# -- text forms ----------------------------------------------------------------------


def plain_tex(text: str) -> str:
    """LaTeX as a line of text: fractions with a stroke, roots by name, no braces."""
    text = re.sub(r"\\[td]?frac", r" \\frac", text) if "frac" in text else text
    text = re.sub(r"\\(?:left|right|[,;!])", "", text)
    while True:  # innermost braces first
        made = _FRACTION_OF.sub(lambda m: f"{m[1] or m[2] or ''}/{m[3] or m[4] or ''}", text) if "\\frac" in text else text
        made = _ROOT_OF.sub(lambda m: f"sqrt({m[1] or m[2] or ''})", made) if "\\sqrt" in made else made
        made = re.sub(r"\\(?:text|mathrm|mbox|textbf)\{([^{}]*)\}", r"\1", made) if "\\" in made else made
        made = re.sub(r"(?<![a-z])\{([^{}]*)\}", r"\1", made) if made == text and "{" in made else made
        if made == text:
            break
        text = made
    return (re.sub(r"\\([A-Za-z]+|.)", lambda m: TEX_NAMES.get(m[1], ""), text) if "\\" in text else text).strip()


def whole_number(text: str) -> int | None:
    """The integer that a literal names, thousands apart or not, to within 1e-7."""
    try:
        x = float(joined_thousands(text))
        return round(x) if abs(x - round(x)) <= 1e-7 else None
    except (ValueError, OverflowError):
        return None


def joined_thousands(text: str) -> str:
    """Commas go that stand between a digit and three digits; commas of tuples stay."""
    before = None
    while text != before and "," in text:
        before, text = text, _THOUSANDS.sub(r"\1\2", text)
    return text


def _without_signs(text: str) -> str:
    """Without money, percent, degrees and units, numbers by name as powers."""
    if m := _TEXT.search(text):
        text = m[1]
    for old, new in SIGNS:
        text = text.replace(old, new)
    for unit in _UNITS if _UNIT.search(text) else ():
        text = unit.sub("", text)
    text = re.sub(r"\^ *\\circ", "", text) if "\\circ" in text else text
    if text.startswith("{") and text.endswith("}"):
        text = text[1:-1]
    text = re.sub(r",\\! *", "", text) if ",\\!" in text else text
    return text


def answer_form(text: str | None) -> str | None:
    """The text in which answers are compared."""
    if text is None:
        return None
    if not NUMERALS.fullmatch(text):
        text = _without_signs(text)
    try:
        x = float(text)
        text = str(round(x)) if abs(x - round(x)) <= 1e-7 else text
    except (ValueError, OverflowError):
        pass
    if "\\" in text:
        text = plain_tex(text)
    if " " in text:
        text = re.sub("([0-9]) +([0-9])", r"\1+\2", re.sub("- *", "-", text))  # a mixed number is a sum
    text = text.lower()
    n = whole_number(text)
    return text if n is None else str(n)


def tuple_parts(text: str) -> list[str]:
    """What a tuple or an interval holds, or the text itself."""
    text = joined_thousands(text)
    if not text:
        return []
    inner = text[1:-1]
    if len(text) > 2 and text[0] in BRACKETS and text[-1] in BRACKETS and not set(inner) & set(BRACKETS):
        return [part.strip() for part in inner.split(",")]
    return [text]


def interval_form(text: str) -> str:
    """Named intervals with brackets."""
    m = text.startswith("Interval") and re.match(r"^(Interval(?:\.[RL]?open)?)\((.*)\)$", text)
    return INTERVALS[m[1]][0] + m[2] + INTERVALS[m[1]][1] if m and m[1] in INTERVALS else text


# -- exact arithmetic ----------------------------------------------------------------

#: A sum of terms: (unknowns with their powers, radicand without squares) -> factor, whole or not.
Sum = dict[tuple[tuple[tuple[str, int], ...], int], Fraction | int]
UNIT = (), 1
MOST_TERMS, MOST_LENGTH, MOST_POWER = 300, 400, 60


_PRIMES = [n for n in range(2, 1000) if all(n % p for p in range(2, math.isqrt(n) + 1))]


def _square_part(n: int) -> tuple[int, int]:
    """``a, r`` with ``n = a * a * r``, r without squares (of primes below 1000, or itself a square)."""
    outside, rest = 1, n
    if (root := math.isqrt(n)) ** 2 == n:
        return root, 1
    for p in _PRIMES:
        if p * p > rest:
            break
        while rest % (p * p) == 0:
            outside, rest = outside * p, rest // (p * p)
    return outside, rest


def _add(x: Sum, y: Sum, sign: int = 1) -> Sum:
    out = dict(x)
    for k, v in y.items():
        out[k] = out.get(k, 0) + (v if sign > 0 else -v)
    return {k: v for k, v in out.items() if v}


def _times(x: Sum, y: Sum) -> Sum:
    if len(x) * len(y) > MOST_TERMS:
        raise ValueError("too many terms")
    if len(x) == 1 and UNIT in x:
        x, y = y, x
    if len(y) == 1 and UNIT in y:  # by a number
        w = y[UNIT]
        return x if w == 1 else {k: v * w for k, v in x.items()}
    out: Sum = {}
    for (a, r), v in x.items():
        for (b, s), w in y.items():
            powers = dict(a)
            for name, n in b:
                powers[name] = powers.get(name, 0) + n
            outside, rest = (1, r * s) if r == 1 or s == 1 else _square_part(r * s)
            key = tuple(sorted((n, p) for n, p in powers.items() if p)), rest
            out[key] = out.get(key, 0) + v * w * outside
    return {k: v for k, v in out.items() if v}


def _number(x: Fraction | int) -> Sum:
    return {UNIT: x} if x else {}


ONE = _number(1)


class _Reader:
    """Reads an expression as a quotient of two sums."""

    PARTS, LITERAL, FACTOR = re.compile(r"\d+\.?\d*|\.\d+|sqrt|pi|[a-z]|[-+*/^()]|\S"), re.compile(r"\d+\.?\d*|\.\d+"), re.compile(r"[\d.a-z(]")

    def __init__(self, text: str):
        self.parts = [*self.PARTS.findall(text), None]
        self.at = 0

    def next(self) -> str | None:
        return self.parts[self.at]

    def take(self, *wanted: str) -> str | None:
        part = self.parts[self.at]
        if part in wanted:
            self.at += 1
            return part
        return None

    def whole(self) -> tuple[Sum, Sum]:
        out = self.sum()
        if self.next() is not None:
            raise ValueError("not an expression")
        return out

    def sum(self):
        out = self.product()
        while sign := self.take("+", "-"):
            (a, b), (c, d) = out, self.product()
            if b is ONE and d is ONE and max(len(a), len(c)) <= MOST_TERMS:
                out = _add(a, c, 1 if sign == "+" else -1), ONE
                continue
            out = _add(_times(a, d), _times(c, b), 1 if sign == "+" else -1), _times(b, d)
        return out

    def product(self):
        out = self.signed()
        while True:
            if sign := self.take("*", "/"):
                a, b = self.signed()
            elif self.next() is not None and self.FACTOR.match(self.next()):
                sign, (a, b) = "*", self.power()
            else:
                return out
            if sign == "/":
                a, b = b, a
            if not b:
                raise ValueError("division by zero")
            out = _times(out[0], a), _times(out[1], b)

    def signed(self):
        if self.take("-"):
            a, b = self.signed()
            return _times(a, _number(-1)), b
        return self.signed() if self.take("+") else self.power()

    def power(self):
        base = self.atom()
        if not self.take("^"):
            return base
        top, below = self.signed()
        power = Fraction(_constant(top), _constant(below))
        if power.denominator != 1 or abs(power) > MOST_POWER:
            raise ValueError("not a small whole power")
        if power < 0:
            base = base[1], base[0]
        if not base[1]:
            raise ValueError("division by zero")
        out = ONE, ONE
        for _ in range(abs(int(power))):
            out = _times(out[0], base[0]), _times(out[1], base[1])
        return out

    def atom(self):
        part = self.next()
        if part is None:
            raise ValueError("not an expression")
        self.at += 1
        if part == "(":
            out = self.sum()
            if not self.take(")"):
                raise ValueError("an open bracket")
            return out
        if part == "sqrt":
            a, b = self.atom()
            under = Fraction(_constant(a), _constant(b))
            if under < 0:
                raise ValueError("root of a negative number")
            outside, rest = _square_part(under.numerator * under.denominator)
            return ({((), rest): Fraction(outside, under.denominator)} if under else {}), ONE
        if part and self.LITERAL.fullmatch(part):
            part = part.rstrip(".")
            return _number(Fraction(part) if "." in part else int(part)), ONE
        if part and part.isalpha():
            return {(((part, 1),), 1): 1}, ONE
        raise ValueError("not an expression")


def _constant(x: Sum) -> Fraction | int:
    if len(x) > (UNIT in x):
        raise ValueError("not a rational number")
    return x.get(UNIT, 0)


_TERM = re.compile(r"(-?)(\d+)(?:/(\d+)|\.(\d+))?", re.ASCII)
#: What most answers are: a number, a fraction of two, or a sum of these.
_PLAIN = re.compile(r"-?\d+(?:/\d+|\.\d+)?(?:[-+]\d+(?:/\d+|\.\d+)?)*", re.ASCII)


def _plain(text: str) -> tuple[int, int] | None:
    """Such a sum as a quotient, by a shorter way than reading it as an expression."""
    if not _PLAIN.fullmatch(text):
        return None
    top, below = 0, 1
    for sign, n, d, tenths in _TERM.findall(text):
        n, d = (int(n + tenths), 10 ** len(tenths)) if tenths else (int(n), int(d or 1))
        top, below = (top * d - n * below if sign else top * d + n * below), below * d
    return top, below


def same_value(a: str, b: str) -> bool:
    """Whether two expressions of at most two letters are equal for all their unknowns.
    Stacked, bracketed and large powers are not looked at."""
    text = f"({a})-({b})"
    if len(text) > MOST_LENGTH or "^" in text and ("^{" in text or "^(" in text or re.search(r"\^[0-9]+\^|\^[0-9][0-9]+", text)):
        return False
    if (x := _plain(a)) and (y := _plain(b)):
        return x[1] * y[1] != 0 and x[0] * y[1] == y[0] * x[1]
    letters = set(text.replace("sqrt", "").replace("frac", ""))
    if sum(map(str.isalpha, letters)) > 2:
        return False
    try:
        return not _Reader(text).whole()[0]
    except (ValueError, ZeroDivisionError, RecursionError):
        return False


def numeric_value(text: str) -> float | None:
    """The value of an expression without unknowns but pi."""
    x = _value(text)
    return None if x is None else float(x)


def _value(text: str) -> Fraction | float | None:
    """As ``numeric_value``, rational numbers as they are."""
    if len(text) > MOST_LENGTH:
        return None
    try:
        text = answer_form(text) or ""
        if x := _plain(text):
            top, below = _number(x[0]), _number(x[1])
        else:
            top, below = _Reader(text).whole()
        if len(top) == (UNIT in top) and len(below) == (UNIT in below):
            x = Fraction(_constant(top), _constant(below))
            return x if math.isfinite(float(x)) else None
        at = lambda s: sum(float(v) * math.sqrt(r) * math.prod({"pi": math.pi}[n] ** p for n, p in a) for (a, r), v in s.items())
        return at(top) / at(below)
    except (ValueError, KeyError, ZeroDivisionError, OverflowError, RecursionError):
        return None


# -- grades --------------------------------------------------------------------------

FRACTION = re.compile(r"^-?[0-9]+.?/0*[1-9][0-9]*.?$")


def grade_answer(given: str | None, truth: str | None) -> bool:
    """Whether an answer is the truth: the same text in either normal form, or, part by part
    of tuples with the same brackets, the same value. Fractions have to be as reduced as the
    truth's, and a whole number is only matched by itself."""
    if given is None or truth is None:
        return False
    if _tex_form(given) == _tex_form(truth):
        return True
    a, b = answer_form(given), answer_form(truth)
    if a == b:
        return True
    if not a:
        return False
    mine, theirs = tuple_parts(a), tuple_parts(b)
    if len(mine) != len(theirs) or (len(theirs) > 1 and (a[0], a[-1]) != (b[0], b[-1])):
        return False
    return all(_same_part(x, y) for x, y in zip(mine, theirs, strict=True))


def _same_part(x: str, y: str) -> bool:
    if "/" in x and "/" in y and FRACTION.search(x) and FRACTION.search(y):
        return x == y
    if (whole_number(x) is None) != (whole_number(y) is None):
        return False
    return same_value(y, x)


def _tex_form(text: str) -> str:
    text = text.strip()
    if m := _TEXT.search(text):
        text = m[1].strip()
    try:
        return tex_normal(text)
    except (ValueError, IndexError):
        return text


def stated_answer(text: str) -> tuple[bool, str]:
    """Whether a response names an answer with a digit, and the part that does: after the
    last lead-in, within the last box."""
    named, lower = False, text.lower()
    for words, place in ((BEFORE, -1), (AFTER, 0)) if "answer" in lower else ():
        for w in words:
            at = lower.rfind(w)
            if at >= 0:
                named, text = True, (text[at + len(w) :] if place else text[:at]).strip()
                lower = text.lower()
    at = max(text.rfind("\\boxed"), -1)
    at = at if at >= 0 else text.rfind("\\fbox")
    box = balanced_from(text, at) if at >= 0 else None
    if box and (inner := box[box.index("{") + 1 : -1].strip()):
        named, text = True, inner
    text = text.rpartition(". ")[0].strip() if ". " in text else text
    lower = text.lower()
    for w in LEAD_IN:
        at = lower.rfind(w)
        if at >= 0:
            named, text = True, text[at + len(w) :].strip()
            lower = text.lower()
    return named and any(c.isdigit() for c in text), text


def close_answers(a: str, b: str, near_parts: bool = True) -> bool:
    """As ``math_equal``, also for named intervals, roots and multiples of pi (3.14 will do).
    Without ``near_parts`` only lone values may be near; parts of tuples have to be the same."""
    a, b = interval_form(a.strip()), interval_form(b.strip())
    exact = not near_parts and _bracketed(a) and _bracketed(b)
    if math_equal(a, b, percent=not exact, tolerance=0.0 if exact else 1e-4):
        return True
    x, y = _value(a), _value(b)
    if x is None or y is None:
        return False
    if isinstance(x, Fraction) and isinstance(y, Fraction) and "\\pi" not in a and "\\pi" not in b:
        return _near_rational(x, y)
    x, y, loose = float(x), float(y), 3.14 / math.pi if "\\pi" in a or "\\pi" in b else 1.0
    near = lambda p, q: math.isclose(p, q, rel_tol=1e-4)
    return any(near(x, z * f) or near(x * f, z) for z in (y, y / 100, y * 100) for f in (1.0, loose))


def _bracketed(text: str) -> bool:
    return len(text) > 2 and text[0] in "([" and text[-1] in ")]"


def _near_rational(x: Fraction, y: Fraction) -> bool:
    """Within 1e-4 of the larger, or of a hundred times more or less; in whole numbers, as they may lie on the bound."""
    p, q = x.numerator * y.denominator, y.numerator * x.denominator
    return any(abs(s * p - t * q) * 10_000 <= max(abs(s * p), abs(t * q)) for s, t in ((1, 1), (100, 1), (1, 100)))


def grade_response(text: str | None, truth: str | None, near_parts: bool = True) -> tuple[bool, bool, str]:
    """``correct, formatted, answer`` of a whole response."""
    text, truth = text or "", truth or ""
    _, answer = stated_answer(text)
    if grade_answer(answer, truth):
        return True, True, answer
    return close_answers(answer, truth, near_parts), in_form(text), answer


def in_form(text: str) -> bool:
    """Whether a wrong response has at least the form."""
    return "Step 2:" in text and "\\box" in text


@F.pandas_udf(T.BooleanType())
def grade_udf(given: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series([grade_answer(a, b) for a, b in zip(given, truth, strict=True)], dtype=bool)


GRADE = T.StructType([T.StructField("correct", T.BooleanType()), T.StructField("formatted", T.BooleanType()), T.StructField("answer", T.StringType())])


@F.pandas_udf(GRADE)
def response_grade(text: pd.Series, truth: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([grade_response(a, b) for a, b in zip(text, truth, strict=True)], columns=GRADE.names)


def answer_grades(near_parts: bool = True):
    """A function of responses, the answers they should state, and truths: ``response_grade`` and, as ``strict``,
    ``grade_udf`` of the answer, which is graded once where the response states it. ``near_parts`` as in ``close_answers``."""
    made = T.StructType([*GRADE, T.StructField("strict", T.BooleanType())])

    def grade(text: str | None, given: str | None, truth: str | None, known: dict) -> tuple[bool, bool, str, bool]:
        _, answer = stated_answer(text or "")
        key = answer, truth or ""
        if key not in known:
            known[key] = (same := grade_answer(*key)), same or close_answers(*key, near_parts)
        same, correct = known[key]
        strict = same if given == answer and truth is not None else grade_answer(given, truth)
        return correct, same or in_form(text or ""), answer, strict

    @F.pandas_udf(made)
    def graded(text: pd.Series, given: pd.Series, truth: pd.Series) -> pd.DataFrame:
        known: dict[tuple[str, str], tuple[bool, bool]] = {}  # of this batch: answers of a prompt recur
        rows = [grade(*row, known) for row in zip(text, given, truth, strict=True)]
        return pd.DataFrame({f.name: pd.Series([r[i] for r in rows], dtype=object if f.name == "answer" else bool) for i, f in enumerate(made)})

    return graded
