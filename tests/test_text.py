"""Truth tables of the scalar text rules."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.functions import text as T
from foliospark.sources import page_ranges


def values(spark, fragment, xs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string")
    return [r["y"] for r in rows.select("i", T.column(fragment).alias("y")).orderBy("i").collect()]


CASES = {
    "cjk_spaces": [("总 则 与 范 围", "总则与范围"), ("1总则", "1 总则"), ("第三章总则", "第三章 总则"), ("范围 ， 术语", "范围，术语"), (" a b ", "a b"), ("3.3  SCOPE", "3.3 SCOPE")],
    "clean_title": [("总则 ...... ", "总则"), ("目　次", "目次"), ("附录A要求", "附录 A 要求"), ("··· 范围", "范围"), ("1 总 则……..ab", "1 总则"), ("H2O CONTENT ........", "H2O CONTENT")],
    "meaningful": [("总则", True), ("x", False), ("abcdef", False), ("see chapter two", True), ("1.2 SCOPE", True), ("1.2 Scope", False), ("subsections", False)],
    "noise": [("", True), ("  ", True), ("see www.site.org", True), ("http s://x.y", True), ("name.com/x", True), ("下 载 地 址", True), ("DL/T 1234-2010", True), ("GB 50010", True), ("1 总则 ... 5", False), ("combine", False)],
    "roman": [("iv", 4), ("IX", 9), ("iiii", 4), ("vx", 5), ("mcmxciv", 1994), ("abc", None), ("", None), (" xii ", 12)],
    "level_guess": [("1 总则", 1), ("1.1 范围", 2), ("1.1.1 术语", 3), ("1.2.3.4.5 x", 4), ("1.1.1. x", 4), ("第三章 总则", 1), ("第二节 x", 2), ("第1节 x", None), ("Chapter 2", 1), ("12、附件", 1), ("前言", 1), ("SCOPE", None)],
    "margin_token": [("(12)", 12), ("（3）", 3), ("...(IV)", 4), ("12", 12), ("(166)", 166), ("12345", None), ("a1", None), ("___9", 9)],
    "match_key": [("3.3 Scope—Übersicht", "3.3scopebersicht"), ("总 则 (A)", "总则a")],
    "glue_decimal": [("1 . 2 . 3", "1.2.3"), ("a . b", "a . b")],
    "heal_row": [("4 . 2 DETAILS (1 2)", "4.2 DETAILS (12)"), ("SCOPE 3", "SCOPE 3"), ("1 0 电气（ 3 ）", "10 电气(3)")],
    "usable": [("\ue000\ue000abc", ""), ("12 34", ""), ("  text ", "text"), ("a", "")],
    "script": [("中文目录内容", "zh"), ("contents", "en"), ("中文abcdefgh", "en")],
}


@pytest.mark.parametrize("name", CASES)
def test_rules(spark, name):
    xs, expected = zip(*CASES[name])
    assert values(spark, getattr(T, name)("x"), xs) == list(expected)


def roman_rule(s):
    known = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    total = 0
    for a, b in zip(s, [*s[1:], None]):
        total += -known[a] if b and known[a] < known[b] else known[a]
    return total


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ivxlcdm", min_size=1, max_size=12), min_size=40, max_size=60))
def test_roman_numerals_follow_the_subtractive_rule(spark, xs):
    assert values(spark, T.roman("x"), xs) == [roman_rule(x) for x in xs]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("a 1.总则（）…·-A\u3000", max_size=20), min_size=30, max_size=40))
def test_clean_title_has_no_outer_space_or_leaders(spark, xs):
    for y in values(spark, T.clean_title("x"), xs):
        assert y == y.strip() and not y.startswith("…")


def test_readable_limits(spark):
    texts = ["a" * 100 + "\x01", "a" * 50 + "\x01", "a" * 300 + "\ufffd", "a" * 100 + "\ufffd", "a" * 200 + "\ue000", "a" * 50 + "\ue000", "a"]
    assert values(spark, T.readable("x"), texts) == [True, False, True, False, True, False, False]


def test_page_ranges(spark):
    cases = [("5-8", [5, 6, 7, 8]), ("5,6，7", [5, 6, 7]), (" 5 ", [5]), ("", None), (",", []), ("8-5", None), ("0", None), ("11", None), ("x", None), ("3,1,3", [1, 3]), ("1-2-3", None), ("2 - 3", [2, 3])]
    rows = spark.createDataFrame([(i, c, 10) for i, (c, _) in enumerate(cases)], "i int, range string, max_page int")
    assert [r["pages"] for r in page_ranges.parse_ranges(rows).orderBy("i").collect()] == [e for _, e in cases]
