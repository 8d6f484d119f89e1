"""Scalar text rules of tables of contents, as SQL fragments for either dialect.

Each function takes a SQL expression and gives a SQL expression; column() turns one into a
Spark Column.  Fixed character classes and word lists stand together at the top.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.sql import SPARK, SparkDialect

# Fixed values.
SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CJK = r"\x{4e00}-\x{9fa5}"
CJK_WIDE = r"\x{4e00}-\x{9fff}"
NUMERAL = "零一二三四五六七八九十百"
LEADER = r".·…\-_﹍"
NOT_WORD = r"[^\p{L}\p{N}_]"
STRUCTURE_WORDS = "chapter|part|section|appendix|index|contents|annex"
PROMOTION = ("下载地址", "关注微信", "公众号")
DOMAINS = "com|cn|net|org"
STANDARDS = "dl|gb|iso|iec|ieee|gjb|q/"
FRONT_MATTER = "附录|参考文献|致谢|前言|序|后记|索引|目次|目录|编制说明"
SPECIAL_TITLES = ("目次", "目录", "前言", "序言", "编制说明")
CONTENTS_TITLES = ("目次", "目录")
PREFACE_TITLES = ("前言", "序言", "编制说明")
CONTENTS_KEYWORDS = ("目录", "目次", "contents", "tableofcontents", "总目")
ROMAN = (("i", 1, "vxlcdm"), ("v", 5, "xlcdm"), ("x", 10, "lcdm"), ("l", 50, "cdm"), ("c", 100, "dm"), ("d", 500, "m"), ("m", 1000, ""))
ROMAN_TOKEN = "[IVXLCDMivxlcdm]"
ANCHORS = (
    rf"第[{NUMERAL}\p{{Nd}}]+[章节]|\p{{Nd}}+\.\p{{Nd}}+(?:\.\p{{Nd}}+)?|\p{{Nd}}{{1,2}}[{SPACE}]*[A-Za-z{CJK}]|"
    rf"前[{SPACE}\-_—–一]*言?|目[{SPACE}]*次|目[{SPACE}]*录|附[{SPACE}]*录[A-Za-z0-9{CJK}]*|参考文献|编制说明|致谢|引言|序言"
)


def column(fragment: str) -> Column:
    return F.expr(fragment)


def strip(x: str, d: SparkDialect = SPARK) -> str:
    return d.replace(x, rf"^[{SPACE}]+|[{SPACE}]+\z")


def compact(x: str, d: SparkDialect = SPARK) -> str:
    return d.replace(x, rf"[{SPACE}]+")


def cjk_spaces(x: str, d: SparkDialect = SPARK) -> str:
    """No spaces between ideographs or around their punctuation; one after a chapter number."""
    for _ in range(2):
        x = d.replace(x, rf"([{CJK}])[{SPACE}]+([{CJK}])", "$1$2")
    x = d.replace(x, rf"[{SPACE}]*([、，。；：！？（）《》“”])[{SPACE}]*", "$1")
    x = d.replace(x, rf"^(\p{{Nd}}{{1,3}}(?:\.\p{{Nd}}+)*|第[{NUMERAL}\p{{Nd}}]+[章节])[{SPACE}]*([A-Za-z{CJK}])", "$1 $2")
    return strip(x, d)


def generic_title(x: str, d: SparkDialect = SPARK) -> str:
    x = d.replace(d.replace(x, rf"目[{SPACE}]*次", "目次"), rf"目[{SPACE}]*录", "目录")
    return strip(d.replace(x, rf"^附录[{SPACE}]*([A-Za-z])[{SPACE}]*", "附录 $1 "), d)


def without_leaders(x: str, d: SparkDialect = SPARK) -> str:
    x = d.replace(x, rf"([{CJK}）)])[{SPACE}{LEADER}\p{{Nd}}]*[a-z{SPACE}.,\x27`\-_]{{2,}}\z", "$1")
    x = d.replace(x, rf"[{SPACE}{LEADER}:：,\x27\x22`~@#$%^&*+=]+\z")
    x = d.replace(x, rf"[{SPACE}{LEADER}]+\z")
    return strip(d.replace(x, rf"^[{SPACE}{LEADER}:：]+"), d)


def clean_title(x: str, d: SparkDialect = SPARK) -> str:
    return strip(generic_title(without_leaders(cjk_spaces(without_leaders(x, d), d), d), d), d)


def meaningful(x: str, d: SparkDialect = SPARK) -> str:
    t = "v_title"
    words = rf"(?i)(?:^|{NOT_WORD})(?:{STRUCTURE_WORDS})(?:\z|{NOT_WORD})"
    return d.let(t, strip(x, d), f"(length({t}) >= 2 AND ({d.like(t, f'[{CJK}]')} OR {d.like(t, words)} OR {d.like(t, rf'^[0-9.{SPACE}]*[A-Z][A-Z]')}))")


def noise(x: str, d: SparkDialect = SPARK) -> str:
    c = "v_line"
    address = rf"https?://|www\.|[a-z0-9_-]\.(?:{DOMAINS})(?:\z|{NOT_WORD})"
    standard = rf"^(?:{STANDARDS})[/\-_t{SPACE}\p{{Nd}}—]+\z"
    phrases = " OR ".join(f"instr({c}, '{p}') > 0" for p in PROMOTION)
    return d.let(c, f"lower({compact(x, d)})", f"({c} = '' OR {d.like(c, address)} OR {phrases} OR {d.like(c, standard)})")


def roman(x: str, d: SparkDialect = SPARK) -> str:
    """Subtractive sum without a validity check: a letter before a larger one counts negative."""
    t = "v_roman"
    parts = [f"{value} * ({d.count(t, c)}" + (f" - 2 * {d.count(t, f'{c}[{larger}]')}" if larger else "") + ")" for c, value, larger in ROMAN]
    return d.let(t, f"lower({strip(x, d)})", f"CASE WHEN {d.like(t, rf'^[ivxlcdm]+\z')} THEN CAST({' + '.join(parts)} AS INT) END")


def page_token(x: str, d: SparkDialect = SPARK) -> str:
    t = "v_token"
    return d.let(t, x, f"CASE WHEN {d.like(t, rf'^\p{{Nd}}+\z')} THEN {d.to_int(t)} ELSE {roman(t, d)} END")


def level_guess(x: str, d: SparkDialect = SPARK) -> str:
    t = "v_title"
    number = d.extract(t, r"^[\p{Nd}.]+", 0)
    rules = f"""CASE WHEN {d.like(t, r"^\p{Nd}+\.\p{Nd}+\.\p{Nd}+")} THEN least(4, CAST(length({number}) - length(replace({number}, '.', '')) + 1 AS INT))
 WHEN {d.like(t, rf"^\p{{Nd}}+\.\p{{Nd}}+(?:\z|{NOT_WORD})")} THEN 2
 WHEN {d.like(t, rf"^(?:第[{NUMERAL}]+章|Chapter[{SPACE}]*\p{{Nd}}+|\p{{Nd}}+[{SPACE}]*[A-Za-z{CJK}]|\p{{Nd}}+[.、])")} THEN 1
 WHEN {d.like(t, rf"^第[{NUMERAL}]+节")} THEN 2
 WHEN {d.like(t, rf"^(?:{FRONT_MATTER})")} THEN 1 END"""
    return d.let(t, cjk_spaces(strip(x, d), d), rules)


def heal_row(x: str, d: SparkDialect = SPARK) -> str:
    """Glue a leading number and a trailing bracketed number that were split by spaces."""
    head = rf"^[{SPACE}]*(\p{{Nd}}[\p{{Nd}}.{SPACE}]*)([A-Za-z{CJK}])"
    r = "v_row"
    x = d.let(r, x, f"CASE WHEN {d.like(r, head)} THEN {compact(d.extract(r, head, 1), d)} || ' ' || {d.replace(r, head, '$2')} ELSE {r} END")
    tail = rf"[（(][{SPACE}]*([\p{{Nd}}{SPACE}]+)[）)][{SPACE}]*\z"
    return d.let(r, x, f"CASE WHEN {d.like(r, tail)} THEN {d.replace(r, tail)} || '(' || {compact(d.extract(r, tail, 1), d)} || ')' ELSE {r} END")


def margin_token(x: str, d: SparkDialect = SPARK) -> str:
    t = d.replace(x, rf"^[.·…_\-{SPACE}]+|[.·…_\-{SPACE}]+\z")
    t = d.replace(t, rf"^[（(][{SPACE}]*|[{SPACE}]*[）)]\z")
    m = "v_margin"
    return d.let(m, t, f"CASE WHEN {d.like(m, rf'^\p{{Nd}}{{1,4}}\z')} THEN {d.to_int(m)} WHEN {d.like(m, rf'^{ROMAN_TOKEN}{{1,8}}\z')} THEN {roman(m, d)} END")


def glue_decimal(x: str, d: SparkDialect = SPARK) -> str:
    """No spaces around a dot between digits; a digit can stand on both sides, so each twice."""
    for gap in (rf"[{SPACE}]+\.[{SPACE}]*", rf"\.[{SPACE}]+"):
        for _ in range(2):
            x = d.replace(x, rf"(\p{{Nd}}){gap}(\p{{Nd}})", "$1.$2")
    return x


def match_key(x: str, d: SparkDialect = SPARK) -> str:
    return f"lower({d.replace(x, f'[^0-9A-Za-z{CJK}.]')})"


def numbered_key(key: str, d: SparkDialect = SPARK) -> str:
    return d.like(key, rf"^(?:第[{NUMERAL}\p{{Nd}}]+[章节]|\p{{Nd}}+)")


def readable(x: str, least: int = 2, d: SparkDialect = SPARK) -> str:
    """Long enough and under 1.5 % control, 1 % private-use and 0.5 % replacement characters."""
    t = "v_text"
    n = f"length({t})"
    control, private, lost = d.count(t, r"[\x{01}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}-\x{9f}]"), d.count(t, r"\p{Co}"), d.count(t, r"\x{fffd}")
    return d.let(t, strip(x, d), f"({n} >= {least} AND {control} < 0.015 * {n} AND {private} < 0.01 * {n} AND {lost} < 0.005 * {n})")


def usable(x: str, d: SparkDialect = SPARK) -> str:
    """The stripped text where it is readable and has a letter, else empty."""
    return f"CASE WHEN {readable(x, 2, d)} AND {d.like(x, r'\p{L}')} THEN {strip(x, d)} ELSE '' END"


def script(x: str, d: SparkDialect = SPARK) -> str:
    cjk, latin = d.count(x, f"[{CJK_WIDE}]"), d.count(x, "[A-Za-z]")
    return f"CASE WHEN {cjk} >= greatest(5, CAST(floor({latin} / 5) AS INT)) THEN 'zh' ELSE 'en' END"


def special(x: str, titles: tuple[str, ...] = SPECIAL_TITLES, d: SparkDialect = SPARK) -> str:
    return f"({strip(x, d)} IN ({', '.join(repr(t) for t in titles)}))"


def signed(x: str) -> str:
    return f"CASE WHEN {x} < 0 THEN '' ELSE '+' END || CAST({x} AS STRING)"


def clamp(x: str, low: object, high: object) -> str:
    return f"least(greatest({x}, {low}), {high})"


def toc_line(x: str, d: SparkDialect = SPARK) -> dict[str, str]:
    """Fragments of a hand-edited line: skip, level, title, page (null where it has none)."""
    tabs, spaces = f"length({d.extract(x, r'^(\t*)', 1)})", f"length({d.extract(x, '^( *)', 1)})"
    body = d.replace(x, r"^(?:\t+| +)")
    pattern = rf"(?s)^(.*?)[{SPACE}]+(\p{{Nd}}+)[{SPACE}]*\z"
    return {
        "skip": f"({strip(x, d)} = '' OR {strip(x, d)} LIKE '#%')",
        "level": f"least(4, CASE WHEN {tabs} > 0 THEN CAST({tabs} AS INT) + 1 ELSE CAST(floor({spaces} / 2) AS INT) + 1 END)",
        "title": f"CASE WHEN {d.like(body, pattern)} THEN {strip(d.extract(body, pattern, 1), d)} END",
        "page": f"CASE WHEN {d.like(body, pattern)} THEN {d.to_int(d.extract(body, pattern, 2))} END",
    }


# The row tokenizer.

_PAGE_END = rf"(\p{{Nd}}{{1,4}}|{ROMAN_TOKEN}+)[{SPACE}]*\z"


def open_brackets(x: str, d: SparkDialect = SPARK) -> str:
    """A trailing bracketed page number without its brackets."""
    return d.replace(x, rf"[（(][{SPACE}]*(\p{{Nd}}{{1,4}}|{ROMAN_TOKEN}+)[{SPACE}]*[）)][{SPACE}]*\z", " $1")


def whole_line(x: str, d: SparkDialect = SPARK) -> tuple[str, str]:
    """(page token, title before it) where a row starts with a number and has a leader; the token is empty elsewhere."""
    pattern = rf"(?s)^(.*?)[{LEADER}{SPACE}]{{2,}}{_PAGE_END}"
    applies = f"{d.like(x, rf'^[{SPACE}]*\p{{Nd}}{{1,3}}(?:\.\p{{Nd}}+)*[{SPACE}]+')} AND {d.like(x, r'[.·…_﹍]{3,}')}"
    return f"CASE WHEN {applies} THEN {d.extract(x, pattern, 2)} ELSE '' END", d.replace(x, pattern, "$1")


def marked(x: str, d: SparkDialect = SPARK) -> str:
    """The row with chr(1) before each chapter anchor."""
    return d.replace(x, rf"(?:^|[{SPACE}]+)({ANCHORS})", "\x01$1")


def chunk(x: str, digits_only: bool = False, d: SparkDialect = SPARK) -> tuple[str, str]:
    """(page token, title before it) of one chunk: a page after leaders, spaces or a letter; else an empty token."""
    end = rf"(\p{{Nd}}{{1,4}})[{SPACE}]*\z" if digits_only else _PAGE_END
    pattern = rf"(?s)^(?:(.*?)[{LEADER}{SPACE}]+|(.*?[{CJK}A-Za-z])){end}"
    return d.extract(x, pattern, 3), d.replace(x, pattern, "$1$2")
