"""Operator 7, URL rules indexed by their rarest literal token (DataFrame functions only).

A rule names literal tokens ([a-z0-9]+ runs) that every URL it fits must contain as whole tokens,
so its pattern delimits them on both sides; "ad|ads" stands for one token or the other.  Token
frequencies over the URLs decide which of them files the rule (under each of its alternatives); a
URL's tokens fetch candidate rules from that index and only candidates run their regular
expression, on host || path.

Defined results: null URL or one without '://': host and path empty, no rule, the default
verdict.  The longest fitting address rule decides; without one, any fitting pattern blocks.
Equal lengths: a block before an allow, then the rule's text.  Empty tables give empty results.
Only the input's named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INLINE_RULES = 500  # up to so many rules the index is a literal; beyond, a joined table


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str
    pattern: str  # Java regular expression for host || path
    literals: tuple[str, ...]
    address: bool


def address_rule(verdict: str, text: str) -> Rule:
    """text: host, or host and path prefix; fits the host and all its subdomains."""
    host, slash, path = text.partition("/")
    prefix = slash + path
    pattern = rf"^(?:[^/]*\.)?{_quote(host)}" + (_quote(prefix) if prefix else "(?:/|$)")
    whole = host + (prefix if not prefix or not prefix[-1].isalnum() else re.sub(r"[A-Za-z0-9]+$", "", prefix))
    return Rule(text, verdict, pattern, tuple(re.findall("[a-z0-9]+", whole.lower())), True)


def pattern_rule(name: str, pattern: str, *literals: str) -> Rule:
    return Rule(name, "block", pattern, literals, False)


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


ADDRESSES = (
    address_rule("block", "com/en/"),
    address_rule("allow", "example.com/en/7"),
    address_rule("allow", "net/de/"),
    address_rule("block", "example.net/de/8"),
    address_rule("block", "org/es/"),
)
PATTERNS = (
    pattern_rule("free-bets", r"^[^/]*free-bets\.", "bets"),  # "free" and "cheap" may end a longer token
    pattern_rule("cheap-pills", r"^[^/]*cheap-pills\.", "pills"),
    pattern_rule("casino", r"^(?:[^/]*[.-])?casino[.-]", "casino"),
    pattern_rule("adult", r"^(?:[^/]*[.-])?adult[.-]", "adult"),
    pattern_rule("tracker", r"^[^/]*/(?:[^/]*/)*ads?/click", "ad|ads"),  # "click" may begin a longer token
)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def tokens(target: Column) -> Column:
    return F.array_distinct(F.split(lower_ascii(target), "[^a-z0-9]+"))


def index_rules(targets: DataFrame, rules: tuple[Rule, ...]) -> dict[str, list[Rule]]:
    """Each rule filed under its literal that the fewest targets have (ties: first by text); the
    counts of alternatives add up.

    What comes to the driver is one count per literal of the rules, whatever the corpus size.
    """
    words = sorted({t for r in rules for x in r.literals for t in x.split("|")})
    seen = targets.select(F.explode(F.array_intersect(tokens(F.col("target")), F.array(*map(F.lit, words)))).alias("t")).groupBy("t").count()
    counts = {r["t"]: r["count"] for r in seen.collect()}
    index: dict[str, list[Rule]] = {}
    for r in rules:
        if not r.literals:
            raise ValueError(f"rule {r.text!r} has no literal token")
        rarest = min(r.literals, key=lambda x: (sum(counts.get(t, 0) for t in x.split("|")), x))
        for t in dict.fromkeys(rarest.split("|")):
            index.setdefault(t, []).append(r)
    return index


def _rule_struct(r: Rule) -> Column:
    values = (F.lit(len(r.text) if r.address else -1), F.lit(r.verdict == "block"), F.lit(r.text), F.lit(r.verdict), F.lit(r.pattern))
    return F.struct(*(v.alias(n) for v, n in zip(values, ("size", "block", "text", "verdict", "pattern"))))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = ADDRESSES + PATTERNS, default: str = "allow", inline: int = INLINE_RULES) -> DataFrame:
    """pages(page_id, url) with host, path, rule, pattern (first fitting pattern) and verdict."""
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("target", F.concat("host", "path"))
    index = index_rules(rows, rules)
    if len(rules) <= inline:
        entries = [x for t, rs in sorted(index.items()) for x in (F.lit(t), F.array(*map(_rule_struct, rs)))]
        filed = F.create_map(*entries)
        fetched = F.flatten(F.transform(F.array_intersect(tokens(F.col("target")), F.map_keys(filed)), lambda t: F.element_at(filed, t)))
        judged = rows.withColumn("cand", fetched).withColumn("fits", F.filter("cand", lambda r: F.regexp_like(F.col("target"), r["pattern"])))
    else:
        spark = pages.sparkSession
        schema = "t string, size int, block boolean, text string, verdict string, pattern string"
        listed = spark.createDataFrame([(t, len(r.text) if r.address else -1, r.verdict == "block", r.text, r.verdict, r.pattern) for t, rs in index.items() for r in rs], schema)
        found = rows.select("target").distinct().withColumn("t", F.explode(tokens(F.col("target")))).join(listed, "t").where(F.regexp_like("target", F.col("pattern")))
        found = found.groupBy("target").agg(F.collect_set(F.struct("size", "block", "text", "verdict", "pattern")).alias("fits"))
        judged = rows.join(found, "target", "left").withColumn("fits", F.coalesce("fits", F.array().cast("array<struct<size:int,block:boolean,text:string,verdict:string,pattern:string>>")))
    address = F.array_max(F.transform(F.filter("fits", lambda r: r["size"] >= 0), lambda r: F.struct(r["size"].alias("size"), r["block"].alias("block"), r["text"].alias("text"), r["verdict"].alias("verdict"))))
    pattern = F.array_min(F.transform(F.filter("fits", lambda r: r["size"] < 0), lambda r: r["text"]))
    judged = judged.withColumn("best", address).withColumn("hit", pattern)
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("hit").isNotNull(), F.lit("block")), F.lit(default))
    return judged.select("page_id", "host", "path", F.col("best.text").alias("rule"), F.col("hit").alias("pattern"), verdict.alias("verdict"))
