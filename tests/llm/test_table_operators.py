"""Operators 6, 7 and 10 and the pipeline."""

import math
import os
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from foliospark.llm import queries as Q
from foliospark.llm import source_mix as S
from foliospark.llm import url_rules as U
from foliospark.llm import vantage_search as V

DATA = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, shard int, v string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, 0, 1, "x") for i, e in rows], VECTORS)


def brute(rows, k):
    good = {}
    for i, e in rows:
        if i is not None and e and len(e) == 8 and all(x is not None and math.isfinite(x) for x in e) and any(e):
            good.setdefault(i, []).append(np.array(e, np.float32).astype(float))
    out = {}
    for q, own in good.items():
        if q % 20 == 0:
            near = sorted((-float(np.cumsum(x * own[0])[-1]), i) for i, xs in good.items() if i != q for x in xs)
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


@pytest.mark.parametrize("shard_rows", [40, 5000])
def test_nearest_equals_brute_force(spark, shard_rows):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.1, 1, 9])).round(3).tolist()) for i in range(600)]
    rows += [(600 + i, rows[5][1]) for i in range(60)]  # copies: ties go to the smaller id
    rows += [(900, None), (901, [0.0] * 8), (902, [1.0, None] + [1.0] * 6), (903, [math.nan] + [1.0] * 7), (904, [math.inf] + [1.0] * 7), (905, [1.0]), (None, [1.0] * 8), rows[0]]
    rows = [(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e]) for i, e in rows]
    found = {}
    for r in V.nearest(vectors(spark, rows), lambda c: c % 20 == 0, k=7, shard_rows=shard_rows).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    seen = list(dict.fromkeys((i, None if e is None else tuple(e)) for i, e in rows))
    assert found == brute([(i, None if e is None else list(e)) for i, e in seen], 7)


def test_ties_of_different_vectors_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(1)
    tied = [(i, [0.5, *rng.normal(size=7).round(2).tolist()]) for i in range(400, 0, -1)]
    rows = [(1000, [1.0] + [0.0] * 7), *tied, (5000, [1e6] + [0.0] * 7), (401, [0.25] * 8)]
    out = V.nearest(vectors(spark, rows), lambda c: c == 1000, shard_rows=150).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in out] == [(5000, 1e6), *((i, 0.5) for i in range(1, 20))]


def test_few_or_no_vectors(spark):
    assert V.nearest(vectors(spark, []), lambda c: c % 20 == 0).count() == 0
    out = V.nearest(vectors(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])]), lambda c: c % 20 == 0).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in out] == [(1, 1, 0.5), (2, 2, 0.5)]


def test_relaxed_pruning_keeps_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    points = np.concatenate([c + rng.normal(size=(100, 16)) * 0.15 for c in centres])
    rows = list(enumerate(points.tolist()))
    exact = V.nearest(vectors(spark, rows), lambda c: c % 20 == 0, k=10).toPandas()
    loose = V.nearest(vectors(spark, rows), lambda c: c % 20 == 0, k=10, relax=1.3).toPandas()
    pairs = lambda f: set(zip(f.query_id, f.vec_id))
    assert len(pairs(exact) & pairs(loose)) >= 0.9 * len(pairs(exact))


def judged(spark, urls, **options):
    rows = spark.createDataFrame([(i, u, "h", "t") for i, u in enumerate(urls)], "page_id long, url string, host string, tokens string")
    return [tuple(r)[1:] for r in U.judge(rows, **options).orderBy("page_id").collect()]


URLS = {
    "https://WWW.Example.COM/en/7x?q#f": ("www.example.com", "/en/7x", "example.com/en/7", None, "allow"),
    "http://example.com/en/8": ("example.com", "/en/8", "com/en/", None, "block"),
    "http://example.com/EN/8": ("example.com", "/EN/8", None, None, "allow"),
    "http://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", None, "block"),
    "http://mycom/en/7": ("mycom", "/en/7", None, None, "allow"),
    "x://a.net/de/8": ("a.net", "/de/8", "net/de/", None, "allow"),
    "x://b.example.net/de/8/9": ("b.example.net", "/de/8/9", "example.net/de/8", None, "block"),
    "x://a.org/es": ("a.org", "/es", None, None, "allow"),
    "x://org/es/?": ("org", "/es/", "org/es/", None, "block"),
    "x://a.org?/es/": ("a.org", "", None, None, "allow"),
    "http://m.free-bets.example.org/fr/1": ("m.free-bets.example.org", "/fr/1", None, "free-bets", "block"),
    "http://free-bets.example.net/de/1": ("free-bets.example.net", "/de/1", "net/de/", "free-bets", "allow"),
    "no scheme/com/en/": ("", "", None, None, "allow"),
    "": ("", "", None, None, "allow"),
    None: ("", "", None, None, "allow"),
    "http://": ("", "", None, None, "allow"),
    "a://b://com/en/": ("b:", "//com/en/", None, None, "allow"),
    "http://" + "x" * 100_000 + ".com/en/": ("x" * 100_000 + ".com", "/en/", "com/en/", None, "block"),
}


@pytest.mark.parametrize("inline", [500, 0])
def test_url_verdicts(spark, inline):
    urls = [*URLS, *URLS]
    assert judged(spark, urls, inline=inline) == [URLS[u] for u in urls]
    assert judged(spark, [], inline=inline) == []


def test_rules_are_filed_under_the_rarest_literal(spark):
    targets = spark.createDataFrame([("a.com/en/1",), ("b.com/en/2",), ("c.com/fr/",)], "target string")
    index = U.index_rules(targets, (U.address_rule("block", "com/en/"), U.address_rule("block", "zz.com/en/")))
    assert {t: [r.text for r in rs] for t, rs in index.items()} == {"en": ["com/en/"], "zz": ["zz.com/en/"]}


GLUED = {
    "http://buycheap-pills.example.org/fr/1": ("cheap-pills", "block"),
    "http://m.nocheap-pills.x/": ("cheap-pills", "block"),
    "http://xfree-bets.example.org/": ("free-bets", "block"),
    "http://a.x/ads/clicks/1": ("tracker", "block"),
    "http://a.x/ad/click123": ("tracker", "block"),
    "http://a.x/ad/ads/click_1": ("tracker", "block"),
    "http://a.x/b/ads/click": ("tracker", "block"),
    "http://a.x/bads/click": (None, "allow"),
    "http://a.x/ad/xclick": (None, "allow"),
    "http://cheap-pillsx.x/": (None, "allow"),
    "http://xcasino.x/": (None, "allow"),
    "http://big-adult.x/": ("adult", "block"),
}


@pytest.mark.parametrize("inline", [500, 0])
def test_rules_find_glued_hosts_and_suffixed_paths(spark, inline):
    common = [f"http://a{i}.x/free/cheap/click/casino" for i in range(3)]  # decides which literals are rare
    for extra in ([], common, [u.replace("a", "bets-pills.ad.ads.", 1) for u in common]):
        assert [r[3:] if r[3] else (None, r[4]) for r in judged(spark, [*GLUED, *extra], inline=inline)][: len(GLUED)] == list(GLUED.values())


def test_every_fitting_rule_is_fetched():
    """Whatever a pattern fits holds a token of each of its literals."""
    rng, parts = random.Random(8), ["free-bets.", "cheap-pills.", "casino.", "casino-", "adult.", "ads/click", "ad/click", "example.com/en/7", "org/es/", "example.net/de/8", "com", "x", "9", ".", "-", "/", "s", "é", "A"]
    rules = U.ADDRESSES + U.PATTERNS
    fits = dict.fromkeys((r.text for r in rules), 0)
    for _ in range(40_000):
        target = "".join(rng.choices(parts, k=rng.randint(1, 6)))
        tokens = set(re.split("[^a-z0-9]+", target.lower()))
        for r in rules:
            if re.search(r.pattern, target):
                fits[r.text] += 1
                assert all(tokens & set(x.split("|")) for x in r.literals), (target, r)
    assert min(fits.values()) > 20


def mix_rows(seed=4):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["b", "a", "c", "é", None]), " ".join("w" * rng.randint(0, 80))) for i in range(900)]
    return rows + [(5, "a", None), (5, "a", "x y"), (5, "a", "x y"), (None, "b", "one two three"), (7777, "hot", "w " * 30_000), (7778, "blank", " \n")]


def test_mix_meets_its_targets(spark):
    rows = mix_rows()
    docs = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, source string, text string, row string, block int")
    plan, schedule = S.mix(docs, block_words=64)
    out = plan.toPandas()
    assert len(out) == len(rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    aims = dict(zip(order, S.water_fill([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5, 2.0)))
    out["source"] = [None if s is None or s != s else s for s in out["source"]]
    for s in order:
        own = out[[x == s if s is not None else x is None for x in out["source"]]]
        assert set(own.source_size) == {sizes[s]} and abs(own.target.iloc[0] - aims[s]) < 1e-6
        assert abs(own.taken.sum() - aims[s]) <= 1
    assert (out.taken <= 2 * out["size"]).all()
    again = S.mix(docs, block_words=64)[0].toPandas()
    key = ["row", "size", "taken"]
    assert sorted(map(tuple, out[key].values.tolist())) == sorted(map(tuple, again[key].values.tolist()))
    slots = schedule.select("slot", "source_no", "block").distinct().toPandas().sort_values("slot")
    assert slots.slot.tolist() == list(range(len(slots)))
    hot = (slots.source_no == slots.source_no.value_counts().idxmax()).values
    share = hot.mean()
    assert np.abs(np.cumsum(hot) - share * np.arange(1, len(hot) + 1)).max() < 8  # low discrepancy
    whole = S.mixed_documents(docs, block_words=64)
    assert whole.columns == docs.columns
    plan = S.mix(docs, block_words=64, equal=S._whole_row(docs))[0].toPandas()
    assert whole.count() == int(sum(math.floor(t / n + 0.5) for t, n in zip(plan.taken, plan["size"]) if n))


def passes(docs, **options):
    """Of each doc_id and text, the rows that the schedule's taken words ask for."""
    words = docs.select("doc_id", "text", S.row_hash(S._whole_row(docs), 1).alias("h")).distinct()
    plan, found = S.mix(docs, equal=S._whole_row(docs), **options)[0].join(words.drop("doc_id"), "h"), {}
    for r in plan.collect():
        key = r["doc_id"], r["text"]
        found[key] = found.get(key, 0) + (math.floor(r["taken"] / r["size"] + 0.5) if r["size"] else 0)
    return {k: n for k, n in found.items() if n}


@pytest.mark.parametrize("stretch, block", [(4096, 64), (100, 64), (300, 512)])
def test_mixed_rows_follow_the_schedule(spark, monkeypatch, stretch, block):
    monkeypatch.setattr(S, "STRETCH_ROWS", stretch)
    for rows in (mix_rows(), mix_rows(5)[:900]):  # with equal rows and without
        docs = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, source string, text string, row string, place int")
        got = {(r["doc_id"], r["text"]): r["count"] for r in S.mixed_documents(docs, block_words=block).groupBy("doc_id", "text").count().collect()}
        assert got == passes(docs, block_words=block) and {1, 2} <= set(got.values())


def test_mixed_documents_shuffle_no_text(spark):
    rng, threshold = random.Random(6), "spark.sql.autoBroadcastJoinThreshold"
    rows = [(i, rng.choice(["a", "b", None]), " ".join("w" * rng.randint(0, 9))) for i in range(12_000)]
    docs, before = spark.createDataFrame(rows, "doc_id long, source string, text string"), spark.conf.get(threshold)
    try:
        spark.conf.set(threshold, "40k")  # as at larger sizes, one entry a row is too much to be broadcast
        out = S.mixed_documents(docs)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        assert out.count() == sum(passes(docs).values())
    finally:
        spark.conf.set(threshold, before)


def plain_targets(sizes, weights):
    """Water filling by bisection on the level."""
    aim, lo, hi = 1.5 * sum(sizes), 0.0, 2.0 * max(sizes) + 1
    for _ in range(200):
        level = (lo + hi) / 2
        lo, hi = (level, hi) if sum(min(2.0 * s, level * w) for s, w in zip(sizes, weights)) < aim else (lo, level)
    return [min(2.0 * s, hi * w) for s, w in zip(sizes, weights)]


def test_targets_equal_plain_water_filling(spark):
    rng = random.Random(2)
    for n in (1, 2, 5, 9):
        sizes = [rng.choice([3, 50, 400, 5000]) + rng.randrange(40) for _ in range(n)]
        totals = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, source_size long")
        got = [r["target"] for r in S.targets(spark, totals, S.WEIGHTS, 1.5, 2.0).orderBy("source").collect()]
        assert np.allclose(got, plain_targets(sizes, [(5, 2, 1)[i % 3] for i in range(n)]), rtol=1e-9)


def test_slot_arithmetic_and_many_equal_rows(spark, monkeypatch):
    rows = [(None, "hot", "same words here")] * 9000 + [(i, "b", "w " * (i % 30)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    monkeypatch.setattr(S, "STRETCH_ROWS", 512)
    key = lambda plan: sorted(tuple(r) for r in plan.select("row", "size", "taken").collect())
    narrow = key(S.mix(docs)[0])
    assert sum(r[2] for r in narrow if r[1]) and len(narrow) == 9300 and len({r[0] for r in narrow}) == 9300
    monkeypatch.setattr(S, "NARROW_SLOTS", 3)
    assert key(S.mix(docs.repartition(3))[0]) == narrow
    times = {}
    for row, size, taken in key(S.mix(docs, equal=S._whole_row(docs))[0]):
        times[size] = times.get(size, 0) + (math.floor(taken / size + 0.5) if size else 0)
    out = S.mixed_documents(docs).groupBy("text").count().collect()
    got = {}
    for r in out:
        got[len(r["text"].split())] = got.get(len(r["text"].split()), 0) + r["count"]
    assert got == {k: n for k, n in times.items() if n}


def test_native_operators_plan_no_python(spark):
    docs = spark.createDataFrame(mix_rows(), "doc_id long, source string, text string")
    for frame in (S.mix(docs)[0], S.mixed_documents(docs), Q.op2_chat_format(spark, DATA), Q.op7_url_rules(spark, DATA)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "PythonRDD"))


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert S.mix(empty)[0].count() == 0 and S.mixed_documents(empty).count() == 0
    blank = spark.createDataFrame([(1, "a", ""), (2, None, None)], "doc_id long, source string, text string")
    assert [(r["size"], r["taken"]) for r in S.mix(blank)[0].collect()] == [(0, 0), (0, 0)]


def test_golden_step_is_prime_to_n():
    for n in [*range(1, 200), 10**6, 2**30]:
        assert math.gcd(S.golden_step(n), n) == 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, before, kept = [], docs, {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, before, DATA)
        assert after.columns == docs.columns
        kept[name] = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert kept[name] <= {r["doc_id"] for r in before.select("doc_id").collect()}
        names.append(name)
        before = spark.createDataFrame(after.collect(), docs.schema)
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert not any(i in r["text"] for r in before.collect() for i in items)
    out = corpus_pipeline.run(spark, DATA).toPandas().sort_values("start")
    assert set(out.doc_id) <= kept["decontaminate"] and out.doc_id.is_monotonic_increasing
    assert out.start.tolist() == [0, *np.cumsum(out.n_tokens)[:-1]]


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(30_000))
    item = "an item of the benchmark that is long enough to be told from all the other texts in here"
    rows = [(7, "one two three four five six"), (7, "one two three four five six"), (9, "one two three four five six"), (None, None), (None, ""), (10, None), (11, long), (12, "x " + item), (None, "y " + item), (13, "all alone in the world of texts"), (14, " \t")]
    schema = "doc_id long, text string, lang string, source string, n_chars int, size int, score double, row string, node long"
    docs = spark.createDataFrame([(i, t, "en", None if k % 2 else "s", 0, 1, 0.0, "r", 2) for k, (i, t) in enumerate(rows)], schema)
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, str(tmp_path))
        assert after.columns == docs.columns, name
        before = spark.createDataFrame(after.collect(), docs.schema)
        if name == "decontaminate":
            left = sorted((str(r["doc_id"]), str(r["text"])[:8]) for r in before.collect())
            assert left == sorted([("7", "one two "), ("None", "None"), ("None", ""), ("10", "None"), ("11", "w0 w1 w2"), ("13", "all alon"), ("14", " \t")])
    out = corpus_pipeline.STAGES[-1][1](spark, before, str(tmp_path))
    assert out.count() == before.count() and {r["doc_id"] for r in out.collect()} <= {7, 11, 13}
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.queries()) == list(range(1, 11))
    assert set(Q.oracle_sql()) <= set(Q.queries())
