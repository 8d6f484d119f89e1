"""Row tokenizer, levels, hierarchy, detection, offsets and bookmarks on small cases."""

import random

from foliospark.operators import detect as D
from foliospark.operators import locate as P
from foliospark.operators import outline as O
from foliospark.operators import rows as R
from foliospark.operators import toc as C
from foliospark.plans.sql import run


def tokenised(spark, *rows):
    frame = spark.createDataFrame([(i, 1, 1, r) for i, r in enumerate(rows)], "doc_id int, source_page int, row_no int, row_text string")
    found = {}
    for r in C.row_items(frame).orderBy("doc_id", "item_no").collect():
        found.setdefault(r["doc_id"], []).append((r["title"], r["logical_page"]))
    return [found.get(i, []) for i in range(len(rows))]


def test_rows_to_items(spark):
    assert tokenised(spark, "1 总则 …… (1)", "2.1 术语 ........ 12 2.2 符号 ........ 13", "5 SF6 气体 H2O 含量 ........ (15)", "前言 .... III", "www.site.com 12", "REPORT SUMMARY .. 9", "no page here", "2.1 符号 .. 12 2.2 术语 .. 13") == [
        [("1 总则", 1)], [("2.1 术语 ........ 12 2.2 符号", 13)], [("5 SF6 气体 H2O 含量", 15)], [("前言", 3)], [], [("REPORT SUMMARY", 9)], [], [("2.1 符号", 12), ("2.2 术语", 13)],
    ]


def entries(spark, rows, schema="doc_id int, entry_no int, title string, logical_page int, raw_level int, source_page int"):
    return spark.createDataFrame(rows, schema)


def test_level_clamp_equals_the_recurrence(spark):
    rng, rows, expected = random.Random(4), [], {}
    for doc in range(60):
        before = 0
        for i in range(1, rng.randint(2, 30)):
            raw = rng.randint(-1, 6)
            level = 1 if i == 1 else max(1, min(raw, before + 1))
            before = expected[doc, i] = level
            rows.append((doc, i, "t", 1, raw, 1))
    out = run(spark, lambda d, e: C.clamp_sql(e), e=entries(spark, rows))
    assert {(r["doc_id"], r["entry_no"]): r["level"] for r in out.collect()} == expected


def test_parents_keep_stale_branches(spark):
    rng, rows, expected = random.Random(5), [], {}
    for doc in range(40):
        seen = {}
        for i in range(1, 25):
            level = 1 if i == 1 else rng.randint(1, 4)
            up = level - 1
            while up > 0 and up not in seen:
                up -= 1
            expected[doc, i] = seen.get(up)
            seen[level] = i
            rows.append((doc, i, "t", level))
    out = C.parents(spark.createDataFrame(rows, "doc_id int, entry_no int, title string, level int"))
    assert {(r["doc_id"], r["entry_no"]): r["parent_no"] for r in out.collect()} == expected


def test_contradicting_numbers_need_recognition(spark):
    lists = [["2.1 范围"], ["1 总则", "2.1 范围"], ["1 总则", "1.1 范围", "2 术语", "2.1 词"], ["1 总则", "附录", "2.1 范围"], ["1 总则", "\ue000\ue000"]]
    rows = [(i, k, t, 1) for i, ts in enumerate(lists) for k, t in enumerate(ts)]
    docs = spark.createDataFrame([(i,) for i in range(6)], "doc_id int")
    out = C.needs_ocr(spark.createDataFrame(rows, "doc_id int, entry_no int, title string, logical_page int"), docs)
    assert [r["needs_ocr"] for r in out.orderBy("doc_id").collect()] == [False, True, False, False, True, True]


def pages(spark, *texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts, 1)], "doc_id int, page_no int, text string")


def test_contents_scores(spark):
    texts = ["目\n次\n1 总则 … 1\n2 范围 … 2\n3 术语 … 3", "4 要求 (4)\n5 试验 (5)\n6 检验 (6)\n7 标志 (7)\n8 附录 (8)", "正文\n没有页码", "3.1\n3.2\n3.3\n3 . 4", "", "contents\nintroduction 1"]
    out = [(r["is_toc"], r["score"]) for r in D.toc_score(pages(spark, *texts)).orderBy("page_no").collect()]
    assert out == [(True, 80), (True, 70), (False, 0), (False, 0), (False, 0), (True, 70)]


def test_language_groups(spark):
    zh, en = "目次\n1 总则 ... 1\n2 范围 ... 2\n3 术语 ... 3", "Contents\n1 GENERAL ... 1\n2 SCOPE ... 2\n3 TERMS ... 3"
    text = pages(spark, "cover", "x", "x", "x", "x", zh, zh, en, en)
    scored = D.toc_score(text).selectExpr("*", "CAST(NULL AS INT) AS n_parsed")
    assert [r["page_no"] for r in run(spark, D.toc_group_lang_sql, scored=scored).orderBy("page_no").collect()] == [6, 7]
    assert [r["page_no"] for r in D.toc_pages(text).orderBy("page_no").collect()] == [6, 7, 8, 9]


def item(page, no, text, x, y, w=40.0, h=10.0):
    return (1, page, no, text, [[x, y], [x + w, y], [x + w, y + h], [x, y + h]])


ITEMS = "doc_id int, page_no int, item_no int, text string, box array<array<double>>"


def headings(spark, items, titles):
    asked = spark.createDataFrame([(1, i, t, 1, 9) for i, t in enumerate(titles)], "doc_id int, entry_no int, title string, lo int, hi int")
    found = P.find_headings(asked, P.heading_rows(spark.createDataFrame(items, ITEMS)))
    return {(r["entry_no"], r["page_no"]): (r["x"], r["y"]) for r in found.collect()}


def test_heading_lookup(spark):
    items = [item(1, 0, "见7.2技术状况评价", 60.0, 50.0), item(1, 1, "7.2", 50.0, 100.0), item(1, 2, "技术状况评价", 95.0, 101.0), item(2, 0, "14.7 范围", 10.0, 5.0), item(2, 1, "4.7.1 范围", 10.0, 40.0), item(2, 2, "47 范围", 10.0, 80.0)]
    found = headings(spark, items, ["7.2 技术状况评价", "4.7 范围", "—"])
    assert found == {(0, 1): (50.0, 85.0)}
    assert headings(spark, items, ["技术状况评价"])[0, 1] == (50.0, 85.0)


def test_offset_votes(spark):
    docs = spark.createDataFrame([(1, 4), (2, 4), (3, 4)], "doc_id int, last_toc_page int")
    ents = spark.createDataFrame([(d, i, "t", 2 + i) for d in (1, 2, 3) for i in range(3)], "doc_id int, entry_no int, title string, logical_page int")
    votes = spark.createDataFrame([(1, 0, 4), (1, 1, 4), (1, 2, 5), (2, 0, 7), (2, 1, 6)], "doc_id int, entry_no int, vote int")
    out = {r["doc_id"]: (r["page_offset"], r["votes"], r["status"]) for r in P.page_offset(votes, docs, ents).collect()}
    assert out == {1: (4, 3, "matched"), 2: (7, 2, "disputed"), 3: (3, 0, "guessed")}


def test_bookmarks_reject_whole_documents(spark):
    ents = spark.createDataFrame([(1, 1, "目次", 1, 1, 3), (1, 2, "1 总则", 1, 3, 3), (1, 3, "2 范围", 2, 1, 3), (2, 1, "1 总则", 99, 1, 1), (2, 2, "2 范围", 1, 1, 1)], "doc_id int, entry_no int, title string, logical_page int, level int, source_page int")
    docs = spark.createDataFrame([(1, 10, 4), (2, 3, 0)], "doc_id int, n_pages int, page_offset int")
    none = spark.createDataFrame([], "doc_id int, entry_no int, page_no int")
    out = [tuple(r)[:5] for r in O.bookmarks(ents, docs, none).orderBy("doc_id", "entry_no").collect()]
    assert out == [(1, 1, 1, "目次", 3), (1, 2, 2, "1 总则", 5), (1, 3, 1, "2 范围", 6)]
    assert [tuple(r)[:5] for r in O.bookmarks(ents, docs, none, True).where("doc_id = 2").collect()] == [(2, 1, 1, "2 范围", 1)]
    assert [(r["doc_id"], r["n_bad"], r["examples"]) for r in O.rejects(ents, docs).collect()] == [(2, 1, "1 总则 -> 99")]


def test_preface_probe_order(spark):
    ents = spark.createDataFrame([(1, 1, "前言", 2), (2, 1, "前言", 2)], "doc_id int, entry_no int, title string, source_page int")
    text = spark.createDataFrame([(1, 3, "前\n言 本"), (1, 1, "前言"), (2, 1, "这是前言"), (2, 4, "x" * 150 + "前言")], "doc_id int, page_no int, text string")
    assert sorted(tuple(r) for r in P.preface_pages(ents, text).collect()) == [(1, 1, 3), (2, 1, 1)]


def cluster_rule(ys, tolerance, anchored):
    rows = []
    for y in ys:
        for r in rows:
            if abs(r[0] - y) <= tolerance:
                r[1].append(y)
                if not anchored:
                    r[0] = sum(r[1]) / len(r[1])
                break
        else:
            rows.append([y, [y]])
    return [(round(a, 9), len(b)) for a, b in rows]


def test_leader_clustering_follows_the_rule(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    lists = [sorted(round(rng.uniform(0, 40), 3) for _ in range(rng.randint(1, 25))) for _ in range(80)]
    frame = spark.createDataFrame([(i, [(y,) for y in ys]) for i, ys in enumerate(lists)], "i int, parts array<struct<y:double>>")
    for anchored in (False, True):
        out = frame.select("i", F.transform(R.cluster(F.col("parts"), 3.0, anchored), lambda r: F.struct(r["y"].alias("y"), F.size(r["parts"]).alias("n"))).alias("rows")).orderBy("i").collect()
        assert [[(round(r["y"], 9), r["n"]) for r in o["rows"]] for o in out] == [cluster_rule(ys, 3.0, anchored) for ys in lists]


def test_greedy_margin_match(spark):
    rng, titles, numbers, expected = random.Random(9), [], [], {}
    for page in range(40):
        ts = sorted(rng.randint(0, 60) for _ in range(8))
        ns = sorted(rng.randint(0, 60) for _ in range(6))
        titles += [(1, page, i, float(y), f"t{i}") for i, y in enumerate(ts)]
        numbers += [(1, page, i, float(y), i) for i, y in enumerate(ns)]
        free = set(range(len(ns)))
        for i, y in enumerate(ts):
            near = [(abs(y - ns[j]), j) for j in free if abs(y - ns[j]) <= 8]
            if near:
                expected[page, i] = min(near)[1]
                free.remove(min(near)[1])
    out = R.match_margin(spark.createDataFrame(titles, "doc_id int, page_no int, row_no int, y double, title string"), spark.createDataFrame(numbers, "doc_id int, page_no int, number_no int, y double, value int"))
    assert {(r["page_no"], r["row_no"]): r["logical_page"] for r in out.collect()} == expected


def test_numbering_repair(spark):
    rows = spark.createDataFrame([(1, 1, 1, 10.0, "0 电气"), (1, 1, 2, 30.0, "电气"), (1, 1, 3, 50.0, "3 电气"), (1, 1, 4, 70.0, "SCOPE"), (1, 1, 5, 200.0, "电气")], "doc_id int, page_no int, row_no int, y double, row_text string")
    tokens = spark.createDataFrame([(1, 1, 11.0, "10"), (1, 1, 33.0, "5"), (1, 1, 50.0, "7"), (1, 1, 70.0, "8")], "doc_id int, page_no int, y double, token string")
    assert [r["row_text"] for r in R.repair_numbering(rows, tokens).orderBy("row_no").collect()] == ["10 电气", "5 电气", "3 电气", "SCOPE", "电气"]


def test_margin_vote_prefers_crops_over_confidence(spark):
    rows = [(1, 1, 1, 0, 10.0, 2, 0.4), (1, 1, 2, 1, 11.0, 2, 0.3), (1, 1, 3, 2, 10.5, 7, 0.99), (1, 1, 4, 0, 40.0, 5, 0.5)]
    out = R.margin_votes(spark.createDataFrame(rows, "doc_id int, page_no int, seq int, crop_ix int, y double, value int, conf double"))
    assert [(r["number_no"], r["y"], r["value"]) for r in out.orderBy("number_no").collect()] == [(1, 10.5, 2), (2, 40.0, 5)]


def vote_rule(items, hits, known, last, n_pages, radius=4):
    """Entries in turn; pages recognised on the way are known to later entries."""
    rough, cache, votes = last + 1 - min(p for _, p in items), set(known), {}
    for no, logical in items:
        seen = [p for p in sorted(cache) if last < p <= n_pages and (no, p) in hits]
        if seen:
            votes[no] = seen[0] - logical
            continue
        for p in range(max(last + 1, logical + rough - radius), min(n_pages, logical + rough + radius) + 1):
            if p not in cache:
                cache.add(p)
                if (no, p) in hits:
                    votes[no] = p - logical
                    break
    return votes


def test_recognised_pages_become_known(spark):
    rng, ents, rows, known, docs, expected = random.Random(12), [], [], [], [], {}
    for doc in range(40):
        last, n = rng.randint(1, 4), rng.randint(15, 40)
        items = [(i, rng.randint(1, 25)) for i in range(1, rng.randint(2, 7))]
        hits = {(no, rng.randint(1, n + 2)) for no, _ in items for _ in range(rng.randint(0, 4))}
        read = {p for p in range(1, n + 1) if rng.random() < 0.15}
        docs.append((doc, last, n))
        ents += [(doc, no, f"heading{chr(96 + no)}", p) for no, p in items]
        rows += [(doc, p, float(no), 1.0, 20.0, f"heading{chr(96 + no)}") for no, p in hits]
        known += [(doc, p) for p in read]
        expected |= {(doc, no): v for no, v in vote_rule(items, hits, read, last, n).items()}
    out = P.ocr_votes(
        spark.createDataFrame(ents, "doc_id int, entry_no int, title string, logical_page int"),
        spark.createDataFrame(rows, "doc_id int, page_no int, y double, x0 double, y0 double, row_text string"),
        spark.createDataFrame(known, "doc_id int, page_no int"),
        spark.createDataFrame(docs, "doc_id int, last_toc_page int, n_pages int"),
    )
    assert {(r["doc_id"], r["entry_no"]): r["vote"] for r in out.collect()} == expected


def test_destination_cascade(spark):
    targets = spark.createDataFrame([(1, i, f"title{c}", 5) for i, c in enumerate("abc")] + [(1, 3, "titled", 6)], "doc_id int, entry_no int, title string, target_page int")
    schema = "doc_id int, page_no int, y double, x0 double, y0 double, row_text string"
    ocr = spark.createDataFrame([(1, 5, 1.0, 7.0, 20.0, f"title{c}") for c in "abc"] + [(1, 6, 1.0, 7.0, 20.0, "titled")], schema)
    text = spark.createDataFrame([(1, 5, 1.0, 9.0, 20.0, "titlea"), (1, 5, 1.0, 9.0, 20.0, "titlec"), (1, 6, 1.0, 9.0, 20.0, "titled")], schema)
    pages = spark.createDataFrame([(1, 5, "some text"), (1, 6, "")], "doc_id int, page_no int, text string")
    known = spark.createDataFrame([(1, 6)], "doc_id int, page_no int")

    def found(*options, **more):
        return [r["dest_source"] for r in P.destinations(targets, ocr, text, pages, *options, **more).orderBy("entry_no").collect()]

    assert found() == ["text", "page_top", "text", "page_top"]
    assert found(known) == ["text", "page_top", "text", "ocr"]
    assert found(ocr_fallback=True) == ["text", "ocr", "ocr", "ocr"]  # the page is known once it was recognised for the second
    assert found(use_ocr=True) == ["ocr"] * 4
