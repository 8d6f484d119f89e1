"""Text files, settings, providers, sinks and whole jobs."""

import json

import pytest
from pyspark.sql import functions as F

from foliospark.operators import detect as D
from foliospark.operators import layer as L
from foliospark.plans import jobs
from foliospark.sources import config, providers, sinks, toc_text
from foliospark.streaming.control import Cancelled, cancellation_scope


def test_toc_text_round_trip(spark, tmp_path):
    ents = spark.createDataFrame([(1, 1, "1 总则", 1, 1), (1, 2, "1.1 范围", 2, 2), (1, 3, "a\tb", 3, 4)], "doc_id int, entry_no int, title string, logical_page int, level int")
    body = toc_text.export_text(ents).first()["body"]
    (tmp_path / "a.txt").write_text(body, encoding="utf-8")
    out = toc_text.import_entries(toc_text.read_lines(spark, str(tmp_path))).orderBy("entry_no").collect()
    assert [(r["title"], r["logical_page"], r["level"]) for r in out] == [("1 总则", 1, 1), ("1.1 范围", 2, 2), ("a\tb", 3, 4)]


def test_toc_text_lines(spark):
    lines = ["# note", "", "总则 1", "  范围  2", "    术语\t3", "\t\t\t\t\t深 4", "bad line", " x 5", "7"]
    frame = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines, 1)] + [(2, 1, "ok 1")], "doc_id int, line_no int, line string")
    bad = toc_text.bad_lines(frame).collect()
    assert [(r["doc_id"], r["n_bad"], r["line_numbers"]) for r in bad] == [(1, 2, "7, 9")]
    assert [r["doc_id"] for r in toc_text.import_entries(frame).collect()] == [2]
    kept = toc_text.import_entries(frame.where("line_no NOT IN (7, 9)")).where("doc_id = 1").orderBy("entry_no").collect()
    assert [(r["title"], r["logical_page"], r["level"]) for r in kept] == [("总则", 1, 1), ("范围", 2, 2), ("术语", 3, 3), ("深", 4, 4), ("x", 5, 1)]


def test_model_replies(spark):
    replies = [(1, '```json\n[{"title":"总则","page":3,"level":9},{"title":" ","page":1},{"title":"B"}]\n```', 4), (2, '{"title":"x"}', 4), (3, '[{"title":"x","page":"y"}]', 4), (4, "no json", 1)]
    out = toc_text.parse_model_reply(spark.createDataFrame(replies, "doc_id int, reply string, first_toc_page int")).orderBy("doc_id", "item_no").collect()
    assert [(r["doc_id"], r["title"], r["logical_page"], r["level"], r["source_page"]) for r in out if r["doc_id"] != 2] == [(1, "总则", 3, 4, 4), (1, "B", 1, 1, 4)]


def test_config(tmp_path):
    path = tmp_path / "config.json"
    path.write_text(json.dumps({"general": {"dpi": 321, "max_ocr_workers": 0}}))
    assert config.load([path], {}) == config.Config(dpi=321, max_ocr_workers=1)
    assert config.load([tmp_path / "none", path], {"AI_MODEL": "m"}).model_name == "m"
    path.write_text("{")
    assert config.load([path], {}) == config.Config()
    assert config.candidate_paths({config.ENV_FILE: str(path)})[0] == path
    assert [config.worker_profile(p, 8, 4) for p in ("balanced", "extreme", "eco")] == [4, 6, 2]


def test_sinks(spark, tmp_path):
    source = tmp_path / "a.b.pdf"
    source.write_text("x")
    assert sinks.output_problem(str(source), str(source)) == "same_file"
    assert sinks.output_problem(str(source), str(tmp_path / "no" / "b.pdf")) == "no_directory"
    assert sinks.output_problem(str(source), str(tmp_path / "b.pdf")) is None
    row = spark.range(1).select(*(sinks.output_path(F.lit("/in/a.b.pdf"), F.lit("/out/"), m).alias(m) for m in sinks.SUFFIXES)).first()
    assert row["ocr_bookmark"] == "/out/a.b_ocr_bookmark.pdf" and row["toc"] == "/out/a.b_toc.txt"
    sinks.write_table(spark.range(3).toDF("n"), str(tmp_path / "t"))
    with pytest.raises(Exception, match="exists"):
        sinks.write_table(spark.range(3).toDF("n"), str(tmp_path / "t"))


def test_open_report(spark):
    docs = spark.createDataFrame([(1, 5, False), (2, 0, None), (3, 5, True)], "doc_id int, n_pages int, needs_pass boolean")
    assert [(r["ok"], r["code"]) for r in providers.open_report(docs).orderBy("doc_id").collect()] == [(True, None), (False, "no_pages"), (False, "encrypted")]


def quad(x, y, w, h):
    return [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]


def test_draw_ops_by_word_and_line(spark):
    items = [(1, 1, 1, "ab", quad(0.0, 0.0, 40.0, 10.0), [quad(0.0, 0.0, 20.0, 10.0), quad(20.0, 0.0, 0.1, 10.0)], ["a", "b"]), (1, 1, 2, " 总则 ", quad(0.0, 20.0, 100.0, 50.0), [], []), (1, 1, 3, "x", [], None, None)]
    frame = spark.createDataFrame(items, "doc_id int, page_no int, item_no int, text string, box array<array<double>>, word_boxes array<array<array<double>>>, word_contents array<string>")
    out = {(r["item_no"], r["part_no"]): (r["text"], round(r["font_size"], 2), round(r["y"], 2), r["by_word"]) for r in L.draw_ops(frame).collect()}
    assert out == {(1, 0): ("a", 8.6, 8.8, True), (2, -1): ("总则", 36.0, 64.0, False)}


def test_scan_stats_and_strip(spark):
    rows = [(1, 1, 100.0, 100.0, "t", [[0.0, 0.0, 90.0, 90.0]], [0, 3]), (1, 2, 100.0, 100.0, " ", [[0.0, 0.0, 100.0, 90.0]], None), (1, 3, 0.0, 0.0, None, None, [3])]
    pages = spark.createDataFrame(rows, "doc_id int, page_no int, width double, height double, text string, image_boxes array<array<double>>, trace_types array<int>")
    assert tuple(D.scan_stats(pages).first()) == (1, 2, 2)
    assert [r["should_strip"] for r in L.strip_pages(pages).orderBy("page_no").collect()] == [True, False, False]


def test_text_statistics(spark):
    rows = [(1, i, "\ue000" * 25) for i in range(1, 5)] + [(2, i, "健全的文字层内容" * 4) for i in range(1, 5)] + [(2, 5, "短")]
    pages = spark.createDataFrame(rows, "doc_id int, page_no int, text string")
    assert {r["doc_id"]: (r["suspicious"], r["evaluated"]) for r in D.text_quality(pages).collect()} == {1: (4, 4), 2: (0, 4)}
    assert {r["doc_id"]: (r["pages_with_text"], r["pages"]) for r in D.text_layer_stats(pages).collect()} == {1: (4, 4), 2: (4, 5)}


def test_failed_pages_fail_the_document(spark):
    rows = [(1, 1, None), (1, 2, "boom"), (1, 3, "bang"), (2, 1, None)]
    out = L.failure_report(spark.createDataFrame(rows, "doc_id int, page_no int, error string")).orderBy("doc_id").collect()
    assert [(r["failed"], r["failed_pages"], r["first_error"], r["ok"]) for r in out] == [(2, [2, 3], "boom", False), (0, [], None, True)]


def book(spark, text_layer=True):
    """Nine pages: cover, notes, preface, contents (4), body from 5; offset 4."""
    toc = [("1 总则", 1), ("1.1 范围", 2), ("1.2 术语", 3), ("2 要求", 4), ("2.1 一般要求", 5)]
    text = {1: "封面标题文字", 2: "版权页面文字", 3: "前言 本书说明", 4: "目次\n" + "\n".join(f"{t} ………… {p}" for t, p in toc)} | {4 + p: f"{t}\n正文内容" for t, p in toc}
    spans, items = [], []
    for page, body in text.items():
        for n, line in enumerate(body.split("\n")):
            y = 100.0 + 40 * n
            spans.append((1, page, n, line, 50.0, y, 300.0, y + 10))
            shown, _, number = line.partition(" ………… ")
            items.append((1, page, n, shown, quad(50.0, y, 200.0, 10.0)))
    blank = lambda t: t if text_layer else ""
    pages = spark.createDataFrame([(1, p, 600.0, 800.0, blank(t)) for p, t in text.items()], "doc_id int, page_no int, width double, height double, text string")
    spans = spark.createDataFrame(spans if text_layer else [], providers.SCHEMAS["spans"])
    items = spark.createDataFrame(items if not text_layer else [], "doc_id bigint, page_no int, item_no int, text string, box array<array<double>>")
    candidates = [(1, 4, k, 0, 145.0 + 40 * k, p, 0.9) for k, (_, p) in enumerate(toc)]
    known = providers.Tables(items, spark.createDataFrame(candidates, providers.SCHEMAS["margin_candidates"]), spark.createDataFrame([], providers.SCHEMAS["left_tokens"]))
    return spark.createDataFrame([(1, 9)], "doc_id bigint, n_pages int"), pages, spans, known


def test_outline_of_a_text_book(spark):
    made = jobs.outline(*book(spark))
    assert [tuple(r) for r in made.report.collect()] == [(1, "ok")]
    marks = made.bookmarks.orderBy("entry_no").collect()
    assert [(r["level"], r["title"], r["target_page"], r["dest_source"]) for r in marks] == [(1, "1 总则", 5, "text"), (2, "1.1 范围", 6, "text"), (2, "1.2 术语", 7, "text"), (1, "2 要求", 8, "text"), (2, "2.1 一般要求", 9, "text")]
    assert marks[0]["dest"]["x"] == 50.0 and marks[0]["dest"]["y"] == 85.0


def test_pages_without_text_use_recognised_items(spark):
    docs, pages, spans, known = book(spark, text_layer=False)
    toc = jobs.contents_pages(pages, known.items, spans)
    assert toc.count() == 0  # titles without numbers are no contents page
    from foliospark.operators import toc as C

    wanted = spark.createDataFrame([(1, 4)], "doc_id bigint, page_no int")
    out = C.parse_ocr_pages(known.items, pages, *known.margins(wanted), wanted).orderBy("entry_no").collect()
    assert [(r["title"], r["logical_page"], r["level"]) for r in out] == [("1 总则", 1, 1), ("1.1 范围", 2, 2), ("1.2 术语", 3, 2), ("2 要求", 4, 1), ("2.1 一般要求", 5, 2)]


def test_cancelled_scope(spark):
    with pytest.raises(Cancelled), cancellation_scope(spark) as scope:
        assert spark.range(5).count() == 5
        scope.cancel()
    assert not issubclass(Cancelled, Exception)


def test_modes(spark):
    with pytest.raises(ValueError):
        jobs.job("x", *book(spark), None)
