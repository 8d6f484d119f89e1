"""Invisible text layer as draw operations, and which old layers to remove."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T


def natural_width(text: Column) -> Column:
    """Width at font size 1 of a full-width font: 1 for ideographs, a half otherwise.

    A provider with real metrics passes its own column instead.
    """
    wide = F.regexp_count(text, F.lit(r"[\x{1100}-\x{11ff}\x{2e80}-\x{ffdc}]"))
    return wide + (F.char_length(text) - wide) * 0.5


def draw_ops(items: DataFrame, width=natural_width) -> DataFrame:
    """(doc_id, page_no, item_no, part_no, text, x, y, font_size, by_word).

    items(doc_id, page_no, item_no, text, box, word_boxes, word_contents): words where each has a
    box and at least one can be drawn, else the whole line.
    """
    key = ["doc_id", "page_no", "item_no"]
    boxes, words = F.coalesce("word_boxes", F.array()), F.coalesce("word_contents", F.array())
    paired = (F.size(boxes) > 0) & (F.size(boxes) == F.size(words))
    each = items.where(paired).select(*key, F.posexplode(F.arrays_zip("word_boxes", "word_contents")).alias("part_no", "z"))
    each = each.select(*key, "part_no", F.col("z.word_contents").alias("text"), G.rect(F.col("z.word_boxes")).alias("r")).where("text <> '' AND r IS NOT NULL")
    each = each.where((F.col("r.x1") - F.col("r.x0") >= 0.5) & (F.col("r.y1") - F.col("r.y0") >= 0.5)).withColumn("by_word", F.lit(True))
    lines = items.join(each.select(*key).distinct(), key, "left_anti").select(*key, F.lit(-1).alias("part_no"), T.column(T.strip("text")).alias("text"), G.rect("box").alias("r"))
    lines = lines.where("text <> '' AND r IS NOT NULL AND r.x1 > r.x0 AND r.y1 > r.y0").withColumn("by_word", F.lit(False))
    both = each.unionByName(lines)
    high, wide = F.col("r.y1") - F.col("r.y0"), F.col("r.x1") - F.col("r.x0")
    size = G.font_size(high, wide, width(F.col("text")))
    return both.select(*key, "part_no", "text", F.col("r.x0").alias("x"), G.baseline(F.col("r.y0"), F.col("r.y1")).alias("y"), size.alias("font_size"), "by_word")


def strip_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, should_strip): scanned pages whose old text layer is replaced."""
    scanned = G.coverage("image_boxes", "width", "height") >= 0.8
    return pages.select("doc_id", "page_no", (scanned & (T.column(T.strip("coalesce(text, '')")) != "")).alias("should_strip"))


def failure_report(results: DataFrame, first: int = 20) -> DataFrame:
    """results(doc_id, page_no, error): done and failed pages, the first failures in page order.

    One failed page fails the document (ok is false), so nothing partial is written.
    """
    bad = F.when(F.col("error").isNotNull(), F.struct("page_no", "error"))
    out = results.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count("error").alias("failed"), F.min(bad).alias("f"), F.slice(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.col("page_no")))), 1, first).alias("failed_pages"))
    return out.select("doc_id", "pages", "failed", "failed_pages", F.col("f.error").alias("first_error"), (F.col("failed") == 0).alias("ok"))


def scaled_items(items: DataFrame) -> DataFrame:
    """items with pixel boxes(doc_id, page_no, ..., width, height, px_width, px_height) in page points."""
    sx, sy = F.col("width") / F.col("px_width"), F.col("height") / F.col("px_height")
    words = F.transform(F.coalesce("word_boxes", F.array().cast("array<array<array<double>>>")), lambda b: F.transform(b, lambda p: F.array(p[0] * sx, p[1] * sy)))
    return items.withColumn("box", G.scale_box("box", sx, sy)).withColumn("word_boxes", words)
