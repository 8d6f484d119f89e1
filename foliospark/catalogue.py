"""Named queries of the library and their DuckDB twins.

Most are one SQL text rendered for both engines from the operators' builders; those built on
higher-order functions are DataFrame functions, some with a twin of their own.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import geometry as G
from .functions import text as T
from .operators import detect as D
from .operators import layer as L
from .operators import locate as P
from .operators import outline as O
from .operators import rows as R
from .operators import toc as C
from .plans import fixtures as X
from .plans import jobs
from .plans.sql import DUCK, SPARK, cut
from .sources import page_ranges, toc_text

_count = itertools.count()
Builder = Callable[..., str]


class Names(dict):
    """Base tables as views of one input folder, registered when a query first names them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> str:
        view = f"__folio_base_{name}_{next(_count)}"
        self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").createOrReplaceTempView(view)
        self[name] = view
        return view


def frame(spark: SparkSession, sf_dir: str, builder: Builder, **written: DataFrame) -> DataFrame:
    """builder over the base tables and the written relations that it can read instead of deriving them."""
    names = Names(spark, sf_dir)
    for name, table in written.items():
        names[name] = f"__folio_written_{name}_{next(_count)}"
        table.createOrReplaceTempView(names[name])
    try:
        return spark.sql(builder(SPARK, names))
    finally:
        for view in names.values():
            spark.catalog.dropTempView(view)


def sub(sql: str) -> str:
    return f"({sql})"


# SQL queries: builder(dialect, tables).

def items(d, t):
    return C.row_items_sql(d, f"({X.toc_rows(d, t)}) AS src")


def entries(d, t):
    if "entries" in t:
        return f"SELECT * FROM {t['entries']}"
    return C.entries_sql(d, f"({items(d, t)}) AS it")


def outline_levels(d, t):
    return f"SELECT doc_id, level, count(*) AS n, min(logical_page) AS first_page, max(logical_page) AS last_page FROM ({entries(d, t)}) AS e GROUP BY doc_id, level"


def outline_parents(d, t):
    return C.parents_sql(d, f"({entries(d, t)}) AS en")


def title_clean(d, t):
    raw = "CASE p_partkey % 6 WHEN 0 THEN '1.2总 则 ' || p_name || ' ......12' WHEN 1 THEN '··· 附录a ' || p_name || '…… ' WHEN 2 THEN '目  次（' || p_name || '）..ab' WHEN 3 THEN '第三章 范 围 ，' || p_name WHEN 4 THEN p_name || ' -- __' ELSE upper(p_name) || ' ........ ' END"
    return f"""SELECT p_partkey, {T.clean_title('raw', d)} AS title, {T.meaningful('raw', d)} AS meaningful, {T.cjk_spaces('raw', d)} AS spaced, {T.match_key('raw', d)} AS match_key
FROM (SELECT p_partkey, {raw} AS raw FROM {t['part']}) AS r"""


def title_meaningful(d, t):
    return f"""SELECT meaningful, upper_meaningful, count(*) AS n FROM (SELECT {T.meaningful('p_name', d)} AS meaningful, {T.meaningful('upper(p_type)', d)} AS upper_meaningful FROM {t['part']}) AS q GROUP BY meaningful, upper_meaningful"""


def noise_filter(d, t):
    lines = d.unnest(f"(SELECT doc_id, text FROM {t['documents']})", d.lines("text"), "line", "line_no")
    return f"SELECT doc_id, count(CASE WHEN {T.noise('line', d)} THEN 1 END) AS noise_lines, count(*) AS n_lines FROM {lines} AS x GROUP BY doc_id"


def roman_to_int(d, t):
    token = "CASE o_orderkey % 5 WHEN 0 THEN repeat('x', CAST(o_orderkey % 4 AS INT)) || 'iv' WHEN 1 THEN 'MCM' || repeat('I', CAST(o_custkey % 5 AS INT)) WHEN 2 THEN 'vx' WHEN 3 THEN 'xlii' || substr(o_orderpriority, 1, 1) ELSE ' cdLXX ' END"
    return f"SELECT o_orderkey, token, {T.roman('token', d)} AS value FROM (SELECT o_orderkey, {token} AS token FROM {t['orders']}) AS q"


def level_guess(d, t):
    title = "CASE l_linenumber % 8 WHEN 0 THEN '第三章 ' WHEN 1 THEN '1.2.3.4 ' WHEN 2 THEN CAST(l_linenumber AS STRING) || '.2 ' WHEN 3 THEN '第1节 ' WHEN 4 THEN '附录A ' WHEN 5 THEN '第二节 ' WHEN 6 THEN 'Chapter 3 ' ELSE '12、' END || l_returnflag"
    return f"SELECT title, {T.level_guess('title', d)} AS level, count(*) AS n FROM (SELECT {title} AS title FROM {t['lineitem']}) AS q GROUP BY title, {T.level_guess('title', d)}"


def row_tokenize_multi(d, t):
    rows = f"""SELECT doc_id, source_page, CAST(floor((row_no - 1) / 3) AS INT) AS row_no, {d.agg_text("numbering || ' ' || name || ' .. ' || CAST(idx AS STRING)", "'  '", "idx")} AS row_text
FROM ({X.toc_rows(d, t)}) AS r GROUP BY doc_id, source_page, CAST(floor((row_no - 1) / 3) AS INT)"""
    return C.row_items_sql(d, f"({rows}) AS src")


def margin_token(d, t):
    token = "CASE l_linenumber % 6 WHEN 0 THEN '（' || CAST(l_suppkey AS STRING) || '）' WHEN 1 THEN '...(IV)' WHEN 2 THEN CAST(l_partkey AS STRING) || '___' WHEN 3 THEN '1２' WHEN 4 THEN 'xiv…' ELSE l_linestatus END"
    return f"SELECT token, {T.margin_token('token', d)} AS value, count(*) AS n FROM (SELECT {token} AS token FROM {t['lineitem']}) AS q GROUP BY token, {T.margin_token('token', d)}"


def heal_rows(d, t):
    raw = "CAST(o_custkey % 9 AS STRING) || ' . ' || CAST(o_orderkey % 7 AS STRING) || ' ' || upper(o_orderpriority) || ' ( ' || CAST(o_custkey % 10 AS STRING) || ' 2 )'"
    return f"SELECT o_orderkey, {T.heal_row('raw', d)} AS healed, {T.glue_decimal('raw', d)} AS glued FROM (SELECT o_orderkey, {raw} AS raw FROM {t['orders']}) AS q"


def toc_text_export(d, t):
    return toc_text.export_sql(d, f"({entries(d, t)}) AS en")


def _lines(d, t):
    lines = d.unnest(f"({toc_text_export(d, t)})", d.lines("body"), "line", "line_no")
    return f"SELECT doc_id, line_no, CASE WHEN doc_id % 10 = 0 AND line_no % 9 = 0 THEN 'NO PAGE' WHEN line_no % 4 = 1 THEN '  ' || line ELSE line END AS line FROM {lines} AS x"


def toc_text_import(d, t):
    return toc_text.import_sql(d, f"({_lines(d, t)}) AS li")


def toc_text_errors(d, t):
    return toc_text.bad_lines_sql(d, f"({_lines(d, t)}) AS li")


def text_layer_stats(d, t):
    return D.text_layer_stats_sql(d, f"({X.text_pages(d, t)}) AS tp")


def text_quality(d, t):
    return D.text_quality_sql(d, f"({X.text_pages(d, t)}) AS tp")


def has_text_layer(d, t):
    return D.has_text_layer_sql(d, f"({X.text_pages(d, t)}) AS tp")


def missing_text_pages(d, t):
    return D.missing_text_sql(d, f"({X.text_pages(d, t)}) AS tp")


def script_language(d, t):
    return f"""SELECT doc_id, page_no, {T.script('text', d)} AS lang, length({T.usable('text', d=d)}) AS usable_chars FROM ({X.text_pages(d, t)}) AS tp
UNION ALL SELECT doc_id, page_no, {T.script('text', d)}, length({T.usable('text', d=d)}) FROM ({X.toc_text(d, t)}) AS tt"""


def _scored(d, t):
    return D.toc_score_sql(d, f"({X.toc_text(d, t)} UNION ALL {X.text_pages(d, t)}) AS tx")


def toc_page_score(d, t):
    return f"SELECT doc_id, page_no, score, is_toc, length(text) AS n_chars FROM ({_scored(d, t)}) AS s"


def toc_groups_text(d, t):
    return D.toc_group_sql(d, f"({D.toc_score_sql(d, sub(X.toc_text(d, t)) + ' AS tx')}) AS sc")


def toc_groups_lang(d, t):
    return D.toc_group_lang_sql(d, f"(SELECT *, CAST(NULL AS INT) AS n_parsed FROM ({D.toc_score_sql(d, sub(X.toc_text(d, t)) + ' AS tx')}) AS s0) AS sc")


def _lookups(d, t):
    return f"""SELECT e.doc_id, e.entry_no, e.title, e.logical_page, b.last_toc_page + 1 AS lo, b.last_toc_page + {P.BODY_PAGES} AS hi
FROM ({P.voters_sql(d, sub(entries(d, t)) + ' AS en')}) AS e JOIN ({X.books(d, t)}) AS b ON e.doc_id = b.doc_id"""


def _heading_lookup(d, t):
    return P.best_heading_sql(d, f"({_lookups(d, t)}) AS lk", f"({X.body_rows(d, t)}) AS br")


def _votes(d, t):
    return f"""SELECT h.doc_id, h.entry_no, CAST(min(h.page_no) - min(e.logical_page) AS INT) AS vote FROM ({_heading_lookup(d, t)}) AS h
JOIN ({entries(d, t)}) AS e ON h.doc_id = e.doc_id AND h.entry_no = e.entry_no GROUP BY h.doc_id, h.entry_no"""


def _offset_vote(d, t):
    return P.offset_sql(d, f"({_votes(d, t)}) AS vo", f"({X.books(d, t)})", f"({entries(d, t)}) AS en")


def offset_fallback(d, t):
    none = "(SELECT doc_id, entry_no, 0 AS vote FROM (SELECT CAST(1 AS BIGINT) AS doc_id, 1 AS entry_no) AS z WHERE 1 = 0) AS vo"
    return P.offset_sql(d, none, f"({X.books(d, t)})", f"({entries(d, t)}) AS en")


def toc_needs_ocr(d, t):
    return C.needs_ocr_sql(d, f"({entries(d, t)}) AS en")


def _entries_front(d, t):
    """Entries with a contents and a preface entry put first."""
    extra = f"SELECT doc_id, 0 AS entry_no, '目次' AS title, 1 AS logical_page, 1 AS level, 2 AS source_page FROM ({X.books(d, t)}) AS b1 UNION ALL SELECT doc_id, -1, '前言', -5, 1, 2 FROM ({X.books(d, t)}) AS b2"
    return f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY entry_no) AS INT) AS entry_no, title, logical_page, level, source_page FROM (SELECT doc_id, entry_no, title, logical_page, level, source_page FROM ({entries(d, t)}) AS e0 UNION ALL {extra}) AS e1"


def _front_pages(d, t):
    return f"SELECT doc_id, page_no, {T.usable('text', d=d)} AS text FROM (SELECT doc_id, CAST(1 + doc_id % 4 AS INT) AS page_no, CASE WHEN doc_id % 3 = 0 THEN '前' || chr(10) || '言 本书' WHEN doc_id % 3 = 1 THEN repeat('x', 150) || '前言' ELSE '前言' END AS text FROM ({X.books(d, t)}) AS b3) AS b4"


def front_matter_probe(d, t):
    return P.preface_sql(d, f"({_entries_front(d, t)}) AS ef", f"({_front_pages(d, t)}) AS fp")


def bookmark_resolve(d, t, in_range_only=False):
    return O.bookmarks_sql(d, f"({_entries_front(d, t)})", f"({X.books(d, t)})", f"({front_matter_probe(d, t)})", in_range_only)


def bookmark_subset(d, t):
    return bookmark_resolve(d, t, True)


def bookmark_range_reject(d, t):
    return O.rejects_sql(d, f"({_entries_front(d, t)})", f"({X.books(d, t)})")


def bookmark_valid(d, t):
    return O.valid_sql(d, f"({_entries_front(d, t)}) AS ef")


def bookmark_preview(d, t):
    return O.preview_sql(d, f"({_entries_front(d, t)})", f"({X.books(d, t)})")


def _cascade(d, t):
    """Bookmarks with their destination: recognised rows of even pages first, then text rows, then the page top."""
    marks = bookmark_resolve(d, t)
    asked = f"SELECT doc_id, entry_no, title, target_page AS lo, target_page AS hi FROM ({marks}) AS m0"
    body = X.body_rows(d, t)
    ocr = P.best_heading_sql(d, f"({asked}) AS a1", f"(SELECT * FROM ({body}) AS b4 WHERE page_no % 2 = 0) AS r1")
    text = P.best_heading_sql(d, f"({asked}) AS a2", f"(SELECT doc_id, page_no, y, x0 + 1 AS x0, y0, row_text FROM ({body}) AS b5) AS r2")
    return f"""SELECT m.doc_id, m.entry_no, m.target_page, m.clipped, coalesce(o.x, n.x) AS x, coalesce(o.y, n.y) AS y, CASE WHEN o.x IS NOT NULL THEN 'ocr' WHEN n.x IS NOT NULL THEN 'text' ELSE 'page_top' END AS dest_source
FROM ({marks}) AS m LEFT JOIN ({ocr}) AS o ON m.doc_id = o.doc_id AND m.entry_no = o.entry_no LEFT JOIN ({text}) AS n ON m.doc_id = n.doc_id AND m.entry_no = n.entry_no"""


def _bookmark_summary(d, t):
    return O.summary_sql(d, f"({_cascade(d, t)}) AS bm")


def document_kind(d, t):
    stats = f"""SELECT s.doc_id, s.pages, s.pages_with_text, q.suspicious, q.evaluated, s.pages * (s.doc_id % 2) AS scan_like, s.pages AS invisible,
  'Scan' || CASE WHEN s.doc_id % 4 = 0 THEN '_searchable' ELSE '' END || '.pdf' AS path, CASE WHEN s.doc_id % 9 = 0 THEN 'made by {D.MARKER}' END AS metadata_text
FROM ({text_layer_stats(d, t)}) AS s JOIN ({text_quality(d, t)}) AS q ON s.doc_id = q.doc_id"""
    return D.document_kind_sql(d, f"({stats}) AS st")


def _merge_levels(d, t):
    """Each contents page parsed alone, then renumbered and clamped over the whole document."""
    per_page = f"SELECT doc_id, source_page, row_number() OVER (PARTITION BY doc_id, source_page ORDER BY entry_no) AS entry_no, title, logical_page, CASE WHEN row_number() OVER (PARTITION BY doc_id, source_page ORDER BY entry_no) = 1 THEN 1 ELSE level END AS level FROM ({entries(d, t)}) AS e"
    return f"""WITH a AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY source_page, entry_no) AS INT) AS place FROM ({per_page}) AS pp),
b AS (SELECT doc_id, place AS entry_no, title, logical_page, CASE WHEN entry_no = 1 AND place > 1 THEN coalesce({T.level_guess('title', d)}, level) ELSE level END AS raw_level, source_page FROM a)
{C.clamp_sql('b')}"""


SQL_QUERIES: dict[str, Builder] = {
    "outline_parse": entries, "outline_levels": outline_levels, "outline_parents": outline_parents, "title_clean": title_clean, "title_meaningful": title_meaningful,
    "noise_filter": noise_filter, "roman_to_int": roman_to_int, "level_guess": level_guess, "row_tokenize_multi": row_tokenize_multi, "margin_token": margin_token, "heal_rows": heal_rows,
    "toc_text_export": toc_text_export, "toc_text_import": toc_text_import, "toc_text_errors": toc_text_errors, "text_layer_stats": text_layer_stats, "text_quality": text_quality,
    "has_text_layer": has_text_layer, "missing_text_pages": missing_text_pages, "script_language": script_language, "toc_page_score": toc_page_score, "toc_groups_text": toc_groups_text,
    "toc_groups_lang": toc_groups_lang, "offset_fallback": offset_fallback, "toc_needs_ocr": toc_needs_ocr,
    "front_matter_probe": front_matter_probe, "bookmark_resolve": bookmark_resolve, "bookmark_subset": bookmark_subset, "bookmark_range_reject": bookmark_range_reject, "bookmark_valid": bookmark_valid,
    "bookmark_preview": bookmark_preview, "document_kind": document_kind,
}


# DataFrame queries.  Those over books write the relations they use several times.

def _books(spark, sf_dir):
    rows = cut(frame(spark, sf_dir, X.toc_rows))
    found = {"toc_rows": rows, "books": cut(frame(spark, sf_dir, X.books, toc_rows=rows))}
    return found | {"entries": cut(frame(spark, sf_dir, entries, **found))}


def heading_lookup(spark, sf_dir):
    own = _books(spark, sf_dir)
    return P.find_headings(frame(spark, sf_dir, _lookups, **own), frame(spark, sf_dir, X.body_rows, **own))


def offset_vote(spark, sf_dir):
    own = _books(spark, sf_dir)
    votes = P.text_votes(own["entries"], frame(spark, sf_dir, X.body_rows, **own), own["books"])
    return P.page_offset(cut(votes), own["books"], own["entries"])


def coordinate_cascade(spark, sf_dir):
    own = _books(spark, sf_dir)
    front, pages = cut(frame(spark, sf_dir, _entries_front, **own)), frame(spark, sf_dir, _front_pages, **own)
    marks = cut(O.bookmarks(front, own["books"], P.preface_pages(front, pages)))
    rows = cut(frame(spark, sf_dir, X.body_rows, **own))
    text = rows.select("doc_id", "page_no", F.lit("readable text").alias("text")).distinct()
    found = P.destinations(marks, rows.where("page_no % 2 = 0"), rows.withColumn("x0", F.col("x0") + 1), text, use_ocr=True)
    return found.select("doc_id", "entry_no", "target_page", "clipped", "dest.x", "dest.y", "dest_source")


def bookmark_summary(spark, sf_dir):
    return O.summary(coordinate_cascade(spark, sf_dir))


def merge_levels(spark, sf_dir):
    page = Window.partitionBy("doc_id", "source_page").orderBy("entry_no")
    found = frame(spark, sf_dir, entries).withColumn("on_page", F.row_number().over(page))
    alone = found.withColumn("entry_no", F.col("on_page")).withColumn("level", F.when(F.col("on_page") == 1, 1).otherwise(F.col("level")))
    return C.merge_pages(alone.drop("on_page", "raw_text"))


def weak_page_groups(spark, sf_dir):
    """Contents pages where the page after them scores weakly: it counts if its lines parse to entries."""
    own = _books(spark, sf_dir)
    lines = cut(frame(spark, sf_dir, X.weak_pages, **own))
    y = F.col("line_no") * 12.0 + 60
    spans = lines.select("doc_id", "page_no", F.col("line_no").alias("span_no"), F.col("line").alias("text"), F.lit(50.0).alias("x0"), y.alias("y0"), F.lit(300.0).alias("x1"), (y + 8).alias("y1"))
    pages = frame(spark, sf_dir, X.toc_text, **own).unionByName(lines.groupBy("doc_id", "page_no").agg(F.listagg("line", F.lit("\n")).alias("text")))
    none = spark.createDataFrame([], "doc_id long, page_no int, item_no int, text string")
    return jobs.contents_pages(pages.withColumn("height", F.lit(800.0)), none, spans)


def left_number_rows(spark, sf_dir):
    return R.left_numbers(frame(spark, sf_dir, X.numbering))



def row_cluster_mean(spark, sf_dir):
    return R.page_rows(frame(spark, sf_dir, X.fragments), 3.0)


def row_cluster_anchor(spark, sf_dir):
    return R.page_rows(frame(spark, sf_dir, X.fragments), 3.0, anchored=True, by="")


def row_assemble(spark, sf_dir):
    text = "CASE WHEN span_no % 60 = 0 AND doc_id % 3 = 0 THEN 'www.' || text ELSE text END AS text"  # noise at the top of a page
    spans = frame(spark, sf_dir, X.fragments).selectExpr("doc_id", "page_no", "span_no", text, "floor(x0 / 12) * 12.0D AS x0", "y0", "x0 + 5 AS x1", "y0 + 10 AS y1")
    pages = spans.selectExpr("doc_id", "page_no", "72.0D AS height").distinct()
    return R.span_rows(spans, pages)


def margin_vote(spark, sf_dir):
    return R.margin_votes(frame(spark, sf_dir, X.candidates))


def greedy_band_match(spark, sf_dir):
    return R.match_margin(frame(spark, sf_dir, X.titles), margin_vote(spark, sf_dir))


def _tokens(d, t):
    return f"SELECT doc_id, page_no, y, CAST(seq AS DOUBLE) AS x0, CAST(seq AS STRING) || '1' AS token FROM ({X.candidates(d, t)}) AS c"


def nearest_band_match(spark, sf_dir):
    lead = F.element_at(F.array(F.lit("1 电气 "), F.lit("电气 "), F.lit("7 电气 ")), F.col("row_no") % 3 + 1)
    rows = frame(spark, sf_dir, X.titles).withColumn("row_text", F.concat(lead, "title"))
    return R.repair_numbering(rows, frame(spark, sf_dir, _tokens)).select("doc_id", "row_no", "row_text")


def quad_rect(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    box = F.array(*(F.array(F.col(a).cast("double"), F.col(b).cast("double")) for a, b in (("l_quantity", "l_discount"), ("l_tax", "l_linenumber"), ("l_linenumber", "l_tax"), ("l_discount", "l_quantity"))))
    rect = G.rect(G.scale_box(box, F.lit(0.5), F.lit(2.0)))
    return lines.select("l_orderkey", "l_linenumber", rect.alias("r"), G.centre_y(box).alias("yc")).select("l_orderkey", "l_linenumber", "r.*", F.round("yc", 6).alias("yc"))


def draw_ops(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("l_partkey") == F.col("p_partkey"))
    x, y, w, h = F.col("l_quantity"), F.col("l_linenumber") * 10.0, F.col("l_discount") * 1000, F.col("l_tax") * 100
    items = lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").cast("int").alias("page_no"), F.xxhash64(*lines.columns).alias("item_no"), F.col("p_name").alias("text"), G.quad(x, y, x + w, y + h).alias("box"))
    items = items.withColumn("word_boxes", F.lit(None).cast("array<array<array<double>>>")).withColumn("word_contents", F.lit(None).cast("array<string>"))
    return L.draw_ops(items).select("doc_id", "page_no", "text", *(F.round(c, 6).alias(c) for c in ("x", "y", "font_size")))


def scan_coverage(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    boxes = F.when(F.col("l_returnflag") != "N", F.array(F.array(F.lit(0.0), F.lit(0.0), F.col("l_quantity") * 2, F.lit(100.0))))
    pages = lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"), F.lit(100.0).alias("width"), F.lit(100.0).alias("height"), boxes.alias("image_boxes"), F.when(F.col("l_linestatus") == "O", F.array(F.lit(0), F.lit(3))).alias("trace_types"))
    return D.scan_stats(pages)


def page_range_parse(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    a, b = (F.col("o_orderkey") % 9).cast("string"), (F.col("o_custkey") % 12).cast("string")
    literal = F.when(F.col("o_orderkey") % 5 == 0, F.concat(a, F.lit("，"), b)).when(F.col("o_orderkey") % 5 == 1, F.concat(a, F.lit(" - "), b, F.lit(",")))
    literal = literal.when(F.col("o_orderkey") % 5 == 2, F.lit(" , ")).when(F.col("o_orderkey") % 5 == 3, F.concat(b, F.lit(",x"))).otherwise(F.lit("  "))
    parsed = page_ranges.parse_ranges(orders.select("o_orderkey", literal.alias("range"), F.lit(10).alias("max_page")))
    return parsed.select("o_orderkey", "range", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


def ocr_failure_report(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    results = lines.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_no")).agg(F.min(F.when(F.col("l_suppkey") % 13 == 0, F.concat(F.lit("failed "), F.col("l_suppkey").cast("string")))).alias("error"))
    report = L.failure_report(results)
    return report.withColumn("failed_pages", F.array_join(F.col("failed_pages").cast("array<string>"), ","))


FRAME_QUERIES = {f.__name__: f for f in (heading_lookup, offset_vote, coordinate_cascade, bookmark_summary, merge_levels, weak_page_groups, left_number_rows, row_cluster_mean, row_cluster_anchor, row_assemble, margin_vote, greedy_band_match, nearest_band_match, quad_rect, draw_ops, scan_coverage, page_range_parse, ocr_failure_report)}



def _fold(fragments: str, order: str, tolerance: float, anchored: bool = False) -> str:
    """WITH o, g: fragments of a page in order with the row (cl) each joins, one fragment a step.

    Heights ascend, so only the latest row can be near enough.  total / n is the row's height.
    """
    near = f"abs(g.total / g.n - o.y) <= {tolerance}"
    total, n = ("g.total", "1") if anchored else ("g.total + o.y", "g.n + 1")
    return f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY {order}) AS k FROM ({fragments})),
g AS (SELECT doc_id, page_no, k, CAST(1 AS BIGINT) AS cl, 0.0::DOUBLE + y AS total, CAST(1 AS BIGINT) AS n FROM o WHERE k = 1
  UNION ALL SELECT o.doc_id, o.page_no, o.k, CASE WHEN {near} THEN g.cl ELSE g.cl + 1 END, CASE WHEN {near} THEN {total} ELSE o.y END, CASE WHEN {near} THEN {n} ELSE 1 END
  FROM g JOIN o ON o.doc_id = g.doc_id AND o.page_no = g.page_no AND o.k = g.k + 1),
m AS (SELECT o.*, g.cl, g.total / g.n AS now FROM o JOIN g ON o.doc_id = g.doc_id AND o.page_no = g.page_no AND o.k = g.k)"""


def _rows_twin(fragments: str, order: str, tolerance: float, by: str, tie: str, anchored: bool = False, sort_rows: bool = False) -> str:
    place = "CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y, cl) AS INT)" if sort_rows else "CAST(cl AS INT)"
    return f"""{_fold(fragments, order, tolerance, anchored)},
w AS (SELECT doc_id, page_no, cl, arg_max(now, k) AS y, min(x0) AS x0, min(y0) AS y0, string_agg(text, '{by}' ORDER BY x0, {tie}) AS row_text FROM m GROUP BY doc_id, page_no, cl)
SELECT doc_id, page_no, {place} AS row_no, y, x0, y0, row_text FROM w"""


_FRAGMENTS = X.fragments(DUCK, X.PLAIN)
_SPANS = f"""SELECT doc_id, page_no, span_no, text, x0, y0, (y0 + y0 + 10) / 2 AS y FROM (SELECT doc_id, page_no, span_no, {T.strip("CASE WHEN span_no % 60 = 0 AND doc_id % 3 = 0 THEN 'www.' || text ELSE text END", DUCK)} AS text, floor(x0 / 12) * 12.0 AS x0, y0 FROM ({_FRAGMENTS}))
WHERE text <> '' AND NOT (y0 < 72.0 * 0.08 AND {T.noise('text', DUCK)}) AND NOT (y0 + 10 > 72.0 * 0.94 AND (length(text) <= 6 OR regexp_matches(text, '^\\p{{Nd}}+\\z')))"""
_NUMBERS = f"""SELECT doc_id, page_no, y, x0, y AS y0, text FROM (SELECT doc_id, page_no, y, x0, replace({T.compact('token', DUCK)}, '。', '.') AS text FROM ({X.numbering(DUCK, X.PLAIN)}))
WHERE regexp_matches(text, '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{0,3}}$')"""
_WEAK = f"""SELECT doc_id, page_no, text, NULL AS n_parsed FROM ({X.toc_text(DUCK, X.PLAIN)})
UNION ALL SELECT doc_id, page_no, string_agg(line, chr(10)), CASE WHEN doc_id % 2 = 0 THEN count(*) ELSE 0 END FROM ({X.weak_pages(DUCK, X.PLAIN)}) GROUP BY doc_id, page_no"""

TWINS = {
    "quad_rect": """SELECT l_orderkey, l_linenumber, least(l_quantity, l_tax, l_linenumber, l_discount) * 0.5 AS x0, least(l_discount, l_linenumber, l_tax, l_quantity) * 2.0 AS y0,
  greatest(l_quantity, l_tax, l_linenumber, l_discount) * 0.5 AS x1, greatest(l_discount, l_linenumber, l_tax, l_quantity) * 2.0 AS y1, round((l_discount + l_linenumber + l_tax + l_quantity) / 4, 6) AS yc FROM lineitem""",
    "draw_ops": """WITH i AS (SELECT l_orderkey AS doc_id, CAST(l_suppkey AS INT) AS page_no, p_name AS text, l_quantity AS x, l_linenumber * 10.0 AS y0, l_discount * 1000 AS w, l_tax * 100 AS h FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT doc_id, page_no, text, round(x, 6) AS x, round(y0 + h - (y0 + h - y0) * 0.12, 6) AS y, round(greatest(3.0, least((y0 + h - y0) * 0.86, (x + w - x) / greatest(length(text) * 0.5, 0.1), 36.0)), 6) AS font_size FROM i WHERE text <> '' AND x + w > x AND y0 + h > y0""",
    "scan_coverage": """SELECT l_orderkey AS doc_id, count(CASE WHEN l_returnflag <> 'N' AND l_quantity * 2 * 100 / 10000 >= 0.8 THEN 1 END) AS scan_like, count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS invisible FROM lineitem GROUP BY l_orderkey""",
    "page_range_parse": """WITH r AS (SELECT o_orderkey, o_orderkey % 5 AS k, o_orderkey % 9 AS a, o_custkey % 12 AS b FROM orders),
s AS (SELECT *, CASE k WHEN 0 THEN a || '，' || b WHEN 1 THEN a || ' - ' || b || ',' WHEN 2 THEN ' , ' WHEN 3 THEN b || ',x' ELSE '  ' END AS range FROM r)
SELECT o_orderkey, range, CASE WHEN k = 0 AND a >= 1 AND b BETWEEN 1 AND 10 THEN CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE least(a, b) || ',' || greatest(a, b) END
  WHEN k = 1 AND a >= 1 AND a <= b AND b <= 10 THEN array_to_string(range(a, b + 1), ',') WHEN k = 2 THEN '' END AS pages FROM s""",
    "ocr_failure_report": """WITH p AS (SELECT l_orderkey AS doc_id, l_linenumber AS page_no, min(CASE WHEN l_suppkey % 13 = 0 THEN 'failed ' || l_suppkey END) AS error FROM lineitem GROUP BY ALL)
SELECT doc_id, count(*) AS pages, count(error) AS failed, coalesce(string_agg(CASE WHEN error IS NOT NULL THEN CAST(page_no AS VARCHAR) END, ',' ORDER BY page_no), '') AS failed_pages, arg_min(error, CASE WHEN error IS NOT NULL THEN page_no END) AS first_error, count(error) = 0 AS ok FROM p GROUP BY doc_id""",
    "margin_vote": f"""WITH RECURSIVE c AS ({X.candidates(DUCK, X.PLAIN)}),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y, seq) AS k FROM c),
g AS (SELECT doc_id, k, y, value, crop_ix, conf, CAST(1 AS BIGINT) AS cl, y AS total, CAST(1 AS BIGINT) AS n FROM o WHERE k = 1
  UNION ALL SELECT o.doc_id, o.k, o.y, o.value, o.crop_ix, o.conf, CASE WHEN abs(g.total / g.n - o.y) <= 3 THEN g.cl ELSE g.cl + 1 END,
    CASE WHEN abs(g.total / g.n - o.y) <= 3 THEN g.total + o.y ELSE o.y END, CASE WHEN abs(g.total / g.n - o.y) <= 3 THEN g.n + 1 ELSE 1 END FROM g JOIN o ON o.doc_id = g.doc_id AND o.k = g.k + 1),
v AS (SELECT doc_id, cl, value, count(DISTINCT crop_ix) AS crops, list_reduce(list(conf ORDER BY k), lambda x, z: x + z) AS conf, avg(y) AS y, min(k) AS f FROM g GROUP BY doc_id, cl, value),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, cl ORDER BY crops DESC, conf DESC, f) AS place FROM v)
SELECT doc_id, 1 AS page_no, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY y, cl) AS INT) AS number_no, y, value FROM b WHERE place = 1""",
    "heading_lookup": _heading_lookup(DUCK, X.PLAIN), "offset_vote": _offset_vote(DUCK, X.PLAIN), "coordinate_cascade": _cascade(DUCK, X.PLAIN),
    "bookmark_summary": _bookmark_summary(DUCK, X.PLAIN), "merge_levels": _merge_levels(DUCK, X.PLAIN),
    "weak_page_groups": D.toc_group_lang_sql(DUCK, f"(SELECT s.*, w.n_parsed FROM ({D.toc_score_sql(DUCK, sub(_WEAK))}) AS s JOIN ({_WEAK}) AS w ON s.doc_id = w.doc_id AND s.page_no = w.page_no)"),
    "row_cluster_mean": _rows_twin(_FRAGMENTS, "y, x0, text, y0", 3.0, " ", "text"),
    "row_cluster_anchor": _rows_twin(_FRAGMENTS, "y, x0, text, y0", 3.0, "", "text", anchored=True),
    "left_number_rows": f"SELECT doc_id, page_no, y, row_text AS token FROM ({_rows_twin(_NUMBERS, 'y, x0, text', 3.0, '', 'text', anchored=True)})",
    "row_assemble": f"""SELECT * FROM (SELECT doc_id, page_no, row_no, y, x0, y0, {T.heal_row(T.strip('row_text', DUCK), DUCK)} AS row_text FROM ({_rows_twin(_SPANS, 'y, x0, span_no', 6.0, ' ', 'k', sort_rows=True)})) WHERE NOT {T.noise('row_text', DUCK)}""",
    "nearest_band_match": f"""WITH r AS (SELECT *, ['1 电气 ', '电气 ', '7 电气 '][row_no % 3 + 1] || title AS row_text FROM ({X.titles(DUCK, X.PLAIN)})),
n AS (SELECT r.doc_id, r.row_no, c.seq || '1' AS token, row_number() OVER (PARTITION BY r.doc_id, r.row_no ORDER BY abs(r.y - c.y), c.seq || '1') AS place
  FROM r JOIN ({X.candidates(DUCK, X.PLAIN)}) AS c ON c.doc_id = r.doc_id AND abs(r.y - c.y) <= 4)
SELECT r.doc_id, r.row_no, CASE WHEN n.token IS NULL OR r.row_no % 3 = 2 THEN r.row_text ELSE n.token || ' 电气 ' || r.title END AS row_text FROM r LEFT JOIN n ON n.doc_id = r.doc_id AND n.row_no = r.row_no AND n.place = 1""",
}
TWINS["greedy_band_match"] = f"""WITH RECURSIVE nums AS (SELECT doc_id, list({{'no': number_no, 'y': y, 'value': value}} ORDER BY number_no) AS numbers FROM ({TWINS['margin_vote']}) GROUP BY doc_id),
t AS (SELECT t.doc_id, t.row_no, t.y, t.title, nums.numbers FROM ({X.titles(DUCK, X.PLAIN)}) AS t JOIN nums ON t.doc_id = nums.doc_id),
g AS (SELECT doc_id, 0 AS row_no, CAST([] AS INT[]) AS taken, '' AS title, CAST(NULL AS INT) AS no, CAST(NULL AS INT) AS logical_page FROM nums
  UNION ALL SELECT doc_id, row_no, list_append(taken, pick.no), title, pick.no, pick.value FROM
    (SELECT t.doc_id, t.row_no, t.title, g.taken, list_sort(list_transform(list_filter(t.numbers, lambda n: abs(t.y - n.y) <= 8 AND NOT list_contains(g.taken, n.no)), lambda n: {{'d': abs(t.y - n.y), 'no': n.no, 'value': n.value}}))[1] AS pick
     FROM g JOIN t ON t.doc_id = g.doc_id AND t.row_no = g.row_no + 1))
SELECT doc_id, 1 AS page_no, row_no, title, logical_page FROM g WHERE no IS NOT NULL"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, b=b: frame(spark, sf_dir, b)) for name, b in SQL_QUERIES.items()} | FRAME_QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: b(DUCK, X.PLAIN) for name, b in SQL_QUERIES.items()} | TWINS
