"""Text-layer statistics, contents-page detection and document classification.

Builders give SQL for either dialect over pages(doc_id, page_no, text) unless stated; the
functions at the end apply them to DataFrames.  Everything is keyed by doc_id, so each builder
shuffles once by it at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import text as T
from ..plans.sql import SPARK, SparkDialect, run

SEARCH_PAGES, SAMPLE_PAGES, WEAK = 35, 10, 40
EMPTY_AS_TEXT = "coalesce(text, '')"
MARKER = "folio searchable layer"


def text_layer_stats_sql(d: SparkDialect, pages: str, least: int = 10) -> str:
    return f"SELECT doc_id, CAST(count(CASE WHEN length({T.strip('text', d)}) >= {least} THEN 1 END) AS BIGINT) AS pages_with_text, count(*) AS pages FROM {pages} GROUP BY doc_id"


def text_quality_sql(d: SparkDialect, pages: str, least: int = 20) -> str:
    return f"""SELECT doc_id, count(CASE WHEN n >= {least} AND NOT ok THEN 1 END) AS suspicious, count(CASE WHEN n >= {least} THEN 1 END) AS evaluated
FROM (SELECT doc_id, length({T.strip('text', d)}) AS n, {T.readable('text', least, d)} AS ok FROM {pages}) AS q GROUP BY doc_id"""


def has_text_layer_sql(d: SparkDialect, pages: str, sample: int = SAMPLE_PAGES) -> str:
    return f"SELECT doc_id, coalesce(sum(CASE WHEN page_no <= {sample} THEN length({T.strip('text', d)}) END), 0) >= 20 AS has_text FROM {pages} GROUP BY doc_id"


def missing_text_sql(d: SparkDialect, pages: str, least: int = 10) -> str:
    return f"SELECT doc_id, page_no FROM {pages} WHERE length({T.strip(EMPTY_AS_TEXT, d)}) < {least}"


def toc_score_sql(d: SparkDialect, pages: str) -> str:
    """(doc_id, page_no, text, score, is_toc) of each page's usable text."""
    keyword = "|".join(T.CONTENTS_KEYWORDS)
    clause = rf"^\p{{Nd}}+(?:[{T.SPACE}]*\.[{T.SPACE}]*\p{{Nd}}+)+[{T.SPACE}]*\z"
    ends = rf"(?:[{T.LEADER}{T.SPACE}]|^)[（(]?\p{{Nd}}{{1,4}}[）)]?[{T.SPACE}]*\z"
    wrapped = rf"(?:^|[{T.SPACE}])[（(][{T.SPACE}]*\p{{Nd}}{{1,4}}[{T.SPACE}]*[）)][{T.SPACE}]*\z"
    lines = d.only(d.each(d.lines("text"), "l", T.strip("l", d)), "l", "l <> ''")
    heading = T.compact(f"lower({d.joined(d.head('lines', 5), chr(39) * 2)})", d)
    single = d.size(d.only(d.head("lines", 5), "l", d.like(T.compact("lower(l)", d), f"^(?:{keyword})")))

    def many(pattern: str) -> str:
        return d.size(d.only("rows", "l", d.like("l", pattern)))

    return f"""WITH a AS (SELECT doc_id, page_no, text, {lines} AS lines FROM {pages}),
b AS (SELECT doc_id, page_no, text, {d.size('lines')} AS n, ({d.like(heading, f'^(?:{keyword})')} OR {single} > 0) AS keyword,
             {d.only('lines', 'l', f'NOT {d.like("l", clause)}')} AS rows FROM a),
c AS (SELECT doc_id, page_no, text, n, keyword, {many(ends)} AS numbered, {many(rf'[{T.LEADER}]{{3,}}')} AS leaders, {many(wrapped)} AS wrapped FROM b),
e AS (SELECT doc_id, page_no, text, CASE WHEN n < 2 THEN 0 ELSE
        CASE WHEN numbered >= 3 THEN CASE WHEN keyword THEN 50 ELSE 0 END + least(50, 10 * numbered) WHEN keyword AND numbered >= 1 THEN 70 ELSE 0 END
        + CASE WHEN leaders >= 2 THEN 30 ELSE 0 END + CASE WHEN wrapped >= 3 THEN 20 ELSE 0 END END AS score FROM c)
SELECT doc_id, page_no, text, CAST(score AS INT) AS score, score >= 60 AS is_toc FROM e"""


def toc_group_sql(d: SparkDialect, scored: str, first: int = SEARCH_PAGES) -> str:
    """Pages of the longest run of contents pages with gaps of at most one page, gaps filled."""
    pages = "explode(sequence(lo, hi))" if d.name == "spark" else "unnest(generate_series(lo, hi))"
    return f"""WITH a AS (SELECT doc_id, page_no, CASE WHEN page_no - lag(page_no) OVER (PARTITION BY doc_id ORDER BY page_no) <= 2 THEN 0 ELSE 1 END AS opens
  FROM {scored} WHERE is_toc AND page_no <= {first}),
b AS (SELECT doc_id, page_no, sum(opens) OVER (PARTITION BY doc_id ORDER BY page_no) AS run FROM a),
c AS (SELECT doc_id, run, min(page_no) AS lo, max(page_no) AS hi, count(*) AS n FROM b GROUP BY doc_id, run),
e AS (SELECT doc_id, lo, hi, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lo) AS place FROM c)
SELECT doc_id, CAST(page_no AS INT) AS page_no FROM (SELECT doc_id, {pages} AS page_no FROM e WHERE place = 1) AS f"""


def toc_group_lang_sql(d: SparkDialect, scored: str, first: int = SEARCH_PAGES, weak: int = WEAK) -> str:
    """Pages of the best run of adjacent candidates in one language that holds a strong page.

    scored may carry n_parsed: readable pages that are weak need two parsed entries.
    """
    return f"""WITH a AS (SELECT doc_id, page_no, score, is_toc, {T.script('text', d)} AS lang FROM {scored}
  WHERE score >= {weak} AND page_no <= {first} AND (is_toc OR n_parsed IS NULL OR n_parsed >= 2)),
b AS (SELECT *, CASE WHEN page_no = lag(page_no) OVER w + 1 AND lang = lag(lang) OVER w THEN 0 ELSE 1 END AS opens FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY page_no)),
c AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY page_no) AS run FROM b),
e AS (SELECT doc_id, run, count(*) AS n, sum(score) AS total, min(page_no) AS lo, bool_or(is_toc) AS strong FROM c GROUP BY doc_id, run),
f AS (SELECT doc_id, run, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, total DESC, lo) AS place FROM e WHERE strong)
SELECT c.doc_id, c.page_no, c.lang, c.score FROM c JOIN f ON c.doc_id = f.doc_id AND c.run = f.run WHERE f.place = 1"""


def document_kind_sql(d: SparkDialect, stats: str) -> str:
    """stats(doc_id, path, metadata_text, pages, pages_with_text, suspicious, evaluated, scan_like, invisible)."""
    damaged = "(evaluated > 0 AND suspicious >= greatest(2, CAST(floor(evaluated * 0.2) AS BIGINT)))"
    stem = d.replace("path", r"\.[^./\\]*\z")
    return f"""WITH a AS (SELECT *, {damaged} AS damaged,
  (pages_with_text < pages OR scan_like >= greatest(1, CAST(floor(pages / 2) AS BIGINT)) OR {damaged}) AS scanned,
  (instr(lower(coalesce(metadata_text, '')), '{MARKER}') > 0
   OR ({d.like(f'lower({stem})', r'_searchable\z')} AND invisible >= greatest(1, CAST(floor(pages * 0.8) AS BIGINT)))) AS processed FROM {stats})
SELECT doc_id, damaged, scanned, processed, CASE WHEN NOT scanned THEN 'digital' WHEN pages_with_text = 0 THEN 'image_only' WHEN damaged THEN 'damaged_text'
  WHEN pages_with_text < pages THEN 'partial_text' ELSE 'scanned_with_text' END AS kind FROM a"""


def text_layer_stats(pages: DataFrame, least: int = 10) -> DataFrame:
    return run(pages.sparkSession, lambda d, pages: text_layer_stats_sql(d, pages, least), pages=pages)


def text_quality(pages: DataFrame, least: int = 20) -> DataFrame:
    return run(pages.sparkSession, lambda d, pages: text_quality_sql(d, pages, least), pages=pages)


def usable_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("text", T.column(T.usable("text")))


def toc_score(pages: DataFrame) -> DataFrame:
    return run(pages.sparkSession, toc_score_sql, pages=pages)


def toc_pages(pages: DataFrame) -> DataFrame:
    """Contents pages (doc_id, page_no) by the text layer; only the first pages are scored."""
    scored = toc_score(usable_pages(pages.where(f"page_no <= {SEARCH_PAGES}")))
    return run(pages.sparkSession, toc_group_sql, scored=scored)


def scan_stats(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page_no, width, height, image_boxes, trace_types): scan-like and invisible pages.

    Image boxes are [x0, y0, x1, y1]; a page is scan-like if one covers at least 80 % of it.
    """
    from pyspark.sql import functions as F

    from ..functions.geometry import coverage

    marked = pages.select("doc_id", (coverage("image_boxes", "width", "height") >= 0.8).alias("scan"), F.coalesce(F.array_contains("trace_types", 3), F.lit(False)).alias("hidden"))
    return marked.groupBy("doc_id").agg(F.count_if("scan").alias("scan_like"), F.count_if("hidden").alias("invisible"))
