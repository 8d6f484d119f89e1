"""Bookmarks: target pages, range checks, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import text as T
from ..plans.sql import SparkDialect, run


def range_check_sql(d: SparkDialect, entries: str, documents: str) -> str:
    """entries with target, in_range and the document's number of entries out of range.

    documents(doc_id, n_pages, page_offset).  Special titles are exempt.
    """
    target = "e.logical_page + x.page_offset"
    ok = f"({T.special('e.title', d=d)} OR ({target} >= 1 AND {target} <= x.n_pages))"
    return f"""SELECT e.doc_id, e.entry_no, e.title, e.level, e.source_page, CAST({target} AS INT) AS target, {ok} AS in_range,
  sum(CASE WHEN {ok} THEN 0 ELSE 1 END) OVER (PARTITION BY e.doc_id) AS n_bad, x.n_pages FROM {entries} e JOIN {documents} x ON e.doc_id = x.doc_id"""


def bookmarks_sql(d: SparkDialect, entries: str, documents: str, prefaces: str, in_range_only: bool = False) -> str:
    """(doc_id, entry_no, level, title, target_page, clipped) of documents whose targets are all in range.

    Contents titles go to their own page, prefaces to the page found near it; levels are clamped
    anew.  in_range_only keeps the valid entries instead of rejecting the document.
    """
    keep = "in_range" if in_range_only else "n_bad = 0"
    goal = f"CASE WHEN {T.special('k.title', T.CONTENTS_TITLES, d)} THEN k.source_page WHEN f.page_no IS NOT NULL THEN f.page_no ELSE k.target END"
    return f"""WITH c AS ({range_check_sql(d, entries, documents)}),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY entry_no) AS INT) AS place FROM c WHERE {keep}),
g AS (SELECT k.doc_id, k.entry_no, k.place, k.title, k.n_pages, greatest(k.level, 1) AS raw_level, {goal} AS goal
      FROM k LEFT JOIN {prefaces} f ON k.doc_id = f.doc_id AND k.entry_no = f.entry_no)
SELECT doc_id, place AS entry_no, CAST(min(CASE WHEN place = 1 THEN 1 ELSE raw_level END - place) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + place AS INT) AS level,
  title, CAST({T.clamp('goal', 1, 'n_pages')} AS INT) AS target_page, (goal < 1 OR goal > n_pages) AS clipped FROM g"""


def summary_sql(d: SparkDialect, bookmarks: str) -> str:
    """bookmarks with dest_source: written, precise and clipped counts."""
    return f"SELECT doc_id, count(*) AS written, count(CASE WHEN dest_source <> 'page_top' THEN 1 END) AS precise_count, count(CASE WHEN clipped THEN 1 END) AS clipped_count FROM {bookmarks} GROUP BY doc_id"


def rejects_sql(d: SparkDialect, entries: str, documents: str) -> str:
    """(doc_id, n_bad, examples) of rejected documents; the first five bad entries as text."""
    text = "title || ' -> ' || CAST(target AS STRING)"
    return f"""WITH c AS ({range_check_sql(d, entries, documents)}),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY entry_no) AS place FROM c WHERE NOT in_range)
SELECT doc_id, CAST(max(n_bad) AS BIGINT) AS n_bad, {d.agg_text(f"CASE WHEN place <= 5 THEN {text} END", "'，'", "entry_no")} AS examples FROM b GROUP BY doc_id"""


def valid_sql(d: SparkDialect, entries: str) -> str:
    """(doc_id, valid): no empty title and no page under 1."""
    return f"SELECT doc_id, bool_and({T.strip('title', d)} <> '' AND logical_page >= 1) AS valid FROM {entries} GROUP BY doc_id"


def preview_sql(d: SparkDialect, entries: str, documents: str) -> str:
    """(doc_id, entry_no, label): level, title, printed page, target and whether it is outside."""
    return f"""SELECT doc_id, entry_no, '[L' || CAST(level AS STRING) || '] ' || title || ' (' || CAST(target AS STRING) || CASE WHEN target < 1 OR target > n_pages THEN ', outside' ELSE '' END || ')' AS label
FROM ({range_check_sql(d, entries, documents)}) AS c"""


def bookmarks(entries: DataFrame, documents: DataFrame, prefaces: DataFrame, in_range_only: bool = False) -> DataFrame:
    return run(entries.sparkSession, lambda d, **t: bookmarks_sql(d, **t, in_range_only=in_range_only), entries=entries, documents=documents, prefaces=prefaces)


def summary(found: DataFrame) -> DataFrame:
    return run(found.sparkSession, summary_sql, bookmarks=found)


def rejects(entries: DataFrame, documents: DataFrame) -> DataFrame:
    return run(entries.sparkSession, rejects_sql, entries=entries, documents=documents)


def valid(entries: DataFrame) -> DataFrame:
    return run(entries.sparkSession, valid_sql, entries=entries)


def preview(entries: DataFrame, documents: DataFrame) -> DataFrame:
    return run(entries.sparkSession, preview_sql, entries=entries, documents=documents)
