"""Contents rows to entries: row tokenizer, levels, hierarchy repair, contradiction check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.sql import SparkDialect, run
from . import rows as R


def row_items_sql(d: SparkDialect, rows: str) -> str:
    """(doc_id, source_page, row_no, item_no, title, logical_page) of rows(doc_id, source_page, row_no, row_text).

    One row can give several items: it is cut before each chapter anchor.  A row that starts with
    a number and has a leader is one item.  The rows are gone through once, each rule evaluated once.
    """
    marked = "instr(m, chr(1)) > 0"
    whole_token, whole_title = T.whole_line("r", d)
    plain_token, plain_title = T.chunk("piece", True, d)
    piece_token, piece_title = T.chunk("piece", False, d)

    def good(title: str, page: str) -> str:
        return f"({title} <> '' AND {page} IS NOT NULL AND {T.meaningful(title, d)})"

    def cleaned(token: str, title: str) -> tuple[str, str]:
        return f"CASE WHEN {token} <> '' THEN {T.clean_title(title, d)} END", f"CASE WHEN {token} <> '' THEN {T.page_token(token, d)} END"

    t = d.once(f"(SELECT doc_id, source_page, row_no, row_text FROM {rows} WHERE NOT {T.noise('row_text', d)})", r=T.open_brackets("row_text", d))
    t = d.once(t, whole=whole_token)
    own_title, own_page = cleaned("whole", whole_title)
    t = d.once(t, own_title=own_title, own_page=own_page)
    t = d.once(t, done=f"coalesce({good('own_title', 'own_page')}, false)")
    t = d.once(t, m=f"CASE WHEN done THEN '' ELSE {T.marked('r', d)} END")
    pieces = f"CASE WHEN done THEN {d.items(repr(''))} WHEN {marked} THEN {d.split('m', 'chr(1)')} ELSE {d.items('r')} END"
    t = f"(SELECT * FROM {d.unnest(t, pieces, 'piece', 'item_no')} AS x WHERE item_no > 1 OR NOT {marked})"
    t = d.once(t, token=f"CASE WHEN done THEN '' WHEN {marked} THEN {piece_token} ELSE {plain_token} END")
    title, page = cleaned("token", f"CASE WHEN {marked} THEN {piece_title} ELSE {plain_title} END")
    t = d.once(t, title=f"CASE WHEN done THEN own_title ELSE {title} END", logical_page=f"CASE WHEN done THEN own_page ELSE {page} END")
    return f"""SELECT doc_id, source_page, row_no, CAST(item_no AS INT) AS item_no, title, CAST(logical_page AS INT) AS logical_page FROM {t} AS u
WHERE done OR {good('title', 'logical_page')}"""


def entries_sql(d: SparkDialect, items: str) -> str:
    """Items in reading order with entry_no and guessed, clamped levels."""
    order = "PARTITION BY doc_id ORDER BY source_page, row_no, item_no"
    return f"""WITH a AS (SELECT doc_id, CAST(row_number() OVER ({order}) AS INT) AS entry_no, title, logical_page, coalesce({T.level_guess('title', d)}, 1) AS raw_level, source_page FROM {items})
{clamp_sql('a')}"""


def clamp_sql(entries: str) -> str:
    """level: 1 first, then at most one deeper than the entry before (closed form of the recurrence)."""
    return f"""SELECT doc_id, entry_no, title, logical_page, CAST(min(CASE WHEN entry_no = 1 THEN 1 ELSE greatest(raw_level, 1) END - entry_no)
  OVER (PARTITION BY doc_id ORDER BY entry_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + entry_no AS INT) AS level, title AS raw_text, source_page FROM {entries}"""


def parents_sql(d: SparkDialect, entries: str) -> str:
    """parent_no: the latest entry one level up, else the next lower level that has been seen, else null."""
    frame = "PARTITION BY doc_id ORDER BY entry_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    seen = ", ".join(f"{d.last_known(f'CASE WHEN level = {k} THEN entry_no END')} OVER ({frame}) AS l{k}" for k in (1, 2, 3))
    return f"""WITH a AS (SELECT *, {seen} FROM {entries})
SELECT doc_id, entry_no, level, title, CASE WHEN level >= 4 THEN coalesce(l3, l2, l1) WHEN level = 3 THEN coalesce(l2, l1) WHEN level = 2 THEN l1 END AS parent_no FROM a"""


def needs_ocr_sql(d: SparkDialect, entries: str) -> str:
    """Per document with entries: unreadable titles, pages under 1, or a section of another chapter.

    A document without entries needs recognition too; it has no row here (see needs_ocr).
    """
    t = T.compact("title", d)
    major, minor = d.extract(t, r"^(\p{Nd}+)", 1), d.extract(t, r"^\p{Nd}+\.(\p{Nd}+)", 1)
    return f"""WITH a AS (SELECT doc_id, entry_no, logical_page, {T.readable('title', 2, d)} AS ok, {d.to_int(major)} AS major, {minor} <> '' AS dotted, {major} <> '' AS numbered FROM {entries}),
b AS (SELECT *, {d.last_known("CASE WHEN NOT numbered THEN -1 WHEN NOT dotted THEN major END")} OVER (PARTITION BY doc_id ORDER BY entry_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS chapter FROM a)
SELECT doc_id, bool_or(logical_page < 1 OR NOT ok OR (dotted AND chapter >= 0 AND major <> chapter AND chapter IS NOT NULL)) AS needs_ocr FROM b GROUP BY doc_id"""


def row_items(rows: DataFrame) -> DataFrame:
    return run(rows.sparkSession, row_items_sql, rows=rows)


def entries(items: DataFrame) -> DataFrame:
    return run(items.sparkSession, entries_sql, items=items)


def parents(found: DataFrame) -> DataFrame:
    return run(found.sparkSession, parents_sql, entries=found)


def parse_text_pages(spans: DataFrame, pages: DataFrame, toc_pages: DataFrame) -> DataFrame:
    """Entries of the text layer's contents pages; pages outside the document are dropped by the join."""
    wanted = pages.join(toc_pages.select("doc_id", "page_no").distinct(), ["doc_id", "page_no"])
    rows = R.span_rows(spans, wanted).withColumnRenamed("page_no", "source_page")
    return entries(row_items(rows))


def parse_ocr_pages(items: DataFrame, pages: DataFrame, candidates: DataFrame, tokens: DataFrame, toc_pages: DataFrame) -> DataFrame:
    """Entries of recognised contents pages: title rows, repaired numbering, margin numbers.

    Only the document's first level is set to 1; deeper ones stay as guessed.
    """
    wanted = pages.join(toc_pages.select("doc_id", "page_no").distinct(), ["doc_id", "page_no"])
    titles = R.repair_numbering(R.title_rows(items, wanted), R.left_numbers(tokens))
    titles = titles.withColumn("title", T.column(T.clean_title("row_text"))).where(T.column(T.meaningful("title")))
    found = R.match_margin(titles, R.margin_votes(candidates))
    return run(
        items.sparkSession,
        lambda d, found: f"""WITH a AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_no, row_no) AS INT) AS entry_no FROM {found})
SELECT doc_id, entry_no, title, logical_page, CASE WHEN entry_no = 1 THEN 1 ELSE coalesce({T.level_guess('title', d)}, 1) END AS level, title AS raw_text, page_no AS source_page FROM a""",
        found=found,
    )


def needs_ocr(found: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, needs_ocr) for every document of documents(doc_id)."""
    judged = run(found.sparkSession, needs_ocr_sql, entries=found)
    return documents.select("doc_id").distinct().join(judged, "doc_id", "left").select("doc_id", F.coalesce("needs_ocr", F.lit(True)).alias("needs_ocr"))


def merge_pages(found: DataFrame) -> DataFrame:
    """Entries of several contents pages, each parsed alone: renumbered and clamped together.

    found(doc_id, source_page, entry_no, title, logical_page, level): the first entry of every
    later page takes the level its numbering tells, where it tells one.
    """
    return run(
        found.sparkSession,
        lambda d, found: f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source_page ORDER BY entry_no) AS on_page,
  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY source_page, entry_no) AS INT) AS place FROM {found}),
b AS (SELECT doc_id, place AS entry_no, title, logical_page, CASE WHEN on_page = 1 AND place > 1 THEN coalesce({T.level_guess('title', d)}, level) ELSE level END AS raw_level, source_page FROM a)
{clamp_sql('b')}""",
        found=found,
    )
