"""Relations of books, contents rows, pages and fragments derived from the star schema.

Every builder gives SQL for either dialect over base tables named by t; arithmetic only, so both
engines derive the same rows from whole tables.
"""

from __future__ import annotations

from .sql import SparkDialect

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations", "embeddings")
PLAIN = {name: name for name in BASE}


def toc_rows(d: SparkDialect, t: dict[str, str]) -> str:
    """Contents rows of books: a book is a customer, a chapter an order, a section a line item.

    (doc_id, idx, source_page, row_no, numbering, name, row_text); contents start on page 2 with
    12 rows a page, every 17th row is a web address.
    Where t names the written relation, it is read.
    """
    if "toc_rows" in t:
        return f"SELECT * FROM {t['toc_rows']}"
    return f"""SELECT doc_id, idx, CAST(2 + floor((idx - 1) / 12) AS INT) AS source_page, CAST((idx - 1) % 12 + 1 AS INT) AS row_no, numbering, name,
  CASE WHEN idx % 17 = 0 THEN 'www.example.com' ELSE numbering || ' ' || name || ' ........ (' || CAST(idx AS STRING) || ')' END AS row_text
FROM (SELECT doc_id, name, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ch, sec) AS INT) AS idx,
        CASE WHEN sec = 1 THEN CAST(ch AS STRING) WHEN sec % 3 = 0 THEN CAST(ch AS STRING) || '.' || CAST(sec AS STRING) || '.1.1' ELSE CAST(ch AS STRING) || '.' || CAST(sec AS STRING) END AS numbering
      FROM (SELECT o.doc_id, o.ch, s.sec, upper(p.p_name) AS name
            FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS sec FROM {t['lineitem']}) AS s
            JOIN (SELECT o_orderkey, o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ch FROM {t['orders']}) AS o ON s.l_orderkey = o.o_orderkey
            JOIN {t['part']} p ON p.p_partkey = s.l_partkey) AS j) AS n"""


def books(d: SparkDialect, t: dict[str, str]) -> str:
    """(doc_id, last_toc_page, n_pages, page_offset): true offset = last contents page + doc_id % 3; every 7th book lacks its last pages."""
    if "books" in t:
        return f"SELECT * FROM {t['books']}"
    return f"""SELECT doc_id, max(source_page) AS last_toc_page, CAST(max(source_page) + doc_id % 3 + max(idx) - CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 0 END AS INT) AS n_pages,
  CAST(max(source_page) + doc_id % 3 AS INT) AS page_offset FROM ({toc_rows(d, t)}) AS r GROUP BY doc_id"""


def body_rows(d: SparkDialect, t: dict[str, str]) -> str:
    """Heading rows of the books' bodies: every 11th is altered, every 5th stands a page late."""
    return f"""SELECT r.doc_id, CAST(r.idx + b.page_offset + CASE WHEN r.idx % 5 = 0 THEN 1 ELSE 0 END AS INT) AS page_no, CAST(40.0 + r.idx % 7 AS DOUBLE) AS y, CAST(50.0 AS DOUBLE) AS x0,
  CAST(30.0 + r.idx % 7 AS DOUBLE) AS y0, r.numbering || CASE WHEN r.idx % 11 = 0 THEN '.9 ' ELSE ' ' END || r.name AS row_text
FROM ({toc_rows(d, t)}) AS r JOIN ({books(d, t)}) AS b ON r.doc_id = b.doc_id"""


def toc_text(d: SparkDialect, t: dict[str, str]) -> str:
    """pages(doc_id, page_no, text) of the books' contents; the first has a heading, books alternate in language."""
    rows = toc_rows(d, t)
    return f"""SELECT doc_id, source_page AS page_no, CASE WHEN source_page = 2 THEN CASE WHEN doc_id % 2 = 0 THEN '目 次' ELSE 'CONTENTS' END || chr(10) ELSE '' END
  || {d.agg_text("CASE WHEN doc_id % 2 = 0 THEN '总则与范围' ELSE '' END || row_text", "chr(10)", "row_no")} AS text FROM ({rows}) AS r GROUP BY doc_id, source_page"""


def text_pages(d: SparkDialect, t: dict[str, str]) -> str:
    """pages(doc_id, page_no, text): whole documents cut into pages of 4 lines; some get defects."""
    lines = d.unnest(f"(SELECT doc_id, text FROM {t['documents']})", d.lines("text"), "line", "line_no")
    defect = "CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 7 = 0 THEN '��' WHEN doc_id % 11 = 0 THEN '\u0001\u0002\u0003\u0004' ELSE '' END"
    return f"""SELECT doc_id, CAST(floor((line_no - 1) / 4) + 1 AS INT) AS page_no, {defect} || {d.agg_text('line', 'chr(10)', 'line_no')} AS text
FROM {lines} AS x GROUP BY doc_id, CAST(floor((line_no - 1) / 4) + 1 AS INT)"""


def fragments(d: SparkDialect, t: dict[str, str]) -> str:
    """Words of whole documents as fragments: 10 words a row, 6 rows a page, jittered heights."""
    words = d.unnest(f"(SELECT doc_id, {d.replace('text', '[ \\n]+', ' ')} AS s FROM {t['documents']})", d.split("s", "' '"), "word", "n")
    return f"""SELECT doc_id, CAST(floor((n - 1) / 60) + 1 AS INT) AS page_no, CAST((n - 1) % 60 AS INT) AS span_no, word AS text,
  CAST(6 * ((n - 1) % 10) AS DOUBLE) AS x0, CAST(12 * floor(((n - 1) % 60) / 10) + (7 * doc_id + 13 * n) % 5 - 2 AS DOUBLE) AS y,
  CAST(12 * floor(((n - 1) % 60) / 10) + (7 * doc_id + 13 * n) % 5 - 6 AS DOUBLE) AS y0 FROM {words} AS w WHERE word <> ''"""


def candidates(d: SparkDialect, t: dict[str, str]) -> str:
    """Margin-number candidates of contents pages: pages are orders, crops and values from line items."""
    return f"""SELECT l_orderkey AS doc_id, 1 AS page_no, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS seq,
  CAST(l_suppkey % 5 AS INT) AS crop_ix, CAST(20 * l_linenumber + l_partkey % 3 AS DOUBLE) AS y, CAST(l_quantity AS INT) % 4 AS value, l_discount AS conf FROM {t['lineitem']}"""


def titles(d: SparkDialect, t: dict[str, str]) -> str:
    """Title rows on the same pages, beside the candidates."""
    return f"""SELECT l_orderkey AS doc_id, 1 AS page_no, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS row_no,
  CAST(20 * l_linenumber + (l_partkey * 3) % 9 - 4 AS DOUBLE) AS y, 'TITLE ' || CAST(l_partkey AS STRING) AS title FROM {t['lineitem']}"""


def weak_pages(d: SparkDialect, t: dict[str, str]) -> str:
    """(doc_id, page_no, line_no, line): five lines on the page after the contents; only those of even books are titles."""
    return f"""SELECT b.doc_id, b.last_toc_page + 1 AS page_no, r.idx AS line_no, CASE WHEN b.doc_id % 2 = 0 THEN '总则与范围 ' ELSE 'of the ' END || lower(r.name) || ' ' || CAST(r.idx AS STRING) AS line
FROM ({books(d, t)}) AS b JOIN ({toc_rows(d, t)}) AS r ON b.doc_id = r.doc_id WHERE r.idx <= 5"""


def numbering(d: SparkDialect, t: dict[str, str]) -> str:
    """Tokens of the numbering column, some with a wide full stop, some no numbers, some close to each other."""
    token = "CASE seq % 5 WHEN 0 THEN 'x' || CAST(value AS STRING) WHEN 1 THEN CAST(value AS STRING) || '。' || CAST(seq AS STRING) WHEN 2 THEN ' ' || CAST(seq AS STRING) ELSE CAST(seq AS STRING) || '.' END"
    return f"SELECT doc_id, page_no, floor(y / 2) AS y, CAST(value * 10 + seq AS DOUBLE) AS x0, {token} AS token FROM ({candidates(d, t)}) AS c"
