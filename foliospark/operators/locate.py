"""Heading lookup, page offset votes, front-matter probes and the coordinate cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..plans.sql import SPARK, SparkDialect, run
from . import rows as R

VOTERS, BODY_PAGES, RADIUS = 6, 50, 4


def best_heading_sql(d: SparkDialect, titles: str, rows: str, one_page: bool = False) -> str:
    """(doc_id, entry_no, page_no, x, y): the best row for each title on each page of its document.

    titles(doc_id, entry_no, title[, lo, hi]), rows(doc_id, page_no, y, x0, y0, row_text).  A
    numbered title must start its row, another may stand inside; equal rows come first, then rows
    that start with it, then the nearest length, then the highest row.  one_page: lo equals hi, so
    titles and rows meet by page and not by document.
    """
    near = "r.page_no = t2.lo" if one_page else "r.page_no BETWEEN t2.lo AND t2.hi"
    title_key, row_key = T.match_key("title", d), T.match_key("row_text", d)
    return f"""WITH t AS (SELECT doc_id, entry_no, lo, hi, {title_key} AS k FROM {titles}),
t2 AS (SELECT *, {T.numbered_key('k', d)} AS numbered FROM t WHERE k <> ''),
r AS (SELECT doc_id, page_no, y, x0, y0, {row_key} AS rk FROM {rows}),
m AS (SELECT t2.doc_id, t2.entry_no, r.page_no, r.x0, r.y0, row_number() OVER (PARTITION BY t2.doc_id, t2.entry_no, r.page_no
        ORDER BY CASE WHEN rk = k THEN 2 WHEN instr(rk, k) = 1 THEN 1 ELSE 0 END DESC, abs(length(rk) - length(k)), r.y, r.x0) AS place
      FROM t2 JOIN r ON t2.doc_id = r.doc_id AND {near} AND instr(r.rk, t2.k) > 0 AND (NOT t2.numbered OR instr(r.rk, t2.k) = 1))
SELECT doc_id, entry_no, page_no, x0 AS x, greatest(0.0, y0 - 15.0) AS y FROM m WHERE place = 1"""


def heading_rows(items: DataFrame) -> DataFrame:
    """Rows for lookup from recognised items(doc_id, page_no, item_no, text, box)."""
    return R.page_rows(R.item_fragments(items), 3.0, seq="item_no")


def span_items(spans: DataFrame) -> DataFrame:
    """Native spans in the shape of recognised items."""
    return spans.select("doc_id", "page_no", F.col("span_no").alias("item_no"), "text", G.quad("x0", "y0", "x1", "y1").alias("box"))


def find_headings(titles: DataFrame, rows: DataFrame, one_page: bool = False) -> DataFrame:
    """titles(doc_id, entry_no, title, lo, hi): best row on each page from lo to hi."""
    return run(titles.sparkSession, lambda d, titles, rows: best_heading_sql(d, titles, rows, one_page), titles=titles, rows=rows)


def voters_sql(d: SparkDialect, entries: str) -> str:
    """The first entries that vote: no special titles, pages from 1 on."""
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY entry_no) AS voter FROM {entries}
WHERE NOT {T.special('title', d=d)} AND logical_page >= 1) AS v WHERE voter <= {VOTERS}"""


def offset_sql(d: SparkDialect, votes: str, documents: str, entries: str) -> str:
    """(doc_id, page_offset, votes, agreeing, status) for documents(doc_id, last_toc_page).

    votes(doc_id, entry_no, vote): the most frequent vote, the first cast among equals.  status:
    matched, disputed (no strict majority) or guessed (no vote: just after the contents).
    """
    return f"""WITH e AS ({voters_sql(d, entries)}),
g AS (SELECT doc_id, min(logical_page) AS first_page FROM e GROUP BY doc_id),
n AS (SELECT doc_id, vote, count(*) AS n, min(entry_no) AS cast_at FROM {votes} GROUP BY doc_id, vote),
b AS (SELECT doc_id, vote, n, sum(n) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, cast_at) AS place FROM n)
SELECT x.doc_id, CAST(coalesce(b.vote, x.last_toc_page + 1 - coalesce(g.first_page, 1)) AS INT) AS page_offset, CAST(coalesce(b.total, 0) AS BIGINT) AS votes,
  coalesce(b.n, 0) AS agreeing, CASE WHEN b.vote IS NULL THEN 'guessed' WHEN 2 * b.n > b.total THEN 'matched' ELSE 'disputed' END AS status
FROM {documents} x LEFT JOIN g ON x.doc_id = g.doc_id LEFT JOIN (SELECT * FROM b WHERE place = 1) AS b ON x.doc_id = b.doc_id"""


def text_votes(entries: DataFrame, rows: DataFrame, documents: DataFrame, body: int = BODY_PAGES) -> DataFrame:
    """(doc_id, entry_no, vote) by the text layer: the first page after the contents with the heading."""
    voters = run(entries.sparkSession, voters_sql, entries=entries).join(documents.select("doc_id", "last_toc_page"), "doc_id")
    titles = voters.select("doc_id", "entry_no", "title", "logical_page", (F.col("last_toc_page") + 1).alias("lo"), (F.col("last_toc_page") + body).alias("hi"))
    first = find_headings(titles, rows).groupBy("doc_id", "entry_no").agg(F.min("page_no").alias("page_no"))
    return first.join(titles, ["doc_id", "entry_no"]).select("doc_id", "entry_no", (F.col("page_no") - F.col("logical_page")).cast("int").alias("vote"))


def ocr_votes(entries: DataFrame, rows: DataFrame, known: DataFrame, documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Votes by recognised pages of documents(doc_id, last_toc_page, n_pages).

    An entry votes for the first known page with its heading; without one, pages within the radius of
    the expected one are recognised in turn up to the first with the heading.  known(doc_id, page_no)
    are those recognised before; pages recognised for one entry are known to the later ones.
    """
    voters = run(entries.sparkSession, voters_sql, entries=entries).join(documents.select("doc_id", "last_toc_page", "n_pages"), "doc_id")
    rough = F.col("last_toc_page") + 1 - F.min("logical_page").over(Window.partitionBy("doc_id"))
    first = (F.col("last_toc_page") + 1).cast("int")
    titles = voters.withColumn("first", first).withColumn("lo", first).withColumn("hi", F.col("n_pages")).withColumn("expected", F.col("logical_page") + rough)
    hits = find_headings(titles.select("doc_id", "entry_no", "title", "lo", "hi"), rows)
    hits = hits.join(known.select("doc_id", "page_no", F.lit(True).alias("known")).distinct(), ["doc_id", "page_no"], "left")
    hits = hits.groupBy("doc_id", "entry_no").agg(F.array_sort(F.collect_list(F.struct(F.col("page_no").cast("int").alias("page_no"), F.coalesce("known", F.lit(False)).alias("known")))).alias("hits"))
    low, high = F.greatest("first", F.col("expected") - radius).cast("int"), F.least("n_pages", F.col("expected") + radius).cast("int")
    tried = titles.join(hits, ["doc_id", "entry_no"], "left").select("doc_id", "entry_no", "logical_page", low.alias("low"), high.alias("high"), F.coalesce("hits", F.array().cast("array<struct<page_no:int,known:boolean>>")).alias("hits"))
    tried = tried.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*tried.columns[1:]))).alias("voters"))  # VOTERS at most

    def page(x: Column) -> Column:
        return x["page_no"]

    def step(state: Column, v: Column) -> Column:
        seen = F.get(F.transform(F.filter(v["hits"], lambda h: h["known"] | F.array_contains(state["read"], h["page_no"])), page), F.lit(0))
        met = F.get(F.transform(F.filter(v["hits"], lambda h: (h["page_no"] >= v["low"]) & (h["page_no"] <= v["high"])), page), F.lit(0))
        end = F.coalesce(met, v["high"])
        read = F.when(seen.isNull() & (end >= v["low"]), F.array_union(state["read"], F.sequence(v["low"], end))).otherwise(state["read"])
        vote = F.struct(v["entry_no"].alias("entry_no"), (F.coalesce(seen, met) - v["logical_page"]).cast("int").alias("vote"))
        return F.struct(read.alias("read"), F.concat(state["votes"], F.array(vote)).alias("votes"))

    kind = dict(entries.dtypes)["entry_no"]
    start = F.struct(F.array().cast("array<int>").alias("read"), F.array().cast(f"array<struct<entry_no:{kind},vote:int>>").alias("votes"))
    votes = tried.select("doc_id", F.inline(F.aggregate("voters", start, step, lambda z: z["votes"])))
    return votes.where("vote IS NOT NULL")


def page_offset(votes: DataFrame, documents: DataFrame, entries: DataFrame) -> DataFrame:
    return run(votes.sparkSession, offset_sql, votes=votes, documents=documents, entries=entries)


def preface_sql(d: SparkDialect, entries: str, pages: str) -> str:
    """(doc_id, entry_no, page_no) of preface-like entries found near their contents page.

    Probes source_page +1, +2, +3, -1, -2, -3 in this order; the title must begin within the
    first 100 characters or fifth of the page's text without spaces.  pages hold the text as it is to
    be read: the text layer where usable, else what was recognised.
    """
    probes = " UNION ALL ".join(f"SELECT {i} AS probe, {s} AS step" for i, s in enumerate((1, 2, 3, -1, -2, -3), 1))
    return f"""WITH e AS (SELECT doc_id, entry_no, {T.compact('title', d)} AS k, source_page FROM {entries} WHERE {T.special('title', T.PREFACE_TITLES, d)}),
p AS (SELECT doc_id, page_no, {T.compact('text', d)} AS body FROM {pages}),
h AS (SELECT e.doc_id, e.entry_no, p.page_no, row_number() OVER (PARTITION BY e.doc_id, e.entry_no ORDER BY probe) AS place
  FROM e CROSS JOIN ({probes}) AS s JOIN p ON p.doc_id = e.doc_id AND p.page_no = e.source_page + s.step
  WHERE instr(body, k) > 0 AND instr(body, k) - 1 <= greatest(100, CAST(floor(length(body) / 5) AS INT)))
SELECT doc_id, entry_no, page_no FROM h WHERE place = 1"""


def preface_pages(entries: DataFrame, pages: DataFrame) -> DataFrame:
    return run(entries.sparkSession, preface_sql, entries=entries, pages=pages)


def destinations(targets: DataFrame, ocr_rows: DataFrame, text_rows: DataFrame, text_pages: DataFrame, known: DataFrame | None = None, use_ocr: bool = False, ocr_fallback: bool = False) -> DataFrame:
    """targets(doc_id, entry_no, title, target_page) with dest_source, x and y.

    Cascade: recognised rows first where use_ocr asks for them or the page is in known(doc_id,
    page_no); then the text layer where usable; then, with ocr_fallback, recognised rows; else the page
    top.  A page recognised as fallback is known to the document's later entries.
    """
    asked = targets.select("doc_id", "entry_no", "title", F.col("target_page").alias("lo"), F.col("target_page").alias("hi"))
    named = lambda hits, s: hits.select("doc_id", "entry_no", F.struct("x", "y").alias(s))
    by_ocr = named(find_headings(asked, ocr_rows, True), "ocr")
    usable = text_rows.join(text_pages.where(T.column(T.usable("text")) != "").select("doc_id", "page_no"), ["doc_id", "page_no"], "left_semi")
    by_text = named(find_headings(asked, usable, True), "native")
    out = targets.join(by_ocr, ["doc_id", "entry_no"], "left").join(by_text, ["doc_id", "entry_no"], "left")
    ahead = F.lit(use_ocr)
    if known is not None:
        out = out.join(known.select("doc_id", F.col("page_no").alias("target_page"), F.lit(True).alias("__known")).distinct(), ["doc_id", "target_page"], "left")
        ahead = ahead | F.coalesce("__known", F.lit(False))
    if ocr_fallback:
        before = Window.partitionBy("doc_id", "target_page").orderBy("entry_no").rowsBetween(Window.unboundedPreceding, -1)
        ahead = ahead | F.coalesce(F.bool_or(F.col("native").isNull()).over(before), F.lit(False))
    by_ocr, by_text = F.col("ocr").isNotNull(), F.col("native").isNotNull()
    out = out.withColumn("dest_source", F.when(ahead & by_ocr, "ocr").when(by_text, "text").when(by_ocr & F.lit(ocr_fallback), "ocr").otherwise("page_top"))
    point = F.when(F.col("dest_source") == "ocr", F.col("ocr")).when(F.col("dest_source") == "text", F.col("native"))
    return out.withColumn("dest", point).select(*targets.columns, "dest", "dest_source")
