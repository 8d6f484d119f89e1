"""Hand-edited contents files: one entry a line, indented by level, ending in its page number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.sql import SparkDialect, run

HEADER = """# Contents for review.
# One entry a line: title, a tab or spaces, printed page number.
# Indent by one tab, or two spaces, for each level below the first (up to four levels).
# Lines that begin with # are ignored.
"""


def lines_sql(d: SparkDialect, lines: str) -> str:
    """lines(doc_id, line_no, line) parsed; invalid lines have no page."""
    f = T.toc_line("line", d)
    return f"SELECT doc_id, line_no, {f['title']} AS title, {f['page']} AS logical_page, {f['level']} AS level FROM {lines} WHERE NOT {f['skip']}"


def import_sql(d: SparkDialect, lines: str) -> str:
    """Entries of files without an invalid line; source pages default to 1."""
    return f"""WITH a AS ({lines_sql(d, lines)}),
b AS (SELECT *, sum(CASE WHEN logical_page IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS bad FROM a)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS INT) AS entry_no, title, logical_page, CAST(level AS INT) AS level, 1 AS source_page FROM b WHERE bad = 0"""


def bad_lines_sql(d: SparkDialect, lines: str, first: int = 10) -> str:
    """(doc_id, n_bad, line_numbers) of files with invalid lines; the first ten numbers as text."""
    return f"""WITH a AS ({lines_sql(d, lines)}),
b AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS place FROM a WHERE logical_page IS NULL)
SELECT doc_id, count(*) AS n_bad, {d.agg_text(f"CASE WHEN place <= {first} THEN CAST(line_no AS STRING) END", "', '", "line_no")} AS line_numbers FROM b GROUP BY doc_id"""


def export_sql(d: SparkDialect, entries: str) -> str:
    """(doc_id, body) with one line for each entry, in order."""
    line = "repeat(chr(9), level - 1) || title || chr(9) || CAST(logical_page AS STRING)"
    return f"SELECT doc_id, {d.agg_text(line, 'chr(10)', 'entry_no')} || chr(10) AS body FROM {entries} GROUP BY doc_id"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, line_no, line): files as documents; line numbers start at 1."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), "value")
    body = F.regexp_replace(F.regexp_replace("value", r"\r\n?", "\n"), r"\n\z", "")
    return whole.select("doc_id", F.posexplode(F.split(body, "\n")).alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("line_no"), "line")


def import_entries(lines: DataFrame) -> DataFrame:
    return run(lines.sparkSession, import_sql, lines=lines)


def bad_lines(lines: DataFrame) -> DataFrame:
    return run(lines.sparkSession, bad_lines_sql, lines=lines)


def export_text(entries: DataFrame) -> DataFrame:
    out = run(entries.sparkSession, export_sql, entries=entries)
    return out.withColumn("body", F.concat(F.lit(HEADER + "\n"), "body"))


def parse_model_reply(replies: DataFrame) -> DataFrame:
    """Entries of replies(doc_id, reply, first_toc_page): a JSON array, maybe in a code fence.

    An element needs a title; page and level default to 1, level is held to 1 to 4.  A reply that
    is no array, or holds an unreadable number, gives no rows.
    """
    fenced = F.when(F.instr("reply", "```json") > 0, F.get(F.split(F.get(F.split("reply", "```json"), F.lit(1)), "```"), F.lit(0)))
    fenced = fenced.when(F.instr("reply", "```") > 0, F.get(F.split(F.get(F.split("reply", "```"), F.lit(1)), "```"), F.lit(0))).otherwise(F.col("reply"))
    rows = F.from_json(F.trim(fenced), "array<struct<title:string,page:string,level:string>>")
    kept = replies.select("doc_id", "first_toc_page", rows.alias("rows")).where("rows IS NOT NULL")
    number = lambda f: F.when(f.isNull(), F.lit(1)).otherwise(f.try_cast("int"))
    kept = kept.where(~F.exists("rows", lambda r: r.isNull() | number(r["page"]).isNull() | number(r["level"]).isNull()))
    out = kept.select("doc_id", "first_toc_page", F.posexplode("rows").alias("p", "r")).withColumn("title", T.column(T.strip("coalesce(r.title, '')"))).where("title <> ''")
    return out.select("doc_id", (F.col("p") + 1).alias("item_no"), "title", number(F.col("r.page")).alias("logical_page"), F.least(F.greatest(number(F.col("r.level")), F.lit(1)), F.lit(4)).alias("level"), F.coalesce("first_toc_page", F.lit(1)).alias("source_page"))
