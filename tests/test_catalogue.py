"""Registered queries against DuckDB on the smallest tables; plans stay inside the JVM."""

import glob
import numbers
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from foliospark import catalogue

DATA = "/root/testdata/sf0.001"
FAST = ["title_clean", "title_meaningful", "roman_to_int", "level_guess", "margin_token", "heal_rows", "noise_filter", "text_quality", "toc_page_score", "toc_groups_text", "document_kind", "margin_vote", "quad_rect", "draw_ops", "scan_coverage", "page_range_parse", "ocr_failure_report", "outline_parents", "offset_vote", "bookmark_range_reject"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def text(v):
        if v is None or v is pd.NA or v != v:
            return ""
        return repr(round(float(v), 9)) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(text, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", FAST)
def test_twins_agree(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    ours, theirs = catalogue.queries()[name](spark, DATA).toPandas(), con.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_no_python_in_native_plans(spark):
    for name, query in catalogue.queries().items():
        plan = query(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "ArrowEval" not in plan, name


def test_entry_and_contract(spark):
    assert entry.entry(spark).columns == ["doc_id", "entry_no", "title", "logical_page", "level", "raw_text", "source_page"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
