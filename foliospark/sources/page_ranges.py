"""Page-range literals such as 5-8,10."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def parse_ranges(rows: DataFrame) -> DataFrame:
    """rows(range, max_page, ...) with pages: ascending distinct numbers.

    Null for a blank literal and for one with any bad, reversed or outside part; empty where only
    commas stand.
    """
    parts = F.filter(F.transform(F.split(F.replace("range", F.lit("，"), F.lit(",")), ","), lambda p: F.regexp_replace(p, rf"[{T.SPACE}]+", " ")), lambda p: F.trim(p) != "")
    bound = lambda p, i: F.trim(F.get(F.split(p, "-", 2), F.lit(i))).try_cast("int")
    low = lambda p: bound(p, 0)
    high = lambda p: F.when(F.contains(p, F.lit("-")), bound(p, 1)).otherwise(bound(p, 0))
    good = F.forall(parts, lambda p: F.coalesce((low(p) >= 1) & (high(p) >= low(p)) & (high(p) <= F.col("max_page")), F.lit(False)))
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(low(p), high(p))))))
    blank = T.column(T.strip("range")) == ""
    return rows.withColumn("pages", F.when(blank | ~good, F.lit(None).cast("array<int>")).otherwise(pages))
