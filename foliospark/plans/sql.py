"""One SQL text for two engines: the dialects differ only in regular expressions and lists.

Patterns are written in the common subset of both regular-expression syntaxes: no look-around,
explicit white-space and digit classes, \\z instead of $.  Group references are written $1.
"""

from __future__ import annotations

import atexit
import itertools
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_names = itertools.count()


class SparkDialect:
    name = "spark"

    def replace(self, x: str, pattern: str, by: str = "") -> str:
        return f"regexp_replace({x}, r'{pattern}', '{by}')"

    def extract(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({x}, r'{pattern}', {group})"

    def like(self, x: str, pattern: str) -> str:
        return f"regexp_like({x}, r'{pattern}')"

    def count(self, x: str, pattern: str) -> str:
        return f"regexp_count({x}, r'{pattern}')"

    def lines(self, x: str) -> str:
        return f"split({x}, chr(10))"

    def each(self, xs: str, var: str, to: str) -> str:
        return f"transform({xs}, {var} -> {to})"

    def only(self, xs: str, var: str, keep: str) -> str:
        return f"filter({xs}, {var} -> {keep})"

    def size(self, xs: str) -> str:
        return f"size({xs})"

    def head(self, xs: str, n: int) -> str:
        return f"slice({xs}, 1, {n})"

    def joined(self, xs: str, by: str) -> str:
        return f"array_join({xs}, {by})"

    def split(self, x: str, mark: str) -> str:
        return f"split({x}, {mark})"

    def unnest(self, table: str, xs: str, var: str, at: str) -> str:
        """table with one row for each element of xs: columns var and at (from 1)."""
        return f"(SELECT __t.*, __p + 1 AS {at}, {var} FROM {table} __t LATERAL VIEW posexplode({xs}) __e AS __p, {var})"

    def once(self, table: str, **found: str) -> str:
        """table with further columns, each evaluated once: neither filters nor projections repeat them."""
        return f"(SELECT __t.*, {', '.join(found)} FROM {table} __t LATERAL VIEW inline(array(struct({', '.join(found.values())}))) __s AS {', '.join(found)})"

    def items(self, *xs: str) -> str:
        return f"array({', '.join(xs)})"

    def agg_text(self, x: str, by: str, order: str) -> str:
        return f"listagg({x}, {by}) WITHIN GROUP (ORDER BY {order})"

    def to_int(self, x: str) -> str:
        return f"try_cast(translate({x}, '０１２３４５６７８９', '0123456789') AS INT)"

    def let(self, var: str, x: str, body: str) -> str:
        """body with var bound to the value of x, evaluated once."""
        return f"get(transform(array({x}), {var} -> {body}), 0)"

    def last_known(self, x: str) -> str:
        return f"last_value({x}) IGNORE NULLS"


class DuckDialect(SparkDialect):
    name = "duckdb"

    def replace(self, x: str, pattern: str, by: str = "") -> str:
        return f"regexp_replace({x}, '{pattern}', '{re.sub(r'[$]([0-9])', r'\\\1', by)}', 'g')"

    def extract(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({x}, '{pattern}', {group})"

    def like(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    def count(self, x: str, pattern: str) -> str:
        return f"CAST(len(regexp_extract_all({x}, '{pattern}')) AS INT)"

    def lines(self, x: str) -> str:
        return f"string_split({x}, chr(10))"

    def each(self, xs: str, var: str, to: str) -> str:
        return f"list_transform({xs}, lambda {var}: {to})"

    def only(self, xs: str, var: str, keep: str) -> str:
        return f"list_filter({xs}, lambda {var}: {keep})"

    def size(self, xs: str) -> str:
        return f"CAST(len({xs}) AS INT)"

    def head(self, xs: str, n: int) -> str:
        return f"({xs})[1:{n}]"

    def joined(self, xs: str, by: str) -> str:
        return f"array_to_string({xs}, {by})"

    def split(self, x: str, mark: str) -> str:
        return f"string_split({x}, {mark})"

    def unnest(self, table: str, xs: str, var: str, at: str) -> str:
        return f"(SELECT * FROM (SELECT __t.*, unnest(range(1, len({xs}) + 1)) AS {at}, unnest({xs}) AS {var} FROM {table} __t))"

    def once(self, table: str, **found: str) -> str:
        return f"(SELECT *, {', '.join(f'{x} AS {name}' for name, x in found.items())} FROM {table})"

    def items(self, *xs: str) -> str:
        return f"[{', '.join(xs)}]"

    def agg_text(self, x: str, by: str, order: str) -> str:
        return f"string_agg({x}, {by} ORDER BY {order})"

    def to_int(self, x: str) -> str:
        return f"try_cast(translate({x}, '０１２３４５６７８９', '0123456789') AS INT)"

    def let(self, var: str, x: str, body: str) -> str:
        return f"list_transform([{x}], lambda {var}: {body})[1]"

    def last_known(self, x: str) -> str:
        return f"last_value({x} IGNORE NULLS)"


SPARK, DUCK = SparkDialect(), DuckDialect()


def run(spark: SparkSession, build, **frames: DataFrame) -> DataFrame:
    """build(dialect, **names) as a DataFrame over the given frames."""
    names = {}
    for key, frame in frames.items():
        names[key] = f"__folio_{key}_{next(_names)}"
        frame.createOrReplaceTempView(names[key])
    try:
        return spark.sql(build(SPARK, **names))  # analysed at once, so the views have served
    finally:
        for name in names.values():
            spark.catalog.dropTempView(name)


def cut(frame: DataFrame) -> DataFrame:
    """frame as a table written in the folder that spark.checkpoint.dir names (a temporary one where unset in one process).

    Plans that use a relation several times start from its files: neither the optimizer nor a
    lost executor goes back through its lineage.
    """
    spark = frame.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="foliospark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = "file://" + own
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/foliospark/cut-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
