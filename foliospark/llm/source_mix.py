"""Operator 10, mixing sources to target weights (DataFrame functions only).

Sizes are words.  Targets come from weights by water filling: a source whose share exceeds
EPOCHS times its size stops there and the excess goes to the others by weight.  Every source's
documents form a shuffled stream, repeated as often as the target needs, cut into blocks of
equal words.  The schedule has one slot per block: slot i takes point i * g mod n of a
golden-ratio lattice (g the number prime to n nearest n / phi), and the source in whose run of
the cumulative block counts the point falls; each source's slots are ranked and slot r is joined
to block r, so each source gets exactly its blocks and every stretch of the schedule is close to
the weights.

Prefix sums and ranks use two levels (stretches of bounded size, then totals of stretches), so
no source is gathered in one task, nor are equal rows, which are numbered by written partition.

Defined results: null text: size 0, taken 0.  Null source: a source of its own, last in order.
Repeated or null doc_ids: each row is drawn for itself (rows are told apart by a row hash and a
number within equal rows, which stand in for each other).  Sources without words: target 0.  Empty
tables give empty results.  mix() reads the named columns only; mixed_documents() keeps all columns,
whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WORD = r"[^\x20\x09-\x0D]"
WEIGHTS = (5.0, 2.0, 1.0)  # by source in code-point order, repeating, null last
SHARE, EPOCHS = 1.5, 2.0  # of all words; most times a source is read
BLOCK_WORDS = 512
NARROW_SLOTS = 1 << 31  # up to so many, slot arithmetic fits 64 bits; beyond, it uses decimals
STRETCH_ROWS = 4096  # rows in a stretch of a two-level prefix sum, about
SLOT_CHUNK = 1 << 14


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"{WORD}+")), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[float], share: float, epochs: float) -> list[float]:
    """Targets of share * total words: by weight, none above epochs * its size."""
    left, target, open_ = share * sum(sizes), [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > epochs * sizes[i]]
        if not full:
            for i in open_:
                target[i] = unit * weights[i]
            break
        for i in full:
            target[i] = epochs * sizes[i]
            left -= target[i]
        open_ = [i for i in open_ if i not in set(full)]
    return target


def targets(spark, totals: DataFrame, weights: tuple[float, ...], share: float, epochs: float) -> DataFrame:
    """(source, source_size, target) by water filling as SQL: sources fill in order of size / weight.

    With sources sorted by size / weight, those before the first that stays below its cap are
    full, so running sums decide it; the totals table has one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = totals.withColumn("weight", w).withColumn("cap", F.lit(epochs) * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = rows.withColumn("unit", (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    rows = rows.withColumn("below", F.col("unit") * F.col("weight") <= F.col("cap"))
    level = F.first(F.when(F.col("below"), F.col("unit")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("target", F.coalesce(F.least("cap", level * F.col("weight")), F.col("cap"))).select("source", "source_size", "target")


def golden_step(n: int) -> int:
    """The number prime to n that is nearest to n / phi."""
    at = round(n * (math.sqrt(5) - 1) / 2)
    return next(g for d in range(n + 1) for g in (at + d, at - d) if 0 < g <= max(n, 1) and math.gcd(g, n) == 1)


def _stretches(rows: DataFrame, keys: list[str], stretch: Column, order: list, value: str, out: str, scratch: common.Scratch) -> DataFrame:
    """rows with out = the sum of value over the rows before, in (stretch, order), within keys."""
    rows = rows.withColumn("__s", stretch)
    sums = rows.groupBy(*keys, "__s").agg(F.sum(value).alias("__n"))
    over = Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    sums = scratch.keep(sums.select(*keys, "__s", F.coalesce(F.sum("__n").over(over), F.lit(0)).alias("__base")), f"stretches-{out}")
    inner = Window.partitionBy(*keys, "__s").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return rows.join(sums, [*keys, "__s"]).withColumn(out, F.col("__in") + F.col("__base")).drop("__s", "__in", "__base")


def row_hash(columns: list[Column], seed: int) -> Column:
    return F.xxhash64(*columns, F.lit(seed))


def _whole_row(docs: DataFrame) -> list[Column]:
    """Columns that together name a row; hashing takes no maps, so these go in as text."""
    return [F.to_json(f.name) if isinstance(f.dataType, T.MapType) else docs[f.name] for f in docs.schema.fields]


def _row(h: Column, copy: Column) -> Column:
    return F.xxhash64(h, copy)


def _parts(n_rows: int) -> int:
    return max(1, -(-n_rows // STRETCH_ROWS))


def _spot(row: Column, doc_id: Column, parts: int) -> Column:
    """Where a row stands in its source's stream; stretches (place) are ranges of the hash."""
    place = F.floor((F.shiftrightunsigned(row, 16).cast("double") / float(1 << 48)) * parts)
    return F.struct(place.alias("place"), row.alias("row"), doc_id.alias("doc_id"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, block_words: int = BLOCK_WORDS, seed: int = 1, equal: list[Column] | None = None):
    """(plan, schedule) for docs(doc_id, source, text).

    plan: one row per document with row, h (equal for equal rows), doc_id, source, size, source_size,
    target, taken.  schedule: one row per slot and document in it with slot, source_no, block, row,
    doc_id, first and last word position within the document (of the stream's pass).
    equal: the columns in which rows must agree to stand in for each other (doc_id, source, text).
    """
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "mix")
    named = [F.col("doc_id"), F.col("source"), F.col("text")]
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash(equal or named, seed).alias("h"))
    sized = scratch.keep(rows.withColumn("at", F.monotonically_increasing_id()).withColumn("one", F.lit(1).cast("long")), "sized")
    n_rows = sized.count()
    # The upper bits of at are the partition that wrote the row, so equal rows share no larger window.
    numbered = _stretches(sized, ["h"], F.shiftright("at", 33), [F.col("at")], "one", "copy", scratch)
    sized = scratch.keep(numbered.drop("at", "one").withColumn("row", _row(F.col("h"), F.col("copy"))), "rows")
    scratch.drop("sized", "stretches-copy")

    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = targets(spark, totals, weights, share, epochs).withColumn("aim", F.round("target").cast("long"))
    block = block_words
    order = Window.orderBy(F.col("source").asc_nulls_last())
    aims = aims.withColumn("blocks", F.ceil(F.col("aim") / block).cast("long")).withColumn("source_no", F.row_number().over(order))
    aims = scratch.keep(aims.withColumn("first", F.coalesce(F.sum("blocks").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "aims")
    n = aims.agg(F.sum("blocks").alias("n")).first()["n"] or 0

    # Slots: the lattice is a permutation, so each source's run of points maps back to its slots.
    step = golden_step(n) if n else 1
    back = pow(step, -1, n) if n > 1 else 0
    chunks = aims.where("blocks > 0").select("source_no", "first", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(blocks - 1) div {SLOT_CHUNK}"))).alias("c"))
    points = chunks.repartition("source_no", "c").select("source_no", F.explode(F.expr(f"sequence(first + c * {SLOT_CHUNK}, first + least(blocks, (c + 1) * {SLOT_CHUNK}) - 1)")).alias("p"))
    wide = "long" if n <= NARROW_SLOTS else "decimal(19,0)"
    slot = (F.col("p").cast(wide) * F.lit(back).cast(wide)) % F.lit(max(n, 1)).cast(wide)
    slots = points.select("source_no", slot.cast("long").alias("slot"), F.lit(1).cast("long").alias("one"))
    slots = scratch.keep(_stretches(slots, ["source_no"], F.floor(F.col("slot") / STRETCH_ROWS), [F.col("slot")], "one", "block", scratch), "slots").select("source_no", "slot", "block")

    # Streams: documents in hash order.
    spot = _spot(F.col("row"), F.col("doc_id"), _parts(n_rows))
    numbered = sized.join(aims.select(F.col("source").alias("s"), "source_no", "aim", "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # eqNullSafe keeps the null source; the aims table has one row per source.
    streams = scratch.keep(_stretches(numbered, ["source_no"], spot["place"], [F.col("row"), F.col("doc_id")], "size", "start", scratch), "streams")
    passes = streams.where("size > 0 and aim > 0").withColumn("pass", F.explode(F.expr("sequence(0L, (aim - 1) div source_size)")))
    passes = passes.withColumn("lo", F.col("start") + F.col("pass") * F.col("source_size")).withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("aim"))).where("hi > lo")
    pieces = passes.withColumn("block", F.explode(F.expr(f"sequence(lo div {block}, (hi - 1) div {block})")))
    pieces = pieces.withColumn("from", F.greatest("lo", F.col("block") * block)).withColumn("to", F.least("hi", (F.col("block") + 1) * block))
    schedule = pieces.select("source_no", "block", "row", "doc_id", (F.col("from") - F.col("lo")).alias("first"), (F.col("to") - F.col("lo")).alias("last")).join(slots, ["source_no", "block"])
    taken = schedule.groupBy("row", "doc_id").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    taken = taken.select(F.col("row").alias("r"), F.col("doc_id").alias("d"), "taken")
    plan = streams.join(taken, (F.col("row") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    plan = plan.select("row", "h", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return plan, schedule


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each row as many times as the whole passes nearest to what is taken.

    taken / size rounds half up, so a document of which under half is taken is left out and one
    read twice appears twice; columns are those of docs.  A source's target ends within one pass of
    its stream, so rows up to some spot get one pass more than those behind it: that spot and the two
    counts say it for the whole source, and texts are not shuffled for it.  Of equal rows one is
    repeated for all, dealt out in chunks, so many of them are neither gathered nor numbered.
    """
    scratch, seed = common.Scratch(docs.sparkSession, "mixed"), options.get("seed", 1)
    plan, _ = mix(docs, equal=_whole_row(docs), **options)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("long")
    plan = scratch.keep(plan.select("h", "row", "doc_id", "source", "size", times.alias("n")), "plan")
    parts = _parts(plan.count())
    ends = plan.where("size > 0").groupBy("source", "n").agg(F.max(_spot(F.col("row"), F.col("doc_id"), parts)).alias("last"))
    ends = ends.groupBy(F.col("source").alias("__source")).agg(F.max("n").alias("__more"), F.min("n").alias("__less"), F.max_by("last", "n").alias("__last"))
    ends = scratch.keep(ends, "ends")
    several = plan.groupBy(F.col("h").alias("__h")).agg(F.sum("n").alias("__n"), F.count("*").alias("__rows"))
    several = scratch.keep(several.where("__rows > 1").select("__h", "__n"), "several")
    scratch.drop("plan")
    some = not several.isEmpty()

    own = docs.withColumn("__h", row_hash(_whole_row(docs), seed))
    single = own.join(several, "__h", "left_anti") if some else own
    single = single.where(F.col("text").rlike(WORD)).join(ends, F.col("source").eqNullSafe(F.col("__source")))
    spot = _spot(_row(F.col("__h"), F.lit(0).cast("long")), F.col("doc_id"), parts)
    n = F.when(spot <= F.col("__last"), F.col("__more")).otherwise(F.col("__less"))
    single = single.withColumn("__n", n).where("__n > 0").withColumn("__n", F.explode(F.expr("sequence(1L, __n)")))
    out = single.select(*docs.columns)
    if not some:
        return out
    several = several.where("__n > 0")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = own.join(several, "__h", "left_semi").groupBy("__h").agg(F.first(whole).alias("__row"))
    chunks = one.join(several, "__h").withColumn("__c", F.explode(F.expr(f"sequence(0L, (__n - 1) div {STRETCH_ROWS})")))
    chunks = chunks.repartition("__h", "__c").withColumn("__i", F.explode(F.expr(f"sequence(1L, least({STRETCH_ROWS}L, __n - __c * {STRETCH_ROWS}))")))
    return out.unionByName(chunks.select("__row.*"))
