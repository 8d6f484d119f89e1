"""Operator 8, benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised (lower case, every run of characters that are neither letters nor
digits becomes one space).  An item of n characters allows k = floor(RATE * n) edits; cut into
k + 1 pieces, at least one piece occurs unchanged in any passage within k edits.  An Aho-Corasick
automaton finds the pieces in whole texts; around each hit a window of the item's length plus k
on both sides is verified with Myers' bit-parallel edit distance of the item to any substring.

Items are normalised and written in blocks to the shared folder, and workers read a block from there
and keep its automaton for later tasks, so no item comes to the driver.  Each block is one pass over
the documents.

Defined results: null or empty texts and items without letters or digits match nothing.  An item of
any length matches anywhere, within words too, so one of a few letters is found in most texts: leave
such out of the benchmark table if that is not wanted.  Null
doc_id or item_id: reported as null.  Repeated documents or items are reported each by itself;
of several places in one document the least distance counts (ties: the first).  Empty tables
give an empty result.  Extra columns are ignored.  drop_contaminated judges each row by its own
text, whatever rows share its doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RATE = 0.05  # edits per character of the item
BLOCK_CHARS = 4 << 20  # characters of items searched at a time, about; more items make more passes
SCHEMA = "doc_id long, item_id long, distance int, first int, last int"


def normalise(column) -> pa.Array:
    low = pc.utf8_lower(column.fill_null(""))
    return pc.utf8_trim(pc.replace_substring_regex(low, r"[^\p{L}\p{N}]+", " "), " ")


def pieces(item: str, rate: float = RATE) -> tuple[int, list[tuple[int, str]]]:
    """Edits allowed, and (offset, piece) of the item's k + 1 near-equal pieces."""
    k = int(rate * len(item))
    cuts = [i * len(item) // (k + 1) for i in range(k + 2)]
    return k, [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def peq(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], size: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to a substring of text, and the first end reaching it."""
    top, full = 1 << size - 1, (1 << size) - 1
    up, down, distance = full, 0, size
    best, end = size, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        across = ((eq & up) + up ^ up) | eq | down
        plus, minus = down | ~(across | up) & full, up & across
        if plus & top:
            distance += 1
        elif minus & top:
            distance -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        vertical = eq | down
        up, down = (minus | ~(vertical | plus)) & full, plus & vertical
        if distance < best:
            best, end = distance, j + 1
    return best, end


class Matcher:
    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        import ahocorasick

        self.items, self.masks, where, named = [], [], {}, {}
        for item_id, text in items:
            named.setdefault(text, []).append(item_id)
        for text, item_ids in named.items():
            k, parts = pieces(text, rate)
            number = len(self.items)
            self.items.append((item_ids, text, k))
            self.masks.append(None)
            for offset, part in parts:
                where.setdefault(part, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for part, places in where.items():
            self.automaton.add_word(part, (len(part), places))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def find(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item_id, distance, first, last) of each item within its edits; last is exact, first
        is the earliest start an occurrence of that distance can have."""
        if self.empty or not text:
            return []
        spans: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for number, offset in places:
                _, item, k = self.items[number]
                start = end + 1 - size - offset
                lo, hi = max(0, start - k), min(len(text), start + len(item) + k)
                known = spans.setdefault(number, [])
                if known and lo <= known[-1][1] and lo >= known[-1][0]:
                    known[-1][1] = max(known[-1][1], hi)
                else:
                    known.append([lo, hi])
        found = []
        for number, windows in sorted(spans.items()):
            item_ids, item, k = self.items[number]
            if self.masks[number] is None:
                self.masks[number] = peq(item)
            best = None
            for lo, hi in windows:
                at = text.find(item, lo, hi)
                distance, end = (0, at + len(item) - lo) if at >= 0 else myers(self.masks[number], len(item), text[lo:hi])
                if distance <= k and (best is None or distance < best[0]):
                    best = (distance, max(0, lo + end - len(item) - distance), lo + end)
            if best:
                found += [(item_id, *best) for item_id in item_ids]
        return found


def _normalised(batches: Iterator) -> Iterator:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), normalise(batch.column("text"))], ["item_id", "text"])


def _matcher(folder: str, rate: float) -> Matcher:
    """The matcher of the items in a written block; a worker keeps the last one."""
    import pyarrow.dataset as ds
    from pyarrow.fs import FileSystem

    cache = common.worker_cache("decontaminate")
    if cache.get("matcher", (None,))[0] != (folder, rate):
        fs, path = FileSystem.from_uri(folder)
        items = ds.dataset(path, schema=pa.schema([("item_id", pa.int64()), ("text", pa.string())]), filesystem=fs, format="parquet").to_table()
        rows = zip(items.column("item_id").to_pylist(), items.column("text").to_pylist())
        cache["matcher"] = ((folder, rate), Matcher(list(rows), rate))
    return cache["matcher"][1]


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, first, last) for docs(doc_id, text) and benchmark(item_id, text).

    Positions count characters of the normalised text.  Blocks hold about block_chars characters.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    scratch = common.Scratch(spark, "items")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = scratch.keep(items.mapInArrow(_normalised, "item_id long, text string").where("text <> ''"), "all")
    blocks = max(1, -(-(items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0) // block_chars))
    block = F.pmod(F.xxhash64("text"), F.lit(blocks))  # equal items share one

    def search(folder: str) -> DataFrame:
        def run(batches: Iterator) -> Iterator:
            matcher = _matcher(folder, rate)
            for batch in batches:
                found = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), normalise(batch.column("text")).to_pylist()):
                    found += [(doc_id, *hit) for hit in matcher.find(text)]
                columns = list(zip(*found)) if found else [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "item_id", "distance", "first", "last"])

        return rows.mapInArrow(run, SCHEMA)

    out = None
    for b in range(blocks):
        scratch.keep(items.where(block == b), f"block-{b}")
        found = search(scratch.path(f"block-{b}"))
        out = found if out is None else out.unionByName(found)
    scratch.drop("all")
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a test item, rows with a null doc_id among them."""
    return common.without(docs, lambda rows: matches(rows, benchmark), "contaminated")
