"""Operator 3, MinHash near-dedup with sequential Bayesian verification.

1. Every text becomes its set of distinct 5-word shingle hashes, a MinHash signature and band
   keys.  Texts with equal sets form a class, a node named by 64 bits of the set's digest and
   represented by one of its rows.  Rows of one doc_id with different texts are linked outright.
2. Star pass: in each band bucket every representative is paired with the bucket's smallest one
   (linear in the bucket).  Pairs compare signature batches; a pair is dropped as soon as the
   posterior P(similarity >= threshold | matches) falls under the miss probability; survivors
   are confirmed on full sets.
3. Block pass: the smallest one of each bucket is done; buckets whose other members still lie in
   different components are compared in square blocks, only across components.  First blocks of
   signatures return the documents that have a partner left after pruning; then these alone meet
   again with their full sets, and a block returns no more links than it has documents (a
   spanning forest).  So no group is expanded into its pairs, and sets travel for likely pairs only.
4. Components come from alternating large-star and small-star steps on written tables.

Defined results: null, empty or wordless text: n_shingles 0, its own component, kept.
Null doc_id: the row links like others; it is kept only if no row of its component has an id, and
then one row of the component is (with the smallest hash of the text).  component_id is null where
no row has an id.
Repeated doc_ids: rows of one id are in one component and kept or left out together; keep_one leaves
one row for each different set of shingles of the kept id.  Which rows link does not depend on their
order.  An empty table gives an empty result; extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .textvec import WordHasher, shingle_sets

SIGNATURE, BANDS, BATCH = 128, 32, 32  # hashes, bands of 4 hashes, hashes per comparison step
NUMERATOR, DENOMINATOR = 75, 100  # similarity threshold as a fraction, compared in integers
MISS = 1e-5  # posterior probability under which a pair is dropped
BLOCK = 1024  # documents on a side of a block
FILTER_BITS = 1 << 26  # of the bitmap that keeps unwanted texts out of a shuffle


def min_matches(threshold: float, miss: float, n_hashes: int, batch: int) -> list[tuple[int, int]]:
    """(hashes seen, fewest matches to go on): the Beta(m+1, n-m+1) tail above threshold >= miss.

    P(Beta(m+1, n-m+1) > t) equals P(Binomial(n+1, t) <= m).
    """
    from math import comb

    steps = []
    for n in range(batch, n_hashes + 1, batch):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        steps.append((n, m))
    return steps


def _multipliers() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 2**64, SIGNATURE, dtype=np.uint64) | np.uint64(1)


def signature(shingles: np.ndarray, mult: np.ndarray) -> np.ndarray:
    low = np.full(len(mult), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 128):
        np.minimum(low, (shingles[at : at + 128] * mult[:, None]).min(1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def similar(a: np.ndarray, b: np.ndarray, num: int = NUMERATOR, den: int = DENOMINATOR) -> bool:
    """Exact test on ascending distinct arrays: den * |a & b| >= num * |a | b|."""
    if not len(a) or not len(b) or den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    common_n = int((both[1:] == both[:-1]).sum())
    return den * common_n >= num * (len(both) - common_n)


def _sketch(batches: Iterator) -> Iterator:
    import xxhash

    hasher, mult = WordHasher(), _multipliers()
    salt = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)
    for batch in batches:
        n, node, sig, bands = [], [], [], []
        for s in shingle_sets(hasher, batch.column("text")):
            n.append(len(s))
            if not len(s):
                node.append(None), sig.append(None), bands.append(None)
                continue
            x = signature(s, mult)
            node.append(int.from_bytes(xxhash.xxh3_128_digest(s.tobytes())[:8], "little", signed=True))
            sig.append((x & np.uint32(255)).astype(np.uint8).tobytes())
            key = salt.copy()
            for part in x.reshape(BANDS, -1).T.astype(np.uint64):
                key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + part
            bands.append(key.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            ["row", "doc_id", "n_shingles", "node", "sig", "bands"],
        )
    common.release()


def _sets(batches: Iterator) -> Iterator:
    hasher = WordHasher()
    for batch in batches:
        found = [s.tobytes() for s in shingle_sets(hasher, batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], ["id", "shingles"])
    common.release()


def _prune(batches: Iterator) -> Iterator:
    """Pairs whose signatures stay plausible through all batches."""
    steps = min_matches(NUMERATOR / DENOMINATOR, MISS, SIGNATURE, BATCH)
    for batch in batches:
        left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SIGNATURE) for c in ("sig_a", "sig_b"))
        alive, seen, done = np.arange(len(left)), np.zeros(len(left), np.int32), 0
        for n, need in steps:
            seen += (left[alive, done:n] == right[alive, done:n]).sum(1, dtype=np.int32)
            ok = seen >= need
            alive, seen, done = alive[ok], seen[ok], n
        yield batch.select(["a", "b"]).take(pa.array(alive))


def _confirm(batches: Iterator) -> Iterator:
    for batch in batches:
        ok = [similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist())]
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


class _Block:
    """The documents of one block pair and their plausible partners in other components."""

    def __init__(self, group: pa.Table):
        self.steps = min_matches(NUMERATOR / DENOMINATOR, MISS, SIGNATURE, BATCH)
        self.ids, self.part, self.comp = (np.asarray(group.column(c).to_numpy()) for c in ("id", "part", "comp"))
        self.sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(-1, SIGNATURE)
        self.lo, self.hi = int(group.column("lo")[0].as_py()), int(group.column("hi")[0].as_py())

    def partners(self) -> Iterator[tuple[int, np.ndarray]]:
        sig, comp, words = self.sig, self.comp, self.sig.view(np.uint32)
        rows, cols = np.flatnonzero(self.part == self.lo), np.flatnonzero(self.part == self.hi)
        for i in rows:
            js = cols[(cols > i) if self.lo == self.hi else slice(None)]
            js = js[comp[js] != comp[i]]
            js = js[(words[js] == words[i]).any(1)]  # a shared band makes a candidate
            seen, done = np.zeros(len(js), np.int32), 0
            for n, need in self.steps:
                seen = seen + (sig[js, done:n] == sig[i, done:n]).sum(1, dtype=np.int32)
                js, seen, done = js[seen >= need], seen[seen >= need], n
            if len(js):
                yield i, js


def _block_likely(group: pa.Table) -> pa.Table:
    """The rows of one block pair that have a plausible partner."""
    block = _Block(group)
    likely = np.zeros(len(block.ids), bool)
    for i, js in block.partners():
        likely[i] = True
        likely[js] = True
    return group.select(DEALT).filter(pa.array(likely))


def _block_links(group: pa.Table) -> pa.Table:
    """Links across components among the documents of one block pair (a spanning forest of them)."""
    block = _Block(group)
    ids, comp = block.ids, block.comp
    sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
    root = {int(c): int(c) for c in comp}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out_a, out_b = [], []
    for i, js in block.partners():
        for j in js:
            a, b = find(int(comp[i])), find(int(comp[j]))
            if a != b and similar(sets[i], sets[j]):
                root[max(a, b)] = min(a, b)
                out_a.append(max(ids[i], ids[j]))
                out_b.append(min(ids[i], ids[j]))
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


DEALT = ["hub", "id", "comp", "part", "lo", "hi"]


def _dealt(rows: DataFrame) -> DataFrame:
    """rows(hub, id, comp) dealt into block pairs (lo, hi) of about BLOCK rows a side for each hub."""
    sizes = rows.groupBy("hub").agg(F.count("*").alias("n")).select("hub", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    dealt = rows.join(sizes, "hub").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other")).select(*DEALT)


def _only_wanted(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs without most rows whose key (row) is not in wanted(row): a bitmap of key hashes.

    The bitmap has FILTER_BITS bits however many keys it takes, so it can be broadcast; the fuller it
    is, the less it keeps out, and the join that follows decides.
    """
    place = F.pmod("row", F.lit(FILTER_BITS)) + 1
    bits = wanted.select(place.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = docs.join(F.broadcast(bits), F.bitmap_bucket_number(place) == F.col("bucket"))
    return near.where(F.getbit(byte, (at % 8).cast("int")) == 1).drop("bucket", "bits")


def components(scratch: common.Scratch, links: DataFrame, name: str) -> DataFrame:
    """(id, comp), a written table: the smallest id reachable over links (a, b), for ids that have a link."""
    edges = scratch.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0")
    last, k = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        k += 1
        edges = scratch.keep(small, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == last:
            found = scratch.keep(edges.groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "id"), name)
            scratch.drop(f"{name}-{k}")
            return found
        last = state


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text)."""
    return decisions(docs).drop("row", "node")


def _keyed(docs: DataFrame) -> DataFrame:
    doc_id, text = F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    return docs.select(doc_id, text).withColumn("row", row_key())


def row_key():
    """Equal for rows of equal doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def decisions(docs: DataFrame) -> DataFrame:
    """near_duplicates with the key (row) of each row and its node, null for a wordless row without an id."""
    spark: SparkSession = docs.sparkSession
    common.small_batches(spark)
    scratch = common.Scratch(spark, "minhash")
    docs = _keyed(docs)

    found = docs.mapInArrow(_sketch, "row long, doc_id long, n_shingles long, node long, sig binary, bands array<long>")
    found = found.withColumn("node", F.coalesce("node", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))))  # wordless texts
    sketch = scratch.keep(found.withColumn("nth", F.monotonically_increasing_id()), "sketch")
    # Rows of a node have equal sets, so any row's signature and bands are the node's.
    reps = sketch.where("sig is not null").groupBy(F.col("node").alias("id")).agg(F.min("row").alias("row"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    reps = scratch.keep(reps, "reps")

    rows = reps.select("id", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("top")).where("hub <> top").select("key", "hub")
    buckets = scratch.keep(rows.join(shared, "key"), "buckets")
    sigs = scratch.keep(reps.select("id", "sig", "row").join(buckets.select("id").distinct(), "id"), "sigs")
    scratch.drop("reps")

    def side(table: DataFrame, key: str, value: str) -> DataFrame:
        return table.select(F.col("id").alias(key), F.col(table.columns[1]).alias(f"{value}_{key}"))

    pairs = buckets.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    likely = scratch.keep(pairs.join(side(sigs, "a", "sig"), "a").join(side(sigs, "b", "sig"), "b").mapInArrow(_prune, "a long, b long"), "likely")

    def sets_of(wanted: DataFrame, name: str) -> DataFrame:
        asked = scratch.keep(sigs.select("id", "row").join(wanted, "id"), f"{name}-rows")
        rows = _only_wanted(docs, asked).join(asked, "row").select("id", "text")
        return scratch.keep(rows.mapInArrow(_sets, "id long, shingles binary").dropDuplicates(["id"]), name)  # of an id, all sets are equal

    sets = sets_of(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "sets")
    stars = scratch.keep(likely.join(side(sets, "a", "set"), "a").join(side(sets, "b", "set"), "b").mapInArrow(_confirm, "a long, b long"), "stars")
    scratch.drop("sets", "sets-rows", "likely")
    several = sketch.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("hi")).where("b <> hi").select("doc_id", "b")
    same_id = sketch.select("doc_id", F.col("node").alias("a")).join(several, "doc_id").where("a <> b").select("a", "b").distinct()
    stars = stars.unionByName(scratch.keep(same_id, "same-id"))
    comps = components(scratch, stars, "star-cc")

    # The hub of a bucket has met all of it, so only the others are still to be compared.
    placed = buckets.where("id <> hub").join(comps, "id", "left").select("key", "hub", "id", F.coalesce("comp", "id").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    open_rows = scratch.keep(placed.join(mixed, "key").select("hub", "id", "comp").distinct(), "open")
    own = sigs.select("id", "sig")
    blocks = _dealt(open_rows).join(own, "id").groupBy("hub", "lo", "hi")
    marked = scratch.keep(blocks.applyInArrow(_block_likely, "hub long, id long, comp long, part int, lo int, hi int"), "marked")
    sets = sets_of(marked.select("id").distinct(), "open-sets")
    blocks = marked.join(own, "id").join(sets, "id")
    rest = scratch.keep(blocks.groupBy("hub", "lo", "hi").applyInArrow(_block_links, "a long, b long"), "rest")
    final = components(scratch, stars.unionByName(rest), "cc").select(F.col("id").alias("node"), "comp")
    scratch.drop("buckets", "sigs", "stars", "same-id", "star-cc", "open", "marked", "open-sets", "open-sets-rows", "rest")

    rows = sketch.select("row", "nth", "doc_id", "n_shingles", "node")
    bare = rows.where("node is null").select("row", "node", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    rows = rows.where("node is not null").join(final, "node", "left").withColumn("root", F.coalesce("comp", "node"))
    groups = rows.groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("root", "least")
    first = rows.where("doc_id is null").groupBy("root").agg(F.min(F.struct("row", "nth")).alias("first"))
    out = rows.join(scratch.keep(groups, "groups"), "root", "left").join(scratch.keep(first, "first"), "root", "left")
    component = F.coalesce("least", "doc_id")
    alone = component.isNull() & (F.col("nth") == F.col("first.nth"))
    kept = F.coalesce(F.col("doc_id") == component, alone, F.lit(False))
    return out.select("row", "node", "doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept")).unionByName(bare)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose document is the kept one of its group, with all columns of docs.

    Of the kept id's rows with the same set of shingles one stays: that of the smallest hash of its
    text, and of rows with equal texts that of the smallest hash of all columns.
    """
    scratch = common.Scratch(docs.sparkSession, "minhash-gone")
    found = scratch.keep(decisions(docs).where("node is not null").select("row", "doc_id", "node", "kept"), "found")
    stay = scratch.keep(found.where("kept").groupBy("doc_id", "node").agg(F.min("row").alias("row")).select("row"), "stay")
    gone = scratch.keep(found.select("row").distinct().join(stay, "row", "left_anti").select(F.col("row").alias("__row")), "gone")
    kept = docs.join(gone, row_key() == gone["__row"], "left_anti")
    again = found.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row")
    once = scratch.keep(stay.join(again, "row", "left_semi").select(F.col("row").alias("__row")), "once")
    if once.isEmpty():
        return kept
    rows = kept.join(once, row_key() == once["__row"])
    one = rows.groupBy("__row").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("r")).select("r.*")
    return kept.join(once, row_key() == once["__row"], "left_anti").unionByName(one)
