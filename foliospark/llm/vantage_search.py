"""Operator 6, nearest vectors by vantage-point trees per shard.

Largest inner product becomes nearest distance in one more dimension: with R the largest norm,
x' = (x, sqrt(R^2 - |x|^2)) and q' = (q * R / |q|, 0) give |q' - x'|^2 = 2 R^2 - 2 R (q . x) / |q|,
so the triangle inequality prunes exactly.  Rows are dealt to shards by hash; each shard keeps its
distinct vectors in a vantage-point tree (a row each in a written table).  A subtree is skipped
when relax * (distance to its shell) exceeds the query's k-th best so far by more than rounding can
explain: relax 1 is exact, larger values skip more.  A block of queries
walks a tree twice, to each query's own leaf and then to whatever its k-th best leaves open, so
every node is visited by one group of queries at a time.  In leaves candidates are ranked by the
inner product itself, summed in order of components in double precision, and by vec_id, so ties
between different vectors are exact too.

Groups of query blocks meet each shard's tree in a cogroup by shard and group, so tasks are shards
times groups; a tree is sent once to each group.  The best of each shard are merged in rounds of 64
shards.

Defined results: vectors that are null, zero, or hold null or non-finite components, and those of
another length than most (ties: the shorter), take no part.  Null vec_id: no part.  Repeated
vec_ids: equal rows count once; different vectors under one id are separate candidates, and an
id never answers itself.  Fewer candidates than k: all.  Empty table: empty result.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHARD_ROWS, QUERY_ROWS, LEAF, MERGE = 8192, 256, 128, 64
GROUP_BLOCKS = 8  # query blocks that meet a tree in one task
SLACK = 1e-11  # of R^2: more than rounding moves a squared distance


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _vectors(column) -> np.ndarray:
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


class Tree:
    """Vantage-point tree over distinct vectors, as arrays.

    Node arrays: vantage row, radius, inner child, outer child (-1: none), first and last row in
    order of the leaf (-1 for inner nodes).
    """

    def __init__(self, arrays):
        self.a = {k: arrays[k] for k in ("points", "order", "nodes", "radius", "ids", "ends")}

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, norm: float) -> Tree:
        by_id = np.argsort(ids, kind="stable")
        ids, vectors = ids[by_id], vectors[by_id] + 0.0
        distinct, inverse = np.unique(vectors, axis=0, return_inverse=True)
        grouped = np.argsort(inverse.ravel(), kind="stable")  # ids stay ascending within a vector
        ends = np.cumsum(np.bincount(inverse.ravel(), minlength=len(distinct)))
        extra = np.sqrt(np.maximum(0, norm**2 - (distinct * distinct).sum(1)))
        points = np.column_stack((distinct, extra))
        rng, nodes, radius, order = np.random.default_rng(3), [], [], []
        todo = [(np.arange(len(points)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            at = len(nodes)
            if parent >= 0:
                nodes[parent][side] = at
            nodes.append([-1, -1, -1, -1, -1])
            radius.append(0.0)
            if len(rows) > LEAF:
                vantage = rows[rng.integers(len(rows))]
                far = np.sqrt(((points[rows] - points[vantage]) ** 2).sum(1))
                middle = float(np.median(far))
                inner = far <= middle
                if inner.any() and not inner.all():
                    nodes[at][0], radius[at] = vantage, middle
                    todo += [(rows[inner], at, 1), (rows[~inner], at, 2)]
                    continue
            nodes[at][3:] = [len(order), len(order) + len(rows)]
            order += rows.tolist()
        return cls({"points": points, "order": np.array(order, np.int64), "nodes": np.array(nodes, np.int64), "radius": np.array(radius), "ids": ids[grouped], "ends": ends})

    def search(self, query_ids: np.ndarray, queries: np.ndarray, norm: float, k: int, relax: float) -> Iterator[tuple[int, list[int], list[float]]]:
        points, order, nodes, radius, ids, ends = (self.a[n] for n in ("points", "order", "nodes", "radius", "ids", "ends"))
        size = np.sqrt((queries * queries).sum(1, keepdims=True))
        q = np.column_stack((queries * (norm / size), np.zeros(len(queries))))
        begins = np.concatenate(([0], ends[:-1]))
        least, most = ids[begins], ids[ends - 1]
        second = ids[np.minimum(begins + 1, ends - 1)]  # of equal rows one is kept, so the ids of a vector differ
        leaf_vectors = np.ascontiguousarray(points[order][:, :-1].T)  # one row per component
        none = np.iinfo(np.int64).max
        best = np.full((len(q), k), -np.inf)
        best_id = np.full((len(q), k), none)
        best_row = np.full((len(q), k), -1)
        home = np.full(len(q), -1)

        def scan(first: int, last: int, active: np.ndarray) -> None:
            """Keeps the k best vectors by score and smallest id that is not the query's."""
            score = np.zeros((len(active), last - first))
            for component, own in zip(leaf_vectors[:, first:last], queries[active].T):
                score += own[:, None] * component
            some = score.max(1) >= best[active, -1]
            active, score = active[some], score[some]
            if not len(active):
                return
            rows, own = order[first:last], query_ids[active][:, None]
            lowest = np.where(least[rows] != own, least[rows], second[rows])
            itself = (least[rows] == own) & (most[rows] == own)  # no other id has this vector
            both = np.concatenate((best[active], np.where(itself, -np.inf, score)), 1)
            low = np.concatenate((best_id[active], np.where(itself, none, lowest)), 1)
            at = np.concatenate((best_row[active], np.where(itself, -1, rows)), 1)
            sort = np.lexsort((low, -both), 1)[:, :k]
            best[active], best_id[active], best_row[active] = (np.take_along_axis(x, sort, 1) for x in (both, low, at))

        def visit(node: int, active: np.ndarray, widen: bool) -> None:
            """First each query goes to its home leaf; then all others within its k-th best."""
            if not len(active):
                return
            vantage, inner, outer, first, last = nodes[node]
            if vantage < 0:
                if widen:
                    active = active[home[active] != node]
                else:
                    home[active] = node
                if len(active):
                    scan(first, last, active)
                return
            far = np.sqrt(((q[active] - points[vantage]) ** 2).sum(1))
            into = far <= radius[node]
            shell = ((far - radius[node]) * relax) ** 2

            def near() -> np.ndarray:
                if not widen:
                    return np.zeros(len(active), bool)
                bound = 2 * norm**2 - 2 * norm * best[active, -1] / size[active, 0]
                return ~(shell > bound + SLACK * norm**2)

            visit(inner, active[into | near()], widen)
            visit(outer, active[~into | near()], widen)

        visit(0, np.arange(len(q)), False)
        visit(0, np.arange(len(q)), True)
        for i, query_id in enumerate(query_ids):
            found = []
            for score, row in zip(best[i], best_row[i]):
                if row >= 0:
                    own = ids[begins[row] : min(ends[row], begins[row] + k + 1)]
                    found += [(-float(score), int(x)) for x in own if x != query_id]
            found.sort()
            yield int(query_id), [x for _, x in found[:k]], [-s for s, _ in found[:k]]


def _usable(vectors: DataFrame) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.coalesce(good, F.lit(False))).distinct()


def nearest(vectors: DataFrame, is_query, k: int = 20, relax: float = 1.0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) for vectors(vec_id, embedding); is_query: a condition on vec_id."""
    spark = vectors.sparkSession
    common.small_batches(spark)
    scratch = common.Scratch(spark, "vantage")
    rows = scratch.keep(_usable(vectors), "rows")
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m"))
    most = lengths.orderBy(F.desc("n"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if most is None:
        return spark.createDataFrame([], schema)
    rows, norm = rows.where(F.size("v") == most["d"]), float(np.sqrt(most["m"]) * (1 + 1e-12))
    shards = max(1, -(-most["n"] // shard_rows))

    def build(group: pa.Table) -> pa.Table:
        tree = Tree.build(group.column("vec_id").to_numpy(), _vectors(group.column("v")), norm)
        return pa.table({"shard": group.column("shard")[:1], "tree": pa.array([_pack(**tree.a)], pa.binary())})

    def block(group: pa.Table) -> pa.Table:
        packed = _pack(ids=group.column("vec_id").to_numpy(), vectors=_vectors(group.column("v")))
        return pa.table({"part": group.column("part")[:1], "queries": pa.array([packed], pa.binary())})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int"))
    trees = scratch.keep(dealt.groupBy("shard").applyInArrow(build, "shard int, tree binary"), "trees")
    asked = rows.where(is_query(F.col("vec_id")))
    parts = max(1, -(-asked.count() // QUERY_ROWS))
    blocks = asked.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).cast("int")).groupBy("part").applyInArrow(block, "part int, queries binary")
    blocks = scratch.keep(blocks, "queries").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        q, ids, scores = [], [], []
        for packed in left.column("tree"):
            tree = Tree(np.load(io.BytesIO(packed.as_buffer())))
            for asked_ in right.column("queries"):
                own = np.load(io.BytesIO(asked_.as_buffer()))
                for query_id, found, score in tree.search(own["ids"], own["vectors"], norm, k, relax):
                    q.append(query_id), ids.append(found), scores.append(score)
        at = pa.array([0, *np.cumsum([len(x) for x in ids])], pa.int32())
        flat = pa.StructArray.from_arrays([pa.array([-s for x in scores for s in x], pa.float64()), pa.array([i for x in ids for i in x], pa.int64())], ["loss", "vec_id"])
        shard = left.column("shard")[0].as_py() if len(left) else 0
        return pa.table({"query_id": pa.array(q, pa.int64()), "shard": pa.array([shard] * len(q), pa.int32()), "found": pa.ListArray.from_arrays(at, flat)})

    groups = -(-parts // GROUP_BLOCKS)
    sent = trees.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    met = sent.groupBy("shard", "grp").cogroup(blocks.withColumn("grp", F.pmod("part", F.lit(groups)).cast("int")).groupBy("shard", "grp"))
    found = met.applyInArrow(search, "query_id long, shard int, found array<struct<loss:double,vec_id:long>>")
    while True:
        found = found.groupBy("query_id", F.floor(F.col("shard") / MERGE).cast("int").alias("shard")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))
        if shards <= MERGE:
            break
        shards = -(-shards // MERGE)
    ranked = found.select("query_id", F.posexplode("found").alias("p", "x"))
    return ranked.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.loss")).alias("score"))
