"""Exact top-k inner products by ball-tree branch and bound in shards.

Each component x becomes floor(1024 x). Vectors are dealt to shards by space: a bounded sample is split at medians along its
widest directions, and every vector goes down these splits, so that a shard is a region (or a part of a crowded one). Each
shard builds one ball tree. A node with centre c and radius r bounds the inner product with a query q by q.c + |q| r.
A query first searches the shard of the largest root bound; its k-th score there is a floor for all others, and it goes on only
to shards whose root bound reaches the floor. In a tree, nodes are visited in the order of their bounds, until the bound
is below the k-th best score so far. Queries are a stated set and come in blocks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import common

SCALE = 1024
LEAF = 64
#: Vectors in a shard, queries in a block and roots in a block, about.
SHARD, BLOCK, ROOTS = 8_000, 4_096, 4_096
#: Rows that the regions are fitted on at most, their numbers at most, and rows of the sample in a region at least.
SAMPLE, SAMPLE_CELLS, REGION = 20_000, 1 << 22, 32


def _widest(part: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The direction between two points that lie far apart."""
    p = part[((part - centre) ** 2).sum(1).argmax()]
    return p - part[((part - p) ** 2).sum(1).argmax()]


class Regions:
    """Splits of the space fitted on a sample; ``of`` tells the region of each vector."""

    def __init__(self, sample: np.ndarray, count: int):
        self.splits: list[tuple[np.ndarray | None, float, int, int]] = []  # direction, threshold, left, right; or None, 0, region, 0
        self.count = 0

        def build(x: np.ndarray, count: int) -> int:
            me = len(self.splits)
            self.splits.append((None, 0.0, self.count, 0))
            along = x @ _widest(x, x.mean(0)) if count > 1 and len(x) >= 2 * REGION else np.zeros(0)
            at = np.median(along) if len(along) else 0.0
            low = along <= at
            if not len(along) or low.all():
                self.count += 1
                return me
            left = build(x[low], count // 2)
            self.splits[me] = (_widest(x, x.mean(0)), float(at), left, build(x[~low], count - count // 2))
            return me

        build(sample.astype(np.float64), count)

    def of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            k, who = todo.pop()
            direction, at, left, right = self.splits[k]
            if direction is None:
                out[who] = left
            elif len(who):
                low = x[who].astype(np.float64) @ direction <= at
                todo += [(left, who[low]), (right, who[~low])]
        return out


def _bounds(centre: np.ndarray, radius: np.ndarray, q: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Upper bounds (query, ball) of the inner products, rounded up."""
    dot = q @ centre.T
    return dot + norm[:, None] * radius + 1e-9 * (np.abs(dot) + norm[:, None] * (radius + np.sqrt((centre * centre).sum(1)))) + 1


class BallTree:
    """Ball tree over integer vectors; nodes are split at the median along the widest direction."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        x = vectors.astype(np.float64)
        self.nodes: list[tuple[int, int, int, int]] = []  # begin, end, left child, right child (-1: leaf)
        centres, radii = [], []

        def build(a: int, b: int) -> int:
            me = len(self.nodes)
            self.nodes.append((a, b, -1, -1))
            part = x[order[a:b]]
            c = part.mean(0)
            d = part - c
            far = np.sqrt((d * d).sum(1))
            centres.append(c)
            radii.append(far.max())
            if b - a > leaf and far.max() > 0:
                along = part @ _widest(part, c)
                m = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(along, m)]
                left, right = build(a, a + m), build(a + m, b)
                self.nodes[me] = (a, b, left, right)
            return me

        build(0, len(ids))
        self.ids, self.vectors = ids[order], vectors[order]
        self.centre, self.radius = np.array(centres), np.array(radii)
        self.largest = int(np.abs(self.vectors).max(initial=0))

    def scores(self, q: np.ndarray, a: int, b: int) -> np.ndarray:
        """Exact inner products; by floats where these are exact, by unbounded integers where 64 bits may not do."""
        most = int(np.abs(q).max(initial=0)) * self.largest * q.shape[1]
        if most < 1 << 53:
            return (q.astype(np.float64) @ self.vectors[a:b].T.astype(np.float64)).astype(np.int64)
        if most < 1 << 63:
            return q @ self.vectors[a:b].T
        exact = q.astype(object) @ self.vectors[a:b].T.astype(object)
        return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)

    def bounds(self, node: int, q: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products of the queries with a node's vectors, rounded up."""
        return _bounds(self.centre[node : node + 1], self.radius[node : node + 1], q, norm)[:, 0]

    def search(self, qid: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray):
        """(query index, id, score) of each query's k best others. ``floor``: scores below it are of no use.

        The queries go down together: in each step every query opens its open node of the largest bound,
        until that is below its k-th best score."""
        qf = q.astype(np.float64)
        norm = np.sqrt((qf * qf).sum(1))
        best = [np.empty((0, 2), np.int64) for _ in qid]  # ~score, id: the best come first in order
        floor = floor.copy()

        def leaf(node: int, who: np.ndarray) -> None:
            a, b, _, _ = self.nodes[node]
            score = self.scores(q[who], a, b)
            for i, s in zip(who.tolist(), score, strict=True):
                use = (s >= floor[i]) & (self.ids[a:b] != qid[i])
                if use.any():
                    rows = np.concatenate((best[i], np.stack((~s[use], self.ids[a:b][use]), 1)))
                    if len(rows) > k:
                        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))[:k]]
                        floor[i] = max(floor[i], ~rows[-1, 0])
                    elif len(rows) == k:
                        floor[i] = max(floor[i], ~rows[:, 0].max())
                    best[i] = rows

        front = np.full((len(qid), len(self.nodes)), -np.inf)
        front[:, 0] = self.bounds(0, qf, norm)
        active = np.arange(len(qid))
        while len(active):
            node = front[active].argmax(1)
            top = front[active, node]
            go = top >= floor[active]
            active, node, top = active[go], node[go], top[go]
            front[active, node] = -np.inf
            order = np.argsort(node, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(node[order])) + 1) if len(order) else ():
                who, n = active[part], int(node[part[0]])
                _, _, left, right = self.nodes[n]
                if left < 0:
                    leaf(n, who)
                else:
                    for child in (left, right):
                        front[who, child] = np.minimum(top[part], self.bounds(child, qf[who], norm[who]))
        n = [len(r) for r in best]
        rows = np.concatenate(best) if best else np.empty((0, 2), np.int64)
        return np.repeat(np.arange(len(qid)), n), rows[:, 1], ~rows[:, 0]


def scaled(table: DataFrame) -> DataFrame:
    """(vec_id, v array<long>) of the vectors that take part: not null, all components finite, ids not null."""
    x = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = table.select(F.col("vec_id").cast("long"), "embedding", x.alias("x")).where(good)
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * SCALE).cast("long")).alias("v"))


def _matrix(column: pa.ChunkedArray, kind=np.int64) -> np.ndarray:
    """Equal-length lists of numbers as a matrix."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), len(flat) // len(column))


_SCHEMA = pa.schema([(name, pa.int64()) for name in ("query_id", "qhash", "vec_id", "score")])
_LOWEST = -(2**63)


def _dealt(rows: DataFrame, shard_rows: int) -> tuple[DataFrame, int]:
    """(rows with their shard, number of shards): regions of space for each dimension, crowded ones in parts by hash."""
    spark = rows.sparkSession
    crowd = rows.groupBy("dim").count().where(F.col("count") > shard_rows).orderBy(F.desc("count"), "dim").limit(64).collect()  # others are a region each
    fitted: dict[int, Regions] = {}
    for r in crowd:
        most = max(2 * REGION, min(SAMPLE, SAMPLE_CELLS // max(1, r.dim)) // len(crowd))
        sample = rows.where(F.col("dim") == r.dim).orderBy(F.xxhash64("qhash", "vec_id"), "vec_id").limit(most).select("v").toArrow()
        fitted[r.dim] = Regions(_matrix(sample.column(0)), -(-r["count"] // shard_rows))
    made = spark.sparkContext.broadcast(fitted)  # bounded: splits of SAMPLE / REGION regions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim, region = b.column(1).to_numpy(), np.zeros(b.num_rows, np.int64)
            for d in np.unique(dim):
                if int(d) in made.value:
                    at = np.flatnonzero(dim == d)
                    region[at] = made.value[int(d)].of(_matrix(pa.chunked_array([b.column(0).take(pa.array(at))])))
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), b.column(1), b.column(3), pa.array(region)], ["vec_id", "v", "dim", "qhash", "region"])

    placed = common.materialise(rows.select("v", "dim", "vec_id", "qhash").mapInArrow(common.trimmed(run), "vec_id long, v array<long>, dim int, qhash long, region long"), "placed")
    regions = placed.groupBy("dim", "region").count().withColumn("parts", F.ceil(F.col("count") / shard_rows))
    # one row a region and dimension, far fewer than rows; written, so that a crowded region's join can be split
    first = F.sum("parts").over(Window.orderBy("dim", "region")) - F.col("parts")
    numbered = common.materialise(regions.select("dim", "region", "parts", first.alias("first")), "regions")
    shards = numbered.agg(F.coalesce(F.max(F.col("first") + F.col("parts")), F.lit(0))).first()[0]
    part = F.pmod(F.xxhash64("vec_id", "qhash", F.lit(3)), F.col("parts"))
    return placed.join(numbered, ["dim", "region"]).select("vec_id", "v", "dim", "qhash", (F.col("first") + part).alias("shard")), shards


def _tree(rows: pa.Table) -> pa.Table:
    """One row with the ball tree of a shard, its root's ball apart."""
    tree = BallTree(rows.column("vec_id").to_numpy(), _matrix(rows.column("v")))
    made = {"shard": [rows.column("shard")[0].as_py()], "dim": [rows.column("dim")[0].as_py()], "centre": [tree.centre[0]], "radius": [float(tree.radius[0])], "tree": [pickle.dumps(tree, protocol=5)]}
    return pa.table({n: pa.array(x, t) for (n, x), t in zip(made.items(), (pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.binary()), strict=True)})


def reachable(asked: DataFrame, trees: DataFrame, shards: int, block_rows: int, best_only: bool = False) -> DataFrame:
    """(qid, qhash, shard, bound) of the shards of a query's dimension whose root bound reaches its floor; or its best shard.

    Roots come in blocks of ROOTS; asked(qid, q, qdim, qhash, floor) meets each block once."""
    blocks = max(1, -(-shards // ROOTS))
    count = max(1, -(-asked.count() // block_rows))
    schema = "qid long, qhash long, shard long, bound double"
    deal = F.pmod(F.xxhash64("qid", "qhash", F.lit(4)), F.lit(count)).cast("int")
    roots = trees.select("shard", "dim", "centre", "radius", F.floor(F.col("shard") / ROOTS).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("part"))
    each = asked.select("qid", "qhash", "q", "qdim", "floor", deal.alias("qpart"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("qblock"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())], names=["qid", "qhash", "shard", "bound"])
        if not left.num_rows or not right.num_rows:
            return empty
        q = _matrix(right.column("q")).astype(np.float64)
        bound = _bounds(_matrix(left.column("centre"), np.float64), left.column("radius").to_numpy(), q, np.sqrt((q * q).sum(1)))
        if best_only:
            j = bound.argmax(1)
            i = np.arange(len(q))
        else:
            i, j = np.nonzero(bound >= right.column("floor").to_numpy()[:, None])
        return pa.table([right.column("qid").take(pa.array(i)), right.column("qhash").take(pa.array(i)), left.column("shard").take(pa.array(j)), pa.array(bound[i, j])], names=["qid", "qhash", "shard", "bound"])

    found = roots.groupBy("dim", "block", "part").cogroup(each.groupBy("qdim", "qblock", "qpart")).applyInArrow(run, schema)
    if not best_only:
        return found
    best = F.max(F.struct("bound", (-F.col("shard")).alias("order")))
    return found.groupBy("qid", "qhash").agg(best.alias("b")).select("qid", "qhash", (-F.col("b.order")).alias("shard"), F.col("b.bound").alias("bound"))


def _searched(asked: DataFrame, visits: DataFrame, trees: DataFrame, k: int, block_rows: int) -> DataFrame:
    """(query_id, qhash, vec_id, score): the k best of each visit (qid, qhash, shard), above the query's floor.

    A tree meets the queries of its shard in blocks of about block_rows."""
    visits = common.materialise(visits.select("qid", "qhash", "shard"), "visits")
    blocks = visits.groupBy("shard").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    blocks = common.materialise(blocks, "blocks")
    homes = trees.join(blocks, "shard").select("shard", "tree", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    block = F.pmod(F.xxhash64("qid", "qhash", F.lit(5)), F.col("blocks")).cast("int")
    each = visits.join(blocks, "shard").join(asked, ["qid", "qhash"]).select("qid", "qhash", "q", "floor", F.col("shard").alias("qshard"), block.alias("qblock"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _SCHEMA.empty_table()
        tree = pickle.loads(left.column("tree")[0].as_py())  # noqa: S301  written by _tree a moment ago
        ids = right.column("qid").to_numpy()
        at, found, score = tree.search(ids, _matrix(right.column("q")), k, right.column("floor").to_numpy())
        return pa.table([pa.array(x) for x in (ids[at], right.column("qhash").to_numpy()[at], found, score)], schema=_SCHEMA)

    return homes.groupBy("shard", "block").cogroup(each.groupBy("qshard", "qblock")).applyInArrow(run, "query_id long, qhash long, vec_id long, score long")


def top_k(table: DataFrame, queries: Column, k: int = 10, shard_rows: int = SHARD, block_rows: int = BLOCK) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for every vector of table(vec_id, embedding) that meets
    ``queries``, the k largest integer inner products with the other rows, ties to the smaller vec_id.

    Vectors that are null or hold null or non-finite components take no part; only vectors of one
    dimension are compared. Rows with the query's vec_id are not its candidates; equal rows count once,
    rows that share a vec_id but not the vector are candidates each. A query with fewer candidates has
    fewer rows. Scaled components and scores that leave 64 bits become the nearest 64-bit number.
    An empty table gives an empty result; other columns are ignored."""
    return _ranked(*_found(table, queries, k, shard_rows, block_rows)[:2], k)


def _ranked(probed: DataFrame, found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id", "qhash").orderBy(F.desc("score"), "vec_id")
    return probed.union(found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _found(table: DataFrame, queries: Column, k: int, shard_rows: int, block_rows: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(hits of the first visits, hits of the others, the other visits, number of shards)."""
    if k < 1:
        raise ValueError("k must be at least 1")
    rows = common.materialise(scaled(table).distinct().withColumns({"dim": F.size("v"), "qhash": F.xxhash64("v")}), "vectors")
    dealt, shards = _dealt(rows, shard_rows)
    trees = common.materialise(dealt.groupBy("shard").applyInArrow(_tree, "shard long, dim int, centre array<double>, radius double, tree binary"), "trees")
    asked = rows.where(queries).select(F.col("vec_id").alias("qid"), F.col("v").alias("q"), F.col("dim").alias("qdim"), "qhash").withColumn("floor", F.lit(_LOWEST).cast("long"))
    first = common.materialise(reachable(asked, trees, shards, block_rows, best_only=True), "first")
    probed = common.materialise(_searched(asked, first, trees, k, block_rows), "probed")
    kth = F.row_number().over(Window.partitionBy("query_id", "qhash").orderBy(F.desc("score"), "vec_id"))
    floors = probed.withColumn("r", kth).where(F.col("r") == k).select(F.col("query_id").alias("qid"), "qhash", F.col("score").alias("reached"))
    armed = common.materialise(asked.join(floors, ["qid", "qhash"], "left").withColumn("floor", F.coalesce("reached", "floor")).drop("reached"), "armed")
    visits = common.materialise(reachable(armed, trees, shards, block_rows).join(first.select("qid", "qhash", "shard"), ["qid", "qhash", "shard"], "left_anti"), "visits")
    return probed, _searched(armed, visits, trees, k, block_rows), visits, shards


def op4_topk(spark, sf_dir: str) -> DataFrame:
    """The 10 largest inner products of every vector whose id is divisible by 100, against all others."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


ORACLE = """WITH v AS (SELECT DISTINCT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (SELECT q.vec_id AS query_id, q.v AS q, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 10"""
