"""Centroid clustering (k-means on integers): float32 screening with rigorous rounding-error intervals.

Components are integers. In each round a batch of vectors meets all centroids in one float32 matrix product. A computed
product differs from the true one by at most gamma(d + 2) |v| |c|, gamma(n) = n u / (1 - n u), u = 2**-24, whatever the order of the
sums: d roundings of the sum and one of either factor that is longer than 24 bits. So every distance lies in an interval, and only
centroids whose interval reaches below the smallest upper end can be nearest. Where more than one is left, the
distances to these are computed in 64-bit integers, and the smallest number wins ties.

Each round is one scan: a task adds up its vectors by centroid, and only k x d sums reach the driver. The vectors are written
once as packed integers in the shared folder, so that a lost task reads its part again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common

#: Vectors of one matrix product.
BLOCK = 4096
#: Integers beyond this would overflow 64-bit distances of up to 256 components.
LARGEST = 1 << 26
UNIT = 2.0**-24


def integers(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(marks of the vectors that are kept, their components floor(scale * x) in rows)."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    keep = sizes == dims
    at = np.repeat(keep, np.maximum(sizes, 0))
    rows = values[at].reshape(-1, dims)
    finite = np.isfinite(rows).all(axis=1)
    keep[np.flatnonzero(keep)[~finite]] = False
    found = np.floor(scale * rows[finite])
    if len(found) and np.abs(found).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST} after scaling: distances would overflow 64 bits")
    return keep, found.astype(np.int32)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid of each row of integers, the smallest of equally near ones."""
    if not len(vectors):
        return np.empty(0, np.int64)
    d = vectors.shape[1]
    gamma = (d + 2) * UNIT / (1 - (d + 2) * UNIT)
    v, c = vectors.astype(np.float64), centroids.astype(np.float64)
    squares = (centroids.astype(np.int64) ** 2).sum(axis=1)
    product = vectors.astype(np.float32) @ centroids.astype(np.float32).T
    middle = squares.astype(np.float64) - 2.0 * product.astype(np.float64)  # |v|^2 is the same for all
    # twice the bound of the product, and of the roundings of this line and of the norms
    wide = 2.0 * (1 + 1e-6) * gamma * np.sqrt((v * v).sum(axis=1))[:, None] * np.sqrt((c * c).sum(axis=1)) + 1e-12 * (np.abs(middle) + squares)
    low, top = middle - wide, (middle + wide).min(axis=1)
    left = low <= top[:, None]
    found = left.argmax(axis=1)
    unsure = np.flatnonzero(left.sum(axis=1) > 1)
    for at in range(0, len(unsure), BLOCK):
        rows = unsure[at : at + BLOCK]
        i, j = np.nonzero(left[rows])
        step = vectors[rows[i]].astype(np.int64) - centroids[j]
        exact = np.full((len(rows), len(centroids)), np.iinfo(np.int64).max)
        exact[i, j] = (step * step).sum(axis=1)
        found[rows] = exact.argmin(axis=1)  # the first of equal ones
    return found


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    """Packed int32 vectors in rows."""
    flat = column.cast(pa.binary())
    ends = np.frombuffer(flat.buffers()[1], np.int32, len(flat) + 1, 4 * flat.offset)
    return np.frombuffer(flat.buffers()[2], np.int32, int(ends[-1] - ends[0]) // 4, int(ends[0])).reshape(-1, dims)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            yield b.slice(at, BLOCK)


def packed(vectors: DataFrame, dims: int, scale: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Rows (vec_id, v) of the vectors that are kept, v their integers as packed 32-bit numbers; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            keep, found = integers(b.column(1), dims, scale)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), pa.array([x.tobytes() for x in found], pa.binary())], ["vec_id", "v"])

    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{vector_column}`").cast("array<double>").alias("v"))
    return common.materialise(rows.mapInArrow(common.trimmed(run), "vec_id long, v binary"), "vectors")


def _starts(rows: DataFrame, k: int, seed: int, dims: int) -> np.ndarray:
    """The k vectors of the smallest sha256 of seed:vec_id, in that order; of repeated ids the order of the vectors decides."""
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id is not null").orderBy(key, "v").limit(k).collect()  # k rows
    return np.array([np.frombuffer(r.v, np.int32) for r in first], np.int64).reshape(-1, dims)


def _moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every centroid replaced by floor(sum / count) of the vectors nearest to it; those of none stay."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for b in _pieces(batches):
            v = _rows(b.column(1), dims)
            home = nearest(v, centroids)
            order = np.argsort(home, kind="stable")
            heads = np.flatnonzero(np.diff(home[order], prepend=-1))
            if len(heads):
                total[home[order[heads]]] += np.add.reduceat(v[order].astype(np.int64), heads, axis=0)
                count += np.bincount(home, minlength=k)
        some = np.flatnonzero(count)
        at = np.repeat(some, dims)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.tile(np.arange(dims, dtype=np.int32), len(some))), pa.array(total[some].ravel()), pa.array(count[at])], ["cluster", "dim", "total", "n"])

    sums = rows.mapInArrow(common.trimmed(run), "cluster int, dim int, total long, n long").groupBy("cluster", "dim")
    new = centroids.copy()
    for r in sums.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():  # k x dims rows
        new[r.cluster, r.dim] = int(r.total) // r.n
    return new


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one for each vector that is kept.

    Vectors that are null, hold null or non-finite components or have not exactly ``dims`` of them take no part; the others become integers
    floor(scale * x). ``rounds`` rounds of assignment and exact floor(sum / count) start from the k vectors of the smallest sha256 of
    ``seed:vec_id``; an empty cluster keeps its centroid, equally near centroids go by the smaller number. Fewer than k vectors start
    fewer clusters. A null vec_id never starts a cluster but is assigned; if no vector has an id, the result is empty. Repeated rows count each; of
    those that tie as starts the smaller bytes come first. An empty table gives an empty result; other columns are ignored. Components
    beyond 2**26 after scaling raise an error, since distances wouldn't fit 64 bits."""
    spark = vectors.sparkSession
    rows = packed(vectors, dims, scale, id_column, vector_column)
    centroids = _starts(rows, k, seed, dims)
    for _ in range(rounds if len(centroids) else 0):
        new = _moved(rows, centroids)
        if (new == centroids).all():  # the rounds left would change nothing
            break
        centroids = new
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            v = _rows(b.column(1), dims)
            home = nearest(v, centroids)
            step = v.astype(np.int64) - centroids[home]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(home.astype(np.int32)), pa.array((step * step).sum(axis=1))], ["vec_id", "cluster", "distance"])

    some = rows if len(centroids) else rows.limit(0)
    found = common.materialise(some.mapInArrow(common.trimmed(run), "vec_id long, cluster int, distance long"), "assigned")
    common.drop(rows)
    sums = {r.cluster: r.total for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # k rows
    table = spark.createDataFrame([(j, sums.get(j, 0), sum(sums.values()), name) for j, name in enumerate(names)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    """40 clusters of all embeddings of 64 components, five rounds."""
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle(rounds: int = 5) -> str:
    """DuckDB SQL of op12_centroids; sums of products of these integers are exact in doubles."""
    parts = ["""kept as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)""",
    "c0 as (select (row_number() over (order by sha256('2:' || vec_id::varchar)) - 1)::int j, v c from kept where vec_id is not null order by sha256('2:' || vec_id::varchar) limit 40)"]
    distance = "list_dot_product(v, v) - 2 * list_dot_product(v, c) + list_dot_product(c, c)"
    for r in range(rounds + 1):
        parts.append(f"a{r} as materialized (select vec_id, v, min({{'distance': {distance}, 'j': j, 'c': c}}) near from (select row_number() over () k, * from kept), c{r} group by k, vec_id, v)")
        if r < rounds:
            parts.append(f"""m{r} as materialized (select j, list(((s - ((s % n) + n) % n) // n)::double order by d) c from (
  select near.j j, d, sum(x)::bigint s, count(*) n from (select near, unnest(v)::bigint x, unnest(range(64)) d from a{r}) group by near.j, d) group by j)""")
            parts.append(f"c{r + 1} as materialized (select c{r}.j, coalesce(m{r}.c, c{r}.c) c from c{r} left join m{r} on m{r}.j = c{r}.j)")
    return "with " + ",\n".join(parts) + f"""
select vec_id, near.j cluster, near.distance::bigint distance, (sum(near.distance) over (partition by near.j))::bigint cluster_inertia, (sum(near.distance) over ())::bigint inertia,
  sha256(array_to_string(list_transform(near.c, lambda x: x::bigint), ',')) centroid_sha256 from a{rounds}"""


ORACLE = _oracle()
