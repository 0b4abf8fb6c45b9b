"""Vector scans, neighbours by blocks, centroids and embedding caches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import vectors as V


def scan(table: DataFrame, query: list[float], key: str, vector: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(the ``limit`` most similar rows by (1 + cosine) / 2 and key, one row: whether there were more)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = table.where(V.valid(F.col(vector), len(query))).select(key, V.similarity(F.col(vector), q).alias("score"))
    probe = scored.orderBy(F.desc("score"), key).limit(limit + 1)
    return probe.orderBy(F.desc("score"), key).limit(limit), probe.agg((F.count("*") > limit).alias("truncated"))


def similar_outside(table: DataFrame, query: list[float], key: str, vector: str, start: int, end: int, limit: int) -> DataFrame:
    """The ``limit`` rows most similar to a vector whose range (start_char, end_char) doesn't overlap [start, end)."""
    return scan(table.where(~((F.col("start_char") < end) & (F.col("end_char") > start))), query, key, vector, limit)[0]


def centroids(table: DataFrame, by: str, vector: str, weight: Column) -> DataFrame:
    """(by, pos, value): weighted mean vectors, one row for each component."""
    parts = table.select(by, weight.cast("double").alias("w"), F.posexplode(vector).alias("pos", "x"))
    return parts.groupBy(by, "pos").agg((F.sum(F.col("w") * F.col("x").cast("double")) / F.sum("w")).alias("value"))


def unit_rows(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors as rows, their lengths; -1 for vectors that are null, hold a null or have no direction)."""
    one = column.combine_chunks()
    one = pa.concat_arrays(one.chunks) if isinstance(one, pa.ChunkedArray) else one
    size = pc.fill_null(pc.list_value_length(one), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = one.flatten()
    if len(size) and size[0] > 0 and (size == size[0]).all() and not flat.null_count:
        rows = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(size), -1)
    else:
        rows = np.zeros((len(size), max(size.max(initial=0), 1)))
        for i, v in enumerate(one.to_pylist()):
            if v is None or None in v:
                size[i] = -1
            else:
                rows[i, : len(v)] = v
    norm = np.sqrt((rows * rows).sum(axis=1))
    size[norm == 0] = -1
    return rows / np.where(norm > 0, norm, 1.0)[:, None], size


def cosines(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], none: float) -> np.ndarray:
    """Cosines of rows a with rows b of ``unit_rows``; ``none`` where a side has none or the lengths differ."""
    (x, n), (y, m) = a, b
    width = min(x.shape[1], y.shape[1])  # longer vectors on one side have no partner there
    found = x[:, :width] @ y[:, :width].T
    unlike = (n[:, None] != m[None, :]) | (n < 0)[:, None]
    if unlike.any():
        found[unlike] = none
    return found


def best_columns(score: Callable[[slice, slice], np.ndarray], rows: int, columns: int, k: int, tile: tuple[int, int] = (256, 4096)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of each row's k best columns by score to 9 digits, ties to the smaller column; -inf is no candidate, NaN the best.

    Scores are made tile by tile; what leaves a tile are k columns a row."""
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    out = [none]
    for a in range(0, rows, tile[0]):
        floor, found = None, [none]
        for b in range(0, columns, tile[1]):
            s = score(slice(a, min(a + tile[0], rows)), slice(b, min(b + tile[1], columns)))
            rank = np.where(np.isnan(s), np.inf, s)
            floor = np.full(len(s), -np.inf) if floor is None else floor
            new = np.flatnonzero(floor == -np.inf)
            if len(new) and s.shape[1] > k:
                floor[new] = np.partition(rank[new], -k, axis=1)[:, -k]
            r, c = np.nonzero((rank >= floor[:, None] - 1e-9) & (rank > -np.inf))
            found.append(_firsts(r + a, c + b, s[r, c], k))
        out.append(_firsts(*map(np.concatenate, zip(*found)), k))
    return tuple(map(np.concatenate, zip(*out)))


def _firsts(r: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((c, -np.round(np.where(np.isnan(s), np.inf, s), 9), r))
    r, c, s = r[order], c[order], s[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[keep], c[keep], s[keep]


def neighbours(table: DataFrame, key: str, vector: str, group: str, k: int, block: int = 20000, least: float = -1.0) -> DataFrame:
    """(src, dst, score): for every row its ``k`` rows of other groups with the largest cosine, ties to the smaller key.

    Rows are dealt to blocks; each pair of blocks is a matrix product in tiles, of which only each row's best k leave the
    task. Every row is sent once for each block, so rows x rows / block are shuffled: all pairs are compared."""
    rows = table.where(V.valid(F.col(vector))).select(F.col(key).alias("k"), F.col(group).alias("g"), F.col(vector).alias("v"))
    n = max(1, -(-rows.count() // block))
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("k"), F.lit(n)).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = dealt.select("k", "g", "v", F.col("b").alias("lb"), others.alias("lo"))
    right = dealt.select(F.col("k").alias("k2"), F.col("g").alias("g2"), F.col("v").alias("v2"), others.alias("rb"), F.col("b").alias("ro"))
    kinds = dict(table.dtypes)
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("score", pa.float64())])

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        b = b.sort_by("k2")
        ka, kb, x, y = a.column("k").to_numpy(), b.column("k2").to_numpy(), unit_rows(a.column("v")), unit_rows(b.column("v2"))
        ga, gb = a.column("g").to_numpy(), b.column("g2").to_numpy()

        def score(i: slice, j: slice) -> np.ndarray:
            s = cosines((x[0][i], x[1][i]), (y[0][j], y[1][j]), -np.inf)
            s[ga[i][:, None] == gb[j][None, :]] = -np.inf
            return s

        r, c, s = best_columns(score, len(ka), len(kb), k)
        s = np.round(s, 9)
        return pa.table([pa.array(x[s >= least]) for x in (ka[r], kb[c], s)], schema=schema)

    if kinds[key] not in ("bigint", "int"):
        raise ValueError("keys must be whole numbers")
    found = left.groupBy("lb", "lo").cogroup(right.groupBy("rb", "ro")).applyInArrow(best, "src long, dst long, score double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst"))
    return found.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def cache_misses(wanted: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Distinct (hash, text) of wanted(seq, hash, text) without a vector of the model, by first use."""
    first = wanted.groupBy("hash").agg(F.min("seq").alias("seq"), F.min_by("text", "seq").alias("text"))
    return first.join(cache.where(F.col("model") == model).select("hash"), "hash", "left_anti")


def embed(texts: DataFrame, embedder, batch: int = 32) -> DataFrame:
    """texts(hash, text) with vectors by embedder(list of texts) -> list of vectors, in batches inside each partition.

    ``embedder`` is shipped to the executors; it must give one vector of one dimension for each text."""
    if not 1 <= batch <= 256:
        raise ValueError("batch must be 1 to 256")

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, batch):
                part = b.slice(a, batch)
                found = [list(map(float, v)) for v in embedder(part.column(1).to_pylist())]
                if len(found) != part.num_rows or len({len(v) for v in found}) > 1:
                    raise ValueError("the embedder must give one vector of one dimension for each text")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.float32()))], ["hash", "embedding"])

    return texts.select("hash", "text").mapInArrow(run, "hash string, embedding array<float>")


def hashing_embedder(dimensions: int = 64):
    """An offline embedder: words hashed to signed components. For tests and as a default without a provider."""

    def run(texts: list[str]) -> list[list[float]]:
        import zlib

        out = []
        for t in texts:
            v = [0.0] * dimensions
            for w in (t or "").lower().split() or [""]:
                h = zlib.crc32(w.encode())
                v[h % dimensions] += 1.0 if h >> 16 & 1 else -1.0
            if not any(v):
                v[0] = 1.0
            out.append(v)
        return out

    return run
