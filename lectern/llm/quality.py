"""Quality classification by a byte-level convolutional network in numpy.

The UTF-8 bytes of a whole text are embedded and passed through learned filters of WIDTH bytes at
every STRIDE-th place. Overlapping chunks (CHUNK bytes, each shifted by half of that) cover the
text; each filter is max-pooled within a chunk, and the largest and the mean of the chunks'
values are combined by a logistic unit into one probability. For scoring, embedding and filters
are multiplied into one table, so that a filter bank costs WIDTH look-ups at a place.

The training rows are written in the shared folder in a hashed order and read again in every epoch, a batch at a time, so that
the driver holds one batch of texts and no sample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common

WIDTH, STRIDE, CHUNK = 12, 4, 512
#: At most so many labelled rows of each class are used for training.
SAMPLE_EACH = 2000
#: Rows of a training batch, and files of training rows.
BATCH, FILES = 32, 8
#: Places convolved at a time; bounds the memory of a very long text. A multiple of a half chunk.
PLACES = 1 << 15
_HALF = CHUNK // 2 // STRIDE


class Network:
    """Embedding, filters and the logistic unit; made of fixed-size arrays."""

    def __init__(self, filters: int = 32, depth: int = 8, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, depth)).astype(np.float32),
            "conv": rng.normal(0, 1 / np.sqrt(WIDTH * depth), (WIDTH, depth, filters)).astype(np.float32),
            "shift": np.zeros(filters, np.float32),
            "top": rng.normal(0, 0.1, filters).astype(np.float32),
            "mean": rng.normal(0, 0.1, filters).astype(np.float32),
            "bias": np.zeros(1, np.float32),
        }
        self.table: np.ndarray | None = None

    def freeze(self) -> Network:
        """Multiply embedding and filters into the table used for scoring."""
        self.table = np.matmul(self.p["embed"], self.p["conv"])
        return self

    def _halves(self, body: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Of each half chunk and filter: the largest value and its first byte."""
        raw = np.frombuffer(body, np.uint8)
        places = max(1, -(-max(0, len(raw) - WIDTH) // STRIDE) + 1)
        x = np.zeros((places - 1) * STRIDE + WIDTH, np.uint8)
        x[: len(raw)] = raw
        tops, ats = [], []
        for a in range(0, places, PLACES):
            b = min(places, a + PLACES)
            y = self.table[0][x[a * STRIDE : (b - 1) * STRIDE + 1 : STRIDE]]
            for j in range(1, WIDTH):
                y += self.table[j][x[a * STRIDE + j : (b - 1) * STRIDE + j + 1 : STRIDE]]
            n = -(-(b - a) // _HALF)
            full = np.full((n * _HALF, y.shape[1]), -np.inf, np.float32)
            full[: b - a] = y
            full = full.reshape(n, _HALF, -1)
            at = full.argmax(1) if self.training else np.zeros((n, 1), np.int64)
            tops.append(full.max(1))
            ats.append((at + np.arange(n)[:, None] * _HALF + a) * STRIDE)
        return np.concatenate(tops), np.concatenate(ats)

    training = False

    def _chunks(self, body: bytes):
        top, at = self._halves(body)
        if len(top) > 1:
            right = top[1:] > top[:-1]
            value = np.where(right, top[1:], top[:-1])
            place = np.where(right, at[1:], at[:-1]) if self.training else at[1:]
        else:
            value, place = top, at
        return np.maximum(value + self.p["shift"], 0), place

    def score(self, bodies: list[bytes]) -> np.ndarray:
        """Probabilities of label 1, each of a whole text."""
        out = np.empty(len(bodies))
        for i, body in enumerate(bodies):
            c, _ = self._chunks(body)
            out[i] = c.max(0) @ self.p["top"] + c.mean(0) @ self.p["mean"] + self.p["bias"][0]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

    def fit(self, batches: Callable[[], Iterable[tuple[list[bytes], np.ndarray]]], rows: int, positives: int, epochs: int = 5, rate: float = 0.01) -> Network:
        """Adam over the batches (bodies, labels), read anew in each epoch; classes weigh alike. Gradients flow through the pooled places only."""
        p, m, v = self.p, {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}
        heavy = {1: 0.5 * rows / max(1, positives), 0: 0.5 * rows / max(1, rows - positives)}
        step, filters = 0, len(p["shift"])
        self.training = True
        for epoch in range(epochs):
            for bodies, y in batches():
                self.freeze()
                g = {k: np.zeros_like(a) for k, a in p.items()}
                dt = np.zeros(WIDTH * 256 * filters)
                for j in range(len(bodies)):
                    c, place = self._chunks(bodies[j])
                    best = c.argmax(0)
                    top, mean = c[best, np.arange(filters)], c.mean(0)
                    z = top @ p["top"] + mean @ p["mean"] + p["bias"][0]
                    d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[j]) * heavy[int(y[j])] / len(bodies)
                    g["top"] += d * top
                    g["mean"] += d * mean
                    g["bias"] += d
                    dc = np.broadcast_to(d * p["mean"] / len(c), c.shape).copy()
                    dc[best, np.arange(filters)] += d * p["top"]
                    dc *= c > 0
                    g["shift"] += dc.sum(0)
                    r, f = np.nonzero(dc)
                    raw = np.frombuffer(bodies[j], np.uint8)
                    for k in range(WIDTH):
                        at = place[r, f] + k
                        byte = np.where(at < len(raw), raw[np.minimum(at, max(0, len(raw) - 1))] if len(raw) else 0, 0)
                        dt += np.bincount((k * 256 + byte.astype(np.int64)) * filters + f, weights=dc[r, f], minlength=dt.size)
                dt = dt.reshape(WIDTH, 256, filters).astype(np.float32)
                g["conv"] = np.matmul(p["embed"].T, dt)
                g["embed"] = np.einsum("wbf,wdf->bd", dt, p["conv"])
                step += 1
                now = rate / (1 + epoch)
                for k in p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
        self.training = False
        return self.freeze()


def train(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, each: int = SAMPLE_EACH) -> Network:
    """A network fitted on labels.quality of rows whose remainder of crc32(doc_id) is not ``held``."""
    rows = common.labelled(docs, labels, "quality", common.remainder(F.col("doc_id"), modulus) != held, each)
    dealt = rows.repartitionByRange(FILES, "key").sortWithinPartitions("key").select("y", F.col("text").cast("binary").alias("body"))
    kept = common.materialise(dealt, "sample")
    sizes = kept.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("ones")).first()
    net = Network()
    if not sizes.n:
        net.p["top"][:], net.p["mean"][:] = 0, 0
        return net.freeze()

    def batches() -> Iterator[tuple[list[bytes], np.ndarray]]:
        for b in common.stream(kept, BATCH):
            yield b.column(1).to_pylist(), b.column(0).to_numpy()

    net.fit(batches, sizes.n, sizes.ones)
    common.drop(kept)
    return net


def with_score(docs: DataFrame, net: Network, name: str = "score") -> DataFrame:
    """docs with a column of probabilities, named ``name`` (which replaces a column of that name)."""
    model = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    @F.arrow_udf("double")
    def probability(bodies):
        common.only()
        out = pa.array(model.value.score([x.as_py() or b"" for x in bodies]))
        common.trim()
        return out

    return docs.withColumn(name, probability(F.col("text").cast("string").cast("binary")))


def scores(docs: DataFrame, net: Network) -> DataFrame:
    """Rows (doc_id, score) for all rows of docs(doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.value.score([x.as_py() or b"" for x in b.column(1)]))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("body")).mapInArrow(common.trimmed(run), "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, each: int = SAMPLE_EACH) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) for every row of docs(doc_id, text).

    labels(doc_id, quality) marks some of them; rows with null ids or labels are ignored. Without
    any usable label every score is 0.5. A null doc_id is never held out. Null texts score as empty
    ones. Repeated rows stay; an empty table gives an empty result; other columns are ignored."""
    found = scores(docs, train(docs, labels, modulus, held, each))
    out = F.coalesce(common.remainder(F.col("doc_id"), modulus) == held, F.lit(False))
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of remainder 1 modulo 3 are held out."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
