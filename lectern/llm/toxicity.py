"""Toxicity by a second-order factorization machine over hashed terms.

Terms of a document are its words and the beginnings of its words,
hashed into ``2**BITS`` buckets. The machine learns a weight and a latent vector for each bucket;
the products of the vectors score pairs of terms that occur together, such as an insult with the
mention of a group, which no sum of single weights expresses. It is trained with AdaGrad in numpy
on a bounded sample of the labelled rows and scores every whole text.

Long texts hold thousands of words that say nothing, so only some buckets count: those that tell the classes apart on their own, and
those that do so together with others. For the latter a machine is fitted on the former; what it leaves unexplained is
added up for every bucket against MATES groups of partners, and a bucket counts if one of its sums is JOINT standard errors from zero.
Frequencies come from the executors by bucket; the sample's rows are streamed from the shared folder,
so the driver holds the values of buckets that count, at most 2 x SAMPLE_EACH rows of them, and no text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common

BITS = 18
#: At most so many labelled rows of each class are used for training.
SAMPLE_EACH = 4000
#: Standard errors by which a bucket must tell the classes apart on its own, or with a group of partners.
SIGMA, JOINT = 2.0, 12.0
#: Groups that the partners of a bucket are hashed into, and rows that a joint bucket needs.
MATES, ROWS = 16, 8
FACTORS = 8
EPOCHS = 12
_WORD = re.compile(r"[^\W\d_]+")


class _Terms(dict):
    """Buckets of a word: itself and its beginnings of 2 to 5 letters; forgets all when it is full."""

    def __missing__(self, word: str) -> list[int]:
        if len(self) > 300_000:
            self.clear()
        mask = (1 << BITS) - 1
        self[word] = found = [xxhash.xxh64_intdigest(x) & mask for x in (word, *(f"^{word[:k]}" for k in range(2, 6) if k < len(word)))]
        return found


_TERMS = _Terms()


def _terms() -> _Terms:
    """The terms of this process."""
    return _TERMS


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(sorted buckets, values) of a whole text; values are damped counts of unit length. Empty without words."""
    counts = Counter(_WORD.findall((text or "").lower()))
    if not counts:
        return np.empty(0, np.int64), np.empty(0)
    terms = list(map(_TERMS.__getitem__, counts))
    sizes = np.fromiter(map(len, terms), np.int64, len(terms))
    flat = np.fromiter(chain.from_iterable(terms), np.int64, int(sizes.sum()))
    order = np.argsort(flat, kind="stable")
    flat, n = flat[order], np.repeat(np.fromiter(counts.values(), np.float64, len(counts)), sizes)[order]
    heads = np.flatnonzero(np.diff(flat, prepend=-1))
    return flat[heads], np.log1p(np.add.reduceat(n, heads))


class Machine:
    """Weights of a factorization machine; ``known`` marks the buckets that count."""

    def __init__(self, factors: int = FACTORS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bias, self.w = 0.0, np.zeros(1 << BITS)
        self.v = rng.normal(0, 0.02, (1 << BITS, factors))
        self.known = np.zeros(1 << BITS, bool)

    def _batch(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        """Concatenated known features, with the row of each, scaled to unit length."""
        ids, vals, at = [], [], []
        for i, (a, x) in enumerate(rows):
            k = self.known[a]
            a, x = a[k], x[k]
            if len(a):
                ids.append(a)
                vals.append(x / np.sqrt((x * x).sum()))
                at.append(np.full(len(a), i))
        if not ids:
            return np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        return np.concatenate(ids), np.concatenate(vals), np.concatenate(at)

    def _raw(self, ids, vals, at, n):
        vx = self.v[ids] * vals[:, None]
        total = np.zeros((n, self.v.shape[1]))
        square = np.zeros(n)
        if len(ids):
            heads = np.flatnonzero(np.diff(at, prepend=-1))
            total[at[heads]] = np.add.reduceat(vx, heads, axis=0)
            square = np.bincount(at, weights=(vx * vx).sum(1), minlength=n)
        return self.bias + np.bincount(at, weights=self.w[ids] * vals, minlength=n) + 0.5 * ((total * total).sum(1) - square), vx, total

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Probabilities of label 1."""
        raw, _, _ = self._raw(*self._batch(rows), len(rows))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))

    def fit(self, rows, y, epochs: int = 6, size: int = 64, rate: float = 0.25, decay: float = 1e-5, known: np.ndarray | None = None, seed: int = 7) -> Machine:
        """AdaGrad over shuffled batches; classes weigh alike. With one class only, the prior is learnt.

        ``known`` marks the buckets that count; by default those of two or more rows."""
        y = np.asarray(y, float)
        if not len(y):
            return self
        self.known = known if known is not None else np.bincount(np.concatenate([a for a, _ in rows] or [np.empty(0, np.int64)]), minlength=1 << BITS) >= 2
        rng = np.random.default_rng(seed)
        gb, gw, gv = 1e-6, np.full(1 << BITS, 1e-6), np.full(self.v.shape, 1e-6)
        weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for i in range(0, len(rows), size):
                pick = order[i : i + size]
                ids, vals, at = self._batch([rows[j] for j in pick])
                raw, vx, total = self._raw(ids, vals, at, len(pick))
                g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[pick]) * weight[pick] / len(pick)
                gb += g.sum() ** 2
                self.bias -= rate * g.sum() / np.sqrt(gb)
                if not len(ids):
                    continue
                u, inv = np.unique(ids, return_inverse=True)
                dw = np.bincount(inv, weights=g[at] * vals) + decay * self.w[u]
                gw[u] += dw * dw
                self.w[u] -= rate * dw / np.sqrt(gw[u])
                each = (g[at] * vals)[:, None] * (total[at] - vx)
                dv = np.stack([np.bincount(inv, weights=each[:, f]) for f in range(each.shape[1])], 1) + decay * self.v[u]
                gv[u] += dv * dv
                self.v[u] -= 0.2 * rate * dv / np.sqrt(gv[u])
        return self


def telling(ones: np.ndarray, every: np.ndarray, positives: int, rows: int) -> np.ndarray:
    """Marks of the buckets in two or more rows whose share of label 1 differs from the sample's by SIGMA standard errors.

    ones, every: in how many rows of label 1, and of both, each bucket stands. Without two classes, none."""
    share = positives / max(1, rows)
    spread = np.sqrt(np.maximum(every * share * (1 - share) * (1 - every / max(1, rows)), 1e-9))
    known = (every >= 2) & (every < rows) & (np.abs(ones - every * share) >= SIGMA * spread)
    return known if 0 < positives < rows else np.zeros(len(every), bool)


def joint(rows: Iterator[tuple[np.ndarray, np.ndarray]], unexplained: np.ndarray, every: np.ndarray) -> np.ndarray:
    """Marks of the buckets whose products with a group of partners go along with what is unexplained of the rows' labels.

    Products are of values of unit length, a bucket isn't its own partner. Buckets in fewer than ROWS rows, or in all of them, don't count."""
    total, square = np.zeros((1 << BITS, MATES), np.float32), np.zeros((1 << BITS, MATES), np.float32)
    n = 0
    for (ids, x), g in zip(rows, unexplained, strict=True):
        n += 1
        use = (every[ids] >= ROWS) & (every[ids] < len(unexplained))
        ids, x = ids[use], x[use]
        if not len(ids):
            continue
        x = x / np.sqrt((x * x).sum())
        group = (ids * 2654435761 >> 16) % MATES
        mates = np.tile(np.bincount(group, weights=x, minlength=MATES), (len(ids), 1))
        mates[np.arange(len(ids)), group] -= x
        each = g * x[:, None] * mates
        total[ids] += each
        square[ids] += each * each
    return (np.abs(total) >= JOINT * np.sqrt(square + 1e-12)).any(axis=1) if n else np.zeros(1 << BITS, bool)


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, each: int = SAMPLE_EACH) -> Machine:
    """A machine fitted on labels.toxic of rows whose remainder of crc32(doc_id) is not ``held``."""
    names = ("key", "y", "ids", "values")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                a, x = features(b.column(2)[i].as_py())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([a.astype("<i4").tobytes()], pa.binary()), pa.array([x.astype("<f4").tobytes()], pa.binary())], names)

    texts = common.labelled(docs, labels, "toxic", common.remainder(F.col("doc_id"), modulus) != held, each)
    rows = common.materialise(texts.mapInArrow(common.trimmed(read, _terms), "key long, y int, ids binary, values binary"), "sample")

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, every = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for b in batches:
            for y, a in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                a = np.frombuffer(a.as_py(), "<i4")
                every[a] += 1
                ones[a] += y
        at = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(ones[at]), pa.array(every[at])], ["id", "ones", "n"])

    counts = rows.select("y", "ids").mapInArrow(common.trimmed(ids, _terms), "id long, ones long, n long").groupBy("id").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n")).toArrow()  # at most 2**BITS rows
    ones, every = np.zeros(1 << BITS), np.zeros(1 << BITS)
    at = counts.column("id").to_numpy()
    ones[at], every[at] = counts.column("ones").to_numpy(), counts.column("n").to_numpy()

    def sample() -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """The sample's rows in the order of their files, a few at a time."""
        for b in common.stream(rows, 64):
            for key, y, a, x in zip(b.column("key").to_pylist(), b.column("y").to_pylist(), b.column("ids"), b.column("values"), strict=True):
                yield key, y, np.frombuffer(a.as_py(), "<i4").astype(np.int64), np.frombuffer(x.as_py(), "<f4").astype(np.float64)

    def fitted(known: np.ndarray) -> tuple[Machine, np.ndarray, np.ndarray]:
        """A machine of the known buckets, the order of the rows' keys, and their labels in the order of the files."""
        kept = [(key, y, a[known[a]].astype(np.int32), x[known[a]].astype(np.float32)) for key, y, a, x in sample()]
        order = np.argsort([r[0] for r in kept], kind="stable")
        y = np.array([r[1] for r in kept])
        got = [(kept[i][2].astype(np.int64), kept[i][3].astype(np.float64)) for i in order]
        machine = Machine().fit(got, y[order], epochs=EPOCHS, known=known)
        left = np.empty(len(y))
        left[order] = y[order] - machine.score(got) if len(got) else 0
        return machine, left, y

    y = np.array([r[1] for r in sample()])
    known = telling(ones, every, int(y.sum()), len(y))
    machine, left, _ = fitted(known)
    more = joint(((a, x) for _, _, a, x in sample()), left, every) & ~known if 0 < y.sum() < len(y) else known & False
    if more.any():
        machine, _, _ = fitted(known | more)
    common.drop(rows)
    return machine


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """Rows (doc_id, score) for all rows of docs(doc_id, text); null texts score as empty ones."""
    model = docs.sparkSession.sparkContext.broadcast(machine)  # of fixed size: 2**BITS x (1 + FACTORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                p = model.value.score([features(x.as_py()) for x in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(common.trimmed(run, _terms), "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, each: int = SAMPLE_EACH) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) for every row of docs(doc_id, text).

    labels(doc_id, toxic) marks some of them; rows with null ids or labels are ignored. Without
    any usable label every score is 0.5. A null doc_id is never held out. Empty and null texts get
    the score of the bias alone. Repeated rows stay; an empty table gives an empty result; other
    columns are ignored."""
    found = score(docs, train(docs, labels, modulus, held, each))
    out = F.coalesce(common.remainder(F.col("doc_id"), modulus) == held, F.lit(False))
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of remainder 0 modulo 5 are held out."""
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
