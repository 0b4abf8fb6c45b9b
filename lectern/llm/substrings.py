"""Removal of passages that repeat across documents, by FM-indexes over shards.

A window is a run of ``length`` words. Every window is given to the shard of its anchor: the
smallest hash among its runs of GRAM words, so equal windows meet in one shard. Neighbouring
windows with one anchor travel together as a piece of text. Pieces whose anchor occurs in one
text only cannot repeat and stay behind; exact copies of a text are settled beforehand. Each shard
is read in blocks of whole anchors; a block's distinct pieces are indexed (lectern.llm.fmindex)
and the pieces are streamed through backward search, whose matching statistics, cut at ``length``,
tell for each window the smallest doc_id that has it. Pieces of an anchor with more than HOT
occurrences are dealt over several sub-shards by document; what is the first of its window in a
sub-shard is then compared with the firsts of the other sub-shards by the window's digest.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common
from lectern.llm.fmindex import FMIndex

GRAM = 8
#: Occurrences of an anchor in one sub-shard, about.
HOT = 1000
#: Words indexed at once; bounds the memory of a task, besides one anchor's pieces.
BLOCK_WORDS = 250_000
#: Windows that travel in one piece at most.
PIECE = 4096
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


class _Hashes(dict):
    """64-bit hashes of words; forgets all when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def _hashes() -> _Hashes:
    """The words of this process."""
    return _HASHES


def pieces(words: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, number of windows) of each piece of a document."""
    n, gram = len(words), min(GRAM, length)
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
    w = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    g = np.zeros(n - gram + 1, np.uint64)
    for j in range(gram):
        g = g * np.uint64(0x9E3779B97F4A7C15) + w[j : n - gram + 1 + j]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        g = (g ^ (g >> np.uint64(shift))) * np.uint64(factor)
    g ^= g >> np.uint64(31)
    span, have = length - gram + 1, 1
    low = g
    while have < span:  # the smallest of have neighbours, doubled
        k = min(have, span - have)
        low = np.minimum(low[:-k], low[k:])
        have += k
    head = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1))
    size = np.diff(np.concatenate((head, [len(low)])))
    if size.max() > PIECE:
        head = np.concatenate([np.arange(a, a + s, PIECE) for a, s in zip(head, size, strict=True)])
        size = np.diff(np.concatenate((head, [len(low)])))
    return low[head].view(np.int64), head.astype(np.int32), size.astype(np.int32)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, order, two hashes of the text and its bytes."""
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body"))
    return d.select("doc_id", common.order_key("doc_id").alias("ord"), F.xxhash64("body").alias("h"), F.shiftleft(F.crc32("body"), 31).bitwiseOR(F.octet_length("body").cast("long")).alias("c"), "body")


def _ints(lists: list[np.ndarray], kind) -> pa.ListArray:
    sizes = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(lists) if lists else np.empty(0), kind))


def _sketches(docs: DataFrame, length: int) -> DataFrame:
    """Of each row: its keys, number of words, digest of the whole text and its pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sha, found = [], [], []
            for x in b.column(4):
                words = x.as_py().split()
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                found.append(pieces(words, length))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(4)), pa.array(n, pa.int64()), pa.array(sha, pa.string()), *(_ints([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32())))],
                ["doc_id", "ord", "h", "c", "n_words", "sha", "anchors", "starts", "sizes"],
            )

    return _keyed(docs).mapInArrow(common.trimmed(run, _hashes), "doc_id long, ord long, h long, c long, n_words long, sha string, anchors array<long>, starts array<int>, sizes array<int>")


def _search(length: int):
    """The work of a shard: rows sorted by anchor in, intervals of words and firsts of sub-shards out."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        seen: dict[bytes, int] = {}
        owner: list[int] = []
        which = []
        for _, _, ord_, _, _, body in rows:
            k = seen.setdefault(body, len(seen))
            if k == len(owner):
                owner.append(ord_)
            elif ord_ < owner[k]:
                owner[k] = ord_
            which.append(k)
        ids: dict[bytes, int] = {}
        split = [body.split() for body in seen]
        coded = [np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words)) for words in split]
        _, least, begin = FMIndex(coded, np.array(owner, np.int64), length).matching_statistics(coded)
        out: list[tuple] = []
        for (_, salted, ord_, h, start, _), k in zip(rows, which, strict=True):
            low = least[begin[k] : begin[k + 1] - length + 1]
            hit = np.flatnonzero((low >= 0) & (low < ord_))
            if len(hit):
                cut = np.flatnonzero(np.diff(hit) > length) + 1
                for run in np.split(hit, cut) if len(cut) else [hit]:
                    out.append((ord_, h, start + int(run[0]), start + int(run[-1]) + length, None))
            if salted:
                for p in np.flatnonzero(low == ord_).tolist():
                    out.append((ord_, h, start + p, start + p + length, xxhash.xxh128_digest(b" ".join(split[k][p : p + length]))))
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["ord", "h", "lo", "hi", "digest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        words, last = 0, None
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if row[0] != last and words >= BLOCK_WORDS:
                    yield solve(rows)
                    rows, words = [], 0
                last = row[0]
                rows.append(row)
                words += row[5].count(b" ") + 1
        if rows:
            yield solve(rows)

    return run


def _cut(length: int):
    """Cuts the pieces out of the texts that have pieces of shared anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            size = 0
            for ord_, h, body, found in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                words = body.split()
                for f in found:
                    piece = b" ".join(words[f["start"] : f["start"] + f["size"] + length - 1])
                    out.append((f["anchor"], f["salts"], ord_, h, f["start"], piece))
                    size += len(piece)
                if size > 1 << 24:
                    yield _pieces(out)
                    out, size = [], 0
            if out:
                yield _pieces(out)

    return run


def _pieces(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], ["anchor", "salts", "ord", "h", "start", "piece"])


def repeats(docs: DataFrame, length: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What to remove from docs(doc_id, text): (sketches, copies, spans).

    sketches: one row per document (doc_id, ord, h, n_words, sha, ...); copies: (ord, h) of documents
    whose whole text has a smaller doc_id; spans: (ord, h, spans array<struct<lo,hi>>) of
    documents that share passages, as half-open, possibly overlapping ranges of words."""
    spark = docs.sparkSession
    sketch = common.materialise(_sketches(docs, length), "sketches")
    # written, so that both sides of the join are plain exchanges and a text of very many copies is split
    heads = common.materialise(sketch.groupBy("h", "c").agg(F.min("ord").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "heads")
    copies = common.materialise(sketch.select("ord", "h", "c").join(heads, ["h", "c"]).where("first < ord").select("ord", "h").distinct(), "copies")
    runs = sketch.where(F.size("anchors") > 0).select("ord", "h", "anchors", "starts", "sizes").join(copies, ["ord", "h"], "left_anti")
    runs = runs.select("ord", "h", F.explode(F.arrays_zip("anchors", "starts", "sizes")).alias("r")).select("ord", "h", F.col("r.anchors").alias("anchor"), F.col("r.starts").alias("start"), F.col("r.sizes").alias("size"))
    shared = runs.groupBy("anchor").agg(F.min("h").alias("least"), F.max("h").alias("most"), F.count("*").alias("n")).where("least < most").select("anchor", F.ceil(F.col("n") / HOT).cast("int").alias("salts"))
    found = runs.join(shared, "anchor").groupBy("ord", "h").agg(F.collect_list(F.struct("start", "size", "anchor", "salts")).alias("found"))
    texts = _keyed(docs).select("ord", "h", "body").join(found, ["ord", "h"]).mapInArrow(common.trimmed(_cut(length)), "anchor long, salts int, ord long, h long, start int, piece binary")
    shard = F.xxhash64("anchor", F.pmod(F.xxhash64("ord", F.lit(1)), F.col("salts").cast("long")))
    dealt = texts.select(shard.alias("shard"), (F.col("salts") > 1).alias("salted"), "ord", "h", "start", "piece")
    dealt = dealt.repartition(common.partitions(spark), "shard").sortWithinPartitions("shard")
    hits = common.materialise(dealt.mapInArrow(common.trimmed(_search(length)), "ord long, h long, lo int, hi int, digest binary"), "hits")
    firsts = hits.where("digest is not null")
    lowest = firsts.groupBy("digest").agg(F.min("ord").alias("lowest"))
    later = firsts.join(lowest, "digest").where("lowest < ord").select("ord", "h", "lo", "hi")
    spans = hits.where("digest is null").select("ord", "h", "lo", "hi").union(later).groupBy("ord", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return sketch, copies, spans


def _mask(n: int, spans) -> np.ndarray:
    mask = np.zeros(n, bool)
    for s in spans:
        mask[s["lo"] : s["hi"]] = True
    return mask


def removals(docs: DataFrame, length: int = 50) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256) for every row of docs(doc_id, text).

    Words are runs without ASCII white space. A word goes if a window that covers it also starts in a
    document with a smaller doc_id; windows are judged on the input. A null text has no words; a
    null doc_id counts as larger than all others, and one null is not smaller than another. Rows
    with one doc_id never remove from each other. Repeated rows stay and give equal results; an empty
    table gives an empty result; other columns are ignored."""
    sketch, copies, spans = repeats(docs, length)
    spans = common.materialise(spans, "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut, sha = [], []
            for body, found in zip(b.column(2), b.column(3), strict=True):
                words = body.as_py().split()
                mask = _mask(len(words), found.as_py())
                cut.append(int(mask.sum()))
                sha.append(hashlib.sha256(b" ".join([w for w, m in zip(words, mask.tolist(), strict=True) if not m])).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cut, pa.int64()), pa.array(sha, pa.string())], ["ord", "h", "cut", "left"])

    changed = _keyed(docs).select("ord", "h", "body").join(spans, ["ord", "h"]).mapInArrow(common.trimmed(run), "ord long, h long, cut long, left string")
    changed = changed.groupBy("ord", "h").agg(F.min("cut").alias("cut"), F.min("left").alias("left"))
    gone = copies.withColumn("gone", F.lit(True))
    out = sketch.select("doc_id", "ord", "h", "n_words", "sha").join(changed, ["ord", "h"], "left").join(gone, ["ord", "h"], "left")
    whole = F.col("gone").isNotNull() & (F.col("n_words") >= length)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("doc_id", "n_words", F.when(whole, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).cast("long").alias("n_removed"), F.when(whole, empty).otherwise(F.coalesce("left", "sha")).alias("kept_sha256"))


def without_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """docs with the repeated words cut out of ``text``; all columns stay.

    Texts without repeats stay as they are; cut words take the white space after them along. A
    document that loses every word goes; null and empty texts stay. See ``removals`` for nulls and ties."""

    def marked() -> DataFrame:
        _, copies, spans = repeats(docs, length)
        return spans.unionByName(copies.select("ord", "h", F.array(F.struct(F.lit(0).alias("lo"), F.lit(2**31 - 1).alias("hi"))).alias("spans")))

    spans = common.written(docs.sparkSession, marked, "spans")

    @F.arrow_udf("string")
    def cut(bodies, found):
        common.only()
        out = []
        for body, s in zip(bodies.to_pylist(), found.to_pylist(), strict=True):
            if s is None or not len(s):
                out.append(body)
                continue
            raw = body.encode()
            at = [m.start() for m in _WORDS.finditer(raw)] + [len(raw)]
            whole = s[0]["hi"] == 2**31 - 1
            mask = _mask(len(at) - 1, s) if not whole else np.full(len(at) - 1, len(at) > length)
            kept = b"".join(raw[at[i] : at[i + 1]] for i in np.flatnonzero(~mask).tolist())
            out.append(None if mask.any() and mask.all() else kept.decode() if mask.any() else body)
        made = pa.array(out, pa.string())
        common.trim()
        return made

    ord_, h, found, new = (common.unused(docs, x) for x in ("ord", "h", "spans", "new"))
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumns({ord_: common.order_key("doc_id"), h: F.xxhash64(body.cast("binary"))})
    both = keyed.join(spans.withColumnsRenamed({"ord": ord_, "h": h, "spans": found}), [ord_, h], "left")
    changed = both.withColumn(new, F.when(F.col(found).isNotNull() & F.col("text").isNotNull(), cut(body, F.col(found))).otherwise(F.col("text")))
    kept = changed.where(F.col(found).isNull() | F.col("text").isNull() | F.col(new).isNotNull())
    return kept.withColumn("text", F.col(new)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_substrings(spark, sf_dir: str) -> DataFrame:
    """Words of passages of 50 words that a document with a smaller doc_id has too, removed from every document."""
    return removals(spark.read.parquet(f"{sf_dir}/documents.parquet"))
