"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into two halves of 32 bits. Fingerprints that differ in at most 4 bits
differ in at most 2 bits in one of the halves. The anchors of a half are the words of the perfect
[31,26] Hamming code times one free bit: every half lies within the covering radius 1 of an anchor.
Each half is replicated to every anchor within radius 1 plus the threshold met from both sides
(2 bits between two halves: 1 from either). Two halves at distance 2 or less have a point at
distance 1 or less from both; its nearest anchor is therefore reached by both, so no link is lost.
A fingerprint goes to at most 34 anchors of 2 x 2^27. Per anchor only a spanning forest of the
links is emitted, never all pairs; equal fingerprints are one vertex from the start.

A copy with a few changed words differs in more bits than anchors can cover (10 of 64 at similarity 0.8, more than 16 at
times). ``similar_links`` therefore finds texts by BANDS bands of BAND_ROWS minhashes of their shingles and
keeps the pairs whose exact Jaccard similarity suffices; at 0.8 a pair shares no band with probability 3e-6.
Bands of more texts than one task should hold are worked in rounds: a few texts that aren't in the band's largest component
yet are compared with all of the band, which is dealt over many tasks, until every text is in that component or was compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import common

SEED = 42
#: Shingles hashed at a time, so that a very long document needs bounded memory.
BLOCK = 1 << 16
#: Bands of minhashes, and minhashes in each.
BANDS, BAND_ROWS = 24, 4
#: Texts, and bytes of their sets of shingles, that one task compares; a band of more is worked in rounds of at most PIVOTS texts.
GROUP, GROUP_BYTES, PIVOTS = 1000, 1 << 26, (64, 1024)
#: Bands looked at together: after the first ones most similar texts are in one component, and bands within one need no look.
ROUNDS = ((0, 4), (4, BANDS))
_MULTIPLY, _ADD = (np.random.default_rng(SEED).integers(1, 1 << 63, (2, BANDS * BAND_ROWS), np.uint64) | np.uint64(1))


def fingerprint(body: bytes, width: int) -> int:
    """Majority of the bits of the XXH64 of all shingles of ``width`` words; 0 without words."""
    words = body.lower().split()
    n = len(words)
    if n == 0:
        return 0
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if n <= width:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: n - width + 1].tolist()
    ends = (ends[width - 1 :] - 1).tolist()
    count = np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)], "<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n - width + 1, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """Rows (doc_id, h, fp) of docs(doc_id, text), one per row; h hashes the text, null and empty texts have fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_py() or b"", width) for x in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "h", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("body"))
    return rows.select("doc_id", F.xxhash64("body").alias("h"), "body").mapInArrow(common.trimmed(run), "doc_id long, h long, fp long")


def _pair_masks() -> np.ndarray:
    """For each syndrome 1..31 the flips of up to two of bits 0..30 that lead to a codeword."""
    return np.array([[1 << (s - 1)] + [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < (i ^ s) and i != s] for s in range(1, 32)], np.uint32)


_MASKS = _pair_masks()


def syndrome(half: np.ndarray) -> np.ndarray:
    """Of the low 31 bits: the exclusive or of the positions (from 1) of the bits set."""
    s = np.zeros(half.shape, np.uint32)
    for j in range(5):
        m = np.uint32(sum(1 << (i - 1) for i in range(1, 32) if i >> j & 1))
        s |= (np.bitwise_count(half & m).astype(np.uint32) & np.uint32(1)) << np.uint32(j)
    return s


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row index, anchor key) of every anchor that the fingerprints are replicated to."""
    rows, keys = [], []
    for side in (0, 1):
        half = (fp >> np.uint64(32 * side)).astype(np.uint32)
        s, tag = syndrome(half), np.uint64(side) << np.uint64(32)
        at = np.flatnonzero(s)
        home = half.copy()
        home[at] ^= _MASKS[s[at] - 1, 0]
        everyone = np.arange(len(fp))
        near = half[at, None] ^ _MASKS[s[at] - 1, 1:]  # the free bit as it is, two flips
        for r, k in ((everyone, home), (everyone, home ^ np.uint32(1 << 31)), (np.repeat(at, near.shape[1]), near.ravel())):
            rows.append(r)
            keys.append(k.astype(np.uint64) | tag)
    return np.concatenate(rows), np.concatenate(keys).view(np.int64)


def forest(fp: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of distinct fingerprints at ``threshold`` or fewer differing bits.

    Each fingerprint reached is compared with those not reached yet, so a dense group takes
    few comparisons and gives at most one link for each member."""
    links, rest = [], fp
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            close = np.bitwise_count(rest ^ x) <= threshold
            if close.any():
                found = rest[close]
                rest = rest[~close]
                links += [(x, y) for y in found]
                queue += list(found)
    return links


def links(fps: DataFrame, threshold: int = 4) -> DataFrame:
    """Links (a, b) that connect the distinct long fingerprints ``fp``; together they have the components of all links."""
    if threshold > 4:
        raise ValueError("the anchors cover up to 4 differing bits")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 8192):
                rows, keys = anchors(fp[at : at + 8192])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[at : at + 8192][rows].view(np.int64))], ["anchor", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; a group that crosses a batch is carried over."""
        kept_k, kept_f = np.empty(0, np.int64), np.empty(0, np.uint64)

        def out(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.diff(k)) + 1
            starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(k)]))
            found: list[tuple[int, int]] = []
            n = ends - starts
            two = starts[n == 2]  # most groups that matter
            close = np.bitwise_count(f[two] ^ f[two + 1]) <= threshold if len(two) else np.empty(0, bool)
            a, b = f[two[close]] if len(two) else np.empty(0, np.uint64), f[two[close] + 1] if len(two) else np.empty(0, np.uint64)
            for i, j in zip(starts[n > 2], ends[n > 2], strict=True):
                found += forest(f[i:j], threshold)
            if found:
                more = np.array(found, np.uint64)
                a, b = np.concatenate((a, more[:, 0])), np.concatenate((b, more[:, 1]))
            pairs = np.unique(np.stack((a.view(np.int64), b.view(np.int64)), 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            k = np.concatenate((kept_k, batch.column(0).to_numpy(zero_copy_only=False)))
            f = np.concatenate((kept_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            if not len(k):
                continue
            cut = int(np.searchsorted(k, k[-1]))
            kept_k, kept_f = k[cut:], f[cut:]
            if cut:
                yield out(k[:cut], f[:cut])
        if len(kept_k):
            yield out(kept_k, kept_f)

    entries = fps.select("fp").repartition(common.partitions(fps.sparkSession)).mapInArrow(common.trimmed(spread), "anchor long, fp long")
    dealt = entries.repartition(common.partitions(fps.sparkSession), "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(common.trimmed(compare), "a long, b long")


def shingles(body: bytes, width: int) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles of ``width`` words; a shorter text is one shingle, one without words has none."""
    words = body.lower().split()
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: max(1, n - width + 1)].tolist()
    ends = (ends[min(width, n) - 1 :] - 1).tolist()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts)))


def bands(found: np.ndarray) -> np.ndarray:
    """Keys of the bands of a set of shingles that isn't empty."""
    low = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        x = found[at : at + 4096, None] * _MULTIPLY + _ADD
        low = np.minimum(low, (x ^ (x >> np.uint64(32))).min(axis=0))
    each = low.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(each[i].tobytes(), i) for i in range(BANDS)], np.uint64).view(np.int64)


def similar_forest(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links (index, index) of a spanning forest of the sets by Jaccard similarity ``least`` or more."""
    found = []
    size = np.array([len(x) for x in sets])
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    rest = np.ones(len(sets), bool)
    for first in range(len(sets)):
        queue = [first] if rest[first] else []
        rest[first] = False
        while queue and rest.any():
            x = queue.pop()
            a, b = np.searchsorted(every, sets[x]), np.searchsorted(every, sets[x], side="right")
            n = b - a
            at = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(sets))
            near = np.flatnonzero(rest & (both >= least * (size + size[x] - both) - 1e-9))
            rest[near] = False
            found += [(x, int(y)) for y in near]
            queue += near.tolist()
    return found


def _against(least: float):
    """A spanning forest of the links between texts (fp, found) and pivots (pfp, pfound) that are similar."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if left.num_rows and right.num_rows:
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in right.column("pfound")]
            size, names = np.array([len(x) for x in sets]), right.column("pfp").to_pylist()
            every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
            order = np.argsort(every, kind="stable")
            every, owner = every[order], owner[order]
            root = list(range(len(sets)))  # of each pivot, by the links so far

            def find(i: int) -> int:
                while root[i] != i:
                    root[i] = i = root[root[i]]
                return i

            for fp, x in zip(left.column("fp").to_pylist(), left.column("found"), strict=True):
                x = np.frombuffer(x.as_py(), np.uint64)
                lo, hi = np.searchsorted(every, x), np.searchsorted(every, x, side="right")
                n = hi - lo
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(sets))
                first = None
                for i in np.flatnonzero(both >= least * (size + len(x) - both) - 1e-9).tolist():
                    if names[i] == fp or (first is not None and find(i) == find(first)):
                        continue
                    a.append(fp)
                    b.append(names[i])
                    if first is None:
                        first = i
                    else:
                        root[find(i)] = find(first)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def crowded_links(entries: DataFrame, known: DataFrame, least: float, pivots_of_a_round: tuple[int, int] | None = None) -> DataFrame:
    """Links (a, b) within the groups of entries(key, fp, found), which are too large for a task, beside the ``known`` ones.

    Together they have the components of all links. Every text outside its group's largest component is
    compared with the whole group, a bounded number a round."""
    sized = entries.select("key", "fp", F.octet_length("found").alias("bytes"))
    parts = common.materialise(sized.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("bytes") / GROUP_BYTES)).cast("int").alias("parts")), "parts")
    roots = common.components(known).select(F.col("node").alias("fp"), "root")
    label = common.materialise(sized.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "label")
    low, high = pivots_of_a_round or PIVOTS
    dealt = common.materialise(entries.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")), "dealt")
    tried, out, many = None, None, low
    while True:
        count = label.groupBy("key", "root").agg(F.count("*").alias("n"))
        main = common.materialise(count.groupBy("key").agg(F.max(F.struct("n", "root")).alias("m")).select("key", F.col("m.root").alias("main")), "main")
        pending = label.join(main, "key").where("root <> main").drop("main")
        if tried is not None:
            pending = pending.join(tried, ["key", "fp"], "left_anti")
        w = Window.partitionBy("key").orderBy(F.xxhash64("fp"), "fp")
        first = pending.withColumn("n", F.row_number().over(w)).where(F.col("n") <= many)
        first = first.withColumn("until", F.sum("bytes").over(w)).where((F.col("n") == 1) | (F.col("until") <= GROUP_BYTES))
        pivots = common.materialise(first.select("key", "fp"), "pivots")
        if not pivots.head(1):
            return out if out is not None else known.limit(0)
        each = entries.join(pivots, ["key", "fp"]).join(parts, "key")
        each = each.select(F.col("key").alias("pkey"), F.col("fp").alias("pfp"), F.col("found").alias("pfound"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("ppart"))
        new = dealt.groupBy("key", "part").cogroup(each.groupBy("pkey", "ppart")).applyInArrow(_against(least), "a long, b long")
        new = common.materialise(new, "new")
        out = new if out is None else out.union(new)
        label = common.materialise(_relabelled(label, new), "label")
        tried = pivots if tried is None else tried.union(pivots)
        many = min(4 * many, high)


def similar_links(docs: DataFrame, own: DataFrame, width: int, least: float, known: DataFrame) -> DataFrame:
    """Links (a, b) of fingerprints in own(h, fp) of texts of docs whose sets of shingles have Jaccard similarity ``least`` or more.

    Spanning forests of the texts that share a band, as in ``links``; equal texts count once. With the links ``known`` (a, b)
    they have the components of all links."""
    spark = docs.sparkSession

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                found = [bands(x) if len(x) else None for x in (shingles(t.as_py() or b"", width) for t in part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], ["h", "keys"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t.as_py() or b"", width).tobytes() for t in part.column(1)], pa.binary())], ["h", "found"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, fp, found) come sorted by key; a group that crosses a batch is carried over."""
        kept: list[tuple[int, int, np.ndarray]] = []

        def out(group: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
            pairs = {(group[i][1], group[j][1]) for i, j in similar_forest([x for _, _, x in group], least)}
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for b in batches:
            for key, fp, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kept and kept[0][0] != key:
                    if len(kept) > 1:
                        yield out(kept)
                    kept = []
                kept.append((key, fp, np.frombuffer(found, np.uint64)))
        if len(kept) > 1:
            yield out(kept)

    texts = docs.select(F.col("text").cast("string").cast("binary").alias("body")).select(F.xxhash64("body").alias("h"), "body")
    names = common.materialise(own.select("h", "fp").dropDuplicates(["h"]), "names")
    made = common.materialise(texts.mapInArrow(common.trimmed(keys), "h long, keys array<long>").where("keys is not null").dropDuplicates(["h"]), "bands")
    roots = common.components(known).select(F.col("node").alias("fp"), "root")
    label = common.materialise(made.select("h").join(names, "h").join(roots, "fp", "left").select("h", "fp", F.coalesce("root", "fp").alias("root")), "label")
    out = None
    for low, high in ROUNDS:
        each = made.select("h", F.posexplode(F.slice("keys", low + 1, high - low)).alias("band", "key")).withColumn("band", F.col("band") + low).join(label.select("h", "root"), "h")
        shared = each.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"), F.sum(F.pmod(F.xxhash64("h"), F.lit(1 << 40))).alias("all"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1")
        # bands with the same texts are looked at once
        once = common.materialise(shared.groupBy("n", "low", "high", "all").agg(F.min(F.struct("band", "key")).alias("k")).select("k.band", "k.key"), "shared")
        members = common.materialise(each.join(once, ["band", "key"]).select("h", F.xxhash64("band", "key").alias("key")), "members")
        # written, so that its join with texts of very many copies can be split
        wanted = common.materialise(members.select("h").distinct(), "wanted")
        whole = common.materialise(texts.join(wanted, "h", "left_semi").mapInArrow(common.trimmed(sets), "h long, found binary").dropDuplicates(["h"]).join(names, "h"), "sets")
        sized = members.join(whole.select("h", F.octet_length("found").alias("bytes")), "h")
        crowd = common.materialise(sized.groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where((F.col("n") > GROUP) | (F.col("bytes") > GROUP_BYTES)).select("key"), "crowd")
        entries = lambda rows, whole=whole: rows.join(whole, "h").select("key", "fp", "found")
        dealt = entries(members.join(crowd, "key", "left_anti")).repartition(common.partitions(spark), "key").sortWithinPartitions("key")
        found = common.materialise(dealt.mapInArrow(common.trimmed(compare), "a long, b long"), "found")
        if crowd.head(1):
            crowded = common.materialise(entries(members.join(crowd, "key", "left_semi")), "crowded")
            so_far = known.union(found) if out is None else known.union(out).union(found)
            found = found.union(crowded_links(crowded, so_far, least))
            common.drop(crowded)
        out = found if out is None else out.union(found)
        if high < BANDS:
            label = common.materialise(_relabelled(label, found), "label")
        common.drop(whole, members, once, wanted)
    return out


def _relabelled(label: DataFrame, links: DataFrame) -> DataFrame:
    """label(fp, root, ...) with roots joined by links (a, b) of fingerprints."""
    home = common.materialise(label.select("fp", "root").distinct(), "home")
    end = lambda n: home.select(F.col("fp").alias(n), F.col("root").alias(f"{n}_root"))
    joined = common.components(links.join(end("a"), "a").join(end("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
    moved = joined.select(F.col("node").alias("root"), F.col("root").alias("to"))
    return label.join(moved, "root", "left").withColumn("root", F.coalesce("to", "root")).select(*label.columns)


def _grouped(docs: DataFrame, width: int, threshold: int, similar: tuple[int, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with their fingerprints, fingerprints with the root and the smallest doc_id of their component).

    With ``similar`` (words of a shingle, similarity) texts that are so similar are linked too."""
    own = common.materialise(fingerprints(docs, width), "fingerprints")
    fps = own.groupBy("fp").agg(F.min(common.order_key("doc_id")).alias("first"))
    found = links(fps, threshold)
    if similar is not None:
        found = common.materialise(found, "found")
        found = found.union(similar_links(docs, own, *similar, found))
    roots = common.components(found)
    named = fps.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = common.materialise(named, "named")
    # written, so that the joins on a component of very many fingerprints and on a fingerprint of very many rows can be split
    lowest = common.materialise(named.groupBy("root").agg(F.min("first").alias("component")), "lowest")
    return own, common.materialise(named.join(lowest, "root").select("fp", "root", "component"), "label")


def near_duplicates(docs: DataFrame, width: int = 4, threshold: int = 4) -> DataFrame:
    """Rows (doc_id, fp, component_id) of docs(doc_id, text), one per row.

    ASCII letters are lower-cased; words are runs without ASCII white space; repeated shingles count.
    Fingerprints link at ``threshold`` or fewer differing bits; component_id is the smallest doc_id
    reachable. Null or empty texts have fingerprint 0, which links like any other. A null doc_id is
    never chosen as component_id unless its component has no other. Repeated rows stay. An empty
    table gives an empty result; other columns are ignored."""
    own, label = _grouped(docs, width, threshold)
    return own.join(label, "fp").select("doc_id", "fp", F.nullif(F.col("component"), F.lit(common.LAST)).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 4, threshold: int = 4, similar: tuple[int, float] | None = None) -> DataFrame:
    """docs with one row of each component of near-duplicates, that of the smallest doc_id; all columns stay.

    ``similar`` = (words of a shingle, similarity) also links texts whose sets of shingles have that Jaccard similarity.

    Of rows with that doc_id the one with the smallest text hash stays, and any one of equal rows. Null and
    empty texts are one component, of which one row stays."""
    o, h = common.unused(docs, "ord"), common.unused(docs, "h")

    def first() -> DataFrame:
        own, label = _grouped(docs, width, threshold, similar)
        # reduced to one row a fingerprint before the join, so that a fingerprint of very many rows is no single task
        least = own.groupBy("fp").agg(F.min(F.struct(common.order_key("doc_id").alias("o"), "h")).alias("c"))
        return least.join(label, "fp").groupBy("root").agg(F.min("c").alias("c")).select(F.col("c.o").alias(o), F.col("c.h").alias(h))

    chosen = common.written(docs.sparkSession, first, "chosen")
    keyed = docs.withColumns({o: common.order_key("doc_id"), h: F.xxhash64(F.col("text").cast("string").cast("binary"))})
    return keyed.join(chosen, [o, h], "left_semi").dropDuplicates([o, h]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document (4-word shingles, 4 bits)."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
