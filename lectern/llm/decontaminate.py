"""Benchmark decontamination by the q-gram lemma in diagonal bands.

Texts and benchmark items are reduced to lower-case letters and digits with single spaces. If an item
of m characters occurs in a text with at most k edits, it shares at least m - q + 1 - k q of
its q-grams with the text there, on diagonals (place in the text less place in the item) at most k apart.
Shared q-grams are counted in bands of BAND diagonals that overlap by k, so that some band has
them all; bands below the bound are dropped, the rest are verified by banded alignment. An item takes the longest q of QS that
leaves it a bound of LEAST shared grams at its full budget, or else the last one, so short items have the same rate of edits as long ones. The items are
the stated query set: they are indexed in blocks of bounded size and every text is read whole
against every block; no text is shuffled.

Very long texts are read in windows of their reduced form. Windows overlap by the longest possible occurrence and begin
at multiples of BAND, so that the bands, and with them the result, are those of the text in one piece. Shared q-grams are
expanded and counted in slices of at most PAIRS, whatever repeats in text and items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common

#: Items of fewer characters match as whole words only.
Q = 9
#: Lengths of grams; at a rate of edits of 0.1 the last leaves every item of Q characters a bound of one gram or more.
QS = (8, 6, 4)
BAND = 64
#: Edits allowed, as a part of an item's characters.
RATE = 0.1
#: q-grams that an item should share at least.
LEAST = 8
#: Characters of items in one block, and of texts handled at once.
BLOCK_CHARS, TEXT_CHARS = 1 << 21, 1 << 20
#: Pairs of equal q-grams expanded at once, and numbers in one array of an alignment.
PAIRS, CELLS = 1 << 21, 1 << 22
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


def _letters() -> np.ndarray:
    """For each code point of the basic plane: its lower case if that is one letter or digit, else a space."""
    table = np.full(0x10000, 32, np.uint32)
    for c in range(0x10000):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        if ch.isalnum():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else c
    return table


_table: np.ndarray | None = None


def _letter(c: int) -> int:
    """What ``_letters`` says, for any code point."""
    ch = chr(c)
    if not ch.isalnum():
        return 32
    low = ch.lower()
    return ord(low) if len(low) == 1 else c


def _mapped(text: str) -> np.ndarray:
    """Each code point's lower-case letter or digit, or a space."""
    global _table
    if _table is None:
        _table = _letters()
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    m = _table[np.minimum(raw, 0xFFFF)]
    far = np.flatnonzero(raw > 0xFFFF)
    if len(far):
        kinds, which = np.unique(raw[far], return_inverse=True)
        m[far] = np.array([_letter(int(c)) for c in kinds], np.uint32)[which]
    return m


def reduced_parts(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code points, place of each in the text) of the reduced text, in parts; a space may end the last one."""
    after_space = True
    for a in range(0, len(text), TEXT_CHARS):
        m = _mapped(text[a : a + TEXT_CHARS])
        space = m == 32
        keep = ~space
        keep[1:] |= ~space[:-1]
        keep[0] = not (space[0] and after_space)
        after_space = bool(space[-1])
        at = np.flatnonzero(keep)
        yield m[at], at + a


def reduced(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(code points, place of each in the text) of the reduced text."""
    parts = list(reduced_parts(text)) or [(np.empty(0, np.uint32), np.empty(0, np.int64))]
    m, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    return (m[:-1], at[:-1]) if len(m) and m[-1] == 32 else (m, at)


def grams(m: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of the runs of q characters."""
    if len(m) < q:
        return np.empty(0, np.uint64)
    n = len(m) - q + 1
    h, f, width, out, done = m.astype(np.uint64) + np.uint64(1), _FACTOR, 1, None, 0
    while True:  # runs of 1, 2, 4, ... characters, put together to q
        if q & width:
            part = h[done : done + n]
            out = part if out is None else out * f + part
            done += width
        if done == q:
            break
        h = h[:-width] * f + h[width:]
        f = np.uint64(int(f) * int(f) & 0xFFFFFFFFFFFFFFFF)
        width *= 2
    out = out ^ (out >> np.uint64(29))
    return out * np.uint64(0xBF58476D1CE4E5B9)


class _Index:
    """Where the q-grams of some items stand: hashes, sorted, with their items and places."""

    def __init__(self, texts: list[np.ndarray], which: np.ndarray, q: int):
        self.q = q
        h = [grams(texts[k], q) for k in which]
        item = np.repeat(which, [len(x) for x in h])
        place = np.concatenate([np.arange(len(x)) for x in h])
        every = np.concatenate(h)
        order = np.argsort(every, kind="stable")
        self.hash, self.start, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.item, self.place = item[order], place[order]
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[self.hash >> np.uint64(64 - _BITS)] = True


class Items:
    """q-gram index of a block of benchmark items."""

    def __init__(self, rows: list[tuple[int | None, str | None]], rate: float = RATE):
        texts = [reduced(t or "")[0] for _, t in rows]
        self.ids = [i for i, _ in rows]
        self.short = [(k, t) for k, t in enumerate(texts) if 0 < len(t) < Q]
        self.texts = texts
        self.size = np.array([len(t) for t in texts], np.int64)
        self.budget = (rate * self.size + 1e-9).astype(np.int64)
        shared = self.size[:, None] + 1 - np.array(QS) * (1 + self.budget[:, None])
        enough = shared >= LEAST
        self.q = np.where(enough.any(axis=1), enough.argmax(axis=1), len(QS) - 1)
        if len(rows) and (shared[np.arange(len(rows)), self.q] < 1)[self.size >= Q].any():
            raise ValueError("so many edits leave an item no gram that must be shared")
        self.bound = np.maximum(1, shared[np.arange(len(rows)), self.q])
        self.longest = int((self.size + self.budget).max(initial=0))
        long = [np.flatnonzero((self.q == k) & (self.size >= Q)) for k in range(len(QS))]
        self.indexes = [_Index(texts, which, q) for which, q in zip(long, QS, strict=True) if len(which)]

    def candidates(self, m: np.ndarray, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(item, first diagonal of the band) of the bands that meet the bound in a reduced text; items marked in ``skip`` are left out."""
        found = [self._candidates(ix, m, skip) for ix in self.indexes]
        return tuple(np.concatenate([x[i] for x in found] or [np.empty(0, np.int64)]) for i in (0, 1))

    def _candidates(self, ix: _Index, m: np.ndarray, skip: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        h = grams(m, ix.q)
        at = np.flatnonzero(ix.bitmap[h >> np.uint64(64 - _BITS)])
        k = np.minimum(np.searchsorted(ix.hash, h[at]), len(ix.hash) - 1)
        same = ix.hash[k] == h[at]
        at, k = at[same], k[same]
        until = np.cumsum(ix.count[k])
        reach = -(-int(self.budget.max(initial=0)) // BAND)
        live, seen = np.empty(0, np.int64), np.empty(0, np.int64)
        items, bands = [], []
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(until, (until[a - 1] if a else 0) + PAIRS, side="right")))
            key, count = self._counted(ix, at[a:b], k[a:b], skip)
            if len(live):
                key, which = np.unique(np.concatenate((live, key)), return_inverse=True)
                count = np.bincount(which, weights=np.concatenate((seen, count))).astype(np.int64)
            # bands that no later gram can reach are settled
            open_from = (int(at[b]) - self.longest) // BAND - reach if b < len(at) else 1 << 31
            settled = (key & 0xFFFFFFFF) - (1 << 31) < open_from
            good = settled & (count >= self.bound[key >> 32])
            items.append(key[good] >> 32)
            bands.append((key[good] & 0xFFFFFFFF) - (1 << 31))
            live, seen, a = key[~settled], count[~settled], b
        if not items:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        item, band = np.concatenate(items), np.concatenate(bands)
        order = np.lexsort((band, item))
        return item[order], band[order] * BAND

    def _counted(self, ix: _Index, at: np.ndarray, k: np.ndarray, skip: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(item << 32 | band + 2**31, shared grams) of grams ``k`` of the index that stand at ``at`` in a text."""
        n = ix.count[k]
        which = np.repeat(ix.start[k] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        item = ix.item[which]
        diagonal = np.repeat(at, n) - ix.place[which]
        if skip is not None:
            use = ~skip[item]
            item, diagonal = item[use], diagonal[use]
        band = diagonal // BAND
        into = diagonal - band * BAND
        items, places = [item], [band]
        for j in range(-(-int(self.budget[item].max(initial=0)) // BAND)):  # the bands before whose overlap holds it
            reached = into + j * BAND < self.budget[item]
            items.append(item[reached])
            places.append(band[reached] - j - 1)
        item, band = np.concatenate(items), np.concatenate(places) + (1 << 31)
        if len(item) > 4096:
            low, first = int(band.min()), int(item.min())
            span, rows = int(band.max()) - low + 1, int(item.max()) - first + 1
            if span * rows <= 2 * len(item):  # dense: no sort
                count = np.bincount((item - first) * span + band - low, minlength=1)
                found = np.flatnonzero(count)
                return (found // span + first << 32) + found % span + low, count[found]
        return np.unique(item * (1 << 32) + band, return_counts=True)

    def matches(self, m: np.ndarray, skip: np.ndarray | None = None, opens: bool = True, ends: bool = True) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of the best occurrence of each item in a reduced text.

        ``opens`` and ``ends`` tell whether its ends are ends of a text, and so of words."""
        return [(k, *v) for (_, k), v in self.all_matches([(m, opens, ends)], [0], skip).items()]

    def all_matches(self, parts: list[tuple[np.ndarray, bool, bool]], which: list[int], skip: np.ndarray | None = None) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(part, item) -> (start, end, edits) of the best occurrences in the parts ``which``, aligned together."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        found = [self.candidates(parts[p][0], skip) for p in which]
        part = np.repeat(np.array(which, np.int64), [len(x) for x, _ in found])
        item = np.concatenate([x for x, _ in found] or [np.empty(0, np.int64)])
        lo = np.concatenate(([0], np.cumsum([len(p[0]) for p in parts])))
        every = np.concatenate([p[0] for p in parts]) if len(parts) > 1 else parts[0][0]
        first = np.concatenate([x for _, x in found] or [np.empty(0, np.int64)]) + lo[part]
        order = np.argsort(self.size[item], kind="stable")
        part, item, first = part[order], item[order], first[order]
        a = 0
        while a < len(item):
            cells = self.size[item[a : a + 256]] + BAND + 4 * self.budget[item[a : a + 256]] + 1
            b = a + max(1, int(np.searchsorted(cells * np.arange(1, len(cells) + 1), CELLS)))
            for p, k, s, e, d in self._verify(every, part[a:b], item[a:b], first[a:b], lo):
                s, e = s - int(lo[p]), e - int(lo[p])
                if (p, k) not in best or (d, s) < (best[p, k][2], best[p, k][0]):
                    best[p, k] = (s, e, d)
            a = b
        for p in which if self.short else ():
            m, opens, ends = parts[p]
            padded = np.concatenate(([32 if opens else 0], m, [32 if ends else 0])).astype("<u4").tobytes()
            for k, t in self.short:
                if skip is not None and skip[k]:
                    continue
                need = np.concatenate(([32], t, [32])).astype("<u4").tobytes()
                at = padded.find(need)
                while at >= 0 and at % 4:
                    at = padded.find(need, at + 1)
                if at >= 0:
                    best[p, k] = (at // 4, at // 4 + len(t), 0)
        return best

    def _verify(self, m, part, item, first, begin):
        """(part, item, start, end, edits) of the bands within the budget; part p is m[begin[p]:begin[p + 1]]."""
        budget, lo, hi = self.budget[item], begin[part], begin[part + 1]
        most = int(budget.max())
        width = BAND + 3 * most + 1
        base = first - most
        ends, edits = self._align(m, base, [self.texts[k] for k in item], width, np.zeros((len(item), width), np.int32), lo, hi)
        ok = np.flatnonzero(edits <= budget)
        if not len(ok):
            return []
        # from each end backwards, to find the start
        back, n = m[::-1], len(m)
        start = n - ends[ok]
        o = np.arange(2 * most + 1)
        seed = np.broadcast_to(np.where(o >= most, o - most, 1 << 20), (len(ok), len(o))).astype(np.int32)
        begins, _ = self._align(back, start - most, [self.texts[k][::-1] for k in item[ok]], len(o), seed, n - hi[ok], n - lo[ok])
        return [(int(p), int(k), int(n - b), int(e), int(d)) for p, k, b, e, d in zip(part[ok], item[ok], begins, ends[ok], edits[ok], strict=True)]

    @staticmethod
    def _align(m, base, texts, width, seed, lo, hi):
        """Banded edit distance of each text within m[lo:hi]; diagonals base .. base + width. (end in m, edits)."""
        size = np.array([len(t) for t in texts])
        rows = int(size.max())
        at = base[:, None] + np.arange(rows + width)[None, :]
        inside = (at >= lo[:, None]) & (at < hi[:, None])
        region = np.where(inside, m[np.clip(at, 0, max(0, len(m) - 1))], 0)
        pattern = np.full((len(texts), rows), 1, np.int64)
        for i, t in enumerate(texts):
            pattern[i, : len(t)] = t
        ramp = np.arange(width, dtype=np.int32)
        d, last = seed, set(size.tolist())
        end, edits = np.zeros(len(texts), np.int64), np.full(len(texts), 1 << 20)
        for i in range(1, rows + 1):
            new = d + (region[:, i - 1 : i - 1 + width] != pattern[:, i - 1 : i])
            np.minimum(new[:, :-1], d[:, 1:] + 1, out=new[:, :-1])
            d = np.minimum.accumulate(new - ramp, axis=1) + ramp
            if i in last:
                # ends outside the text aren't ends; the padding matches nothing, so none of them is cheaper
                done = np.flatnonzero(size == i)
                o = d[done].argmin(1)
                end[done], edits[done] = np.clip(base[done] + o + i, lo[done], hi[done]), d[done, o]
        return end, edits


def _windows(text: str, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool, bool]]:
    """(reduced part, its places, whether the text begins with it, whether it ends with it) of a text.

    Each part but the first begins with at least ``overlap`` characters of the one before, at a multiple of BAND."""
    m, at, opens = np.empty(0, np.uint32), np.empty(0, np.int64), True
    held = None
    for more, places in reduced_parts(text):
        if held is not None:
            yield held
            step = max(0, (len(m) - overlap) // BAND * BAND)
            m, at, opens = m[step:], at[step:], opens and not step
        m, at = np.concatenate((m, more)), np.concatenate((at, places))
        held = (m, at, opens, False)
    if held is not None:
        yield (*held[:3], True)


_ROWS = "doc_id long, item_id long, start long, end long, edits int, budget int"


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in blocks of about BLOCK_CHARS characters; the driver holds the benchmark, which is the query set, block by block."""
    block, chars, none = [], 0, True
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        block.append((r.item_id, r.text))
        chars += len(r.text or "")
        if chars >= BLOCK_CHARS:
            yield block
            block, chars, none = [], 0, False
    if block or none:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """Rows (doc_id, item_id, start, end, edits, budget) for documents that contain a benchmark item.

    One row for each row of docs(doc_id, text) and item of benchmark(item_id, text): its best
    occurrence, the first on ties, in code points of the text. ``rate`` bounds the edits by the item's reduced
    length. Items without letters or digits match nothing; items shorter than Q characters match as whole
    words only. Null texts match nothing; null ids are passed on; repeated rows and items give
    repeated rows. Empty tables give an empty result; other columns are ignored. Each block of BLOCK_CHARS characters
    of items is one more scan of the documents."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def scan(block: list[tuple[int | None, str | None]]) -> DataFrame:
        made = docs.sparkSession.sparkContext.broadcast(block)  # bounded by BLOCK_CHARS and one item

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(made.value, rate)
            for b in batches:
                ids = b.column(0).to_pylist()
                out = [(ids[t], items.ids[k], s, e, d, int(items.budget[k])) for t, k, s, e, d in _batched(items, b.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "start", "end", "edits", "budget"])

        return texts.mapInArrow(common.trimmed(run), _ROWS)

    out = None
    for block in _blocks(benchmark):
        out = scan(block) if out is None else out.union(scan(block))
    return out


def _batched(items: Items, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of a list of texts; many short ones share the array work."""
    gap = np.zeros(1, np.uint32)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}

    def note(parts, which: list[int], exact: np.ndarray | None = None) -> None:
        for (p, k), (s, e, d) in items.all_matches([(m, opens, ends) for _, m, _, opens, ends in parts], which, exact).items():
            t, where = parts[p][0], parts[p][2]
            at = int(where[min(s, len(where) - 1)])
            found = (d, at, int(where[e - 1]) + 1 if e > s else at)
            if (t, k) not in best or found < best[t, k]:
                best[t, k] = found

    def flush(parts) -> None:
        begin = np.cumsum([0] + [len(p[1]) + 1 for p in parts])
        every = np.concatenate([x for p in parts for x in (p[1], gap)])
        item, first = items.candidates(every)
        # the text that holds the middle of the item in the band; a band may touch two
        lo = np.searchsorted(begin, np.maximum(first, 0), side="right") - 1
        hi = np.searchsorted(begin, np.clip(first + BAND + items.budget[item] + items.size[item], 0, len(every) - 1), side="right") - 1
        todo = {int(x) for a, b in zip(lo, hi, strict=True) for x in range(a, b + 1) if x < len(parts)}
        which = sorted(todo if not items.short else range(len(parts)))
        if which:
            note(parts, which)

    parts, size = [], 0
    for t, text in enumerate(texts):
        exact = np.zeros(len(items.ids), bool)  # items found without edits: nothing later is better
        for m, where, opens, ends in _windows(text or "", items.longest + 2):
            if not len(m):
                continue
            if not (opens and ends):
                note([(t, m, where, opens, ends)], [0], exact)
                exact[[k for k in range(len(items.ids)) if best.get((t, k), (1,))[0] == 0]] = True
                continue
            parts.append((t, m, where, opens, ends))
            size += len(m)
            if size >= TEXT_CHARS:
                flush(parts)
                parts, size = [], 0
    if parts:
        flush(parts)
    for (t, k), (d, s, e) in sorted(best.items()):
        yield t, k, s, e, d


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """docs without the rows that contain a benchmark item; all columns stay, whatever their names.

    Each row is judged by its own text: rows that share an id, or have none, don't touch each other.
    Null and empty texts stay. Blocks of items are taken one after the other in one pass each, without a shuffle."""
    schema = docs.schema
    body = common.unused(docs, "body")

    def scan(left: DataFrame, block: list[tuple[int | None, str | None]]) -> DataFrame:
        made = docs.sparkSession.sparkContext.broadcast(block)  # bounded by BLOCK_CHARS and one item

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(made.value, rate)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[t for t, *_ in _batched(items, b.column(b.num_columns - 1).to_pylist())]] = False
                yield b.select(range(b.num_columns - 1)).filter(pa.array(keep))

        return left.withColumn(body, F.col("text").cast("string")).mapInArrow(common.trimmed(run), schema)

    for block in _blocks(benchmark):
        docs = scan(docs, block)
    return docs


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, with the place and the number of edits."""
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
