"""Packing of tokenised documents into sequences of fixed capacity by linear grouping.

Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the driver; the plan is
made there and its size depends on the capacity, not on the corpus:

1. lengths over a quarter of the capacity are sorted downwards and cut into GROUPS groups of equal cardinality;
   each is rounded up to the largest of its group;
2. configurations of these few sizes are optimised by a linear programme with column generation
   (a knapsack finds the next column) and rounded down;
3. actual lengths take the places of the rounded ones, which frees the room that rounding took;
4. what is left, large first, then all small lengths, goes to the fullest sequence that has room
   (best fit), or to a new one.

Sequences of one make-up form a class with a multiplicity. A row finds its place by its rank among
rows of its length, so nothing is gathered.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import common

CAPACITY = 2048
GROUPS = 96
#: Rows ranked by one task within a length, about.
RANKED = 250


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Letters whose lower case is one letter that no normal form changes, then marks.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+)([.,;:!?]*)\Z")


class _Coder(dict):
    """Ids of words (runs without ASCII white space) as little-endian unsigned 32-bit bytes.

    The tokenizer splits at white space before anything else, so the ids of a text are those of its
    words in turn. Words are looked up. Of an unknown word of Latin letters and closing marks the
    lower-case letters and the marks, which the tokenizer takes apart too, are looked up or coded by its model;
    other unknown words go through the whole tokenizer. Lower-case letters are words themselves, so
    they share the table. Forgets all when it is full."""

    FULL = 250_000

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.codes = [np.array([i], "<u4").tobytes() for i in range(self.tokenizer.get_vocab_size())]
        self.marks: dict[bytes, bytes] = {}
        self.plain = self._is_plain()
        # the byte-level alphabet: printable Latin-1 stands for itself, other bytes for U+0100 and on
        kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        rest = iter(range(256, 512))
        self.letters = "".join([chr(b) if b in kept else chr(next(rest)) for b in range(256)])

    def _is_plain(self) -> bool:
        """Whether letters and marks of a word may be coded apart, seen on samples by the whole tokenizer."""
        whole = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        return all(whole(a + b) == whole(a.lower()) + whole(b) for a in ("The", "Élan", "xqzt", "naïve") for b in (".", ",", "!!", "?!", ":;"))

    def _coded(self, text: str) -> bytes:
        """Ids of lower-case letters or of marks in the byte-level alphabet, by the tokenizer's model."""
        found, code = self.tokenize(text), self.codes
        return code[found[0].id] if len(found) == 1 else b"".join([code[t.id] for t in found])

    def _mark(self, part: bytes) -> bytes:
        ids = self.marks.get(part)
        if ids is None:
            if len(self.marks) > 10_000:
                self.marks.clear()
            ids = self.marks[part] = self._coded(part.decode())
        return ids

    def __missing__(self, word: bytes) -> bytes:
        if not self.plain:
            ids = self._whole(word)
        elif word.isalpha():  # ASCII letters only, as bytes
            low = word.lower()
            ids = self._coded(low.decode()) if low == word else self[low]
        elif word[-1] in b".,;:!?" and word[:-1].isalpha():
            ids = self[word[:-1].lower()] + self._mark(word[-1:])
        elif m := _PLAIN.match(word.decode()):
            low = m[1].lower().encode()
            ids = self._coded(low.decode("latin-1").translate(self.letters)) if low == word else self[low]
            if m[2]:
                ids += self._mark(m[2].encode())
        else:
            ids = self._whole(word)
        self[word] = ids
        return ids

    def _whole(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, bodies: list[bytes]) -> Iterator[bytes]:
        """Ids of each text, without an end mark."""
        for body in bodies:
            words, ids = body.split(), []
            for a in range(0, len(words), 100_000):  # a very long text doesn't overfill the table
                if len(self) > self.FULL:
                    self.clear()
                ids.append(b"".join(map(self.__getitem__, words[a : a + 100_000])))
            yield b"".join(ids)


_coders: dict[str, _Coder] = {}


def _shared() -> dict[str, _Coder]:
    """The coders of this process."""
    return _coders


def _coder(path: str) -> _Coder:
    """This process's coder; it is made once and serves one task after another."""
    if path not in _coders:
        _coders[path] = _Coder(path)
    return _coders[path]


def token_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]) of docs(doc_id, text); null texts count as empty.

    ids are little-endian unsigned 32-bit numbers in a binary column, which is what ids_crc32 is of.
    A document is its ids and ``end_id``; only longer ones than ``capacity`` are cut."""
    path = vocabulary or _vocabulary()
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for b in batches:
            at = 0
            sizes = np.cumsum([len(x.as_py() or b"") for x in b.column(1)])
            while at < b.num_rows:  # about 1 MB of text at a time
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + (1 << 20))))
                part = b.slice(at, to - at)
                at = to
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), coder.encode([x or b"" for x in part.column(1).to_pylist()]), strict=True):
                    ids += end
                    for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[a : a + 4 * capacity]
                        rows.append((doc, k, a // 4, len(piece) // 4, zlib.crc32(piece), *([piece] if keep_ids else [])))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("body")).mapInArrow(common.trimmed(run, _shared), schema)


def _knapsack(sizes: list[int], value: np.ndarray, most: list[int], capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes (each at most ``most`` times) within the capacity."""
    best = np.zeros(capacity + 1)
    steps = []
    for s, v, m in zip(sizes, value, most, strict=True):
        if v <= 1e-12:
            steps.append(None)
            continue
        taken = np.zeros(capacity + 1, np.int16)
        now = best.copy()
        for k in range(1, min(m, capacity // s) + 1):
            other = best[: capacity + 1 - k * s] + k * v
            better = other > now[k * s :] + 1e-12
            now[k * s :][better] = other[better]
            taken[k * s :][better] = k
        best = now
        steps.append(taken)
    at, out = capacity, np.zeros(len(sizes), np.int64)
    for i in range(len(sizes) - 1, -1, -1):
        if steps[i] is not None:
            out[i] = steps[i][at]
            at -= int(out[i]) * sizes[i]
    return float(best[capacity]), out


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 3000) -> list[tuple[int, np.ndarray]]:
    """(multiplicity, how many of each size): the linear programme's basic optimum, rounded down."""
    k = len(sizes)
    basis = np.diag([float(min(capacity // s, d)) for s, d in zip(sizes, demand, strict=True)])
    b = np.array(demand, float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        x = inverse @ b
        y = np.ones(k) @ inverse
        value, column = _knapsack(sizes, y, demand, capacity)
        if value <= 1 + 1e-7:
            break
        way = inverse @ column
        up = way > 1e-9
        if not up.any():
            break
        ratio = np.where(up, np.maximum(x, 0) / np.where(up, way, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    x = np.linalg.solve(basis, b)
    return [(int(n), basis[:, j].round().astype(np.int64)) for j, n in enumerate(np.floor(x + 1e-9)) if n > 0]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, list[tuple[int, int]]]]:
    """Classes of sequences: (multiplicity, [(length, count), ...]); the counts of lengths are met exactly."""
    left = Counter({n: c for n, c in histogram.items() if c})
    classes: list[list] = []  # [multiplicity, room, lengths]
    if left[capacity]:
        classes.append([left.pop(capacity), 0, Counter({capacity: 1})])
    large = sorted((n for n in left if n > capacity // 4), reverse=True)
    total = sum(left[n] for n in large)
    if total:
        # equal cardinality: the i-th group ends where i/groups of the large pieces are behind
        parts: list[list[list[int]]] = [[]]
        seen, quota = 0, -(-total // groups)
        for n in large:
            c = left[n]
            while c:
                take = min(c, quota - seen)
                if take:
                    parts[-1].append([n, take])
                c, seen = c - take, seen + take
                if seen == quota:
                    parts.append([])
                    seen = 0
        parts = [p for p in parts if p]
        merged: dict[int, list[list[int]]] = {}  # groups of one size are one
        for p in parts:
            merged.setdefault(p[0][0], []).extend(p)
        sizes = list(merged)
        for times, config in configurations(sizes, [sum(c for _, c in merged[s]) for s in sizes], capacity):
            slots = [s for s, c in zip(sizes, config, strict=True) for _ in range(int(c))]
            while times and slots:
                # as many equal sequences as the current lengths of the slots' groups allow
                need = Counter(slots)
                if any(not merged[s] for s in need):
                    break
                run = times
                lengths: Counter[int] = Counter()
                for s, c in need.items():
                    if merged[s][0][1] >= c:
                        lengths[merged[s][0][0]] += c
                        run = min(run, merged[s][0][1] // c)
                    else:  # a slot group at the change from one length to the next
                        run = 1
                        rest = c
                        for n, have in merged[s]:
                            use = min(rest, have)
                            lengths[n] += use
                            rest -= use
                            if not rest:
                                break
                        if rest:
                            run = 0
                            break
                if not run:
                    break
                for s, c in need.items():
                    rest = c * run
                    while rest:
                        use = min(rest, merged[s][0][1])
                        merged[s][0][1] -= use
                        left[merged[s][0][0]] -= use
                        rest -= use
                        if not merged[s][0][1]:
                            merged[s].pop(0)
                times -= run
                classes.append([run, capacity - sum(n * c for n, c in lengths.items()), lengths])
    # best fit of the rest, the largest first; room -> classes with that room
    rooms: dict[int, list[list]] = {}
    done = []
    for c in classes:
        (rooms.setdefault(c[1], []) if c[1] else done).append(c)
    keys = sorted(rooms)

    def put(c: list) -> None:
        if not c[1]:
            done.append(c)
            return
        if c[1] not in rooms:
            rooms[c[1]] = []
            bisect.insort(keys, c[1])
        rooms[c[1]].append(c)

    for n in sorted((n for n in left if left[n] > 0), reverse=True):
        count = left[n]
        while count:
            i = bisect.bisect_left(keys, n)
            if i == len(keys):
                each = capacity // n
                full, rest = divmod(count, each)
                if full:
                    put([full, capacity - each * n, Counter({n: each})])
                if rest:
                    put([1, capacity - rest * n, Counter({n: rest})])
                break
            room = keys[i]
            c = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                keys.pop(i)
            each = min(room // n, max(1, count))
            times = min(c[0], count // each)
            if times < c[0]:
                put([c[0] - times, room, c[2]])
            put([times, room - each * n, c[2] + Counter({n: each})])
            count -= times * each
    done += [c for cs in rooms.values() for c in cs]
    return [(c[0], sorted(c[2].items(), reverse=True)) for c in done]


def slots(classes: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """The plan as intervals of ranks: rows of ``length`` with rank from ``low`` on sit ``each`` to a sequence
    from ``sequence`` on, the first at ``offset``."""
    rows, used, base = [], Counter(), 0
    for times, lengths in classes:
        at = 0
        for n, c in lengths:
            rows.append((n, used[n], base, c, at))
            used[n] += times * c
            at += n * c
        base += times
    a = np.array(sorted(rows) or np.empty((0, 5)), np.int64).reshape(-1, 5)
    return dict(zip(("length", "low", "sequence", "each", "offset"), a.T, strict=True))


def _fetch(wide: tuple[str, ...], names: list[str]):
    """Adds the columns ``wide`` to rows sorted by (file, index), their last two columns, by reading the files in step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, chunks, held, first = None, None, None, 0
        for b in batches:
            files, index = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_numpy()
            at = 0
            while at < b.num_rows:
                if files[at] != file:
                    file = files[at]
                    fs, path = FileSystem.from_uri(file)
                    chunks, held, first = pq.ParquetFile(fs.open_input_file(path)).iter_batches(256, columns=list(wide), use_threads=False), None, 0
                while held is None or index[at] >= first + held.num_rows:
                    first += held.num_rows if held is not None else 0
                    held = next(chunks)
                to = at + 1
                while to < b.num_rows and files[to] == file and index[to] < first + held.num_rows:
                    to += 1
                part, taken = b.slice(at, to - at), held.take(pa.array(index[at:to] - first))
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], *(taken.column(c) for c in wide)], names)
                at = to

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, wide: tuple[str, ...] = ()) -> DataFrame:
    """pieces (with a column length, 1 to capacity) and their sequence_id and offset.

    Offsets are gapless from 0 in each sequence; ids of sequences are numbers from 0. Rows of one length
    are interchangeable; they are ranked by sub-groups of about RANKED rows, so equal lengths of
    a third of all rows are no single task. Columns named sequence_id or offset are replaced.

    Binary columns named in ``wide``, such as the ids, are never sorted: the rows travel without them and take them from the
    written pieces in the end, file by file; they come last."""
    spark = pieces.sparkSession
    row, salt, rank, at, first, file, index = (common.unused(pieces, x) for x in ("row", "salt", "rank", "at", "before", "file", "index"))
    table = common.materialise(pieces.withColumn(row, F.monotonically_increasing_id()), "pieces")
    if wide:
        table = table.select(*[F.col(f"`{c}`") for c in table.columns if c not in wide], F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(index))
    counts = {r.length: r.n for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    if not counts:
        none = [F.col(f"`{c}`") for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
        return pieces.select(*none, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError("lengths must be 1 to capacity")
    where = spark.sparkContext.broadcast(slots(plan(counts, capacity, groups)))  # bounded by the capacity
    salts = F.create_map(*[x for n, c in sorted(counts.items()) if c > RANKED for x in (F.lit(n), F.lit(-(-c // RANKED)))]) if max(counts.values()) > RANKED else None
    many = F.coalesce(F.try_element_at(salts, F.col("length")), F.lit(1)) if salts is not None else F.lit(1)
    salted = table.withColumn(salt, F.pmod(F.xxhash64(row), many.cast("long")))
    before = salted.groupBy("length", salt).count().select("length", salt, (F.sum("count").over(Window.partitionBy("length").orderBy(salt)) - F.col("count")).alias(first))
    ranked = salted.withColumn(rank, F.row_number().over(Window.partitionBy("length", salt).orderBy(row)) - 1)
    ranked = ranked.join(before, ["length", salt]).withColumn(rank, (F.col(rank) + F.col(first)).cast("long"))

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def place(length, rank):
        s, n, r = where.value, length.to_numpy(zero_copy_only=False).astype(np.int64), rank.to_numpy(zero_copy_only=False)
        span = int(max(s["low"].max(), r.max(initial=0))) + 1
        i = np.searchsorted(s["length"] * span + s["low"], n * span + r, side="right") - 1
        k = r - s["low"][i]
        return pa.StructArray.from_arrays([pa.array(s["sequence"][i] + k // s["each"][i]), pa.array(s["offset"][i] + k % s["each"][i] * n)], ["sequence_id", "offset"])

    placed = ranked.withColumn(at, place("length", rank))
    kept = [F.col(f"`{c}`") for c in pieces.columns if c.lower() not in ("sequence_id", "offset") and c not in wide]
    out = placed.select(*kept, F.col(at)["sequence_id"].alias("sequence_id"), F.col(at)["offset"].alias("offset"), *([file, index] if wide else []))
    if not wide:
        return out
    dealt = out.repartition(common.partitions(spark), file).sortWithinPartitions(file, index)
    schema = T.StructType([*out.schema.fields[:-2], *(pieces.schema[c] for c in wide)])
    return dealt.mapInArrow(common.trimmed(_fetch(wide, schema.names), _shared), schema)


def packed(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for docs(doc_id, text).

    Null and empty texts are one piece with the end mark alone. Repeated rows and null ids are packed
    like any others. An empty table gives an empty result; other columns are ignored."""
    return pack(token_pieces(docs, vocabulary, capacity, end_id, keep_ids), capacity, wide=("ids",) * keep_ids)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
