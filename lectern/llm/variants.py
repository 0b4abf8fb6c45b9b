"""Spelling variants: words at one edit, found with forward and backward minimal acyclic automata.

Two words that differ by one inserted, deleted or replaced code point agree in one half of the shorter one: in the first, or in the
last. Words are therefore dealt by their halves. A task builds automata of the words of many halves: forward ones that read a
word from its start, where first halves agree, backward ones that read it from its end. The automata are minimal and number their
words by counts of what lies before an edge (perfect hashing), so that a number leads to a word and its frequency. A query follows its half
exactly, then completes the word with one error, and numbers found twice count once. A pair belongs to the half in which its common
beginning ends, so both directions together report it once.

Halves that very many words share are cut again: the words agree in that half and in one half of the rest, and so on until a group is small
enough; with a single open place a group has at most some thousands of words. No group is left out or cut short.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common

#: Runs of letters, and the prime by which runs lose a code point.
RUN, PRIME = re.compile("[A-Za-zÀ-ÿ]+"), 199
#: Characters of a text that are cut into runs at a time, and distinct words that a task counts before it hands them on.
PIECE, COUNTED = 1 << 20, 250_000
#: Words that one automaton holds, about, and the most that share one group; more are cut again.
BLOCK, GROUP = 5_000, 20_000


def runs(doc_id: int | None, body: bytes, least: int) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of a text's runs of ``least`` code points or more, in pieces; a word may come more than once."""
    text, base = body.lower().decode("utf-8", "replace"), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if (m := RUN.match(text, end)) and RUN.match(text, end - 1):
            end = m.end()  # the run that the piece ends in
        for word, n in Counter(RUN.findall(text, at, end)).items():
            if len(word) < least:
                continue
            h = zlib.crc32(word.encode(), base)
            if h % PRIME == 0:
                cut = h % len(word)
                word = word[:cut] + word[cut + 1 :]
                if len(word) < least:
                    continue
            yield word, n
        at = end


def words(docs: DataFrame, length: int = 6, occurrences: int = 5) -> DataFrame:
    """Rows (word, n) of the words of docs(doc_id, text) that are long and frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, int] = {}
        out = lambda: pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])
        for b in batches:
            for doc_id, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for word, n in runs(doc_id, body.as_py() or b"", length):
                    found[word] = found.get(word, 0) + n
                if len(found) >= COUNTED:
                    yield out()
                    found.clear()
        if found:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    counts = rows.mapInArrow(common.trimmed(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= occurrences)


class Automaton:
    """Minimal acyclic automaton of sorted distinct words; a word's number is its place among them.

    ``edges[state][letter]`` is the next state and how many words of the state come before those through that edge."""

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        count: list[int] = []
        known: dict[tuple, int] = {}
        path: list[list] = [[False, []]]  # [ends a word, edges] of each state that may still grow
        last = ""

        def settle(final: bool, edges: list) -> int:
            key = (final, tuple(edges))
            state = known.get(key)
            if state is None:
                state = known[key] = len(self.edges)
                total, out = int(final), {}
                for letter, to in edges:
                    out[letter] = (to, total)
                    total += count[to]
                self.edges.append(out)
                self.final.append(final)
                count.append(total)
            return state

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                state = settle(*path.pop())
                path[-1][1].append((last[len(path) - 1], state))

        for word in words:
            depth = shared(last, word)
            close(depth)
            path.extend([False, []] for _ in word[depth:])
            path[-1][0] = True
            last = word
        close(0)
        self.start = settle(*path[0])
        self.size = count[self.start]

    def follow(self, state: int, number: int, letters: str) -> int:
        """Number of the word that ends after these letters from a state; -1 if there is none."""
        for letter in letters:
            step = self.edges[state].get(letter)
            if step is None:
                return -1
            state = step[0]
            number += step[1]
        return number if self.final[state] else -1

    def near(self, word: str, low: int, high: int) -> set[int]:
        """Numbers of the words that ``word`` becomes when the code point at a place in low..high-1 is replaced, or one is inserted before a place in low..high."""
        state, number, found = self.start, 0, set()
        for letter in word[:low]:
            step = self.edges[state].get(letter)
            if step is None:
                return found
            state, number = step[0], number + step[1]
        for at in range(low, high + 1):
            own, rest = word[at : at + 1], word[at + 1 :]
            for letter, (to, before) in self.edges[state].items():
                if letter != own and at < high:
                    found.add(self.follow(to, number + before, rest))
                found.add(self.follow(to, number + before, own + rest))
            step = self.edges[state].get(own)
            if step is None:
                break
            state, number = step[0], number + step[1]
        found.discard(-1)
        return found


def shared(a: str, b: str) -> int:
    """Length of the common beginning."""
    for i, (x, y) in enumerate(zip(a, b, strict=False)):
        if x != y:
            return i
    return min(len(a), len(b))


def _matched(rows: list[tuple[str, int, int, int, str, int]]) -> pa.RecordBatch:
    """Near words of a block of whole groups: rows (word, n_near, best_n, best), of which a word may have several.

    rows: (direction, m, low, high, word, n); a word of m code points asks for those that differ where its places low..high-1 are."""
    back = rows[0][0] == "b"
    n_of = {r[4]: r[5] for r in rows}
    order = sorted(w[::-1] for w in n_of) if back else sorted(n_of)
    machine = Automaton(order)
    out: list[tuple[str, int, int, str]] = []
    for _, m, low, high, word, n in rows:
        if len(word) != m:
            continue
        places = machine.near(word[::-1], m - high, m - low) if back else machine.near(word, low, high)
        count, best = 0, (0, "")
        for number in places:
            other = order[number][::-1] if back else order[number]
            at = shared(word, other)
            if not (low <= at < high or at == high == m):
                continue  # reported by another part of the word
            count, best = count + 1, min(best, (-n_of[other], other))
            if len(other) > m:
                out.append((other, 1, n, word))
        if count:
            out.append((word, count, -best[0], best[1]))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "best_n", "best"])


def _keyed(rows: DataFrame) -> DataFrame:
    """rows(word, n, m, low, high) with the key of what must agree: the places before low and from high on, of m."""
    key = F.concat_ws("|", "m", "low", "high", F.concat(F.expr("left(word, low)"), F.expr("right(word, m - high)")))
    # read from the end where more agrees there
    return rows.withColumn("key", F.concat(F.when(F.col("low") < F.col("m") - F.col("high"), "b").otherwise("f"), key))


def near_words(found: DataFrame) -> DataFrame:
    """Rows (word, n_near, best_n, best) for the words of found(word, n) that have near words.

    best is the near word of the largest n (best_n), of equal ones the smallest in code-point order."""
    spark = found.sparkSession

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; whole groups are gathered to blocks of one direction."""
        block: list[tuple] = []
        group: list[tuple] = []
        key = None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] != key:
                    if len(group) > 1:
                        if block and (len(block) >= BLOCK or block[0][0] != group[0][0]):
                            yield _matched(block)
                            block = []
                        block += group
                    key, group = row[0], []
                group.append((row[0][0], *row[1:]))
        if len(group) > 1:
            if block and block[0][0] != group[0][0]:
                yield _matched(block)
                block = []
            block += group
        if block:
            yield _matched(block)

    size = F.char_length("word")
    whole = found.select("word", "n", F.explode(F.array(size, size - 1)).alias("m"))
    least = found.agg(F.min(size)).first()[0] or 0  # no word asks for longer ones than m + 1
    rows = whole.where(F.col("m") >= least).withColumns({"low": F.lit(0), "high": F.col("m")})
    out = None
    while True:
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(F.struct("low", middle.alias("high")), F.struct(middle.alias("low"), "high"))
        rows = _keyed(rows.select("word", "n", "m", F.explode(halves).alias("part")).select("word", "n", "m", "part.low", "part.high"))
        rows = common.materialise(rows, "halves")
        crowd = common.materialise(rows.groupBy("key").agg(F.count("*").alias("many"), F.max(F.col("high") - F.col("low")).alias("open")).where((F.col("many") > GROUP) & (F.col("open") > 1)).select("key"), "crowd")
        more = bool(crowd.head(1))
        few = rows.join(crowd, "key", "left_anti") if more else rows
        dealt = few.select("key", "m", "low", "high", "word", "n").repartition(common.partitions(spark), "key").sortWithinPartitions("key")
        made = common.materialise(dealt.mapInArrow(common.trimmed(match), "word string, n_near long, best_n long, best string"), "near")
        out = made if out is None else out.union(made)
        if not more:
            break
        rows = rows.join(crowd, "key", "left_semi").select("word", "n", "m", "low", "high")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return out.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), "b.best")


def roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) of forms(word, form): the end of each chain of forms. Jumps double, so few rounds do; forms must not go in circles."""
    now = common.materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        above = now.select(F.col("word").alias("root"), F.col("root").alias("above"))
        new = common.materialise(now.join(above, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        common.drop(now)
        now = new.drop("moved")
        if not new.where("moved").head(1):
            return now


def variants(docs: DataFrame, length: int = 6, occurrences: int = 5, times: int = 5) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) for every word of docs(doc_id, text).

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF of whole texts with A-Z lower-cased; where 199 divides the crc32 of
    ``doc_id:run``, the run loses the code point at crc32 % its length. Words have ``length`` code points and ``occurrences`` occurrences (n)
    at least. Near words differ by exactly one inserted, deleted or replaced code point. form is the near word of the largest n, of equal ones the
    smallest in code-point order, if that n is ``times`` as large as the word's; root is the last word on the way of forms. Null texts have no
    words; a null doc_id is written as nothing before the colon; repeated rows count each; an empty table gives an empty result; other columns are ignored."""
    found = common.materialise(words(docs, length, occurrences), "words")
    near = common.materialise(near_words(found), "best")
    known = found.join(near, "word", "left")
    takes = F.col("best_n") >= times * F.col("n")
    known = common.materialise(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best")).alias("form"), F.when(takes, F.col("best_n")).alias("form_n")), "known")
    ends = roots(known.where("form is not null"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_variants(spark, sf_dir: str) -> DataFrame:
    """Spelling variants of all words of the documents."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: DuckDB SQL of op13_variants; crc32 byte by byte over a table of its 256 steps.
ORACLE = r"""with recursive steps as (
  select i, 0 k, i::bigint c from range(256) x(i) union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from steps where k < 8),
crc as materialized (select list(c order by i) tab from steps where k = 8),
found as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') run from documents),
counted as (select doc_id, run, count(*) n from found group by all),
hashed as (select run, n, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''),
  lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195::bigint, unicode(c)::bigint - 64] end))), lambda a, b: xor(tab[1 + (xor(a, b) & 255)], a >> 8)), 4294967295) h from counted, crc),
cut as (select n, case when h % 199 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end word from hashed),
words as materialized (select word, sum(n)::bigint n from cut group by word having length(word) >= 6 and sum(n) >= 5),
dels as materialized (select word, n, i, left(word, i::int) || substr(word, i::int + 2) d from (select word, n, unnest(range(length(word))) i from words)),
pairs as (select a.word, b.word near, b.n m from dels a join dels b on a.i = b.i and a.d = b.d and a.word <> b.word
  union select a.word, b.word, b.n from dels a join words b on a.d = b.word union select b.word, a.word, a.n from dels a join words b on a.d = b.word),
best as (select word, count(*) n_near, min({'less': -m, 'near': near}) b from pairs group by word),
known as materialized (select words.word, n, coalesce(n_near, 0) n_near, case when -b.less >= 5 * n then b.near end form, case when -b.less >= 5 * n then -b.less end form_n from words left join best on best.word = words.word),
chain as (select word, form root from known where form is not null union select chain.word, known.form from chain join known on known.word = chain.root where known.form is not null),
ends as (select chain.word, root from chain join known on known.word = chain.root where known.form is null)
select known.word, form, coalesce(root, known.word) root, n, n_near, form_n from known left join ends on ends.word = known.word"""
