"""Lexical search: an inverted index as a table and BM25 as expressions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

K1, B = 1.2, 0.75
#: Characters of phrases looked for in one pass, and postings of one Arrow batch, about.
BLOCK, ROWS = 1 << 22, 50_000
_WORD = re.compile(r"[^\W_]+")


_ENDINGS = sorted(T.ENDINGS, key=len, reverse=True)


def _stem(token: str) -> str:
    return next((token[: -len(e)] for e in _ENDINGS if token.endswith(e) and len(token) >= len(e) + 4), token)


def postings(docs: DataFrame, key: str, text: str = "text", stemmed: bool = False) -> DataFrame:
    """(token, key, tf, dl): an index to be stored; counted within each text, so no occurrence is shuffled.

    With ``stemmed`` tokens are folded (ё as е) and lose their endings, for texts and queries alike."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, str] = {}
        for b in batches:
            at, token, tf, dl = [], [], [], []
            for i in range(b.num_rows):
                words = _WORD.findall((b.column(1)[i].as_py() or "").lower())
                if stemmed:
                    if len(seen) > 200_000:
                        seen.clear()
                    words = [seen.get(w) or seen.setdefault(w, _stem(w.replace("ё", "е"))) for w in words]
                counts = Counter(words)
                at += [i] * len(counts)
                token += counts
                tf += counts.values()
                dl += [len(words)] * len(counts)
                if len(at) >= ROWS or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(token, pa.string()), b.column(0).take(pa.array(at, pa.int64())), pa.array(tf, pa.int64()), pa.array(dl, pa.int64())], ["token", key, "tf", "dl"])
                    at, token, tf, dl = [], [], [], []

    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"token string, {key} {kind}, tf long, dl long")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row (n, mean): how many texts there are and their mean number of tokens; stored beside the postings."""
    return docs.agg(F.count("*").alias("n"), F.avg(F.size(F.regexp_extract_all(F.lower(F.col(text)), F.lit(T.WORD), F.lit(0)))).alias("mean"))


def bm25_from(index: DataFrame, stats: DataFrame, key: str, query: list[str], stemmed: bool = False) -> DataFrame:
    """(key, score) from stored postings: only those of the query's tokens are read, whatever the size of the texts."""
    q = list(dict.fromkeys(_stem(w.lower().replace("ё", "е")) if stemmed else w.lower() for w in query))
    own = index.where(F.col("token").isin(q))
    df = own.groupBy("token").agg(F.count("*").alias("df"))  # as many rows as the query has tokens
    both = own.join(F.broadcast(df), "token").join(F.broadcast(stats))  # stats: one row
    part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    return both.groupBy(key).agg(F.sum(part).alias("score"))


def document_frequency(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(token, df, first): in how many texts each token occurs, and the smallest key among them; distinct tokens of a text only are shuffled."""
    words = docs.select(key, F.explode(T.terms(F.col(text))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("df"), F.min(key).alias("first"))


def substring_hits(docs: DataFrame, key: str, phrase: str, text: str = "text") -> DataFrame:
    """(key, k, start_char, end_char): all places of a phrase that don't overlap, whatever the case; lengths of the parts between give the offsets."""
    parts = docs.select(key, F.split(F.lower(F.col(text)), F.lit(re.escape(phrase.lower())), -1).alias("l"))
    p = parts.select(key, (F.size("l") - 1).alias("n"), F.posexplode("l").alias("k", "t")).select(key, "n", "k", F.length("t").alias("c"))
    start = F.sum("c").over(Window.partitionBy(key).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)) + len(phrase) * F.col("k")
    return p.select(key, "k", "n", start.cast("long").alias("start_char")).where("k < n").select(key, "k", "start_char", (F.col("start_char") + len(phrase)).alias("end_char"))


def containing(docs: DataFrame, key: str, phrases: DataFrame, phrase_key: str, phrase: str, text: str = "text") -> DataFrame:
    """(key, phrase_key, start): texts that hold a phrase exactly, with its first place in code points.

    All phrases of a block are looked for at once, in one pass over the texts, by an automaton; a block holds about BLOCK characters,
    and further blocks are further passes. The driver passes the phrases, which are the query, through block by block."""
    kinds = dict(docs.dtypes)[key], dict(phrases.dtypes)[phrase_key]
    out = None
    for block in _blocks(phrases.select(phrase_key, F.col(phrase).cast("string"))):
        made = docs.sparkSession.sparkContext.broadcast(block)  # bounded by BLOCK and one phrase

        def run(batches: Iterator[pa.RecordBatch], made=made) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            same: dict[str, list] = {}
            for i, p in made.value:
                if p:
                    same.setdefault(p, []).append(i)
            automaton = ahocorasick.Automaton()
            for p in same:
                automaton.add_word(p, p)
            if same:
                automaton.make_automaton()
            for b in batches:
                rows: list[tuple] = []
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    first: dict[str, int] = {}
                    for end, p in automaton.iter(t) if same and t else ():
                        first.setdefault(p, end - len(p) + 1)
                    rows += [(k, i, at) for p, at in first.items() for i in same[p]]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.schema.field(0).type), pa.array([r[1] for r in rows]).cast(made_type), pa.array([r[2] for r in rows], pa.int32())], [key, phrase_key, "start"])

        made_type = pa.int64() if kinds[1] in ("bigint", "int") else pa.string()
        found = docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"{key} {kinds[0]}, {phrase_key} {'bigint' if made_type == pa.int64() else 'string'}, start int")
        out = found if out is None else out.union(found)
    return out


def _blocks(rows: DataFrame) -> Iterator[list[tuple]]:
    block, chars, none = [], 0, True
    for r in rows.toLocalIterator():
        block.append(tuple(r))
        chars += len(r[1] or "")
        if chars >= BLOCK:
            yield block
            block, chars, none = [], 0, False
    if block or none:
        yield block


def _count(token: str):
    """How often a token occurs in the array column w; never null, so that no filter is inferred from it."""
    return F.coalesce(F.size(F.filter("w", lambda x: x == F.lit(token))), F.lit(0))


def bm25(docs: DataFrame, key: str, query: list[str], text: str = "text") -> DataFrame:
    """(key, score) of the texts that hold any of the query's tokens.

    The query's tokens are few, so only their postings are made: frequencies are counted in the scan and
    no text is exploded or shuffled. A few numbers for each text are dealt once and read twice, for the statistics
    and the scores, so that texts are cut into tokens once."""
    if not query:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(T.WORD), F.lit(0))
    q = list(dict.fromkeys(query))
    rows = docs.select(key, words.alias("w")).select(key, F.size("w").alias("dl"), *[_count(t).alias(f"tf{i}") for i, t in enumerate(q)]).repartition(F.col(key))
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("mean"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(q))])
    # one row of statistics; the condition names it, so that it isn't pushed below the exchange that both sides read
    both = rows.join(F.broadcast(stats)).where(sum((F.col(f"tf{i}") for i in range(1, len(q))), F.col("tf0")) * F.col("n") > 0)
    part = lambda i: F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    return both.select(key, sum((part(i) for i in range(1, len(q))), part(0)).alias("score"))


def top(scored: DataFrame, key: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(the best ``limit`` rows by score and key, one row that says whether there were more)."""
    probe = scored.orderBy(F.desc("score"), key).limit(limit + 1)
    return probe.orderBy(F.desc("score"), key).limit(limit), probe.agg((F.count("*") > limit).alias("truncated"))
