"""Arrow functions for what needs match offsets or a sequential scan; batches of whole texts, no row calls from the JVM."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from difflib import SequenceMatcher
from itertools import accumulate, pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# What ends a sentence in a quoted passage, and in a paragraph that is cut.
_BREAK = re.compile(r"[.!?…]+[»\")\]]*(?=\s|$)|\n")
_END = re.compile(r"[.!?…]+[»\")\]]*\s+")
SPAN = "struct<start_char:int,end_char:int>"
_FOLD = str.maketrans("ёЁ", "еЕ")


def evidence(text: str | None, quote: str | None) -> tuple[int, int] | None:
    """Range of the whole sentences of ``text`` that hold ``quote``, compared word by word; None if it isn't there.

    Case, ё/е and what stands between words don't matter. One word counts from four letters on."""
    words = lambda x: [(m.group().translate(_FOLD).lower(), *m.span()) for m in re.finditer(r"\w+", x or "")]
    wanted, there = [w for w, _, _ in words(quote)], words(text)
    if not wanted or len(wanted) == 1 and len(wanted[0]) < 4:
        return None
    n = len(wanted)
    at = next((i for i, w in enumerate(there) if w[0] == wanted[0] and [x for x, _, _ in there[i : i + n]] == wanted), None)
    if at is None:
        return None
    edges = [0, *(m.end() for m in _BREAK.finditer(text)), len(text)]
    start, end = edges[bisect_right(edges, there[at][1], hi=len(edges) - 1) - 1], edges[bisect_left(edges, there[at + n - 1][2])]
    inner = text[start:end].strip()
    start = text.index(inner, start)
    return start, start + len(inner)


def occurrences(text: str | None, form: str | None) -> list[tuple[int, int]]:
    """Ranges where ``form`` stands as whole words, exactly."""
    if not text or not form:
        return []
    return [m.span() for m in re.finditer(rf"(?<!\w){re.escape(form)}(?!\w)", text)]


def resolve(text: str | None, form: str | None, start: int | None, end: int | None, nth: int | None) -> tuple[int, int] | None:
    """Given offsets if they hold the form; else its nth occurrence (from 1) if there are so many; else its only one; else None."""
    if form and start is not None and end is not None and 0 <= start < end and (text or "")[start:end] == form:
        return start, end
    found = occurrences(text, form)
    if nth is not None and 1 <= nth <= len(found):
        return found[nth - 1]
    return found[0] if len(found) == 1 else None


def split_long(text: str, start: int, end: int, most: int) -> list[tuple[int, int]]:
    """[start, end) in parts of at most ``most``: after a sentence if one ends in time, else after a space, else anywhere."""
    ends = [start + m.end() for m in _END.finditer(text[start:end])]

    def cut(at: int) -> int:
        last = bisect_right(ends, at + most)
        gap = text.rfind(" ", at + 1, at + most)
        return ends[last - 1] if last and ends[last - 1] > at else gap + 1 if gap > at else at + most

    cuts = [start]
    while end - cuts[-1] > most:
        cuts.append(end - len(text[cut(cuts[-1]) : end].lstrip()))
    parts = [(a, a + len(text[a:b].rstrip())) for a, b in pairwise(cuts)]
    return parts + [(cuts[-1], end)] * (cuts[-1] < end)


def chunk_spans(text: str | None, least: int = 400, most: int = 1200) -> list[tuple[int, int]]:
    """Ranges of chunks: trimmed lines, long ones split, glued while shorter than ``least`` and then at most ``most``."""
    if not 0 < least <= most or most < 200:
        raise ValueError("0 < least <= most and most >= 200 are needed")
    out: list[tuple[int, int]] = []
    for m in re.finditer(r"[^\n]+", text or ""):
        line = m.group()
        a, b = m.start() + len(line) - len(line.lstrip()), m.end() - len(line) + len(line.rstrip())
        for left, right in split_long(text, a, b, most) if a < b else []:
            if out and out[-1][1] - out[-1][0] < least and right - out[-1][0] <= most:
                out[-1] = out[-1][0], right
            else:
                out.append((left, right))
    return out


def windows(text: str, most: int) -> list[str]:
    """Text in parts of at most ``most`` units (here: code points), at line ends where possible."""
    parts, now = [], ""
    for line in text.splitlines(keepends=True) or [""]:
        for a in range(0, max(1, len(line)), most):
            piece = line[a : a + most]
            if now and len(now) + len(piece) > most:
                parts.append(now)
                now = ""
            now += piece
    return parts + [now] if now else parts


def _evidence(text: pd.Series, quote: pd.Series) -> pd.DataFrame:
    found = [evidence(t, q) or (None, None) for t, q in zip(text, quote, strict=True)]
    return pd.DataFrame({"start_char": pd.array([a for a, _ in found], "Int32"), "end_char": pd.array([b for _, b in found], "Int32")})


def _lists(found: list[list[tuple[int, int]]]) -> pa.Array:
    """Ranges of each text as an Arrow list, without an object for each range."""
    ends = pa.array(list(accumulate(map(len, found), initial=0)), pa.int32())
    flat = [x for spans in found for x in spans]
    fields = pa.StructArray.from_arrays([pa.array([a for a, _ in flat], pa.int32()), pa.array([b for _, b in flat], pa.int32())], ["start_char", "end_char"])
    return pa.ListArray.from_arrays(ends, fields)


def _occurrences(text: pa.Array, form: pa.Array) -> pa.Array:
    return _lists([occurrences(t, f) for t, f in zip(text.to_pylist(), form.to_pylist(), strict=True)])


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def evidence_span(text: Column, quote: Column) -> Column:
    """Struct of the range of the sentences that hold the quote; its fields are null where there is none."""
    return F.pandas_udf(_evidence, SPAN)(text, quote)


def occurrence_spans(text: Column, form: Column) -> Column:
    return F.arrow_udf(_occurrences, f"array<{SPAN}>")(text, form)


def sequence_ratio(a: Column, b: Column) -> Column:
    """Similarity of two strings by longest matching blocks, 0..1; not symmetric."""
    return F.pandas_udf(_ratio, "double")(a, b)


def chunks(text: Column, least: int = 400, most: int = 1200) -> Column:
    """Array of chunk ranges of a text."""

    def run(texts: pa.Array) -> pa.Array:
        return _lists([chunk_spans(t.as_py(), least, most) for t in texts])

    return F.arrow_udf(run, f"array<{SPAN}>")(text)
