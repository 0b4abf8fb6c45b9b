"""Section trees of books: proposals from contents or headings, assembly, validation; grouped by book."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame

# Heading roles with the roles they may stand in (none: only at the root), and roles of blocks.
PARENTS = {
    "collection": "", "work": "collection", "volume": "work", "part": "work volume", "chapter": "work volume part", "section": "work volume part chapter",
    "paragraph": "work volume part chapter section", "preface": "collection work volume part", "prologue": "work volume part", "epilogue": "work volume part",
    "appendix": "collection work volume part", "dramatis_personae": "work", "act": "work", "picture": "act", "dramatic_scene": "act picture", "other": "*",
}
BLOCK_ROLES = "title_page dedication epigraph footnotes scene_break inserted_text contents".split()
SECTION = "book_id string, id string, parent_id string, title string, title_position int, start int, end int, level int, role string, problem string"


def role_at(depth: int) -> str:
    return {2: "section"}.get(depth, "chapter" if depth < 2 else "paragraph")


def from_headings(levels: list[tuple[int, int, str]], n: int) -> list[dict]:
    """Proposals from headings (position, level, title) of a book of n elements.

    Several outermost headings are works. A single one with others below it names the book and is no section.
    A single one alone is the work; without headings the whole book is one."""
    whole = [{"start": 0, "end": n, "level": 1, "role": "work", "title": None, "title_position": None}]
    if not levels:
        return whole
    outer = min(level for _, level, _ in levels)
    tops = sum(level == outer for _, level, _ in levels)
    out = []
    for pos, level, title in levels:
        depth = level - outer
        if depth == 0 and tops == 1 and len(levels) > 1:
            continue
        out.append({"start": pos, "end": None, "title": title, "title_position": pos, "level": max(1, depth + (tops > 1)), "role": role_at(depth) if depth else "work"})
    return out or whole


def from_contents(entries: list[tuple[int, int, str]]) -> list[dict]:
    """Proposals from a table of contents (position, depth, title); a first root with all others below it is the book."""
    deeper = [i + 1 < len(entries) and entries[i + 1][1] > e[1] for i, e in enumerate(entries)]
    roots = [i for i, e in enumerate(entries) if e[1] == 0 and deeper[i]]
    book = roots == [0]
    works = book and any(d > 1 for _, d, _ in entries)
    out = []
    for i, (pos, depth, title) in enumerate(entries):
        if book and i == 0:
            continue
        work = deeper[i] and (depth == 1 if works else depth == 0 and not book)
        below = depth - book - (works and depth > 1)
        out.append({"start": pos, "end": None, "title": title, "title_position": pos, "level": max(1, depth + 1 - book), "role": "work" if work else role_at(max(1, below + 1))})
    return out


def section_id(book: str, start: int, level: int, role: str) -> str:
    return f"{book}:s:{uuid.uuid5(uuid.NAMESPACE_URL, str((book, (start, level, role)))).hex}"


def assemble(book: str, proposals: list[dict], n: int) -> list[dict]:
    """Rows of SECTION: ends and parents of the proposals; a repeated (start, level) is kept with a problem."""
    out, open_, taken = [], [], set()
    ordered = sorted(proposals, key=lambda p: (p["start"], p["level"]))
    heads = [p for p in ordered if p["role"] not in BLOCK_ROLES]
    for p in ordered:
        row = {"book_id": book, "parent_id": None, "problem": None, **p, "id": section_id(book, p["start"], p["level"], p["role"])}
        if (p["start"], p["level"]) in taken:
            out.append({**row, "problem": "another section starts here on this level"})
            continue
        taken.add((p["start"], p["level"]))
        block = p["role"] in BLOCK_ROLES
        given = p["end"]
        if not block and given is None:
            row["end"] = min((q["start"] for q in heads if q["start"] > p["start"] and q["level"] <= p["level"]), default=n)
        # ancestors that end before this start, or are not outside it, are done
        open_ = [a for a in open_ if a["end"] > p["start"] and (block or a["level"] < p["level"])]
        if open_ and row["end"] is not None and row["end"] > open_[-1]["end"]:
            if given is None and not block:
                row["end"] = open_[-1]["end"]
            else:
                row["problem"] = "it ends after its parent"
        row["parent_id"] = open_[-1]["id"] if open_ and row["problem"] is None else None
        out.append(row)
        if not block:
            open_.append(row)
    return out


def build(elements: DataFrame, contents: DataFrame) -> DataFrame:
    """SECTION rows of every book, from contents(book_id, pos, depth, title) where it has them, else from headings.

    elements(book_id, pos, heading_level, text): only headings and the last position travel."""
    schema = SECTION

    def run(e: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        book = (e if len(e) else c)["book_id"].iloc[0]
        n = int(e["pos"].max()) + 1 if len(e) else 0
        if len(c):
            p = from_contents([(int(r.pos), int(r.depth), r.title) for r in c.sort_values("pos").itertuples()])
        else:
            heads = e[e["heading_level"].notna()].sort_values("pos")
            p = from_headings([(int(r.pos), int(r.heading_level), r.text) for r in heads.itertuples()], n)
        rows = pd.DataFrame(assemble(book, p, n), columns=[x.split()[0] for x in schema.split(", ")])
        return rows.astype({"title_position": "Int32", "start": "Int32", "end": "Int32", "level": "Int32"})

    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    last = F.col("pos") == F.max("pos").over(Window.partitionBy("book_id"))
    thin = elements.select("book_id", "pos", "heading_level", F.when(F.col("heading_level").isNotNull(), F.col("text")).alias("text"), last.alias("l")).where("heading_level is not null or l").drop("l")
    toc = contents.select(F.col("book_id"), "pos", "depth", "title")
    return thin.groupBy("book_id").cogroup(toc.groupBy("book_id")).applyInPandas(run, schema)


def hierarchy_violations(sections: DataFrame) -> DataFrame:
    """Sections whose role may not stand in their parent's role: (book_id, id, role, parent_role)."""
    from pyspark.sql import functions as F

    allowed = F.create_map(*[F.lit(x) for k, v in PARENTS.items() for x in (k, v)])
    p = sections.select("book_id", F.col("id").alias("parent_id"), F.col("role").alias("parent_role"))
    both = sections.where(~F.col("role").isin(*BLOCK_ROLES)).join(p, ["book_id", "parent_id"], "left")
    may = F.try_element_at(allowed, F.col("role"))
    ok = F.col("parent_role").isNull() | (may == "*") | F.array_contains(F.split(may, " "), F.col("parent_role"))
    return both.where(~F.coalesce(ok, F.lit(False))).select("book_id", "id", "role", "parent_role")
