"""Entity resolution in chapters and books: clusters of mentions, reconciliation, book entities.

What a mention may join depends on the clusters that earlier mentions made, so clustering runs in order within a chapter, and the
resolution of chapter entities in order within a book; chapters and books run in parallel, one group of applyInPandas each. A
group is one chapter's mentions or one book's chapter entities. The oracle (a language model, a rule, a table of replies) is a plain
function that gets candidates and answers; whatever it says is checked, and what it doesn't say stays unresolved or uncertain.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import batched, chain

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import entities

DECISIONS = ("SAME_ENTITY", "DIFFERENT_ENTITY", "UNCERTAIN")
#: Ratio from which a requested name counts as a form of a mention.
GROUNDED = 0.82
_ENDINGS = sorted(T.ENDINGS, key=len, reverse=True)


def first_seen(values: Iterable) -> list:
    """Distinct values that aren't None, by first occurrence."""
    return list(dict.fromkeys(v for v in values if v is not None))


def tokens(value: str | None) -> list[str]:
    return regex.findall(r"\w+", (value or "").casefold())


def stems(value: str | None) -> list[str]:
    """Tokens without the longest listed ending that leaves four letters."""
    return [next((t[: -len(e)] for e in _ENDINGS if t.endswith(e) and len(t) >= len(e) + 4), t) for t in tokens(value)]


def canonical(values: Iterable[str | None], size: Callable[[str], list] = tokens) -> str | None:
    """Of the names that aren't blank: the most words, then the shortest, then the first in order."""
    names = {v.strip() for v in values if isinstance(v, str) and v.strip()}
    return min(names, key=lambda v: (-len(size(v)), len(v), v), default=None)


@lru_cache(1 << 14)
def _alike(a: str, b: str) -> float:
    """The larger of sequence ratio and stem overlap of two names; the same ones meet again and again while a chapter is clustered."""
    x, y = set(stems(a)), set(stems(b))
    return max(SequenceMatcher(None, a.casefold(), b.casefold()).ratio(), len(x & y) / max(1, len(x | y)))


def likeness(left: Iterable[str], right: Iterable[str]) -> float:
    """The best of sequence ratio and stem overlap over all pairs of two sets of names."""
    right = list(right)
    return max((_alike(a, b) for a in left for b in right), default=0.0)


class Distinct(list):
    """A list of distinct values by first occurrence, which grows by what is new, without a look at the rest."""

    def __init__(self, values: Iterable = ()):
        super().__init__()
        self.known: set = set()
        self.grow(values)

    def grow(self, values: Iterable) -> None:
        for v in values:
            if v is not None and v not in self.known:
                self.known.add(v)
                self.append(v)


def compatible(a: str | None, b: str | None) -> bool:
    return not a or not b or a == b


@dataclass
class Cluster:
    """An entity of a chapter or a book while it grows."""

    id: str
    name: str | None
    kind: str | None
    state: str
    aliases: list[str] = field(default_factory=Distinct)
    hints: list[str] = field(default_factory=Distinct)
    mentions: list[str] = field(default_factory=list)
    scenes: list = field(default_factory=Distinct)
    ranks: list[int] = field(default_factory=Distinct)
    chapters: list = field(default_factory=list)
    evidence: list[tuple[str, str, str]] = field(default_factory=list)  # mention, surface, context
    references: list[str] = field(default_factory=list)
    last: int | None = None  # the largest rank

    def __post_init__(self) -> None:
        self.last = max(self.ranks, default=None)

    def names(self) -> list[str]:
        return [v for v in first_seen([self.name, *self.aliases, *self.hints, *self.references]) if v]

    def representatives(self, most: int) -> tuple[list[str], list[str]]:
        """(longest surfaces, the first and the last contexts)."""
        longest = sorted(self.evidence, key=lambda e: (-len(e[1]), e[0]))[:most]
        contexts = first_seen([c for _, _, c in self.evidence[:1]] + [c for _, _, c in self.evidence[-most:]])
        return first_seen(s for _, s, _ in longest), contexts[:most]


def grounded(requested: str | None, forms: Iterable[str | None]) -> str | None:
    """A requested name if its stems all occur in the forms or it is nearly one of them."""
    if not isinstance(requested, str) or not requested.strip():
        return None
    name, seen = requested.strip(), [f for f in forms if isinstance(f, str) and f.strip()]
    own = set(stems(name))
    known = own <= set(chain.from_iterable(map(stems, seen))) or any(SequenceMatcher(None, name.casefold(), f.casefold()).ratio() >= GROUNDED for f in seen)
    return name if own and known else None


def ranked(name: str, kind: str | None, rank: int, clusters: Iterable[Cluster], k: int) -> list[Cluster]:
    """The k clusters of a compatible kind that are most like a mention; same kind and near scenes count a little."""
    if type(k) is not int or not 1 <= k <= 20:
        raise ValueError("k must be 1 to 20")

    def score(c: Cluster) -> float:
        return likeness([name], c.names()) + (0.08 if kind and kind == c.kind else 0) + 0.04 / (1 + abs(rank - (-1000 if c.last is None else c.last)))

    return sorted((c for c in clusters if compatible(kind, c.kind)), key=lambda c: (-score(c), c.id))[:k]


def alike(a: Cluster, b: Cluster) -> float:
    return likeness(a.names(), b.names()) + (0.08 if a.kind and a.kind == b.kind else 0) if compatible(a.kind, b.kind) else 0.0


def shortlist_pairs(clusters: list[Cluster], k: int) -> dict[tuple[str, str], float]:
    """{(smaller id, larger id): score}: each cluster's k most similar others of a compatible kind; the best score of a pair counts."""
    found: dict[tuple[str, str], float] = {}
    for a in clusters:
        near = sorted(((alike(a, b), b.id) for b in clusters if b.id != a.id and compatible(a.kind, b.kind)), key=lambda x: (-x[0], x[1]))[:k]
        for s, other in near:
            key = (min(a.id, other), max(a.id, other))
            found[key] = max(s, found.get(key, s))
    return dict(sorted(found.items()))


def checked_groups(reply: object, batch: list[dict], candidates: dict[str, list[str]]) -> list[dict]:
    """Groups (ids, kind, entity, name) of a reply; each names known mentions once and one of: a candidate, a new entity, unresolved.

    Mentions of no valid group are unresolved, one by one."""
    left, out = {m["id"] for m in batch}, []
    for row in (reply.get("resolutions") if isinstance(reply, dict) else None) or []:
        ids = row.get("mention_ids") if isinstance(row, dict) else None
        if not isinstance(ids, list) or not ids or not all(isinstance(i, str) for i in ids) or len(set(ids)) < len(ids) or not set(ids) <= left:
            continue
        entity, new = row.get("entity_id"), row.get("new_entity")
        said = [k for k, yes in (("existing", entity is not None), ("new", new is not None), ("unresolved", row.get("unresolved") is True)) if yes]
        if len(said) != 1 or said == ["existing"] and any(entity not in candidates[i] for i in ids) or said == ["new"] and not isinstance(new, dict):
            continue
        left -= set(ids)
        out.append({"ids": ids, "kind": said[0], "entity": entity, "name": (new or {}).get("canonical_name")})
    return out + [{"ids": [m["id"]], "kind": "unresolved", "entity": None, "name": None} for m in batch if m["id"] in left]


def _context(text: str, start: int, end: int, limit: int) -> str:
    side = max(0, (limit - (end - start)) // 2)
    return text[max(0, start - side) : min(len(text), end + side)]


def clusters(book: object, chapter: object, mentions: list[dict], ask: Callable, k: int = 5, size: int = 12, most: int = 3) -> list[Cluster]:
    """Clusters of a chapter's mentions (id, surface, kind, hint, scene, rank, context), in reading order and batches of ``size``.

    ``ask(batch, {mention: candidate ids}, {id: cluster})`` replies with resolutions; later batches see the clusters of earlier ones."""
    made: dict[str, Cluster] = {}
    for batch in map(list, batched(mentions, size)):
        near = {m["id"]: ranked(m["hint"] or m["surface"], m["kind"], m["rank"], made.values(), k) for m in batch}
        offered = {i: [c.id for c in found] for i, found in near.items()}
        by_id = {m["id"]: m for m in batch}
        for g in checked_groups(ask(batch, offered, {c.id: c for found in near.values() for c in found}), batch, offered):
            for ids in [[i] for i in g["ids"]] if g["kind"] == "unresolved" else [g["ids"]]:
                part = [by_id[i] for i in ids]
                target = made.get(g["entity"]) if g["kind"] == "existing" else None
                if target is None:
                    forms = [*(m["hint"] for m in part), *(m["surface"] for m in part)]
                    kinds = {m["kind"] for m in part if m["kind"]}
                    key = "chapter-entity:" + uuid.uuid5(uuid.NAMESPACE_URL, f"{book}:{chapter}:{part[0]['id']}").hex
                    target = made[key] = Cluster(key, grounded(g["name"], forms) or canonical(forms), kinds.pop() if len(kinds) == 1 else None, g["kind"])
                target.mentions += ids
                target.evidence += [(m["id"], m["surface"], m["context"]) for m in part]
                for own, new in ((target.aliases, "surface"), (target.hints, "hint"), (target.scenes, "scene"), (target.ranks, "rank")):
                    own.grow(m[new] for m in part if m[new] != "")
                target.last = max((x for x in (target.last, *(m["rank"] for m in part)) if x is not None), default=None)
    return list(made.values())


def unions(ids: Iterable[str], decisions: dict[tuple[str, str], str]) -> dict[str, str]:
    """{id: smallest id of its group}: groups joined in the order of pairs, only where every pair across is the same entity."""
    same = {p for p, d in decisions.items() if d == "SAME_ENTITY"}
    group = {i: frozenset([i]) for i in ids}
    for a, b in sorted(same):
        if group[a] is not group[b] and all((min(x, y), max(x, y)) in same for x in group[a] for y in group[b]):
            both = group[a] | group[b]
            group |= dict.fromkeys(both, both)
    return {i: min(g) for i, g in group.items()}


def decided(pairs: dict[tuple[str, str], float], ask: Callable, size: int = 8) -> dict[tuple[str, str], str]:
    """A decision for each pair: of batches of replies the first valid one, UNCERTAIN without one."""
    out = dict.fromkeys(pairs, "UNCERTAIN")
    for batch in batched(pairs, size):
        reply = ask(list(batch))
        seen = set()
        for row in (reply.get("decisions") if isinstance(reply, dict) else None) or []:
            pair = tuple(sorted(str(row.get(x)) for x in ("left_entity_id", "right_entity_id"))) if isinstance(row, dict) else ()
            if pair in batch and pair not in seen and row.get("decision") in DECISIONS:
                seen.add(pair)
                out[pair] = row["decision"]
    return out


def merged(group: list[Cluster], most: int, size: Callable[[str], list] = tokens) -> Cluster:
    """One cluster of several, in their order; the smallest id stays."""
    every = lambda name: first_seen(x for c in group for x in getattr(c, name))
    kinds = {c.kind for c in group if c.kind}
    state = "reconciled" if len(group) > 1 else group[0].state
    out = Cluster(min(c.id for c in group), canonical([*(c.name for c in group), *every("hints")], size), kinds.pop() if len(kinds) == 1 else None, state)
    for name in ("aliases", "hints", "mentions", "scenes", "ranks", "chapters", "evidence"):
        setattr(out, name, every(name))
    out.last = max(out.ranks, default=None)
    out.references = every("references")[:most]
    return out


def reconciled(made: list[Cluster], ask: Callable, k: int = 5, size: int = 8, most: int = 3) -> tuple[list[Cluster], dict[str, str], dict[tuple[str, str], str]]:
    """(clusters, {id: id it became}, decisions) after similar clusters are compared in pairs."""
    decisions = decided(shortlist_pairs(made, k), ask, size)
    home = unions([c.id for c in made], decisions)
    groups: dict[str, list[Cluster]] = {}
    for c in made:
        groups.setdefault(home[c.id], []).append(c)
    return [merged(g, most) for g in groups.values()], home, decisions


CHAPTER = "book_id string, chapter_id string, id string, canonical_name string, entity_type string, aliases array<string>, mention_ids array<string>, scene_ids array<string>, canonical_hints array<string>, representative_mentions array<string>, representative_contexts array<string>, representative_references array<string>, resolution_state string"


def resolve_chapters(mentions: DataFrame, scenes: DataFrame, ask: Callable, ask_pairs: Callable | None = None, references: DataFrame | None = None, k: int = 5, size: int = 12, context: int = 240, most: int = 3) -> DataFrame:
    """Chapter entities (CHAPTER) of mentions(book_id, scene_id, id, surface_text, entity_type, canonical_name_hint, start_offset, end_offset).

    scenes(book_id, chapter_id, id, rank, text) place them. ``ask`` and ``ask_pairs`` must be picklable; without ``ask_pairs`` nothing is
    reconciled. references(book_id, scene_id, target_mention_id, surface_text, start_offset, end_offset) add forms and contexts.
    Mentions of unknown scenes are left out."""
    place = scenes.select("book_id", "chapter_id", F.col("id").alias("scene_id"), "rank", F.col("text").alias("__text"))
    around = F.pandas_udf(lambda t, a, b: pd.Series([_context(x or "", int(i), int(j), context) for x, i, j in zip(t, a, b, strict=True)]), "string")
    named = lambda df: df.join(place, ["book_id", "scene_id"]).withColumn("context", around("__text", "start_offset", "end_offset")).drop("__text")
    rows = named(mentions)
    told = named(references).groupBy("book_id", F.col("target_mention_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "start_offset", "surface_text", "context"))).alias("told")) if references is not None else None
    if told is not None:
        rows = rows.join(told, ["book_id", "id"], "left")

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["rank", "start_offset", "end_offset", "id"])
        none = lambda x: None if x is None or x != x else x
        told = dict(zip(part["id"], part["told"], strict=True)) if "told" in part else {}
        listed = [{"id": r.id, "surface": r.surface_text, "kind": none(r.entity_type), "hint": none(r.canonical_name_hint), "scene": str(r.scene_id), "rank": int(r.rank), "context": r.context, "start": int(r.start_offset), "end": int(r.end_offset)} for r in part.itertuples()]
        made = clusters(key[0], key[1], listed, ask, k, size, most)
        contexts = {}
        for c in made:
            more = [x for m in c.mentions for x in (told[m] if told.get(m) is not None else [])]
            c.references = first_seen(x["surface_text"] for x in more)[:most]
            contexts[c.id] = [x["context"] for x in more]
        if ask_pairs is not None:
            made, home, _ = reconciled(made, ask_pairs, k, most=most)
            for old, new in home.items():
                if old != new:
                    contexts[new] = contexts[new] + contexts[old]
        out = []
        for c in made:
            longest, seen = c.representatives(most)
            out.append((str(key[0]), str(key[1]), c.id, c.name, c.kind, c.aliases, c.mentions, c.scenes, c.hints, longest, first_seen([*seen, *contexts[c.id]])[:most], c.references, c.state))
        return pd.DataFrame(out, columns=[x.split()[0] for x in CHAPTER.split(", ")])

    return rows.groupBy("book_id", "chapter_id").applyInPandas(run, CHAPTER)


def checked_choice(reply: object, source: str, offered: list[str]) -> tuple[str, str | None]:
    """(decision, entity) on a chapter entity: the only valid row about it; repeated or wrong rows are uncertain."""
    rows = [r for r in ((reply.get("resolutions") if isinstance(reply, dict) else None) or []) if isinstance(r, dict) and r.get("chapter_entity_id") == source]
    good = [r for r in rows if r.get("decision") in ("same_entity", "new_entity", "uncertain") and (r["decision"] != "same_entity" or r.get("entity_id") in offered)]
    if not good or len(rows) > rows.index(good[0]) + 1:
        return "uncertain", None
    return good[0]["decision"], good[0].get("entity_id")


def fitting(source: Cluster, near: list[Cluster], room: int, most: int) -> tuple[list[Cluster], int]:
    """(candidates, contexts of each) that fit ``room`` characters: contexts go first, then the least similar candidates."""
    for count, contexts in [(len(near), c) for c in range(most, 0, -1)] + [(n, 1) for n in range(len(near) - 1, 0, -1)]:
        shown = [source, *near[:count]]
        if sum(len(json.dumps([c.names(), [e[2] for e in c.evidence[:contexts]]], ensure_ascii=False)) for c in shown) <= room or not near:
            return near[:count], contexts
    raise ValueError("one chapter entity does not fit")


BOOK = "book_id string, id string, canonical_name string, entity_type string, aliases array<string>, canonical_hints array<string>, chapter_ids array<string>, scene_ids array<string>, sources array<string>, uncertain array<string>"


def _listed(value: object) -> list:
    return [] if value is None else list(value)


def resolve_books(chapter_entities: DataFrame, ask: Callable, ask_pairs: Callable | None = None, k: int = 5, most: int = 3, room: int = 100_000) -> DataFrame:
    """Book entities (BOOK) of chapter entities (CHAPTER and ``order``), one after the other in each book.

    ``ask(source, candidates)`` replies with same_entity, new_entity or uncertain; each answer changes the candidates of the next.
    ``sources`` are the chapter entities that resolve to an entity; those without one are in a row of null id, as ``uncertain``.
    With ``ask_pairs`` similar book entities are compared once more in the end and merged."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        made: dict[str, Cluster] = {}
        sources: dict[str, list[str]] = {}
        unsure = []
        for r in part.sort_values(["order", "id"]).itertuples():
            kind = r.entity_type if isinstance(r.entity_type, str) else None
            evidence = [(r.id, r.canonical_name, c) for c in _listed(r.representative_contexts)]
            own = Cluster(r.id, r.canonical_name, kind, "new", _listed(r.aliases), _listed(r.canonical_hints), [], _listed(r.scene_ids), [], [r.chapter_id], evidence, _listed(r.representative_references))
            near, _ = fitting(own, sorted((c for c in made.values() if compatible(kind, c.kind)), key=lambda c, own=own: (-alike(own, c), c.id))[:k], room, most)
            decision, target = checked_choice(ask(own, near), r.id, [c.id for c in near])
            if decision == "uncertain":
                unsure.append(r.id)
                continue
            if decision == "new_entity":
                target = "book-entity:" + uuid.uuid5(uuid.NAMESPACE_URL, f"{key[0]}:{r.id}").hex
                own.id, own.name = target, canonical([own.name, *own.hints], stems)
                made[target] = own
            else:
                grown = merged([made[target], own], most, stems)
                grown.id, grown.kind = target, made[target].kind
                made[target] = grown
            sources.setdefault(target, []).append(r.id)
        if ask_pairs is not None:
            home = unions(made, decided(shortlist_pairs(list(made.values()), k), ask_pairs))
            for new in sorted({h for i, h in home.items() if i != h}):
                group = [i for i in made if home[i] == new]
                one = merged([made[i] for i in group], most, stems)
                sources[new] = first_seen(s for i in group for s in sources[i])
                for i in group:
                    del made[i]
                made[new] = one
        out = [(str(key[0]), c.id, c.name, c.kind, c.aliases, c.hints, [str(x) for x in c.chapters], [str(x) for x in c.scenes], sources[c.id], []) for c in made.values()]
        if unsure:
            out.append((str(key[0]), None, None, None, [], [], [], [], [], unsure))
        return pd.DataFrame(out, columns=[x.split()[0] for x in BOOK.split(", ")])

    return chapter_entities.groupBy("book_id").applyInPandas(run, BOOK)


def flat_resolutions(replies: DataFrame, mentions: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, new entities, faults) from replies(book_id, mention_id, entity_id, new_name, new_type, new_aliases, unresolved), one for each of mentions(book_id, id).

    A reply chooses exactly one of a known entity(book_id, id), a new one with a name, or unresolved; faults name the rest,
    with mentions that have no reply or several. With any fault a caller should refuse the book's whole reply."""
    choices = sum((F.col(c).isNotNull().cast("int") for c in ("entity_id", "new_name")), F.coalesce(F.col("unresolved"), F.lit(False)).cast("int"))
    m = mentions.select("book_id", F.col("id").alias("mention_id"), F.lit(True).alias("asked"))
    e = known.select("book_id", F.col("id").alias("entity_id"), F.lit(True).alias("known"))
    counts = replies.groupBy("book_id", "mention_id").agg(F.count("*").alias("n"))
    both = replies.withColumn("choices", choices).join(m, ["book_id", "mention_id"], "full").join(e, ["book_id", "entity_id"], "left").join(counts, ["book_id", "mention_id"], "left")
    fault = (
        F.when(F.col("asked").isNull(), "unknown mention").when(F.col("n").isNull(), "no reply").when(F.col("n") > 1, "several replies").when(F.col("choices") != 1, "choice")
        .when(F.col("entity_id").isNotNull() & F.col("known").isNull(), "unknown entity").when(F.trim("new_name") == "", "name").when(F.trim("new_type") == "", "type")
    )
    judged = both.withColumn("problem", fault)
    good = judged.where("problem is null")
    new_id = F.when(F.col("new_name").isNotNull(), entities.flat_entity_id(F.col("book_id"), F.col("new_name"), F.col("new_type")))
    links = good.select("book_id", "mention_id", F.coalesce(F.col("entity_id"), new_id).alias("entity_id"))
    new = good.where("new_name is not null").select("book_id", new_id.alias("id"), F.trim("new_name").alias("canonical_name"), F.trim("new_type").alias("entity_type"), F.coalesce("new_aliases", F.array().cast("array<string>")).alias("aliases"))
    made = new.groupBy("book_id", "id").agg(F.min("canonical_name").alias("canonical_name"), F.first("entity_type", True).alias("entity_type"), F.array_distinct(F.flatten(F.collect_list("aliases"))).alias("aliases"))
    fresh = made.join(known.select("book_id", "id"), ["book_id", "id"], "left_anti")
    return links, fresh, judged.where("problem is not null").select("book_id", "mention_id", "problem")


def portions(chunks: DataFrame, scenes: DataFrame) -> DataFrame:
    """(book_id, scene_id, chunk_id, start_offset, text, fits): chunks as parts of their scenes; ``fits`` tells whether the texts agree."""
    s = scenes.select("book_id", F.col("id").alias("scene_id"), F.col("start_char").alias("base"), F.col("text").alias("whole"))
    at = (F.col("start_char") - F.col("base")).cast("int")
    return chunks.join(s, ["book_id", "scene_id"]).select("book_id", "scene_id", F.col("id").alias("chunk_id"), at.alias("start_offset"), "text", (F.substring("whole", at + 1, F.length("text")) == F.col("text")).alias("fits"))


def extract(parts: Iterable[dict], ask: Callable[[dict, int], dict], output: int = 6000) -> Iterator[tuple[dict, dict | None]]:
    """(part, reply) of each part; a reply cut for length is asked again with twice and four times the tokens, then given up."""
    for part in parts:
        replies = (ask(part, output * times) for times in (1, 2, 4))
        yield part, next((r for r in replies if r.get("finish_reason") != "length"), None)
