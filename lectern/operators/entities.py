"""Mentions, entity resolution and the presence graph."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import spans
from lectern.functions import text as T

# Entity types, and pronouns that are no mention by themselves (a word is looked up with ё as е).
TYPES = ("person", "location", "organization", "group", "institution", "vehicle", "artifact", "object", "other")
PRONOUNS = (
    "я меня мне мной мною ты тебя тебе тобой тобою он его него ему нему им ним нём она её неё ней нею ею оно мы нас нам нами вы вас вам вами они их них ими ними"
).split()
_LETTERS = "[A-Za-zА-Яа-яЁё0-9]+"


def individual(surface: Column) -> Column:
    """Whether a mention can name somebody: a word begins with a capital or holds a digit, and not all are pronouns."""
    words = F.regexp_extract_all(surface, F.lit(_LETTERS), F.lit(0))
    marked = F.exists(words, lambda w: w.rlike("^[A-ZА-ЯЁ]|[0-9]"))
    return marked & F.exists(words, lambda w: ~T.fold(w).isin(*PRONOUNS))


def compatible(a: Column, b: Column) -> Column:
    """Entity types that may be the same entity: equal, or one unknown."""
    return a.isNull() | b.isNull() | (a == b)


def _located(rows: DataFrame) -> DataFrame:
    """rows(text, surface_text, start_offset, end_offset, occurrence) with ``span``, null where the form isn't found."""

    def locate(text: pd.Series, form: pd.Series, start: pd.Series, end: pd.Series, nth: pd.Series) -> pd.DataFrame:
        whole = lambda x: None if pd.isna(x) else int(x)
        found = [spans.resolve(t, f, whole(a), whole(b), whole(n)) or (None, None) for t, f, a, b, n in zip(text, form, start, end, nth, strict=True)]
        return pd.DataFrame({"start_char": pd.array([a for a, _ in found], "Int32"), "end_char": pd.array([b for _, b in found], "Int32")})

    return rows.withColumn("span", F.pandas_udf(locate, spans.SPAN)("text", "surface_text", "start_offset", "end_offset", "occurrence"))


def mention_rows(replies: DataFrame, scenes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mentions, rejected) from replies(scene_id, seq, surface_text, start_offset, end_offset, occurrence, entity_type,
    confidence[, local_id, canonical_name_hint]) and scenes(scene_id, text, text_hash[, book_id]).

    A mention must be found in its scene (given offsets, nth or only occurrence), have a local id of its own, no unknown
    type, no blank hint, no confidence outside 0 to 1 and an individualising mark; of mentions on one span the first stays.
    Of one local id only the first record that is found counts, whatever becomes of it."""
    have = set(replies.columns)
    local = F.trim("local_id") if "local_id" in have else F.concat(F.lit("a"), F.col("seq").cast("string"))
    hint = F.trim("canonical_name_hint") if "canonical_name_hint" in have else F.lit(None).cast("string")
    book = F.col("book_id") if "book_id" in scenes.columns else F.lit("")
    placed = _located(replies.join(scenes, "scene_id", "left")).withColumns({"__local": F.coalesce(local, F.concat(F.lit("a"), F.col("seq").cast("string"))), "__hint": hint})
    kind = F.trim("entity_type")
    named = Window.partitionBy("scene_id", "__local", F.col("span.start_char").isNotNull()).orderBy("seq")
    problem = (
        F.when(F.col("text").isNull(), "unknown scene")
        .when(F.col("span.start_char").isNull(), "not found")
        .when((F.col("__local") == "") | (F.row_number().over(named) > 1), "local id")
        .when(kind.isNotNull() & ~kind.isin(*TYPES), "type")
        .when(F.col("__hint") == "", "hint")
        .when(F.col("confidence").isNotNull() & (F.isnan("confidence") | ~F.col("confidence").between(0, 1)), "confidence")
        .when(~individual(F.col("surface_text")), "no individual mark")
    )
    judged = placed.withColumn("problem", problem)
    w = Window.partitionBy("scene_id", "span").orderBy("seq")
    ok = judged.where("problem is null").withColumn("n", F.row_number().over(w))
    key = F.concat_ws(":", book, "scene_id", "text_hash", "span.start_char", "span.end_char")
    good = ok.where("n = 1").select("scene_id", F.concat(F.lit("mention:"), T.uuid5_hex(key)).alias("mention_id"), F.col("__local").alias("local_id"), "surface_text", F.col("span.start_char").alias("start_offset"), F.col("span.end_char").alias("end_offset"), kind.alias("entity_type"), F.col("__hint").alias("canonical_name_hint"), "confidence", "text_hash")
    bad = judged.where("problem is not null").select("scene_id", "seq", "problem").unionByName(ok.where("n > 1").select("scene_id", "seq", F.lit("repeated span").alias("problem")))
    return good, bad


def resolved_references(replies: DataFrame, mentions: DataFrame, scenes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(references, rejected) from replies(scene_id, seq, surface_text, start_offset, end_offset, occurrence, target_local_id,
    reference_kind), mentions as ``mention_rows`` gives them and scenes(scene_id, text, text_hash[, book_id]).

    The target must be a mention of the scene by local id, the kind not blank, the span found and no mention's; the
    first reference on a span stays."""
    book = F.col("book_id") if "book_id" in scenes.columns else F.lit("")
    known = mentions.select("scene_id", F.col("local_id").alias("target_local_id"), F.col("mention_id").alias("target_mention_id"))
    taken = mentions.select("scene_id", F.struct(F.col("start_offset").alias("start_char"), F.col("end_offset").alias("end_char")).alias("span"), F.lit(True).alias("taken"))
    placed = _located(replies.join(scenes, "scene_id", "left")).join(known, ["scene_id", "target_local_id"], "left").join(taken, ["scene_id", "span"], "left")
    problem = (
        F.when(F.col("text").isNull(), "unknown scene")
        .when(F.col("target_mention_id").isNull(), "target")
        .when(F.coalesce(F.trim("reference_kind"), F.lit("")) == "", "kind")
        .when(F.col("span.start_char").isNull(), "not found")
        .when(F.col("taken"), "a mention's span")
    )
    judged = placed.withColumn("problem", problem)
    ok = judged.where("problem is null").withColumn("n", F.row_number().over(Window.partitionBy("scene_id", "span").orderBy("seq")))
    key = F.concat_ws(":", book, "scene_id", "text_hash", "span.start_char", "span.end_char", "target_mention_id")
    good = ok.where("n = 1").select("scene_id", F.concat(F.lit("reference:"), T.uuid5_hex(key)).alias("reference_id"), "surface_text", F.col("span.start_char").alias("start_offset"), F.col("span.end_char").alias("end_offset"), F.trim("reference_kind").alias("reference_kind"), "target_mention_id", "text_hash")
    bad = judged.where("problem is not null").select("scene_id", "seq", "problem").unionByName(ok.where("n > 1").select("scene_id", "seq", F.lit("repeated span").alias("problem")))
    return good, bad


def flat_entity_id(book: Column, name: Column, kind: Column) -> Column:
    """Id of an entity of a book by its folded kind and name."""
    plain = lambda c: T.clean(F.lower(F.coalesce(c, F.lit(""))))
    return F.concat(F.lit("entity:"), T.uuid5_hex(F.concat_ws(":", book, plain(kind), plain(name))))


def reference_rows(replies: DataFrame, mentions: DataFrame) -> DataFrame:
    """References (scene_id, seq, start_offset, end_offset, target_mention_id) whose target is a mention of their scene
    and whose span no mention has; the first of a span stays."""
    m = mentions.select("scene_id", "mention_id", F.col("start_offset").alias("ms"), F.col("end_offset").alias("me"))
    known = replies.join(m.select("scene_id", F.col("mention_id").alias("target_mention_id")), ["scene_id", "target_mention_id"], "left_semi")
    free = known.join(m.select("scene_id", F.col("ms").alias("start_offset"), F.col("me").alias("end_offset")), ["scene_id", "start_offset", "end_offset"], "left_anti")
    w = Window.partitionBy("scene_id", "start_offset", "end_offset").orderBy("seq")
    return free.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def shortlist(mentions: DataFrame, entities: DataFrame, k: int, by: str = "chapter_id") -> DataFrame:
    """(mention_id, entity_id, score): each mention's k most similar entities of its chapter and of a compatible type.

    mentions(by, mention_id, name, entity_type, scene_no), entities(by, entity_id, name, entity_type, scene_no)."""
    e = entities.select(by, "entity_id", F.col("name").alias("e_name"), F.col("entity_type").alias("e_type"), F.col("scene_no").alias("e_scene"))
    pairs = mentions.join(e, by).where(compatible(F.col("entity_type"), F.col("e_type")))
    # names repeat, so each two are compared once in a chapter
    names = pairs.select(by, "name", "e_name").distinct()
    lexical = spans.sequence_ratio(F.lower("name"), F.lower("e_name"))
    names = names.withColumn("near", F.greatest(lexical, T.jaccard(T.stems(F.col("name")), T.stems(F.col("e_name")))))
    pairs = pairs.join(names, [by, "name", "e_name"])
    score = F.col("near") + F.when(F.col("entity_type") == F.col("e_type"), 0.08).otherwise(0.0) + 0.04 / (1 + F.abs(F.col("scene_no") - F.col("e_scene")))
    w = Window.partitionBy("mention_id").orderBy(F.desc("score"), "entity_id")
    return pairs.withColumn("score", score).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("mention_id", "entity_id", "score", "r")


def first_valid(replies: DataFrame, by: list[str], valid: Column, order: str = "seq") -> DataFrame:
    """The first valid reply for each key."""
    w = Window.partitionBy(*by).orderBy(order)
    return replies.where(valid).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def decisions(pairs: DataFrame, replies: DataFrame, allowed: list[str], default: str) -> DataFrame:
    """pairs(pair_id, ...) with ``decision``: the first valid reply (pair_id, decision, seq), else the default."""
    good = first_valid(replies, ["pair_id"], F.col("decision").isin(*allowed)).select("pair_id", "decision")
    return pairs.join(good, "pair_id", "left").withColumn("decision", F.coalesce("decision", F.lit(default)))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of undirected edges (a, b); root is the smallest node. Pointers jump, so chains need few rounds."""
    spark = edges.sparkSession
    # repeated edges change no minimum, so no table of all edges is made to find them
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    has_folder = spark.sparkContext.getCheckpointDir() is not None
    keep = (lambda df: df.checkpoint()) if has_folder else (lambda df: df.persist())
    both = keep(both)
    label = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        low = label.join(near, "node").select("node", F.least("root", "near").alias("root"))
        up = low.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = keep(low.join(up, "root", "left").select("node", F.least(F.col("root"), F.coalesce("above", "root")).alias("root")))
        if not new.join(label.withColumnRenamed("root", "old"), "node").where("root <> old").head(1):
            return new
        label.unpersist()
        label = new


class _Groups:
    """Groups that members join in rising order: the oldest group whose members are all linked with them, or a new one.

    A group keeps the later members that are linked with all of its own, and nothing else."""

    def __init__(self) -> None:
        self.left: dict = {}
        self.next: list = []  # heap of (next of ``left``, root)

    def root(self, member, later: np.ndarray):
        """The root of a member, by its links to larger ones, sorted."""
        found = None
        while self.next and self.next[0][0] <= member:
            at, root = heapq.heappop(self.next)
            if at == member and found is None:
                found, self.left[root] = root, np.intersect1d(self.left[root], later, assume_unique=True)
            self._wait(root, member)
        if found is None:
            found, self.left[member] = member, later
            self._wait(member, member)
        return found

    def _wait(self, root, member) -> None:
        c = self.left[root]
        i = int(np.searchsorted(c, member, side="right"))
        if i < len(c):
            heapq.heappush(self.next, (c[i : i + 1].tolist()[0], root))
        else:
            del self.left[root]


def _grouped(rows: DataFrame, by: str) -> DataFrame:
    """(by, id, root) of rows(by, id, copies, b): each member with its links to larger members, a null b where it has none.

    The links come sorted, in Arrow batches, so neither a book's members nor its links are ever in memory at once."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, last, open_, parts, out, kind = _Groups(), object(), None, [], [], None

        def close() -> None:
            nonlocal groups, last
            book, member, copies = open_
            if book != last:
                groups, last = _Groups(), book
            later = np.unique(np.concatenate(parts))
            out.extend([(book, member, None if member is None else groups.root(member, later))] * copies)

        for batch in batches:
            code = [batch.column(i).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for i in (0, 1)]
            starts = [0, *(np.flatnonzero((np.diff(code[0]) != 0) | (np.diff(code[1]) != 0)) + 1).tolist(), batch.num_rows]
            for a, z in itertools.pairwise(starts):
                if a == z:
                    continue
                key = tuple(batch.column(i)[a].as_py() for i in (0, 1, 2))
                if key != open_:
                    if open_ is not None:
                        close()
                    open_, parts = key, []
                parts.append(batch.column(3).slice(a, z - a).drop_null().to_numpy(zero_copy_only=False))
            kind = [batch.schema.field(i).type for i in (0, 1, 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind[i]) for i in range(3)], [by, "id", "root"])
            out.clear()
        if open_ is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind[i]) for i in range(3)], [by, "id", "root"])

    return rows.mapInArrow(run, f"`{by}` {kinds[by]}, id {kinds['id']}, root {kinds['id']}")


def conservative_groups(same: DataFrame | Callable[[Column, Column], Column], members: DataFrame, by: str = "book_id") -> DataFrame:
    """(by, id, root): groups joined in the order of pairs (a, b) only where every cross pair is in ``same``.

    ``same`` is a table (by, a, b), or a condition on two ids of a book, the smaller first; the pairs of a condition are made one member at a
    time and never shuffled. Joining in the order of pairs comes to this: each member, in rising order, joins the oldest
    group that it is linked with as a whole, for a pair of two groups of several was refused when the younger one's root was tried.
    So the books' members run through in order; a task holds the links of one member and what the open groups may still take."""
    m = members.groupBy(by, "id").agg(F.count("*").alias("copies"))
    # a fixed number, for few members may have many links
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if callable(same):
        dealt = m.repartition(n, F.col(by)).sortWithinPartitions(by, "id")
        dealt = dealt.mapInArrow(lambda batches: batches, dealt.schema)  # the optimiser takes away a sort that stands right below a join
        other = F.broadcast(m.select(F.col(by).alias("__by"), F.col("id").alias("b")))
        rows = dealt.join(other, F.col(by).eqNullSafe(F.col("__by")) & (F.col("id") < F.col("b")) & same(F.col("id"), F.col("b")), "left").select(by, "id", "copies", "b")
    else:
        pairs = same.where("a <> b").select(F.col(by).alias("__by"), F.least("a", "b").alias("__a"), F.greatest("a", "b").alias("b"))
        rows = m.join(pairs, F.col(by).eqNullSafe(F.col("__by")) & (F.col("id") == F.col("__a")), "left").select(by, "id", "copies", "b")
        rows = rows.repartition(n, F.col(by)).sortWithinPartitions(by, "id")
    return _grouped(rows, by)


def canonical(names: Column) -> Column:
    """Of an array of names: the most words, then the shortest, then the first in order."""
    keyed = F.transform(names, lambda n: F.struct((-F.size(T.tokens(n))).alias("w"), F.length(n).alias("n"), n.alias("name")))
    return F.try_element_at(F.array_sort(keyed), F.lit(1))["name"]


def presence(mentions: DataFrame, references: DataFrame) -> DataFrame:
    """(entity_id, scene_id, mention_count, reference_count), counted apart before they are joined."""
    m = mentions.groupBy("entity_id", "scene_id").agg(F.countDistinct("mention_id").alias("mention_count"))
    r = references.groupBy("entity_id", "scene_id").agg(F.countDistinct("reference_id").alias("reference_count"))
    return m.join(r, ["entity_id", "scene_id"], "left").select("entity_id", "scene_id", "mention_count", F.coalesce("reference_count", F.lit(0)).alias("reference_count"))


def scenes_with(presence_rows: DataFrame, ids: list, every: bool = True) -> DataFrame:
    """Scenes where all (or any) of the entities occur, with the number of them."""
    found = presence_rows.where(F.col("entity_id").isin(*ids)).groupBy("scene_id").agg(F.countDistinct("entity_id").alias("n"))
    return found.where(F.col("n") == len(set(ids))) if every else found


def name_match(catalog: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """catalog(id, canonical_name, aliases, scene_count) matched by name: (id, score, scene_count, ambiguous), at least 0.35."""
    values = catalog.select("id", "scene_count", F.explode(F.array_distinct(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("value"))
    n, q = T.normalised_name(F.col("value")), T.normalised_name(F.lit(query))
    v = values.withColumns({"n": n, "q": q})
    a, b = F.split("n", " "), F.split("q", " ")
    full = (F.col("n") != "") & (F.col("q") != "")
    score = F.greatest(F.when(F.col("n") == F.col("q"), 1.0).otherwise(0.0), F.when(full & (F.contains("n", F.col("q")) | F.contains("q", F.col("n"))), 0.92).otherwise(0.0), T.jaccard(a, b), 0.8 * spans.sequence_ratio(F.col("q"), F.col("n")))
    best = v.groupBy("id", "scene_count").agg(F.round(F.max(score), 6).alias("score")).where("score >= 0.35")
    top = best.orderBy(F.desc("score"), F.desc("scene_count"), "id").limit(max(2, limit))
    w = Window.orderBy(F.desc("score"), F.desc("scene_count"), "id")  # at most limit rows
    marked = top.withColumns({"r": F.row_number().over(w), "second": F.lead("score").over(w)})
    gap = F.max(F.when((F.col("r") == 1) & (F.col("score") - F.col("second") < 0.08), True).otherwise(False)).over(Window.partitionBy())
    return marked.withColumn("ambiguous", gap).where(F.col("r") <= limit).select("id", "score", "scene_count", "ambiguous")


def catalog(entities: DataFrame, presence_rows: DataFrame) -> DataFrame:
    """entities(id, ...) with scene_count, 0 for those in no scene."""
    n = presence_rows.groupBy(F.col("entity_id").alias("id")).agg(F.countDistinct("scene_id").alias("n"))
    return entities.join(n, "id", "left").withColumn("scene_count", F.coalesce("n", F.lit(0))).drop("n")
