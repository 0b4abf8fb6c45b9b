"""A store of all tables of the books: consistent snapshots, edits by compare-and-swap, undo, and the reads that services need.

Each table is a set of files by bucket of books; a manifest names the files that belong together and is what readers and writers agree on. A save
writes the changed buckets first and the manifest last, by one rename; until then nobody sees them. An edit of some books reads and
writes the buckets of these books only, whatever else the library holds.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.operators import editing, entities, fulltext, indexing, resolution, sessions, writes

_MANIFEST = "name string, bucket int, path string, kind string, label string"


class Library:
    """Tables in a folder that driver and executors share; ``buckets`` must stay the same for a folder."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.manifest = sessions.VersionedTable(spark, f"{self.path}/manifest")

    def revision(self) -> int:
        """The current revision; 0 before the first save."""
        return self.manifest.version()

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col("book_id").cast("string")), F.lit(self.buckets)).cast("int")

    def _of(self, books: DataFrame) -> set[int]:
        """Buckets of the books(book_id); as many numbers at most as there are buckets."""
        return {r.b for r in books.select(self._bucket().alias("b")).distinct().collect()}

    def _files(self, revision: int) -> list:
        return self.manifest.read(revision).collect() if revision else []  # a row for each table and bucket

    def tables(self, revision: int | None = None, books: DataFrame | None = None) -> writes.Tables:
        """All tables as of a revision, by default the current one; with ``books`` only what lies in their buckets."""
        files = self._files(self.revision() if revision is None else revision)
        wanted = None if books is None else self._of(books)
        out = {}
        for name in sorted({f.name for f in files}):
            own = [f for f in files if f.name == name]
            paths = [f.path for f in own if f.path and (wanted is None or f.bucket is None or f.bucket in wanted)]
            kind = own[0].kind
            out[name] = self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)
        return out

    def _stored(self, name: str, rows: DataFrame) -> dict[int | None, str]:
        """Files of rows by bucket; a table without book_id is one."""
        path = f"{self.path}/{name}/{uuid.uuid4().hex}"
        if "book_id" not in rows.columns:
            rows.write.parquet(path)
            return {None: path}
        # a bucket of much data is split over many tasks, many of little data share one
        rows.withColumn("__bucket", self._bucket()).hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(path)
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        found = [x.getPath().getName() for x in folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(folder)]
        return {int(n.split("=")[1]): f"{path}/{n}" for n in found if n.startswith("__bucket=")}

    def save(self, changed: writes.Tables, expected: int, label: str = "", books: DataFrame | None = None) -> int:
        """Store the changed tables beside the unchanged ones of revision ``expected``; Conflict if it isn't current any more.

        With ``books`` the changed tables hold what is in their buckets, and other buckets stay as they are."""
        if self.revision() != expected:
            raise sessions.Conflict(f"revision {self.revision()} is current, not {expected}")
        wanted = None if books is None else self._of(books)
        listed = [(f.name, f.bucket, f.path, f.kind) for f in self._files(expected)]
        for name, rows in changed.items():
            stay = [x for x in listed if x[0] == name and x[1] is not None and wanted is not None and x[1] not in wanted and x[2]]
            kinds = dict(rows.dtypes)
            if stay:  # columns that other books' files lack are read as null, and the other way round
                old = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(stay[0][3]).fields}
                if any(kinds.get(c, k) != k for c, k in old.items()):
                    raise ValueError(f"types of columns of {name} can't be changed for some books only")
                kinds = old | kinds
            kind = ", ".join(f"`{c}` {k}" for c, k in kinds.items())
            made = [(name, b, path, kind) for b, path in self._stored(name, rows).items()]
            listed = [x for x in listed if x[0] != name] + ([(*x[:3], kind) for x in stay] + made or [(name, None, None, kind)])
        rows = self.spark.createDataFrame([(*x, label) for x in sorted(listed, key=str)], _MANIFEST)
        return self.manifest.write(rows.coalesce(1), expected)

    def edit(self, make: Callable[[writes.Tables], writes.Tables], label: str = "", tries: int = 3, books: DataFrame | None = None) -> int:
        """Apply ``make`` to the current tables and save what it changed; after a Conflict from the newest ones again.

        With ``books`` only their buckets are read and written; ``make`` must not change other books."""
        for n in range(tries):
            at = self.revision()
            before = self.tables(at, books)
            after = make(before)
            try:
                return self.save({k: v for k, v in after.items() if v is not before.get(k)}, at, label, books)
            except sessions.Conflict:
                if n == tries - 1:
                    raise
        raise ValueError("tries must be at least 1")

    def undo(self, expected: int) -> int:
        """A new revision with the tables of the one before; at most editing.HISTORY steps are kept in view."""
        return self.manifest.undo(expected)

    def labels(self) -> list[tuple[int, str]]:
        """(revision, label) of the revisions that can be undone, the newest first."""
        now = self.revision()
        return [(v, self.manifest.read(v).first().label) for v in range(now, max(0, now - editing.HISTORY), -1)]


def chapter_evidence(t: writes.Tables, chapters: DataFrame) -> DataFrame:
    """Mentions of the chapters(book_id, chapter_id) with their scene's text and rank, in reading order."""
    s = writes.only(t["scenes"], chapters, {"book_id": "book_id", "chapter_id": "chapter_id"})
    rank = F.row_number().over(Window.partitionBy("book_id").orderBy("start_char", "end_char", "id"))
    scenes = s.withColumn("rank", rank).select("book_id", "chapter_id", F.col("id").alias("scene_id"), "rank", *[c for c in ("text", "text_hash") if c in s.columns])
    return t["mentions"].join(scenes, ["book_id", "scene_id"])


def pending_chapter_entities(t: writes.Tables) -> DataFrame:
    """Chapter entities without a decision."""
    return t["chapter_entities"].join(t["resolves"].select("book_id", F.col("chapter_entity_id").alias("id")), ["book_id", "id"], "left_anti")


def unresolved_mentions(t: writes.Tables) -> DataFrame:
    """Mentions that refer to no entity yet, for a flat resolution."""
    return t["mentions"].join(t["refers"].select("book_id", F.col("mention_id").alias("id")), ["book_id", "id"], "left_anti")


def book_entities(t: writes.Tables) -> DataFrame:
    """Book entities that some chapter entity resolves to."""
    return writes.only(t["book_entities"], t["resolves"], {"book_id": "book_id", "id": "book_entity_id"})


def scene_entities(t: writes.Tables) -> DataFrame:
    """(book_id, scene_id, entity_id): which book entities are mentioned in which scene, through their chapter entities."""
    own = t["chapter_entities"].select("book_id", F.col("id").alias("chapter_entity_id"), F.explode("mention_ids").alias("id"))
    placed = own.join(t["mentions"].select("book_id", F.col("id").cast("string").alias("id"), "scene_id"), ["book_id", "id"])
    return placed.join(t["resolves"].where("book_entity_id is not null"), ["book_id", "chapter_entity_id"]).select("book_id", "scene_id", F.col("book_entity_id").alias("entity_id")).distinct()


class EntityService:
    """Resolution of chapters and books over a library; the oracles are plain functions."""

    def __init__(self, library: Library, ask: Callable, ask_book: Callable, ask_pairs: Callable | None = None):
        self.library, self.ask, self.ask_book, self.ask_pairs = library, ask, ask_book, ask_pairs

    def resolve_chapters(self, chapters: DataFrame) -> int:
        """Entities of the chapters(book_id, chapter_id) made anew from their mentions."""

        def make(t: writes.Tables) -> writes.Tables:
            seen = chapter_evidence(t, chapters)
            scenes = seen.select("book_id", "chapter_id", F.col("scene_id").alias("id"), "rank", "text").distinct()
            made = resolution.resolve_chapters(seen.select(*t["mentions"].columns), scenes, self.ask, self.ask_pairs)
            made = made.withColumn("book_id", F.col("book_id").cast(dict(t["scenes"].dtypes)["book_id"])).withColumn("chapter_id", F.col("chapter_id").cast(dict(t["scenes"].dtypes)["chapter_id"]))
            return writes.replace_chapter_entities(t, chapters, seen.select("book_id", "id", "scene_text_hash"), made)

        return self.library.edit(make, "chapter entities", books=chapters)

    def resolve_books(self, books: DataFrame) -> int:
        """Book entities of the books(book_id) made anew, chapters in the order of their first scene."""

        def make(t: writes.Tables) -> writes.Tables:
            kind = dict(t["chapter_entities"].dtypes)["book_id"]
            source = writes.only(t["chapter_entities"], books, {"book_id": "book_id"})
            order = t["scenes"].groupBy("book_id", "chapter_id").agg(F.min("start_char").alias("order"))
            found = resolution.resolve_books(source.join(order, ["book_id", "chapter_id"]), self.ask_book, self.ask_pairs).withColumn("book_id", F.col("book_id").cast(kind))
            same = found.select("book_id", F.explode("sources").alias("chapter_entity_id"), F.col("id").alias("book_entity_id"), F.lit("resolved").alias("decision"))
            unsure = found.select("book_id", F.explode("uncertain").alias("chapter_entity_id"), F.lit(None).cast("string").alias("book_entity_id"), F.lit("uncertain").alias("decision"))
            kept = found.where("id is not null").drop("sources", "uncertain")
            return writes.replace_resolution(t, books, source.select("book_id", "id", "mention_ids"), same.unionByName(unsure), kept)

        return self.library.edit(make, "book entities", books=books)

    def presence(self) -> DataFrame:
        """(entity_id, scene_id, mention_count, reference_count) of the current tables."""
        t = self.library.tables()
        m = scene_entities(t).select("entity_id", "scene_id")
        mentions = m.join(t["mentions"].select("scene_id", F.col("id").alias("mention_id")), "scene_id")
        references = m.join(t["references"].select("scene_id", F.col("id").alias("reference_id")), "scene_id")
        return entities.presence(mentions, references)


def rebuild_index(library: Library, model: str, embed: Callable[[DataFrame], DataFrame] | None, books: DataFrame, chapters: DataFrame | None = None, report: dict | None = None) -> tuple[int, str]:
    """(revision, generation) after chunks and scene summaries of the books(book_id) are embedded and their full-text index is made.

    Vectors are kept by the hash of what was embedded, a chunk's context and text or a scene's title and summary; ``embed`` gets the misses
    (hash, text), each once, and adds a column ``embedding``. Without ``embed`` only vectors that are there count. chapters(book_id,
    chapter_id) bound what is embedded anew. Other books stay as they are. ``report`` is told how many texts were ``embedded``."""
    out: dict = {} if report is None else report

    def make(t: writes.Tables) -> writes.Tables:
        source = t["books"].join(books.select("book_id"), "book_id", "left_semi").join(t["index_state"].select("book_id", "generation"), "book_id", "left").select("book_id", "revision", "text_hash", "generation")
        chunks, scenes = indexing.chunk_inputs(t, books), indexing.scene_inputs(t, books)
        wanted = indexing.misses(chunks, scenes, indexing.cached(t, books), model, chapters)
        path = f"{library.path}/embedded/{uuid.uuid4().hex}"  # asked for once, whatever is read how often
        made = (embed(wanted) if embed else wanted.limit(0).withColumn("embedding", F.lit(None).cast("array<double>"))).select("hash", F.col("embedding").cast("array<double>").alias("embedding"))
        made.write.parquet(path)
        fresh = library.spark.read.parquet(path)
        out["embedded"] = fresh.count()
        vectors = indexing.vectors(fresh, indexing.cached(t, books), model)
        after, out["generation"] = writes.replace_index(t, source, indexing.with_vectors(chunks, vectors, model), indexing.with_vectors(scenes, vectors, model), model)
        blocks, stats = fulltext.build(fulltext.postings(chunks))
        for name, rows in (("postings", blocks), ("posting_stats", stats)):
            after[name] = writes.replaced(t[name], rows, books, ["book_id"]) if name in t else rows
        return after

    return library.edit(make, "index", books=books), out["generation"]
