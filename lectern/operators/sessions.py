"""Versioned tables with compare-and-swap, search sessions, chats, reply caches and budgets.

A store is a folder with one subfolder for each version; a write makes the next one by a rename, which succeeds only if the
expected version is still the last. Nothing else has to be written, so a writer that dies leaves no half version. All file work goes through Hadoop's FileSystem, so any
store that Spark reads will do.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer was first, or the text has changed."""


class VersionedTable:
    """A table whose every version is whole; readers never see a half-written one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The current version; 0 before the first write."""
        if not self._fs.exists(self._path(self.path)):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        return max((int(n[1:]) for n in names if re.fullmatch(r"v\d+", n)), default=0)

    def _folder(self, version: int) -> str:
        return f"{self.path}/v{version}"

    def read(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        if not v:
            raise FileNotFoundError(self.path)
        return self.spark.read.parquet(self._folder(v))

    def write(self, df: DataFrame, expected: int) -> int:
        """Store df as version expected + 1; Conflict if the current version isn't ``expected``.

        The data are written aside and the version's folder is made by one rename, which only one writer wins."""
        if self.version() != expected:
            raise Conflict(f"version {self.version()} is current, not {expected}")
        aside = f"{self.path}/_new-{uuid.uuid4().hex}"
        df.write.parquet(aside)
        target = self._path(self._folder(expected + 1))
        if self._fs.exists(target) or not self._fs.rename(self._path(aside), target):
            self._fs.delete(self._path(aside), True)
            raise Conflict(f"version {expected + 1} is there already")
        return expected + 1

    def undo(self, expected: int) -> int:
        """Store the version before the current one anew; the history stays whole."""
        if expected < 2:
            raise Conflict("there is nothing to undo")
        return self.write(self.read(expected - 1), expected)


def latest(rows: DataFrame, by: list[str], *order) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(o) for o in order])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """old with the rows of new in place of those of the same key."""
    return old.join(new.select(*by), by, "left_anti").unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """old and the rows of new whose key it lacks; of repeated new keys one."""
    return old.unionByName(new.dropDuplicates(by).join(old.select(*by), by, "left_anti"))


def append_messages(messages: DataFrame, new: DataFrame) -> DataFrame:
    """messages(conversation_id, position, role, text) and new ones (conversation_id, seq, role, text) at the next positions."""
    top = messages.groupBy("conversation_id").agg(F.max("position").alias("top"))
    w = Window.partitionBy("conversation_id").orderBy("seq")
    numbered = new.withColumn("k", F.row_number().over(w)).join(top, "conversation_id", "left")
    return messages.unionByName(numbered.select("conversation_id", (F.coalesce("top", F.lit(0)) + F.col("k")).cast(dict(messages.dtypes)["position"]).alias("position"), "role", "text"))


def chat_titles(messages: DataFrame) -> DataFrame:
    """(conversation_id, title): the first 60 characters of the first message of a user."""
    first = messages.where("role = 'user'").groupBy("conversation_id").agg(F.min_by("text", "position").alias("t"))
    return first.select("conversation_id", F.substring(F.trim("t"), 1, 60).alias("title"))


def recent(sessions: DataFrame, book: str, offset: int = 0, limit: int = 20) -> DataFrame:
    """Sessions(search_id, book_id, updated_at, items array<struct<viewed,review_status,selected>>) of a book, newest first, with counters."""
    count = lambda f: F.size(F.filter("items", f))
    rows = sessions.where(F.col("book_id") == book).select("search_id", "updated_at", F.size("items").alias("n_items"), count(lambda x: x["viewed"]).alias("n_viewed"), *[_status(s) for s in ("relevant", "uncertain", "rejected", "unreviewed")], count(lambda x: x["selected"]).alias("n_selected"))
    return rows.orderBy(F.desc("updated_at"), F.desc("search_id")).offset(offset).limit(limit)


def _status(s: str):
    return F.size(F.filter("items", lambda x: x["review_status"] == F.lit(s))).alias(f"n_{s}")


def cache_key(*parts):
    """Key of a request: the hash of its parts (prompt, payload, model, endpoint, limits) in order, null parts included."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts])), 256)


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct requests whose key the cache lacks."""
    return requests.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def within_budget(requests: DataFrame, calls: int, tokens: int, order: str = "seq") -> DataFrame:
    """requests(run_id, seq, tokens) with ``allowed``: while calls and reserved tokens last; the first that doesn't fit ends a run."""
    w = Window.partitionBy("run_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return requests.withColumn("allowed", (F.count("*").over(w) <= calls) & (F.sum("tokens").over(w) <= tokens))


def reserve(text, output: int):
    """Tokens to set aside for a request: a tenth more than a rough count, 128 more and the output."""
    return (F.ceil(1.1 * F.size(F.split(text, r"\s+"))) + 128 + output).cast("long")


def history_tail(messages: DataFrame, by: str, order: str, size, budget: int) -> DataFrame:
    """The newest messages of users and assistants while their sizes fit the budget; the first overflow ends the tail."""
    w = Window.partitionBy(by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return messages.where(F.col("role").isin("user", "assistant")).withColumn("tokens_to_end", F.sum(size).over(w)).where(F.col("tokens_to_end") <= budget)


def counters(items: DataFrame) -> DataFrame:
    """(search_id, items, viewed, rejected, last) of items(search_id, viewed, review_status, at)."""
    n = lambda c: F.sum(c.cast("long"))
    return items.groupBy("search_id").agg(F.count("*").alias("items"), n(F.col("viewed")).alias("viewed"), n(F.col("review_status") == "rejected").alias("rejected"), F.max("at").alias("last"))
