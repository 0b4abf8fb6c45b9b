"""Shared storage, stable keys and connected components for the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sorts after every real id; stands for a null doc_id inside operators.
LAST = 2**63 - 1

_local_base: dict[str, str] = {}
#: Folders that tables are written to while ``written`` makes one.
_scopes: list[str] = []


def workspace(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent a temporary folder is made, in local mode only."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _local_base.get(sc.applicationId)
        if base is None:
            path = tempfile.mkdtemp(prefix="lectern-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
            base = _local_base[sc.applicationId] = f"file://{path}"
    if _scopes:
        base = _scopes[-1]
    return f"{base.rstrip('/')}/lectern-{uuid.uuid4().hex}"


def written(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """The frame that ``make`` gives, materialised; all tables that were written for it are deleted."""
    path, scope = f"{workspace(spark)}/{label}", workspace(spark)
    _scopes.append(scope)
    try:
        df = make()
        df.write.parquet(path)
    finally:
        _scopes.remove(scope)
        _delete(spark, scope)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write df as Parquet in the shared folder and read it again; this cuts its lineage."""
    path = f"{workspace(df.sparkSession)}/{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*frames: DataFrame) -> None:
    """Delete the files of materialised frames that nothing reads any more."""
    for df in frames:
        for folder in {f.rsplit("/", 2)[0] for f in df.inputFiles()}:
            if "/lectern-" in folder:
                _delete(df.sparkSession, folder)


#: Variables of a module are copied into functions that are sent to workers, so these are got from functions of their modules, which aren't.
_caches: list[dict] = []


def only(cache: dict | None = None) -> None:
    """Keep this word cache, or none, and let those of other operators go: a Python worker serves one operator after another."""
    for c in _caches:
        if c is not cache and c:
            c.clear()
            trim()
    if cache is not None and not any(c is cache for c in _caches):
        _caches.append(cache)


def trim() -> None:
    """Give memory that Arrow and the C library keep for later back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # another C library keeps its memory
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], cache: Callable[[], dict] | None = None):
    """``run``, a function of a Python worker, which keeps no word cache but ``cache()`` and gives memory back at the end of its task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(cache() if cache else None)
        yield from run(batches)
        trim()

    return whole


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until df has no column of that name in any case."""
    have = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name in have:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    """The session's shuffle parallelism."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def order_key(column: str | Column) -> Column:
    """doc_id as a non-null long; null sorts last."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(LAST)).cast("long")


def labelled(docs: DataFrame, labels: DataFrame, label: str, usable: Column, each: int) -> DataFrame:
    """At most ``each`` labelled rows (key, y, text) of either class, those of the smallest hashes of doc_id, whatever their size.

    Only ids within the bound are sent to the executors; conflicting labels of one id and ids of
    no row are left out, repeated rows count once. ``key`` is an order of its own that mixes the classes."""
    rows = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).where(usable)
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top")
    key = F.xxhash64(F.col("doc_id"))
    ids = rows.where("y = 1").orderBy(key, "doc_id").limit(each).union(rows.where("y = 0").orderBy(key, "doc_id").limit(each)).select("doc_id", "y")
    # bounded: 2 x each ids
    found = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select(F.xxhash64("doc_id", F.lit(7)).alias("key"), "y", "text")


def stream(df: DataFrame, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of a materialised frame on the driver, file by file and ``size`` at a time; nothing else is held."""
    for file in sorted(df.inputFiles()):
        fs, path = FileSystem.from_uri(file)
        with fs.open_input_file(path) as f:
            yield from pq.ParquetFile(f).iter_batches(size, columns=df.columns)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; null when doc_id is null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a long, b long): rows (node, root), root the smallest node.

    Hook to the smallest neighbour, jump pointers until the trees are flat, contract the edges,
    repeat. Each round at least halves what is left, so the number of rounds is logarithmic
    even for long chains. Only counters reach the driver."""
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    total = None
    while left.head(1):
        hook = materialise(both(left).groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "hook")
        while True:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("above"))
            nxt = materialise(hook.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "jump")
            done = not nxt.where("moved").head(1)
            drop(hook)
            hook = nxt.select("node", "root")
            if done:
                break
        if total is None:
            total = hook
        else:
            step = hook.select(F.col("node").alias("root"), F.col("root").alias("new"))
            total = materialise(total.join(step, "root", "left").select("node", F.coalesce("new", "root").alias("root")), "labels")
        at = lambda n, h: h.select(F.col("node").alias(n), F.col("root").alias(f"{n}_root"))
        rest = materialise(
            left.join(at("a", hook), "a").join(at("b", hook), "b")
            .where("a_root <> b_root")
            .select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b"))
            .distinct(),
            "edges",
        )
        drop(left)
        left = rest
    return total if total is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))
