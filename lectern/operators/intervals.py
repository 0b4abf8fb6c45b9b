"""Interval algebra: overlap joins, containment, subtraction, islands and tilings of half-open ranges.

Frames name their bounds start_char and end_char; ``by`` lists the columns (such as book_id) that
ranges must share. Empty ranges take no part in overlaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(a: DataFrame, b: DataFrame) -> Column:
    """Condition that ranges of a and b share a place."""
    return (a.start_char < b.end_char) & (a.end_char > b.start_char)


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], width: int, keep: tuple[str, str] = ("left_", "right_")) -> DataFrame:
    """Pairs of overlapping ranges, by an equi-join on buckets of ``width`` places.

    A range is repeated for each bucket it touches; a pair is taken in the bucket of the larger start,
    so no pair comes twice and no distinct is needed. Other columns get the prefixes ``keep``. ``width`` near
    the usual length of the ranges keeps both the repetition and the buckets small."""

    def dealt(df: DataFrame, prefix: str) -> DataFrame:
        named = df.where("end_char > start_char").select(*by, *[F.col(c).alias(prefix + c) for c in df.columns if c not in by])
        first, last = F.floor(F.col(f"{prefix}start_char") / width), F.floor((F.col(f"{prefix}end_char") - 1) / width)
        return named.withColumn("__bucket", F.explode(F.sequence(first, last)))

    p, q = keep
    both = dealt(left, p).join(dealt(right, q), [*by, "__bucket"])
    a, b = F.col(f"{p}start_char"), F.col(f"{q}start_char")
    meet = (a < F.col(f"{q}end_char")) & (F.col(f"{p}end_char") > b)
    return both.where(meet & (F.floor(F.greatest(a, b) / width) == F.col("__bucket"))).drop("__bucket")


def clip(df: DataFrame, low: Column, high: Column) -> DataFrame:
    """Ranges cut to [low, high); what becomes empty goes."""
    return df.withColumns({"start_char": F.greatest("start_char", low), "end_char": F.least("end_char", high)}).where("start_char < end_char")


def merge(df: DataFrame, by: list[str], touching: bool = False) -> DataFrame:
    """Islands: the unions of overlapping (with ``touching``: or adjacent) ranges, and the number of ranges in each."""
    order = Window.partitionBy(*by).orderBy("start_char", "end_char")
    reach = F.max("end_char").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("start_char") > reach if touching else F.col("start_char") >= reach
    marked = df.withColumn("__new", F.when(new | reach.isNull(), 1).otherwise(0))
    marked = marked.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "__island").agg(F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"), F.count("*").alias("n_ranges")).drop("__island")


def subtract(base: DataFrame, holes: DataFrame, by: list[str]) -> DataFrame:
    """What is left of each base range (one for each ``by``) without the holes, in order, adjacent ranges unmerged."""
    b = base.select(*by, F.col("start_char").alias("__low"), F.col("end_char").alias("__high"))
    cut = holes.select(*by, "start_char", "end_char").join(b, by)
    cut = cut.where("start_char < __high and end_char > __low and start_char < end_char")
    ends = b.select(*by, F.col("__high").alias("start_char"), F.col("__high").alias("end_char"), "__low", "__high")
    order = Window.partitionBy(*by).orderBy("start_char", "end_char").rowsBetween(Window.unboundedPreceding, -1)
    every = cut.select(*by, "start_char", "end_char", "__low", "__high").unionByName(ends)
    gaps = every.select(*by, F.greatest("__low", F.coalesce(F.max("end_char").over(order), F.col("__low"))).alias("__from"), F.least("start_char", "__high").alias("__to"))
    return gaps.where("__from < __to").select(*by, F.col("__from").alias("start_char"), F.col("__to").alias("end_char"))


def tiling_violations(df: DataFrame, by: list[str]) -> DataFrame:
    """Neighbouring ranges that leave a gap or overlap: (by, end of the one, start of the next, kind)."""
    order = Window.partitionBy(*by).orderBy("start_char", "end_char")
    pairs = df.select(*by, F.lag("end_char").over(order).alias("previous_end"), "start_char")
    kind = F.when(F.col("previous_end") < F.col("start_char"), "gap").when(F.col("previous_end") > F.col("start_char"), "overlap")
    return pairs.withColumn("kind", kind).where("kind is not null")


def smallest_container(points: DataFrame, ranges: DataFrame, by: list[str], key: str, width: int) -> DataFrame:
    """For each row of points (with a unique ``key``) the shortest range that contains it, ties to the first start."""
    pairs = overlap_join(points, ranges, by, width).where("right_start_char <= left_start_char and right_end_char >= left_end_char")
    order = Window.partitionBy(*by, f"left_{key}").orderBy(F.col("right_end_char") - F.col("right_start_char"), "right_start_char")
    return pairs.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
