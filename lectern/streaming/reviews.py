"""Review events as a stream: the last verdict of each item, and counts in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import sessions


def counts(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, status, n) of a stream events(ts, status); what comes later than ``late`` is left out by the watermark."""
    kept = events.withWatermark("ts", late)
    return kept.groupBy(F.window("ts", window).alias("w"), "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "status", "n")


def upsert_into(table: sessions.VersionedTable):
    """A function for writeStream.foreachBatch: the last event of each (search_id, id) replaces the stored one.

    A batch that was stored already (by its number) is skipped, so a restart repeats nothing."""

    def run(batch: DataFrame, number: int) -> None:
        version = table.version()
        last = sessions.latest(batch, ["search_id", "id"], "ts").withColumn("batch", F.lit(number).cast("long"))
        if version:
            old = table.read()
            if (old.agg(F.max("batch")).first()[0] or -1) >= number:
                return
            newer = last.join(old.select("search_id", "id", F.col("ts").alias("had")), ["search_id", "id"], "left").where("had is null or ts >= had").drop("had")
            last = sessions.upsert(old, newer, ["search_id", "id"])
        table.write(last, version)

    return run
