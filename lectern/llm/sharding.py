"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked. Each starts in a shard by its hash. Then, in each round, a document moves to the shard that holds most
bytes of its group, as far as that shard's quota of QUOTA equal parts goes, until none is admitted. Who is admitted is decided by running
sums over a fixed number of buckets, in the order of group sizes (powers of two) and hashes. Documents without
links then fill the shards towards equal sizes, by running sums again. Groups are votes for each (group, shard); no
pairs are made.

At last all rows are laid on a line, shard by shard and group by group, which is cut into equal sizes: an overfull shard
sheds to its neighbours, and at most one group a cut is parted. So sizes differ by one document at most, whatever the table holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import common

#: Buckets of the running sums: of groups times of rows for the quotas, and at most for fillers and slots.
GROUP_BUCKETS, ROW_BUCKETS, BUCKETS = 16, 64, 1 << 16
#: Equal parts of all bytes that a shard holds at most while labels move; ties between labels go to the smaller, so one gathers more than its part.
QUOTA = 3
#: Groups below this part of a shard aren't parted by the last cuts.
WHOLE = 0.004
#: Rows of one bucket, about, until there are BUCKETS of them.
BUCKET_ROWS = 1000


def _bucket(n: int, salt: int) -> Column:
    return F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")


def _loads(linked: DataFrame, shards: int) -> list[int]:
    found = {r.shard: r.load for r in linked.groupBy("shard").agg(F.sum("size").alias("load")).collect()}  # one row a shard
    return [found.get(s, 0) for s in range(shards)]


def _by_rooms(at: Column, rooms: list[float]) -> Column:
    """The shard of a place on a line along which the shards take ``rooms`` one after the other."""
    place = F.lit(len(rooms) - 1)
    for s in range(len(rooms) - 1, -1, -1):
        place = F.when(at < F.lit(float(sum(rooms[: s + 1]))), F.lit(s)).otherwise(place)
    return place.cast("int")


def _started(rows: DataFrame, groups: DataFrame, shards: int) -> DataFrame:
    """Linked rows (row, g, size, shard), each in a shard by its own hash: the labels that the rounds start from."""
    return rows.select("row", "g", "size").join(groups.select("g"), "g", "left_semi").withColumn("shard", _bucket(shards, 7))


def propagate(linked: DataFrame, shards: int, capacity: int) -> DataFrame:
    """linked(row, g, size, shard) with shards after label propagation; no quota is exceeded by a move.

    A move joins a part of a group to one at least as large, so the sum of squares of the parts grows and the rounds end."""
    while True:
        room = [capacity - x for x in _loads(linked, shards)]
        rooms = F.array(*[F.lit(max(0, x)).cast("long") for x in room])
        votes = linked.groupBy("g", "shard").agg(F.sum("size").alias("vote"), F.max("size").alias("one"))
        fits = F.when(F.get(rooms, F.col("shard")) >= F.col("one"), F.struct("vote", (-F.col("shard")).alias("order")))
        best = votes.groupBy("g").agg(F.max(fits).alias("best"), F.count("*").alias("parts"), F.floor(F.log2(F.sum("vote"))).cast("int").alias("class")).where("parts > 1 and best is not null").select("g", "class", F.col("best.vote").alias("top"), (-F.col("best.order")).alias("want"))
        moves = votes.select("g", "shard", "vote").join(best, "g").where("shard <> want and (top > vote or (top = vote and want < shard))").select("g", "shard", "want", "class")
        asked = linked.join(moves, ["g", "shard"], "left").withColumns({"gb": F.pmod(F.xxhash64("g", F.lit(5)), F.lit(GROUP_BUCKETS)).cast("int"), "rb": _bucket(ROW_BUCKETS, 6)})
        asked = common.materialise(asked, "asked")
        sums = asked.where("want is not null").groupBy("want", "class", "gb", "rb").agg(F.sum("size").alias("bytes"))
        running = sums.withColumn("until", F.sum("bytes").over(Window.partitionBy("want").orderBy("class", "gb", "rb")))
        admitted = running.where(F.col("until") <= F.get(rooms, F.col("want"))).select("want", "class", "gb", "rb", F.lit(True).alias("go"))
        # bounded: shards x 64 classes x GROUP_BUCKETS x ROW_BUCKETS rows of a few bytes
        moved = asked.join(F.broadcast(admitted), ["want", "class", "gb", "rb"], "left")
        linked = common.materialise(moved.select("row", "g", "size", F.when(F.col("go"), F.col("want")).otherwise(F.col("shard")).cast("int").alias("shard"), F.coalesce("go", F.lit(False)).alias("moved")), "linked")
        done = not linked.where("moved").head(1)
        common.drop(asked)
        linked = linked.drop("moved")
        if done:
            return linked


def _giants(rows: DataFrame, shards: int, total: int) -> list:
    """Rows that fill a shard by themselves: as large as an equal part of all but the larger ones, fewer than ``shards``."""
    out, left = [], total
    for r in rows.select("row", "size").orderBy(F.desc("size"), "row").limit(shards - 1).collect():  # bounded: fewer than shards rows
        if r["size"] * (shards - len(out)) < left:
            break
        out.append(r)
        left -= r["size"]
    return out


def level(every: DataFrame, groups: DataFrame, shards: int, total: int, count: int) -> DataFrame:
    """Rows of every(row, g, size, shard, linked, ...) with shards of equal sizes, in the order of the shards given.

    groups(g, n) are the groups of the linked rows. Giant rows have a shard of their own; the others lie on a line by
    (shard, place of their group, row). Rows without links lie at both ends of a shard's part, so that cuts meet them first;
    a group below the part WHOLE of a shard falls to one side of a cut.
    The running sums take one task about 3 x BUCKETS rows a shard at most, others about count / BUCKETS rows."""
    giants = _giants(every, shards, total)
    own = {r.row: s for r, s in zip(giants, range(shards - 1, -1, -1), strict=False)}
    rest, mean = shards - len(giants), (total - sum(r["size"] for r in giants)) / (shards - len(giants))
    most = max(BUCKET_ROWS, count // BUCKETS)
    buckets = max(1, min(BUCKETS, count // most))
    many = groups.where(F.col("n") > most).select("g", F.ceil(F.col("n") / most).alias("parts"))  # at most BUCKETS rows
    giant = F.col("row").isin(list(own)) if own else F.lit(False)
    lined = every.where(~giant).join(F.broadcast(many), "g", "left")
    kind = F.when(F.col("linked"), 1).otherwise(F.pmod(F.col("g"), F.lit(2)) * 2)
    # a bucket holds small groups or a part of a large one
    lined = lined.withColumns({
        "kind": kind.cast("int"), "gb": F.pmod(F.xxhash64("g", F.lit(11)), F.lit(buckets)).cast("int"),
        "big": F.when(F.col("parts").isNotNull(), F.col("g")), "part": F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("row", F.lit(12)), F.col("parts"))),
    })
    place = ["shard", "kind", "gb", "big", "part"]
    lined = common.materialise(lined.drop("parts").withColumn("bucket", F.xxhash64(*place)), "lined")
    sums = lined.groupBy("bucket", *place).agg(F.sum("size").alias("s"))
    before = sums.select("bucket", (F.sum("s").over(Window.orderBy(*place, "bucket")) - F.col("s")).alias("before"))
    until, part = F.sum("size").over(Window.partitionBy("bucket").orderBy("g")), F.sum("size").over(Window.partitionBy("bucket", "g"))
    each = F.sum("size").over(Window.partitionBy("bucket").orderBy("g", "row")) - F.col("size") / 2
    within = F.when(F.col("big").isNull() & (part <= F.lit(WHOLE * mean)), until - part / 2).otherwise(each)
    at = lined.withColumn("within", within).join(common.materialise(before, "before"), "bucket").withColumn("at", F.col("before") + F.col("within"))
    cut = at.withColumn("shard", F.least(F.lit(rest - 1), F.floor(F.col("at") / F.lit(max(mean, 1e-9)))).cast("int")).select(*every.columns)
    if not own:
        return cut
    homes = F.create_map(*[F.lit(x) for pair in own.items() for x in pair])
    return cut.union(every.where(giant).withColumn("shard", F.try_element_at(homes, F.col("row")).cast("int")).select(*every.columns))


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one per row of docs(doc_id, text).

    The law is ``bytes``: sizes (UTF-8 bytes plus 1) are equal but for one document; equal texts share a shard but where
    a cut parts them. Documents larger than an equal part have a shard of their own, and the others share the rest equally.
    Slots are gapless from 0 in each shard. A null text counts as empty and is linked
    with empty ones; null ids and repeated rows are placed like any row. An empty table gives an
    empty result; other columns are ignored."""
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("crc"), F.xxhash64(body).alias("h"))
    rows = common.materialise(rows.withColumn("g", F.xxhash64("h", "crc", "size")), "rows")
    # written, so that both sides of its joins are plain exchanges and a very large group is split
    groups = common.materialise(rows.groupBy("g").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).where("n > 1"), "groups")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    buckets = min(BUCKETS, max(16, total.n // BUCKET_ROWS))

    held = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    capacity = max(-(-total.bytes // shards), int(1.02 * held / shards))
    linked = propagate(common.materialise(_started(rows, groups, shards), "linked"), shards, QUOTA * capacity)

    loads = _loads(linked, shards)
    room = [max(0, capacity - x) for x in loads]
    free = max(1, sum(room))
    rest = total.bytes - held
    single = rows.join(groups, "g", "left_anti").withColumn("b", _bucket(buckets, 4))
    sums = single.groupBy("b").agg(F.sum("size").alias("s"))
    before = sums.select("b", (F.sum("s").over(Window.orderBy("b")) - F.col("s")).alias("before"))  # at most BUCKETS rows
    within = F.sum("size").over(Window.partitionBy("b").orderBy("row")) - F.col("size") / 2
    at = single.withColumn("within", within).join(before, "b").withColumn("at", F.col("before") + F.col("within"))
    names = ("row", "doc_id", "g", "size", "crc")
    filled = at.select(*names, _by_rooms(F.col("at"), [rest * x / free for x in room]).alias("shard"), F.lit(False).alias("linked"))
    kept = rows.select(*names).join(linked.select("row", "shard", F.lit(True).alias("linked")), "row")
    placed = level(common.materialise(filled.union(kept), "filled"), groups.select("g", "n"), shards, total.bytes, total.n)
    every = common.materialise(placed.withColumn("b", _bucket(buckets, 8)), "placed")
    counts = every.groupBy("shard", "b").count().select("shard", "b", (F.sum("count").over(Window.partitionBy("shard").orderBy("b")) - F.col("count")).alias("before"))
    slot = F.row_number().over(Window.partitionBy("shard", "b").orderBy("row")) - 1
    out = every.withColumn("k", slot).join(counts, ["shard", "b"])
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("k")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near equal bytes, equal texts together."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
