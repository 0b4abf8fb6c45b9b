import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import xxhash

from lectern.llm import sharding


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, shard int, law string")
    got = sharding.shard(df).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == sorted(((d, size(t), zlib.crc32((t or "").encode())) for d, t in rows), key=str)
    slots = defaultdict(list)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    load = Counter()
    for r in got:
        load[r.shard] += r["size"]
    return got, [load[s] for s in range(8)]


def test_balance_and_groups(spark):
    rng = random.Random(1)
    rows = [(i, "w" * rng.randint(1, 400) + str(i)) for i in range(4000)]
    for g in range(60):
        text = f"group {g} " * rng.randint(1, 40)
        rows += [(10000 + 100 * g + k, text) for k in range(rng.randint(2, 12))]
    rows += [(20000 + k, "hot " * 25) for k in range(2000)]  # too large for one shard
    rows += [(30000, None), (30001, ""), (None, "x"), (None, None), (5, rows[5][1])]
    got, load = run(spark, rows)
    assert max(load) - min(load) <= 0.01 * sum(load) / 8
    text = dict(rows)
    where = defaultdict(set)
    for r in got:
        if r.doc_id is not None:
            where[text[r.doc_id]].add(r.shard)
    split = sum(len(s) > 1 for t, s in where.items() if t != "hot " * 25)
    assert split <= 7 and len(where["hot " * 25]) <= 8


def test_small_tables(spark):
    assert run(spark, [])[0] == []
    run(spark, [(1, "a")])
    run(spark, [(1, None), (1, None), (None, None)])
    _, load = run(spark, [(i, "same") for i in range(800)])
    assert load == [500] * 8
    _, load = run(spark, [(i, "x" * i) for i in range(9)])
    assert sum(x > 0 for x in load) == 8


def test_sizes_are_equal_but_for_a_document(spark):
    """Pairs of skewed sizes, heavy tails, giants and one dominating or very long document."""
    rng = random.Random(8)
    pairs = [(2 * i + k, f"{i} " + "w" * int(20 * rng.paretovariate(1.1) % 5000)) for i in range(1500) for k in range(1)]
    pairs += [(d + 1, t) for d, t in pairs]
    tails = [(i, f"{i} " + "w" * int(20 * rng.paretovariate(1.1) % 20000)) for i in range(3000)]
    giants = [(i, f"{i} " + "w" * (200_000 if i < 3 else 90_000 if i == 3 else 50)) for i in range(2000)]
    long = [(0, "v" * 3_000_000), (1, "v" * 3_000_000)] + [(i, f"{i}") for i in range(2, 500)]
    for rows, own in ((pairs, 0), (tails, 0), (giants, 4), (long, 2)):
        sizes = sorted((len(t) + 1 for _, t in rows), reverse=True)
        _, load = run(spark, rows)
        rest = sorted(load, reverse=True)[own:]
        assert max(rest) - min(rest) <= max(sizes[own], 0.01 * sum(load) / 8)
        assert sorted(load, reverse=True)[:own] == sizes[:own]


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def mix(*values):
    """xxhash64 of longs and integers as the SQL function chains it."""
    h = 42
    for v, wide in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q" if wide else "<i", v), h)
    return signed(h)


def plain_propagate(rows, shards, capacity):
    """The rounds in plain Python: {row: shard} of rows (row, g, size, shard)."""
    at = {r: s for r, _, _, s in rows}
    while True:
        load = Counter()
        for r, _, n, _ in rows:
            load[at[r]] += n
        room = [capacity - load[s] for s in range(shards)]
        vote, one = Counter(), Counter()
        for r, g, n, _ in rows:
            vote[g, at[r]] += n
            one[g, at[r]] = max(one[g, at[r]], n)
        want, level = {}, {}
        for g in {g for _, g, _, _ in rows}:
            mine = [s for s in range(shards) if (g, s) in vote]
            fits = [(vote[g, s], -s) for s in mine if max(0, room[s]) >= one[g, s]]
            if len(mine) > 1 and fits:
                top, best = max(fits)
                level[g] = int(math.log2(sum(vote[g, s] for s in mine)))
                for s in mine:
                    if s != -best and (top > vote[g, s] or top == vote[g, s] and -best < s):
                        want[g, s] = -best
        asked, cell = Counter(), {}
        for r, g, n, _ in rows:
            if (g, at[r]) in want:
                cell[r] = (want[g, at[r]], level[g], mix((g, True), (5, False)) % sharding.GROUP_BUCKETS, mix((r, True), (6, False)) % sharding.ROW_BUCKETS)
                asked[cell[r]] += n
        go, sums = set(), Counter()
        for c in sorted(asked):
            sums[c[0]] += asked[c]
            if sums[c[0]] <= max(0, room[c[0]]):
                go.add(c)
        moved = [r for r, c in cell.items() if c in go]
        for r in moved:
            at[r] = cell[r][0]
        if not moved:
            return at


def test_rounds_against_plain_ones(spark):
    rng = random.Random(12)
    rows = []
    for g in range(60):
        size = rng.randint(5, 60)
        rows += [(len(rows) + k, 1000 + g, size, rng.randrange(4)) for k in range(rng.randint(2, 15))]
    capacity = int(1.1 * sum(r[2] for r in rows) / 4)
    df = spark.createDataFrame(rows, "row long, g long, size long, shard int")
    got = {r.row: r.shard for r in sharding.propagate(df, 4, capacity).collect()}
    want = plain_propagate(rows, 4, capacity)
    assert got == want and sum(got[r[0]] != r[3] for r in rows) > 50


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    plan = sharding.shard(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_groups_stay_whole_where_every_text_has_a_copy(spark):
    rng = random.Random(6)
    for copies in (2, 5):
        texts = [f"{i} " + "w" * rng.randint(80, 120) for i in range(4000 // copies)]
        rows = [(10 * i + k, t) for i, t in enumerate(texts) for k in range(copies)]
        got, load = run(spark, rows)
        text, where = dict(rows), defaultdict(set)
        for r in got:
            where[text[r.doc_id]].add(r.shard)
        assert sum(len(s) > 1 for s in where.values()) <= 7
        assert max(load) - min(load) <= 0.01 * sum(load) / 8
    rows = [(100 * g + k, f"{g} " + "v" * 50 * (g + 1)) for g in range(40) for k in range(20)]  # large groups, no other rows
    got, load = run(spark, rows)
    where = defaultdict(set)
    for r in got:
        where[r.doc_id // 100].add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) <= 14 and max(load) - min(load) <= max(len(t) + 1 for _, t in rows)


def test_propagation_gathers_the_groups(spark, monkeypatch):
    """The rounds, not the start, bring equal texts together: labels before and after them."""
    seen, rounds = [], sharding.propagate

    def watched(linked, shards, capacity):
        out = rounds(linked, shards, capacity)
        seen.append([{(r.row, r.g): r.shard for r in df.collect()} for df in (linked, out)])
        return out

    monkeypatch.setattr(sharding, "propagate", watched)
    run(spark, [(10 * g + k, f"text {g} " * 9) for g in range(300) for k in range(3)])
    before, after = seen[0]
    parts = lambda labels: len({(g, s) for (_, g), s in labels.items()})
    assert len(before) == len(after) == 900 and parts(before) > 600 and parts(after) == 300
    assert sum(before[x] != after[x] for x in before) > 300
