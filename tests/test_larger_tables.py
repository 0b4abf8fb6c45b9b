"""Queries on small tables made like the larger or odder ones on which they failed, against their DuckDB oracles."""

import glob
import os

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.operators import entities, fulltext, narrative, related, structure, vectors
from lectern.plans import catalogue, graph_queries
from lectern.sources import html

SF = "/root/testdata/sf0.001"


def equal(spark, sf_dir, name):
    """The query's rows in sf_dir, which must be those of its SQL."""
    duck = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}/*.parquet'")
    df = catalogue.QUERIES[name](spark, str(sf_dir))
    cols = sorted(df.columns)
    got = sorted(repr([r[c] for c in cols]) for r in df.collect())
    found = duck.execute(catalogue.ORACLES[name])
    at = [[d[0] for d in found.description].index(c) for c in cols]
    assert got == sorted(repr([r[i] for i in at]) for r in found.fetchall())
    return got


@pytest.mark.parametrize("name", ["q_layer_cascade", "q_cascade_layers"])
def test_places_beyond_an_int(spark, tmp_path, name):
    far = 9_000_000  # a scene's place is a thousand times its key
    spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey < 200").withColumn("o_orderkey", F.col("o_orderkey") + far).write.parquet(f"{tmp_path}/orders.parquet")
    spark.read.parquet(f"{SF}/lineitem.parquet").where("l_orderkey < 200").withColumn("l_orderkey", F.col("l_orderkey") + far).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert equal(spark, tmp_path, name)


@pytest.mark.parametrize("name", ["q_agent_context", "q_next_blocks"])
def test_halves_go_to_the_even_number(spark, tmp_path, name):
    rows = [(i, f"Customer#{(i * 37) % 100:03d}", 2 * (i % 2), x, "BUILDING") for i, x in enumerate([0.5, -0.5, 1.5, 2.5, 0.0, 2.0, 1.0, 3.0, -1.5, -2.5, -2.0, 4.5] * 8)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    assert equal(spark, tmp_path, name)


def test_names_that_many_parts_have(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graph_queries, "NAME_PARTS", 3)  # few parts of a name in one place
    names = ["red bolt", "bolt red", "red", "", None, "red bolt nut", "nut", "Red_1 bolt nut cap", "cap"]
    rows = [(i, names[i * i % 9], f"B{i % 2}" if i % 11 else None) for i in range(200)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    assert equal(spark, tmp_path, "q_name_jaccard")


def test_names_meet_once_however_many_parts_have_them(spark, tmp_path):
    # 8,000 parts of 8 names of one brand: 4 million pairs are found, the 28 million that only share a word are not made
    spark.range(8000).select(F.col("id").alias("p_partkey"), F.concat_ws(" ", F.lit("red"), F.concat(F.lit("w"), F.col("id") % 8)).alias("p_name"), F.lit("B").alias("p_brand")).write.parquet(f"{tmp_path}/part.parquet")
    found = catalogue.QUERIES["q_name_jaccard"](spark, str(tmp_path))
    assert found.where("score <> 1 or a >= b or (b - a) % 8 <> 0").count() == 0 and found.count() == 8 * 1000 * 999 // 2


def test_best_columns_of_tiles_are_those_of_all():
    rng = np.random.default_rng(3)
    full = rng.integers(0, 12, (30, 200)) / 12.0
    full[rng.random(full.shape) < 0.3] = -np.inf
    full[:, :60][5:9] = -np.inf  # rows without a candidate in the first tiles
    full[3] = -np.inf
    full[4, 7] = np.nan
    for k in (1, 3, 50):
        r, c, s = vectors.best_columns(lambda i, j: full[i, j], 30, 200, k, (7, 20))
        for row in range(30):
            rank = np.where(np.isnan(full[row]), np.inf, full[row])
            want = [x for x in np.lexsort((np.arange(200), -rank)) if rank[x] > -np.inf][:k]
            assert c[r == row].tolist() == want


def test_anchors_of_scenes_of_many_events(spark):
    rng = np.random.default_rng(5)
    vector = lambda: rng.integers(-2, 3, 3).tolist()
    odd = {3: None, 4: [0.0, 0.0, 0.0], 5: [1.0, None, 2.0], 6: [1.0, 1.0]}
    rows = [("b", i, i % 3, odd.get(i, [float(x) for x in vector()]), [float(x) for x in vector()], [f"p{i % 7}", None] if i % 5 else None) for i in range(60)]
    events = spark.createDataFrame(rows, "book_id string, id long, scene_id long, roles array<double>, story array<double>, people array<string>")
    links = spark.createDataFrame([("b", 0, 1, "parallels", "r"), ("b", 1, 2, "causes", None), ("b", 2, 2, "retells", "x"), ("b", 2, 9, "retells", "x")], "book_id string, source_id long, target_id long, type string, reason string")

    def cosine(a, b):
        if a is None or b is None or None in a + b or len(a) != len(b) or not any(a) or not any(b):
            return 0.0
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5

    def score(x, y):
        return max(cosine(x[4], y[4]), cosine(x[3], y[3])) + 0.05 * bool(set(x[5] or ()) & set(y[5] or ()) - {None})

    for block in (4, 1000):
        got = {}
        for r in narrative.scene_link_anchors(events, links, 3, block=block).collect():
            got.setdefault((r.source_id, r.target_id), []).append((-round(r.score, 9), r.left_id, r.right_id))
        for a, b in ((0, 1), (1, 2), (2, 2)):
            assert sorted(got.pop((a, b))) == sorted((-round(score(x, y), 9), x[1], y[1]) for x in rows if x[2] == a for y in rows if y[2] == b)[:3]
        assert not got


def test_similar_chunks_of_many_blocks(spark):
    rng = np.random.default_rng(7)
    rows = [(i % 2, f"c{i}", i // 2 * 100, i // 2 * 100 + 150, [float(x) for x in rng.integers(-3, 4, 4)] if i % 9 else None, None if i % 3 else "m") for i in range(90)]
    chunks = spark.createDataFrame(rows, "book_id long, id string, start_char long, end_char long, embedding array<float>, embedding_model string")
    frag = chunks.select("book_id", F.concat(F.lit("f"), "id").alias("fragment"), (F.col("start_char") + 60).alias("start_char"), (F.col("start_char") + 90).alias("end_char"))
    found = [sorted(tuple(r) for r in related.similar_chunks(frag, chunks, 3, blocks=blocks).collect()) for blocks in ((4, 7), (1000, 1000))]
    assert found[0] == found[1] and len(found[0]) > 100
    own = {"f" + r[1]: r for r in rows}
    for book, f, i, start, end, *_ in found[0]:
        me, it = own[f], own["f" + i]
        assert me[0] == it[0] == book and me[5] == it[5] and not (start < me[3] and end > me[2])


def test_conservative_groups_are_those_of_the_pairs_in_order(spark):
    rng = np.random.default_rng(11)
    members = [(b, f"{i:02d}") for b in ("p", "q", None) for i in range(24)] + [("p", "03"), ("r", "01")]
    pairs = [(b, f"{x:02d}", f"{y:02d}") for b, dense in (("p", 0.3), ("q", 0.8), (None, 0.6)) for x in range(26) for y in range(26) if x != y and rng.random() < dense]
    want = []
    for b in ("p", "q", "r", None):
        ids = {i for k, i in members if k == b}
        same, group = {(min(x, y), max(x, y)) for k, x, y in pairs if k == b}, {i: frozenset([i]) for i in ids}
        for x, y in sorted(same):
            if {x, y} <= ids and group[x] is not group[y] and all((min(u, v), max(u, v)) in same for u in group[x] for v in group[y]):
                group |= dict.fromkeys(group[x] | group[y], group[x] | group[y])
        want += [(b, i, min(group[i])) for k, i in members if k == b]
    m, p = spark.createDataFrame(members, "book_id string, id string"), spark.createDataFrame(pairs, "book_id string, a string, b string")
    assert sorted(map(repr, map(tuple, entities.conservative_groups(p, m).collect()))) == sorted(map(repr, want))


def test_pairs_of_a_condition_are_not_held(spark):
    # 9,000 members of one book: 27 million pairs, which took more than the worker's memory as a set
    import resource

    m = spark.range(9000).select(F.lit(1).alias("book_id"), (F.col("id") * 7001 % 9000).alias("id"))
    got = entities.conservative_groups(lambda a, b: (b - a) % 3 != 0, m)

    def grown(batches):
        n = 0
        for b in batches:
            n += sum(r % 3 == 0 and i - r < 3 for i, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
        yield pa.RecordBatch.from_pydict({"n": [n], "mb": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024]})

    rows = got.mapInArrow(grown, "n long, mb long").collect()
    assert sum(r.n for r in rows) == 9000 and max(r.mb for r in rows) < 1500


def test_edges_of_a_deep_tree_are_not_sent_to_the_driver(spark):
    t = spark.range(50).selectExpr("id", "nullif(id - 1, -1) as parent_id")
    found = structure.closure(t, t.where("parent_id is null"))
    assert "strategy=merge" in found._jdf.queryExecution().analyzed().toString()
    assert sorted(tuple(r) for r in found.collect()) == [(0, i, i) for i in range(50)]


def test_an_index_of_some_tokens_has_only_their_blocks(spark):
    docs = spark.createDataFrame([("b", str(i), i, i + 1, f"red w{i} {'blue' if i % 3 else ''}") for i in range(40)] + [("c", "0", 0, 1, None)], "book_id string, id string, start_char long, end_char long, text string")
    asked = spark.createDataFrame([("b", "blue"), ("b", "blue"), ("b", "none"), ("c", "red")], "book_id string, token string")
    rows = fulltext.postings(docs, stemmed=False)
    every, some = fulltext.build(rows, F.floor(F.col("start_char") / 8)), fulltext.build(rows, F.floor(F.col("start_char") / 8), asked)
    assert [sorted(map(repr, b.where("token = 'blue'").collect())) for b in (every[0], some[0])] == [sorted(map(repr, some[0].collect()))] * 2
    assert sorted(map(tuple, every[1].collect())) == sorted(map(tuple, some[1].collect()))
    assert [sorted(map(repr, fulltext.search(*x, asked, 5)[0].collect())) for x in (every, some)][0] == sorted(map(repr, fulltext.search(*some, asked, 5)[0].collect()))



def test_blocks_of_pages_come_in_bounded_batches():
    pages = pa.RecordBatch.from_pydict({"page_id": list(range(1500)), "html": ["<p>a<p>b<p>c", None, "x"] * 500})
    made = list(html._batches([pages, pages.slice(0, 0)], "page_id"))
    assert len(made) == 1 and made[0].num_rows == 1500 and made[0].column(0).to_pylist() == [k for k in range(0, 1500, 3) for _ in range(3)]
    made = list(html._batches([pages] * 2 + [pa.RecordBatch.from_pydict({"page_id": [7] * 3000, "html": ["<p>a<p>b"] * 3000})], "page_id"))
    assert sum(b.num_rows for b in made) == 9000 and max(b.num_rows for b in made) < html.ROWS + 2


def test_clusters_of_many_mentions_grow_by_what_is_new(monkeypatch):
    # 6,000 mentions of two names: every batch used to go through all scenes and ranks again, 12 million steps
    from lectern.operators import resolution

    steps = 0
    first_seen = resolution.first_seen

    def counted(values):
        nonlocal steps
        out = first_seen(values)
        steps += len(out)
        return out

    monkeypatch.setattr(resolution, "first_seen", counted)
    rows = [{"id": f"m{i}", "surface": "ab"[i % 2] * 4, "kind": None, "hint": None, "scene": str(i), "rank": i * 7 % 6000, "context": "c"} for i in range(6000)]
    ask = lambda batch, offered, known: {"resolutions": [{"mention_ids": [m["id"]], "entity_id": same[0]} if (same := [i for i in offered[m["id"]] if known[i].name == m["surface"]]) else {"mention_ids": [m["id"]], "new_entity": {"canonical_name": m["surface"]}} for m in batch]}
    made = resolution.clusters("b", "c", rows, ask)
    big = made[-1]
    assert steps < 300_000 and sum(len(c.mentions) for c in made) == 6000 and len(made) == 12
    assert sorted(big.ranks) == sorted(set(big.ranks)) and big.last == max(big.ranks) and len(made[0].scenes) == len(made[0].mentions)


def test_segments_of_chapters_come_as_a_stream(spark):
    from lectern.operators import scenes

    units = [(c, u, f"{c} unit {u}." + "\n\n" * (u % 4 == 3)) for c in [*map(str, range(300)), None] for u in range(9)]
    df = spark.createDataFrame(units, "chapter_id string, unit int, text string").repartition(7)
    got = scenes.segment(df, most=60)
    assert "MapInArrow" in got._jdf.queryExecution().toString() and "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
    found = {}
    for r in got.collect():
        found.setdefault(r.chapter_id, []).append((r.first_unit, r.last_unit, r.start_char, r.end_char, r.status))
    assert len(found) == 301
    for c, rows in found.items():
        texts = [t for x, _, t in units if x == c]
        at, want = 0, []
        while at < 9:
            end = scenes.window_end([len(t) for t in texts], at, 60)
            end = next((i for i in range(at + 1, end) if texts[i - 1].endswith("\n\n")), end)
            want.append((at, end, len("".join(texts[:at])), len("".join(texts[:end])), "ready"))
            at = end
        assert sorted(rows) == want


def test_repeated_links_are_not_looked_for(spark, monkeypatch):
    def refused(self):
        raise AssertionError("a table of all links takes the memory of a task")

    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 1), (3, 2), (8, 9), (8, 9), (5, 5)], "a long, b long")
    monkeypatch.setattr(type(edges), "distinct", refused)
    assert sorted(tuple(r) for r in entities.connected(edges).collect()) == [(1, 1), (2, 1), (3, 1), (5, 5), (8, 8), (9, 8)]


def test_texts_of_a_book_are_dealt_over_tasks(spark):
    from lectern.operators import indexing

    chunks = spark.range(400).select((F.col("id") % 2).alias("book_id"), F.nullif(F.col("id"), F.lit(7)).alias("id"), F.concat(F.lit("t"), "id").alias("text"))
    chunks = chunks.union(chunks.where("id = 9"))
    t = {"chunks": chunks, "annotations": spark.createDataFrame([(1, 9, "In a"), (1, 9, "In a"), (0, 2, "x"), (1, None, "no")], "book_id long, chunk_id long, context string")}
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(old, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        got = indexing.chunk_inputs(t, spark.createDataFrame([(1,)], "book_id long")).select("id", "input", F.spark_partition_id().alias("p")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(repr((r.id, r.input)) for r in got) == sorted(repr((None if i == 7 else i, f"In a\n\nt{i}" if i == 9 else f"t{i}")) for i in [*range(1, 400, 2), 9])
    assert len({r.p for r in got}) > 1


def test_two_tables_are_compared_in_one_pass(spark):
    from lectern.operators import writes
    from lectern.operators.sessions import Conflict

    rows = [(1, None, ["a", None]), (1, 2, []), (None, 3, None)]
    make = lambda r: spark.createDataFrame(r, "book_id long, id long, mention_ids array<string>")
    writes._same(make(rows), make(rows[::-1] + rows[:1]), "changed")
    for a, b in ((rows, rows[1:]), (rows[:2], rows), (rows, [*rows[:2], (None, 3, [])])):
        with pytest.raises(Conflict):
            writes._same(make(a), make(b), "changed")


def test_edits_of_openings_sort_a_section_once(spark):
    from lectern.operators import editing

    sections = [("b", f"s{i}", 10 * i, 10 * i + 10, 10 * i, 10 * i + 6) for i in range(9)] + [(None, "s0", 0, 10, 0, 6), ("b", None, 0, 10, None, 3)]
    blocks = [("b", f"e{i}{k}", f"s{i}", "epigraph", 10 * i + k, 10 * i + k + 1, None) for i in range(9) for k in (1, 3)] + [("b", f"n{i}", f"s{i}", "footnotes", 10 * i + 7, 10 * i + 9, None) for i in range(9)]
    odd = [("b", "x", None, "body", 1, 9, None), (None, "y", "s0", "epigraph", 1, 2, None), ("b", "z", "s1", None, None, None, None), ("b", "w", "s77", "epigraph", 1, 2, 1)]
    asked = [("s0", "epigraph", 4, 6), ("s1", "attribution", 14, 15), ("s2", "opening", 21, 23), ("s3", "body", 33, 34), ("s4", "footnotes", 43, 48), ("s5", "clear_epigraph", None, None), ("s6", "x", 1, 2), ("s8", "epigraph", 88, 89), ("s9", "body", 1, 2), (None, "body", 1, 2)]
    frames = (
        spark.createDataFrame(sections, "book_id string, id string, start int, end int, title_position int, body_start int"),
        spark.createDataFrame(blocks + odd, "book_id string, id string, section_id string, role string, start int, end int, attribution_start int"),
        spark.createDataFrame([("b", i, "NarrativeText") for i in range(90)], "book_id string, pos int, type string"),
        spark.createDataFrame([("b", *a) for a in asked], "book_id string, section_id string, operation string, start int, end int"),
    )
    s, b, faults = editing.edit_openings(*frames)
    assert sorted(map(repr, map(tuple, faults.collect()))) == sorted(map(repr, [("b", "s6", "operation"), ("b", "s8", "not an opening"), ("b", "s9", "section"), ("b", None, "section")]))
    begun = {("b", "s0"): 6, ("b", "s1"): 16, ("b", "s2"): 24, ("b", "s3"): 33, ("b", "s5"): 51}
    assert sorted(map(repr, map(tuple, s.collect()))) == sorted(repr((*r[:5], begun.get(r[:2], r[5]))) for r in sections)
    gone = {"e21", "e33", "e43", "n4", "e51", "e53"}
    want = [r for r in blocks + odd if r[1] not in gone | {"e13"}] + [("b", "e13", "s1", "epigraph", 13, 15, 14)]
    made = {("s0", "epigraph", 4, 6), ("s4", "footnotes", 43, 48)}
    got = [tuple(r) for r in b.collect()]
    assert sorted(repr(r) for r in got if not r[1].startswith("b:b:")) == sorted(map(repr, want))
    assert {r[2:6] for r in got if r[1].startswith("b:b:")} == made and len(got) == len(want) + 2
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(old, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        plan = editing.edit_openings(*frames)[1]._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert plan.count("Sort [") <= 6


def test_tables_that_none_names_are_compared_once(spark, monkeypatch):
    from lectern.operators import writes

    m = spark.createDataFrame([("b", "s", f"m{i}") for i in range(6)] + [("c", "s", "m0"), (None, "s", "m0"), ("b", "s", None)], "book_id string, scene_id string, id string")
    t = {
        "mentions": m,
        "references": spark.createDataFrame([("b", "s", "r0", "m0"), ("b", "s", "r1", None), ("c", "s", "r2", "m0"), ("b", "s", "r3", "m5"), (None, "s", "r4", "m0")], "book_id string, scene_id string, id string, target_mention_id string"),
        "chapter_entities": spark.createDataFrame([("b", "c1", "e1", ["m5", "m0"]), ("b", "c2", "e2", ["m5", None]), ("b", "c3", "e3", None), ("b", "c4", "e4", ["m5"]), ("c", "c1", "e1", ["m0"])], "book_id string, chapter_id string, id string, mention_ids array<string>"),
        "resolves": spark.createDataFrame([("b", "e1", "x1"), ("b", "e2", "x2"), ("b", "e4", "x1"), ("c", "e1", "x1")], "book_id string, chapter_entity_id string, book_entity_id string"),
        "book_entities": spark.createDataFrame([("b", "x1"), ("b", "x2"), ("b", "x3"), ("c", "x1"), ("c", "x9")], "book_id string, id string"),
        "possibly_same": spark.createDataFrame([("b", "x2", "x1"), ("b", "x3", "x2"), ("b", "x1", "x2"), ("c", "x1", "x9")], "book_id string, left_id string, right_id string"),
    }
    gone = {"mentions": spark.createDataFrame([("b", "m0"), ("b", "m0"), (None, "m0"), ("b", None)], "book_id string, id string"), "chapter_entities": spark.createDataFrame([("b", "e4")], "book_id string, id string")}
    for keep in (lambda keys: keys, lambda keys: keys.localCheckpoint()):
        monkeypatch.setattr(writes, "_kept", keep, raising=False)
        out = writes.cascade(t, gone)
        left = {n: sorted(map(repr, map(tuple, out[n].select(*out[n].columns[: 4 if n == "references" else 3]).collect()))) for n in t}
        assert len(left["mentions"]) == 8 and repr(("b", "s", "m0")) not in left["mentions"]
        assert left["references"] == sorted(map(repr, [("b", "s", "r1", None), ("c", "s", "r2", "m0"), ("b", "s", "r3", "m5"), (None, "s", "r4", "m0")]))
        assert left["chapter_entities"] == sorted(map(repr, [("b", "c2", "e2"), ("b", "c3", "e3"), ("c", "c1", "e1")]))
        assert left["resolves"] == sorted(map(repr, [("b", "e2", "x2"), ("c", "e1", "x1")]))
        assert left["book_entities"] == sorted(map(repr, [("b", "x2"), ("c", "x1"), ("c", "x9")]))
        assert left["possibly_same"] == [repr(("c", "x1", "x9"))]
        plan = out["references"]._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 1, plan


def test_missing_keys_are_compared_once_for_all_that_name_them(spark):
    from lectern.operators import writes

    df = spark.createDataFrame
    t = {
        "books": df([("1",), ("2",)], "book_id string"),
        "scenes": df([(1, "c", 7), (1, None, 8), (3, "c", 7)], "book_id long, chapter_id string, id long"),
        "mentions": df([(1, 7, 1), (1, 9, 2), (1, 9, 3), (1, None, 4), (None, 7, 5)], "book_id long, scene_id long, id long"),
        "references": df([(1, "7", 1, 1), (1, "9", 2, 6)], "book_id long, scene_id string, id long, target_mention_id long"),
        "chapter_entities": df([(1, "c", "e", ["1", "2", None, "77"]), (2, "c", "f", None)], "book_id long, chapter_id string, id string, mention_ids array<string>"),
    }
    found = writes.missing(t)
    want = [
        ("scenes", "book_id", "3", "3"), ("mentions", "scene_id", "1", "9"), ("mentions", "scene_id", None, "7"), ("references", "scene_id", "1", "9"),
        ("references", "target_mention_id", "1", "6"), ("chapter_entities", "mention_ids", "1", "77"),
    ]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 3  # books, scenes and mentions; eight columns name them
