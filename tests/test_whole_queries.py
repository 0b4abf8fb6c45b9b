"""Queries over all rows whose SQL covers only a part, by brute force on small tables."""

from lectern.functions import spans
from lectern.plans import catalogue


def test_chunk_chain_of_long_lines(spark, tmp_path):
    texts = {1: "Short line.\nAnother.", 2: " ".join(f"Sentence {i} of a very long line." for i in range(120)), 3: "x" * 3000 + "\n" + "tail " * 100, 4: "", 5: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for d, t in texts.items():
        c = spans.chunk_spans(t)
        for k, (a, b) in enumerate(c):
            before, after = c[k - 1] if k else None, c[k + 1] if k + 1 < len(c) else None
            tail = t[max(before[0], before[1] - 200) : before[1]] if before else ""
            want.append((d, a, b, before and before[0], after and after[0], t[a : a + 40], tail))
    got = catalogue.QUERIES["q_chunk_chain_full"](spark, str(tmp_path)).select("doc_id", "start_char", "end_char", "previous_start", "next_start", "head", "tail_before").collect()
    assert sorted(map(tuple, got)) == sorted(want) and {w[0] for w in want} == {1, 2, 3}


def test_components_of_all_links(spark, tmp_path):
    rows = [(1, 1, 10, 1, 5.0, "N"), (1, 2, 11, 1, 50.0, "R"), (1, 3, 12, 1, 1.0, "N"), (2, 1, 20, 1, 3.0, "A"), (2, 2, 21, 1, 3.0, "A"), (3, 1, 30, 1, 50.0, "R"), (3, 2, 30, 1, 50.0, "R"), (4, 1, 12, 1, 2.0, "N"), (4, 2, 9, 1, 2.0, "N")]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    for path in (str(tmp_path), "/root/testdata/sf0.001"):
        lines, root = {}, {}
        for r in spark.read.parquet(f"{path}/lineitem.parquet").collect():
            lines.setdefault(r.l_orderkey, []).append((r.l_linenumber, r.l_suppkey, r.l_partkey))

        def up(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for found in lines.values():
            for (_, a, _), (_, b, _) in zip(sorted(found), sorted(found)[1:]):
                if a != b:
                    low, high = sorted((up(a), up(b)))
                    root[high] = low
        got = {r.node: r.root for r in catalogue.QUERIES["q_connected_components_full"](spark, path).collect()}
        assert got == {x: up(x) for x in root}
