"""The stored full-text index against BM25 on all texts, and what a search leaves unread."""

import random

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import fulltext, lexical
from lectern.service import Search
from tests.test_service import book  # noqa: F401  the fixture


def corpus(spark, n=400):
    rng = random.Random(3)
    words = ["метель", "метели", "дом", "домой", "книгами", "степь"] + [f"слово{i}" for i in range(60)]
    rows, at = [], {"k": 0, "l": 0}
    for i in range(n):
        b = "k" if i % 4 else "l"
        text = " ".join(rng.choices(words, [30 / (j + 1) for j in range(len(words))], k=rng.randint(0, 60)))
        rows.append((b, f"{i:04d}", at[b], at[b] + len(text) + 1, text))
        at[b] += len(text) + 1
    return spark.createDataFrame(rows, "book_id string, id string, start_char int, end_char int, text string")


def test_search_equals_bm25_over_all_texts(spark):
    docs = corpus(spark)
    blocks, stats = (x.persist() for x in fulltext.build(fulltext.postings(docs, stemmed=False), F.floor(F.col("start_char") / 500)))
    q = ["метель", "слово7", "слово59"]
    asked = spark.createDataFrame([(b, t) for b in "kl" for t in q], "book_id string, token string")
    for k in (1, 7, 1000):
        hits, cells = fulltext.search(blocks, stats, asked, k)
        got = {(r.book_id, r.id): (r.score, r.rank) for r in hits.collect()}
        for b in "kl":
            want = sorted(((round(r.score, 9), r.id) for r in lexical.bm25(docs.where(F.col("book_id") == b), "id", q).collect()), key=lambda x: (-x[0], x[1]))[:k]
            mine = sorted((rank, i, s) for (kb, i), (s, rank) in got.items() if kb == b)
            assert [i for _, i, _ in mine] == [i for _, i in want] and all(abs(s - w) < 1e-8 for (_, _, s), (w, _) in zip(mine, want, strict=True))
        every = blocks.where(F.col("token").isin(q)).select("book_id", "cell").distinct().count()
        read = cells.count()
        assert read == cells.distinct().count() <= every
        if k == 1:
            assert read < every / 2  # most cells can't reach the best score
        if k == 1000:
            assert read == every
    none = spark.createDataFrame([("k", "nowhere")], "book_id string, token string")
    assert fulltext.search(blocks, stats, none, 5)[0].count() == 0


def test_ranges_pass_over_blocks_and_keep_frequencies(spark):
    docs = corpus(spark)
    blocks, stats = fulltext.build(fulltext.postings(docs, stemmed=False), F.floor(F.col("start_char") / 500))
    asked = spark.createDataFrame([("k", "метель")], "book_id string, token string")
    ranges = spark.createDataFrame([("k", 1000, 1900), ("k", 1800, 2500), ("l", 0, 9999)], "book_id string, start_char int, end_char int")
    hits, cells = fulltext.search(blocks, stats, asked, 500, ranges)
    own = docs.where("book_id = 'k'")
    scores = {r.id: r.score for r in lexical.bm25(own, "id", ["метель"]).collect()}
    near = [r.id for r in own.collect() if r.start_char < 2500 and r.end_char > 1000 and r.id in scores]
    got = {r.id: r.score for r in hits.collect()}
    assert sorted(got) == sorted(near) and all(abs(got[i] - scores[i]) < 1e-8 for i in near)
    assert {r.cell for r in cells.collect()} <= {1, 2, 3, 4}


def test_edge_cases_and_stems(spark):
    rows = [("k", "a", 0, 5, None), ("k", "b", 5, 9, ""), ("k", "c", 9, 20, "Ёлками, книгами; ёлка"), ("k", "c2", 9, 20, "Ёлками, книгами; ёлка"), (None, "d", 0, 1, "книга")]
    docs = spark.createDataFrame(rows, "book_id string, id string, start_char int, end_char int, text string")
    blocks, stats = fulltext.build(fulltext.postings(docs))
    assert {(r.book_id, r.docs) for r in stats.collect()} == {("k", 4), (None, 1)}
    asked = spark.createDataFrame([("k", t) for t in fulltext.query_tokens("Книга книги ёлка")], "book_id string, token string")
    assert [r.id for r in fulltext.search(blocks, stats, asked, 9)[0].orderBy("rank").collect()] == ["c", "c2"]
    words = "книгами синяя тётями зелёному лес птицын stone".split()
    got = [r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select(T.stem(F.translate("w", "ё", "е")).alias("s")).collect()]
    assert got == [fulltext.stem(w) for w in words]
    empty = fulltext.build(fulltext.postings(docs.limit(0)))
    assert fulltext.search(*empty, asked, 3)[0].count() == 0


def test_service_reads_the_stored_index(spark, book):  # noqa: F811
    blocks, stats = fulltext.build(fulltext.postings(book["chunks"]))
    texts = book["chunks"].withColumn("text", F.lit("nothing"))  # found in the index, not in these
    s = Search(book | {"chunks": texts, "postings": blocks, "posting_stats": stats}, "k")
    plain = Search(book, "k")
    for q in ("метель", "МАША дома", "Пётр"):
        a, b = ([(r.start_char, r.end_char, r.scores) for r in x.words(q).candidates.orderBy("ord").collect()] for x in (s, plain))
        assert a == b and a
    assert s.words("пётр", limit=1).truncated == ["words:text"]
