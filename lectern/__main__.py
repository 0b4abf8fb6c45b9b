"""Command line: ``python -m lectern queries | run | import | words | index``; on a cluster use spark-submit with this file."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import lexical
from lectern.plans import catalogue
from lectern.session import local_session
from lectern.sources import books


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lectern", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("queries", help="names of all queries")
    run = sub.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("name", choices=sorted(catalogue.QUERIES))
    run.add_argument("tables")
    run.add_argument("--rows", type=int, default=20)
    imported = sub.add_parser("import", help="read EPUB, Markdown and HTML files and store their elements")
    imported.add_argument("files")
    imported.add_argument("out")
    index = sub.add_parser("index", help="store postings of a table of texts")
    for name in ("texts", "out"):
        index.add_argument(name)
    index.add_argument("--key", default="doc_id")
    index.add_argument("--stemmed", action="store_true")
    words = sub.add_parser("words", help="search stored postings")
    words.add_argument("index")
    words.add_argument("query")
    words.add_argument("--key", default="doc_id")
    words.add_argument("--stemmed", action="store_true")
    words.add_argument("--rows", type=int, default=10)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "queries":
        print("\n".join(sorted(catalogue.QUERIES)))
        return 0
    spark = spark or SparkSession.getActiveSession() or local_session()
    if a.command == "run":
        catalogue.QUERIES[a.name](spark, a.tables).show(a.rows, truncate=80)
    elif a.command == "import":
        found = books.read(spark, a.files)
        found.write.parquet(f"{a.out}/books")
        books.elements(spark.read.parquet(f"{a.out}/books")).write.parquet(f"{a.out}/elements")
        spark.read.parquet(f"{a.out}/books").select("path", "title", "error", F.size("elements").alias("elements")).show(truncate=60)
    elif a.command == "index":
        texts = spark.read.parquet(a.texts)
        lexical.postings(texts, a.key, stemmed=a.stemmed).sort("token").write.parquet(f"{a.out}/postings")
        lexical.statistics(texts).write.parquet(f"{a.out}/statistics")
    else:
        query = [r.t for r in spark.range(1).select(F.explode(T.terms(F.lit(a.query))).alias("t")).collect()]
        scored = lexical.bm25_from(spark.read.parquet(f"{a.index}/postings"), spark.read.parquet(f"{a.index}/statistics"), a.key, query, a.stemmed)
        lexical.top(scored, a.key, a.rows)[0].show(a.rows)
    return 0


if __name__ == "__main__":
    sys.exit(main())
