"""[X15, X16] Command line: list the queries, run one over a folder of tables, or write its result."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .queries import QUERIES


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillmark")
    p.add_argument("query", nargs="?", help="a query's name; without one, the names are listed")
    p.add_argument("--data", default=".", help="folder of <table>.parquet")
    p.add_argument("--out", help="write the result here, instead of showing it")
    p.add_argument("--format", default="parquet", choices=["parquet", "json", "csv"])
    p.add_argument("--rows", type=int, default=20, help="rows to show")
    a = p.parse_args(argv)
    if not a.query:
        print("\n".join(sorted(QUERIES)))
        return 0
    if a.query not in QUERIES:
        p.error(f"no query is named {a.query}")
    spark = SparkSession.builder.appName(f"quillmark {a.query}").getOrCreate()
    df = QUERIES[a.query](spark, a.data)
    if a.out:
        df.write.mode("overwrite").format(a.format).save(a.out)
    else:
        df.show(a.rows, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
