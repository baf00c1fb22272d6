"""Command line: python -m lodestore {search,expand,timeline,verify} STORE.parquet ARGUMENTS."""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    """Exit code 0 with results, 2 without, 3 for a store that can't be read."""
    parser = argparse.ArgumentParser(prog="lodestore", description=__doc__)
    parser.add_argument("command", choices=("search", "expand", "timeline", "verify"))
    parser.add_argument("store")
    parser.add_argument("arguments", nargs="+")
    parser.add_argument("--top-k", type=int, default=5)
    args = parser.parse_args(argv)
    from pyspark.errors import AnalysisException
    from pyspark.sql import SparkSession

    from .api import Engine

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        engine = Engine(spark, spark.read.parquet(args.store))
    except AnalysisException as e:
        print(str(e).splitlines()[0], file=sys.stderr)
        return 3
    if args.command == "search":
        out = engine.search_memories([" ".join(args.arguments)], mode="fts", top_k=args.top_k).orderBy("rank")
    elif args.command == "expand":
        out = engine.expand_entry(args.arguments)
    elif args.command == "verify":
        out = engine.verify_search([" ".join(args.arguments)], mode="fts", top_k=args.top_k).orderBy("id")
    else:
        out = engine.timeline(args.arguments[0], args.arguments[-1])
    rows = out.toJSON().take(1000)
    for row in rows:
        print(json.dumps(json.loads(row), ensure_ascii=False))
    return 0 if rows else 2


if __name__ == "__main__":
    sys.exit(main())
