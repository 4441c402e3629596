"""python -m graphloom validate | query | explain | schema: a small CLI.

    python -m graphloom query --schema s.yaml --table users=/data/users.parquet \
        "MATCH (u:User) RETURN u.name LIMIT 5"
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="graphloom")
    p.add_argument("command", choices=["validate", "query", "explain", "schema"])
    p.add_argument("text", nargs="?")
    p.add_argument("--schema", required=True)
    p.add_argument("--table", action="append", default=[], help="name=uri")
    p.add_argument("--format", default="PrettyCompact")
    p.add_argument("--param", action="append", default=[], help="name=value")
    args = p.parse_args(argv)
    from pyspark.sql import SparkSession

    from graphloom.api import Graph
    from graphloom.sources.storage import read_source

    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    tables = {n: read_source(spark, uri) for n, _, uri in (t.partition("=") for t in args.table)}
    graph = Graph(spark, args.schema, tables)
    params = {}
    for n, _, v in (x.partition("=") for x in args.param):
        params[n] = int(v) if v.lstrip("-").isdigit() else v
    if args.command == "schema":
        print(graph.describe())
    elif args.command == "validate":
        wrong = graph.validate(args.text, params)
        print(wrong or "ok")
        return int(bool(wrong))
    elif args.command == "explain":
        graph.explain(args.text, params)
    else:
        print(graph.formatted(args.text, args.format, params))
    return 0


if __name__ == "__main__":
    sys.exit(main())
