"""python -m geoloom plan|check REQUEST.json | discover REQUEST.json PRODUCTS | request REQUEST.json PRODUCTS RAW OUT | auxiliary PROVIDER DATASET | queries | run QUERY SF_DIR OUT."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .plans.request import Request, build_plan, check_limits, estimate_bytes


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="geoloom", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("plan", "check"):
        sub.add_parser(name).add_argument("request", type=Path)
    find = sub.add_parser("discover")
    find.add_argument("request", type=Path)
    find.add_argument("products", help="a Parquet table of catalogue records")
    whole = sub.add_parser("request")
    whole.add_argument("request", type=Path)
    whole.add_argument("products", help="a Parquet table of catalogue records")
    whole.add_argument("raw", help="a folder with a Parquet table of raw pixels for each sensor, named after it")
    whole.add_argument("out", help="a folder for the cubes, the request and the provenance")
    spec = sub.add_parser("auxiliary")
    for name in ("provider", "dataset"):
        spec.add_argument(name)
    spec.add_argument("variables", nargs="*")
    sub.add_parser("queries")
    run = sub.add_parser("run")
    for name in ("query", "sf_dir", "out"):
        run.add_argument(name)
    args = parser.parse_args(argv)
    if args.command == "plan":
        for step in build_plan(Request.from_json(args.request.read_text())):
            print(json.dumps(step.__dict__))
    elif args.command == "check":
        request = Request.from_json(args.request.read_text())
        print(f"about {estimate_bytes(request) / 2**20:.1f} MiB")
        try:
            check_limits(request)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
    elif args.command == "discover":
        from pyspark.sql import SparkSession

        from .plans.workflow import discover

        spark = SparkSession.builder.getOrCreate()
        request = Request.from_json(args.request.read_text())
        for sensor in request.sensors:
            for row in discover(spark.read.parquet(args.products), request, sensor).orderBy("rank").collect():  # `limit` rows
                print(json.dumps({"sensor": sensor, "rank": row["rank"], "product_id": row["product_id"]}))
    elif args.command == "request":
        from pyspark.sql import SparkSession

        from .plans.workflow import execute, register_tables

        spark = SparkSession.builder.getOrCreate()
        request = Request.from_json(args.request.read_text())
        register_tables({s: spark.read.parquet(f"{args.raw}/{s}") for s in request.sensors})
        result = execute(spark, request, spark.read.parquet(args.products))
        result.save(args.out, request)
        print(json.dumps({k: result.provenance[k] for k in ("target", "sensors", "errors", "failed_products")}))
    elif args.command == "auxiliary":
        from .sources.sinks import AuxiliarySpec

        print(AuxiliarySpec(args.provider, args.dataset, tuple(args.variables)).key)
    else:
        from .plans.queries import QUERIES

        if args.command == "queries":
            print("\n".join(sorted(QUERIES)))
        else:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.getOrCreate()
            QUERIES[args.query](spark, args.sf_dir).write.mode("errorifexists").parquet(args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
