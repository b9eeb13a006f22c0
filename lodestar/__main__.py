"""The command line: ranks a file of records, or serves rankings over HTTP."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from lodestar.functions import vocabulary as V
from lodestar.operators import audits
from lodestar.plans import compiler, ranker
from lodestar.sources import candidates as sources


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lodestar", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    rank = commands.add_parser("rank", help="write the best records of a file as CSV")
    rank.add_argument("--candidates", required=True, help="JSON lines, plain or gzip, or a JSON array")
    rank.add_argument("--out", required=True)
    rank.add_argument("--top-k", type=int, default=100)
    rank.add_argument("--pool", type=int, help="keep so many rows by retrieval before scoring")
    rank.add_argument("--max-candidates", type=int)
    rank.add_argument("--backend", default="auto", choices=["auto", "bm25s", "rank_bm25"])
    rank.add_argument("--profile", default="main", choices=sorted(V.PROFILES))
    rank.add_argument("--role", help="a text file that describes the role; the default role without it")
    rank.add_argument("--release", action="store_true", help="publish only a ranking without faults")
    serve = commands.add_parser("serve", help="answer requests for rankings")
    serve.add_argument("--folder", required=True, help="a shared folder for uploads, results and states of jobs")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8000)
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("lodestar").getOrCreate()
    if args.command == "serve":
        from lodestar.service import serve

        serve(spark, args.folder, args.host, args.port)
        return 0
    plan = compiler.compile_role(sources.read_role(spark, args.role)) if args.role else ranker.DEFAULT
    config = ranker.RankerConfig(args.top_k, args.pool, args.max_candidates, args.backend, args.profile, plan)
    check = (lambda rows: audits.ranking_faults(rows, args.top_k)) if args.release else None
    print(json.dumps(ranker.run_ranking(spark, args.candidates, args.out, config, check), sort_keys=True))
    return 0


if __name__ == "__main__":
    sys.exit(main())
