"""python -m tallyforge list | run QUERY FOLDER TO | JOB FOLDER TO: the registered queries and the jobs from a shell, or by spark-submit."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from . import jobs

_MODES = ["errorifexists", "overwrite", "append"]


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tallyforge")
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    run = commands.add_parser("run", help="write a query's rows as Parquet")
    run.add_argument("query")
    every = [run]
    for name, job in jobs.JOBS.items():
        every.append(commands.add_parser(name, help=f"{job.help} (reads {', '.join(job.tables)})"))
    for p in every:
        p.add_argument("folder", help="the folder of the tables")
        p.add_argument("to")
        p.add_argument("--mode", default="errorifexists", choices=_MODES)
    return out


def main(arguments: Sequence[str] | None = None) -> None:
    from .plans import registry

    own = parser()
    args = own.parse_args(arguments)
    queries = registry.queries()
    if args.command == "list":
        print("\n".join(sorted(queries)))
        return
    if args.command == "run" and args.query not in queries:
        own.error(f"there is no query {args.query}")
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    found = queries[args.query](spark, args.folder) if args.command == "run" else jobs.run(spark, args.command, args.folder)
    found.write.mode(args.mode).parquet(args.to)


if __name__ == "__main__":
    main()
