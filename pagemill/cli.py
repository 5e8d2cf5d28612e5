"""Command line: convert databases to Parquet, reverse SQLite files, list archives."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from pagemill import __version__
from pagemill.codec import files
from pagemill.operators import sizing
from pagemill.sinks import landing
from pagemill.sources import read


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagemill")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    convert = sub.add_parser("convert", help="databases or one archive to a folder of Parquet tables")
    convert.add_argument("inputs", nargs="+")
    convert.add_argument("output")
    convert.add_argument("--batch-size", type=int)
    convert.add_argument("--strategy", choices=("plain", "extension", "prefix", "namespace", "separate"))
    convert.add_argument("--preset", choices=tuple(sizing.PRESETS), default="default")
    convert.add_argument("--password")
    convert.add_argument("--resume", action="store_true")
    convert.add_argument("--threads", type=int, help="tables that land at once")
    convert.add_argument("--schema-only", action="store_true", help="write empty tables and their SQL statements")
    convert.add_argument("--permissive", action="store_true", help="skip and count what is damaged")
    reverse = sub.add_parser("reverse", help="a SQLite file to databases")
    reverse.add_argument("input")
    reverse.add_argument("output")
    listing = sub.add_parser("list", help="the members of an archive")
    listing.add_argument("archive")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.ERROR if args.quiet else logging.INFO)
    try:
        if args.command == "list":
            for member, category, size in files.archive_members(args.archive):
                print(f"{category:6}{size:12}  {member}")
            return 0
        spark = SparkSession.builder.appName("pagemill").getOrCreate()
        if args.command == "reverse":
            for name, n in landing.reverse(spark, args.input, args.output).items():
                print(f"{name}: {n} rows")
            return 0
        good, bad = read.valid_inputs(args.inputs)
        archives = [p for p in good if p.lower().endswith(files.ARCHIVE)]
        if bad or archives and len(good) > 1:
            print(f"cannot read {', '.join(bad)}" if bad else "an archive is converted alone", file=sys.stderr)
            return 1
        policy = sizing.policy(args.preset)
        policy.apply(spark)
        if args.batch_size:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(args.batch_size))
        options = {"password": args.password} if args.password else {}
        options |= {"mode": "PERMISSIVE", "recover": "true"} if args.permissive else {}
        done = landing.land(spark, ",".join(good), args.output, args.strategy or ("extension" if len(good) > 1 or archives else "plain"), resume=args.resume, policy=policy, threads=args.threads, schema_only=args.schema_only, **options)
        for name, n in done.tables.items():
            print(f"{name}: {n} rows")
        for name, n in done.damaged.items():
            print(f"{name}: {n} damaged pages and records", file=sys.stderr)
        for name, error in done.errors:
            print(f"{name}: {error}", file=sys.stderr)
        return 0 if done.success else 1
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
