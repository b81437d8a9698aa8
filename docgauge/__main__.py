"""Command line: python -m docgauge parse|run|golden FOLDER --config FILE --out FOLDER."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from docgauge.plans import workflows
from docgauge.session import reach
from docgauge.sources.grid import load_config


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="docgauge")
    p.add_argument("command", choices=["parse", "run", "golden"])
    p.add_argument("folder")
    p.add_argument("--config", help="YAML configuration")
    p.add_argument("--out", default="./workdir/out")
    p.add_argument("--enrich", action="store_true", help="describe images")
    p.add_argument("--force", action="store_true", help="parse again what the store already holds")
    args = p.parse_args(argv)
    if args.force and args.command != "parse":
        print(f"--force has no effect on {args.command}: it belongs to parse.")
    config = load_config(args.config) if args.config else {}
    spark = spark or SparkSession.builder.appName("docgauge").getOrCreate()
    reach(spark)
    try:
        return _run(spark, args, config)
    except ValueError as e:  # a refusal: its message says what to do
        print(f"Error: {e}", file=sys.stderr)
        return 2


def _run(spark: SparkSession, args: argparse.Namespace, config: dict) -> int:
    if args.command == "golden":
        print(f"Golden set: {workflows.golden_into(spark, args.folder, config, args.out)['xlsx']}")
        return 0
    if args.command == "run":
        ran = workflows.score_into(spark, args.folder, config, args.out, args.enrich)
        print(f"{ran.n_docs} documents, {ran.n_errors} with errors. Report: {ran.report['xlsx']}")
        return 0
    done = workflows.parse_into(spark, args.folder, config, args.out, args.enrich, args.force)
    print(f"{done.n_written} documents written, {done.n_skipped} skipped. Output: {done.out}")
    if done.n_changed:
        print("Sources changed since they were parsed (--force parses them again):")
        for r in done.plan.where("source_changed").orderBy("doc_id").toLocalIterator():
            print(f"  {r['doc_id']}")
    failed = 0
    for r in done.errors.orderBy("doc_id").toLocalIterator():
        failed += 1
        print(f"  {r['doc_id']}: {r['error']}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
