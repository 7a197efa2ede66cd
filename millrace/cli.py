"""Command line: `python -m millrace.cli medallion|harmonise|publish|report ...`; prints one JSON document.  Exit status 0
if the run's quality passed, 1 if not, 2 if the input can't be read."""

from __future__ import annotations

import argparse
import json
import sys
from typing import Any

from pyspark.sql import SparkSession

from millrace.plans import runs
from millrace.plans.catalog import Catalog, report
from millrace.plans.snapshots import SnapshotTable
from millrace.session import build_session
from millrace.sources.files import MissingColumns


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="millrace")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *needed: str) -> argparse.ArgumentParser:
        one = commands.add_parser(name, help=about)
        for option in needed:
            one.add_argument(f"--{option}", required=True)
        return one

    command("medallion", "source events to bronze, silver and gold", "input", "output").add_argument("--business-date")
    command("harmonise", "wide sources to long rows to one row by entity", "input", "mappings", "output").add_argument("--business-date")
    command("publish", "a canonical batch to a table's snapshot", "input", "warehouse", "table", "business-date").add_argument("--evidence")
    told = command("report", "the last run, its checks and its lineage", "output")
    told.add_argument("--dataset", default=runs.MEDALLION)
    told.add_argument("--run-id")
    return top


def _told(args: argparse.Namespace, spark: SparkSession) -> tuple[dict[str, Any], bool]:
    if args.command == "publish":
        table = SnapshotTable(spark, args.warehouse, args.table)
        found = runs.publish_batch(spark, args.input, args.business_date, table, args.evidence)
        return found, found["status"] != "quality_failed"
    if args.command == "report":
        known = [r for r in Catalog(f"{args.output}/_catalog").runs(args.dataset) if args.run_id in (None, r["run_id"])]
        if not known:
            raise FileNotFoundError(f"no such run under {args.output}")
        return report(known[-1]), True
    if args.command == "medallion":
        result = runs.medallion(spark, args.input, args.output, args.business_date)
    else:
        result = runs.harmonise(spark, args.input, args.mappings, args.output, args.business_date)
    return {"status": result.status, "passed": result.passed, "run_id": result.run["run_id"], "stats": result.run["stats"]}, result.passed


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        found, fine = _told(args, spark or build_session("millrace"))
    except (FileNotFoundError, MissingColumns) as x:
        print(x, file=sys.stderr)
        return 2
    print(json.dumps(found, ensure_ascii=False, default=str))
    return 0 if fine else 1


if __name__ == "__main__":
    sys.exit(main())
