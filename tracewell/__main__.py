"""python -m tracewell list | analyse NAME TABLES | query NAME TABLES [--out FOLDER]: analyses and queries over a folder of tables."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans import composed, literals, problems, reference, selection  # noqa: F401
from .plans.domain import Tables
from .runtime import ship


def main(args: list[str] | None = None) -> int:
    known = {**problems.QUERIES, **reference.QUERIES}
    parser = argparse.ArgumentParser(prog="tracewell")
    parser.add_argument("command", choices=["list", "analyse", "query"])
    parser.add_argument("name", nargs="?")
    parser.add_argument("tables", nargs="?")
    parser.add_argument("--out", help="folder for the rows as JSON; without it the first of them are shown")
    got = parser.parse_args(args)
    if got.command == "list":
        print("\n".join([*(f"analyse {n}" for n in composed.ANALYSES), *(f"query {n}" for n in known)]))
        return 0
    choice = composed.ANALYSES if got.command == "analyse" else known
    if got.name not in choice or not got.tables:
        parser.error(f"{got.command} needs one of {', '.join(choice)} and a folder of tables")
    spark = SparkSession.builder.appName("tracewell").getOrCreate()
    ship(spark)
    rows = composed.run_analysis(Tables(spark, got.tables), got.name) if got.command == "analyse" else known[got.name](spark, got.tables)
    if got.out:
        rows.write.mode("overwrite").json(got.out)
    else:
        rows.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
