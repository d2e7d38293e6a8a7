"""``python -m strata.cli scan|trace|guide``."""

from __future__ import annotations

import argparse
import datetime

from strata.functions.targets import parse_target
from strata.plans.documented import QUERIES
from strata.schema import ddl

GUIDE = """# Lineage tables

A run traces lines back through blame and diffs. `scan` begins with every line that HEAD added since its
merge base with a base ref, `trace` with one `path:line` range of HEAD. Each range is a request; its blame
spans end (an edge type other than `recurse_to_parent`) or lead to requests against the parents.

## Tables

```sql
{schema}
```

## Questions

{queries}
"""


def guide() -> str:
    """The guide with the tables' DDL and the documented queries in place."""
    asked = "\n\n".join(f"`{name}`\n\n```sql\n{sql}\n```" for name, sql in QUERIES.items())
    return GUIDE.replace("{schema}", ddl()).replace("{queries}", asked)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strata")
    sub = top.add_subparsers(dest="command", required=True)
    for name, depth in (("scan", 5), ("trace", 20)):
        p = sub.add_parser(name)
        if name == "scan":
            p.add_argument("base", nargs="?", default="origin/main")
        else:
            p.add_argument("target")
        p.add_argument("--repo", default=".")
        p.add_argument("--out", help="folder of Parquet tables")
        p.add_argument("--sqlite", help="SQLite file")
        p.add_argument("--max-depth", type=int, default=depth)
        p.add_argument("--since", type=datetime.date.fromisoformat)
        p.add_argument("--include-binary", action="store_true")
        p.add_argument("--rename-threshold", type=int, default=50)
        p.add_argument("--moved", type=int, default=0, help="characters from which on moved lines keep their commit")
    g = sub.add_parser("guide")
    g.add_argument("-o", "--output", default="LINEAGE.md")
    g.add_argument("--stdout", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "guide":
        if args.stdout:
            print(guide())
        else:
            with open(args.output, "w", encoding="utf-8") as f:
                f.write(guide())
        return 0
    if args.command == "trace":
        parse_target(args.target)
    from pyspark.sql import SparkSession

    from strata.plans.history import History

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    h = History.from_git(spark, args.repo, threshold=args.rename_threshold, include_binary=args.include_binary, moved=args.moved)
    options = {"max_depth": args.max_depth, "since": args.since}
    found = h.scan(args.base, **options) if args.command == "scan" else h.trace(args.target, **options)
    if args.out:
        found.write(args.out)
    if args.sqlite:
        found.export_sqlite(args.sqlite)
    found.summary().show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
