"""Command line: python -m arkivist scan|dedupe|prune|merge."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from arkivist.functions.paths import default_hostname


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="arkivist", description="Catalogs of file archives: scan, find duplicates, prune, merge.")
    sub = p.add_subparsers(dest="command")
    s = sub.add_parser("scan", help="walk a tree into a catalog and hash what can have a copy")
    for name in ("catalog", "volume", "root", "hostname", "mount-point", "rehash-list", "dataset", "hashlog"):
        s.add_argument(f"--{name}")
    for name in ("full-hash", "rehash", "no-hashlog", "any-host"):
        s.add_argument(f"--{name}", action="store_true")
    s.add_argument("--stale-hash", choices=("keep", "invalidate"), default="keep")
    s.add_argument("--progress-every", type=int, help="files between two lines of progress")
    s.add_argument("--commit-every", type=int, help="files of a slice that is hashed, logged and committed at once")
    s.add_argument("--hash-threads", type=int, help="tasks that hash a slice")
    d = sub.add_parser("dedupe", help="report duplicate files and trees")
    d.add_argument("--catalog")
    d.add_argument("--format", choices=("human", "json"), default="human")
    d.add_argument("--output")
    d.add_argument("--min-size", type=int, default=0)
    r = sub.add_parser("prune", help="delete duplicates by a plan; shows only, unless --apply")
    for name in ("catalog", "plan", "keep-rule"):
        r.add_argument(f"--{name}")
    r.add_argument("--hostname", default=default_hostname())
    r.add_argument("--interactive", action=argparse.BooleanOptionalAction, default=True)
    for name in ("apply", "file-level"):
        r.add_argument(f"--{name}", action="store_true")
    r.add_argument("--verify", action=argparse.BooleanOptionalAction, default=True, help="read what goes and what stays, and compare it with the catalog")
    r.add_argument("-y", "--yes", action="store_true")
    m = sub.add_parser("merge", help="merge catalogs and logs")
    m.add_argument("--output")
    m.add_argument("--inputs", nargs="+", default=[])
    m.add_argument("--rehash-list")
    m.add_argument("--dataset")
    m.add_argument("--append", action="store_true")
    m.add_argument("--lenient", action="store_true")
    for x in (s, r, m):
        x.add_argument("-q", "--quiet", action="store_true")
    return p


REQUIRED = {"scan": ("catalog", "volume", "root"), "dedupe": ("catalog",), "prune": ("catalog", "plan"), "merge": ("output", "inputs")}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit codes: 0 done, 1 aborted, 2 wrong usage or errors."""
    p = parser()
    try:
        a = p.parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    if not a.command:
        p.print_help()
        return 0
    missing = [f"--{n}" for n in REQUIRED[a.command] if not getattr(a, n)]
    if missing:
        sys.stderr.write(f"arkivist {a.command}: missing {', '.join(missing)}\n")
        return 2
    from arkivist.plans import commands as c

    spark = spark or SparkSession.builder.appName("arkivist").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    o = {k: v for k, v in vars(a).items() if k != "command"}
    try:
        if a.command == "scan":
            c.scan_command(spark, **o)
        elif a.command == "dedupe":
            c.dedupe_command(spark, **o)
        elif a.command == "prune":
            return c.prune_command(spark, **o).code
        else:
            o["mode"] = "append" if o.pop("append") else "error"
            c.merge_command(spark, **o)
    except (ValueError, OSError) as e:
        sys.stderr.write(f"arkivist {a.command}: {e}\n")
        return 2
    return 0
