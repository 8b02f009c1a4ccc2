"""Duplicate reports: as text for people, and as a plan that prune reads."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arkivist.functions.formats import fmt_bytes
from arkivist.operators.tree import report_order
from arkivist.schema import GROUP, PLAN_VERSION

#: The top-level key whose value "dedupe" marks a plan.
TAG = "arkivist"
# Parts of report lines.
KEEP, DUPLICATE, COVERED = "KEEP-CANDIDATE:", "DUPLICATE:     ", "   (covered by ancestor dup)"


def tag() -> Column:
    """What the report calls a member: the first one is to be kept."""
    return F.when(F.col("member_idx") == 1, KEEP).otherwise(DUPLICATE)


def report_groups(report: DataFrame) -> DataFrame:
    """One row for each reported group, its members in an array.  For plans, which hold a
    group in one value by their format."""
    member = F.struct(
        F.col("covered_by_ancestor"), F.lit(None).cast("long").alias("file_id"), F.col("hostname"), F.col("key"), F.col("orig_path"), F.col("path"), F.col("sha512"), F.col("volume")
    )
    g = report.groupBy("sig", "kind", "size_each", "file_count_each", "rank").agg(F.array_sort(F.collect_list(F.struct("member_idx", member.alias("m")))).alias("ms"))
    return g.select("file_count_each", "kind", F.transform("ms", lambda x: x["m"]).alias("members"), "sig", "size_each", "rank")


def group_lines(report: DataFrame) -> DataFrame:
    """sig, size_each, file_count_each, rank and one JSON text for each group."""
    g = report_groups(report)
    text = F.to_json(F.struct(*GROUP.names), {"ignoreNullFields": "false"})
    return g.select("sig", "size_each", "file_count_each", "rank", text.alias("value"))


def report_lines(report: DataFrame) -> DataFrame:
    """sig, rank, size_each, file_count_each, line_no, line of the human report (without the groups' numbers)."""
    r = report
    files = F.when(F.col("kind") == "dir", F.concat(F.lit("  ("), F.col("file_count_each").cast("string"), F.lit(" files each)"))).otherwise("")
    head = F.concat(F.upper("kind"), F.lit("  "), fmt_bytes("size_each"), files, F.lit("  "), F.col("copies").cast("string"), F.lit(" copies"))
    line = F.concat(F.lit("  "), tag(), F.lit(" "), F.col("key"), F.when(F.col("covered_by_ancestor"), COVERED).otherwise(""))
    order = ["sig", "rank", "size_each", "file_count_each"]
    heads = r.filter("member_idx = 1").select(*order, F.lit(0).cast("long").alias("line_no"), head.alias("line"))
    return heads.unionByName(r.select(*order, F.col("member_idx").alias("line_no"), line.alias("line")))


def human_report(report: DataFrame, catalog: str, dataset: str | None, warnings: list[str], clock=time.time) -> Iterator[str]:
    """The report's lines, a partition in memory at a time."""
    yield f"# dedupe report ({time.strftime('%Y-%m-%d %H:%M:%S %Z', time.localtime(clock()))})"
    yield f"# catalog: {catalog}"
    if dataset:
        yield f"# dataset: {dataset}"
    yield f"# duplicate groups: {report.select('sig').distinct().count()}"
    if warnings:
        yield ""
        yield from (f"WARNING: {w}" for w in warnings)
    number = 0
    for r in report_lines(report).orderBy(*report_order(), "line_no").toLocalIterator(prefetchPartitions=True):
        if r.line_no == 0:
            number += 1
            yield ""
            yield f"[{number}] {r.line}"
        else:
            yield r.line
    yield ""


#: How the plan's first line ends; each group is a line of its own after it.
OPENING = '"duplicate_groups":['


def json_plan(report: DataFrame, catalog: str, dataset: str | None, warnings: list[str], clock=time.time, tag: str = TAG) -> Iterator[str]:
    """The plan's text in pieces: one JSON value, whose groups stand one on a line."""
    facts = {tag: "dedupe", "version": PLAN_VERSION, "generated_at": int(clock()), "catalog": catalog, "dataset": dataset, "warnings": warnings}
    yield json.dumps(facts, sort_keys=True, separators=(",", ":"), ensure_ascii=False)[:-1] + f",{OPENING}\n"
    first = True
    for r in group_lines(report).orderBy(*report_order()).toLocalIterator(prefetchPartitions=True):
        yield ("" if first else ",\n") + r.value
        first = False
    yield "\n]}\n"


def _groups_by_line(spark: SparkSession, path: str) -> DataFrame:
    """group_idx and g of a plan that json_plan wrote: lines are read and parsed in parallel."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at")).filter("value like '{%' and at > 0")
    g = F.from_json(F.regexp_replace("value", ",$", ""), GROUP)
    return lines.select(F.col("at").alias("group_idx"), F.when(g.isNull(), F.raise_error(F.lit("a plan's group is not JSON")).cast(GROUP)).otherwise(g).alias("g"))


def _groups_of_one_value(spark: SparkSession, path: str) -> DataFrame:
    """The same of a plan in any layout, which has to be parsed as a whole."""
    whole = spark.read.text(path, wholetext=True)
    top = whole.select(F.from_json("value", T.MapType(T.StringType(), T.StringType())).alias("top"))
    is_plan = F.coalesce(F.exists(F.map_values("top"), lambda v: v == "dedupe") & F.map_contains_key("top", "duplicate_groups"), F.lit(False))
    if top.filter(~is_plan).limit(1).count():
        raise ValueError(f"{path} is not a dedupe plan")
    return top.select(F.posexplode(F.from_json(F.col("top")["duplicate_groups"], T.ArrayType(GROUP))).alias("group_idx", "g"))


def _opening(line: str) -> bool:
    """Whether a plan's first line is one that json_plan writes."""
    if not line.endswith("," + OPENING):
        return False
    try:
        return "dedupe" in json.loads(line[: -len(OPENING) - 1] + "}").values()
    except ValueError:
        return False


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """A plan's members: sig, kind, size_each, file_count_each, group_idx (in the plan's order) and member_idx, and each member's facts."""
    head = spark.read.text(path).limit(1).collect()
    groups = (_groups_by_line if head and _opening(head[0].value) else _groups_of_one_value)(spark, path)
    m = groups.select("group_idx", "g", F.posexplode("g.members").alias("i", "m"))
    return m.select(
        F.col("g.sig").alias("sig"), F.col("g.kind").alias("kind"), F.col("g.size_each").alias("size_each"), F.col("g.file_count_each").alias("file_count_each"),
        "group_idx", (F.col("i") + 1).cast("long").alias("member_idx"), F.col("m.hostname").alias("hostname"), F.col("m.volume").alias("volume"),
        F.col("m.path").alias("path"), F.col("m.key").alias("key"), F.col("m.covered_by_ancestor").alias("covered_by_ancestor"), F.col("m.sha512").alias("sha512"),
    )
