"""Scalar functions, as columns and (after register) as SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from arkivist.functions.formats import UNITS
from arkivist.functions.paths import CASE_INSENSITIVE

#: Heads and bodies, in the order of their use.
SQL_FUNCTIONS = {
    "is_case_insensitive_os(os STRING) RETURNS BOOLEAN": f"coalesce(lower(os) IN {CASE_INSENSITIVE}, false)",
    "forward_slashes(path STRING) RETURNS STRING": r"regexp_replace(regexp_replace(translate(path, '\\', '/'), '/+', '/'), '^\\./', '')",
    "untrailed(path STRING) RETURNS STRING": "CASE WHEN path = '/' THEN path ELSE regexp_replace(path, '/$', '') END",
    "normalize_path(path STRING, os STRING) RETURNS STRING": "CASE WHEN is_case_insensitive_os(os) THEN lower(untrailed(forward_slashes(path))) ELSE untrailed(forward_slashes(path)) END",
    "path_depth(path STRING) RETURNS BIGINT": "CASE WHEN path = '' THEN 0L ELSE CAST(size(split(path, '/')) AS BIGINT) END",
    "fmt_bytes(size BIGINT) RETURNS STRING": "CASE WHEN size < 1024 THEN format_string('%d B', size) "
    + " ".join(f"WHEN size < {1024 ** (i + 1)} THEN format_string('%.2f {u}', size / {1024**i}D)" for i, u in enumerate(UNITS[1:-1], 1))
    + f" ELSE format_string('%.2f {UNITS[-1]}', size / {1024 ** (len(UNITS) - 1)}D) END",
    "key_str(hostname STRING, volume STRING, path STRING) RETURNS STRING": "concat_ws(':', hostname, volume, CASE WHEN path = '' THEN '<root>' ELSE path END)",
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to spark.sql()."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
