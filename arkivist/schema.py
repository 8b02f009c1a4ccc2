"""Schemas of catalogs, worklists and duplicate plans."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L = T.StringType(), T.LongType()


def _of(*fields):
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


META = _of(("key", _S, False), ("value", _S, True))
VOLUMES = _of(("volume_id", _L, False), ("hostname", _S, False), ("volume", _S, False), ("mount_point", _S, True), ("os", _S, True), ("scanned_at", _L, True))
FILES = _of(
    ("file_id", _L, False), ("volume_id", _L, False), ("path", _S, False), ("path_norm", _S, False),
    ("size", _L, False), ("mtime", _L, False), ("sha512", _S, True), ("scanned_at", _L, False),
)

#: One row of a catalog, with its volume: what all operators take and what the JSON lines hold (keys in this order).
CATALOG = _of(
    ("hostname", _S, True), ("mount_point", _S, True), ("mtime", _L, True), ("os", _S, True), ("path", _S, True),
    ("path_norm", _S, True), ("scanned_at", _L, True), ("sha512", _S, True), ("size", _L, True), ("volume", _S, True),
)
CATALOG_COLUMNS = CATALOG.names
#: A line of a hash log: a catalog's row, or a tombstone (deleted) that takes one away.
LOG = T.StructType([*CATALOG.fields, T.StructField("deleted", T.BooleanType())])
#: A row's identity: catalogs' own numbers are never compared across catalogs.
KEY = ["hostname", "volume", "path_norm"]

WORKLIST = _of(("hostname", _S, True), ("mount_point", _S, True), ("path", _S, True), ("path_norm", _S, True), ("size", _L, True), ("volume", _S, True))

MEMBER = T.StructType([
    T.StructField("covered_by_ancestor", T.BooleanType()), T.StructField("file_id", _L), T.StructField("hostname", _S), T.StructField("key", _S),
    T.StructField("orig_path", _S), T.StructField("path", _S), T.StructField("sha512", _S), T.StructField("volume", _S),
])
GROUP = T.StructType([
    T.StructField("file_count_each", _L), T.StructField("kind", _S), T.StructField("members", T.ArrayType(MEMBER)), T.StructField("sig", _S), T.StructField("size_each", _L),
])
PLAN_VERSION = 1
SCHEMA_VERSION = 1
