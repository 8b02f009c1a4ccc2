"""Sizes: which files can be copies at all, and which of them still lack a digest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arkivist.functions.paths import key_str
from arkivist.operators.common import redealt
from arkivist.schema import WORKLIST


def size_histogram(rows: DataFrame) -> DataFrame:
    """size, n over all volumes."""
    return rows.groupBy("size").agg(F.count("*").alias("n"))


def colliding_sizes(rows: DataFrame) -> DataFrame:
    return redealt(size_histogram(rows).filter("n > 1").select("size"), "size")


def size_collisions(rows: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """The rows (of among, where given) whose size occurs more than once in rows."""
    return (rows if among is None else among).join(colliding_sizes(rows), "size", "left_semi")


def pending(rows: DataFrame) -> DataFrame:
    """Rows without a digest whose size collides: the only ones whose content has to be read."""
    return size_collisions(rows, rows.filter(F.col("sha512").isNull()))


def rehash_worklist(rows: DataFrame) -> DataFrame:
    """What is still to be hashed, ordered by host, volume and path."""
    return pending(rows).select(*WORKLIST.names).orderBy("hostname", "volume", "path_norm")


def missing_hash_warning(rows: DataFrame, examples: int = 5) -> DataFrame:
    """One row: n_missing, and the first examples in load order joined by commas."""
    own = pending(rows).select("hostname", "volume", "path_norm", key_str("hostname", "volume", "path_norm").alias("key"))
    first = own.orderBy("hostname", "volume", "path_norm").limit(examples)  # a top-k
    # examples rows at most in one array
    text = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hostname", "volume", "path_norm", "key"))), lambda x: x["key"]), ",").alias("examples"))
    total = own.agg(F.count("*").alias("n_missing"))
    return total.withColumn("one", F.lit(1)).join(text.withColumn("one", F.lit(1)), "one").drop("one")  # one row each
