"""Incremental scan: decide what a walk's rows carry over from the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arkivist.operators.common import catalog_rows
from arkivist.schema import CATALOG_COLUMNS, KEY


def load(files: DataFrame, volumes: DataFrame) -> DataFrame:
    """Files with what is known of their volumes, ordered by host, volume and path.  volumes: a row for each."""
    return files.join(volumes, ["hostname", "volume"]).orderBy(*KEY)


def unchanged(old: str = "o", new: str = "n"):
    return F.col(f"{old}.size").isNotNull() & (F.col(f"{old}.size") == F.col(f"{new}.size")) & (F.col(f"{old}.mtime") == F.col(f"{new}.mtime"))


def decide(walk: DataFrame, catalog: DataFrame, full_hash: bool = False) -> DataFrame:
    """The walk's rows with the digest they keep, and needs_hash.

    An unchanged file (same size and mtime) keeps its digest; any other starts without one.
    A full scan hashes whatever has none then.
    """
    old = catalog_rows(catalog).select(*KEY, "size", "mtime", "sha512")
    j = walk.select(*[c for c in CATALOG_COLUMNS if c != "sha512"]).alias("n").join(old.alias("o"), KEY, "left")
    same = F.coalesce(unchanged(), F.lit(False))
    sha = F.when(same, F.col("o.sha512"))
    out = j.select(*KEY, *[F.col(f"n.{c}").alias(c) for c in CATALOG_COLUMNS if c not in KEY and c != "sha512"], sha.alias("sha512"), same.alias("unchanged"))
    return out.withColumn("needs_hash", F.col("sha512").isNull() if full_hash else F.lit(False))


def invalidate_stale(decided: DataFrame, catalog: DataFrame) -> DataFrame:
    """The catalog with the digests of changed files taken out, so that they are read again."""
    changed = decided.filter(~F.col("unchanged")).select(*KEY, F.lit(True).alias("_changed"))
    out = catalog.join(changed, KEY, "left")
    return out.withColumn("sha512", F.when(F.col("_changed").isNull(), F.col("sha512"))).select(*catalog.columns)


def worklist_rows(catalog: DataFrame, worklist: DataFrame, hostname: str, volume: str) -> DataFrame:
    """The catalog's rows without a digest that a worklist names for one volume."""
    own = worklist.filter((F.col("hostname") == hostname) & (F.col("volume") == volume)).select(*KEY).distinct()
    return catalog.filter(F.col("sha512").isNull()).join(own, KEY, "left_semi")
