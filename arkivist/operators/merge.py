"""Merging catalogs: rows of one key arrive in order and are folded into one.

A later row with the same or a newer scan time replaces path, size and mtime; its digest
replaces the digest if it has one; a digest also fills a gap whatever its age.  As windows
over the arrivals of a key: a digest is accepted where no earlier arrival was scanned later,
and the last accepted digest wins, or else the first one.  A tombstone (deleted) takes away all
that came before it.  A folded row stands for its arrivals: folded again with later ones, it
gives what all of them give.  Windows and aggregates are by the
same key, so one exchange serves them all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arkivist.functions.paths import normalize_path
from arkivist.operators.common import catalog_rows, exchanged
from arkivist.schema import CATALOG, CATALOG_COLUMNS, KEY


def _deleted(rows: DataFrame) -> Column:
    return F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in rows.columns else F.lit(False)


def valid_rows(rows: DataFrame, now: int) -> DataFrame:
    """JSON-lines rows with what they may leave out; rows without host, volume or path go, but for tombstones, which need a path_norm."""
    r = rows.dropna(subset=["hostname", "volume"]).withColumn("deleted", _deleted(rows))
    r = r.filter(F.col("path").isNotNull() | (F.col("deleted") & F.col("path_norm").isNotNull()))
    return r.withColumns({
        "path_norm": F.coalesce("path_norm", normalize_path("path", "os")),
        "scanned_at": F.coalesce("scanned_at", F.lit(now).cast("long")),
        "mtime": F.coalesce("mtime", F.lit(0).cast("long")),
        "size": F.coalesce("size", F.lit(0).cast("long")),
    })


def union_inputs(inputs: list[DataFrame]) -> DataFrame:
    """All rows of all inputs, with their arrival seq: the input, then the volume (of catalogs), then the place in the file."""
    out = []
    for i, frame in enumerate(inputs):
        row_no = F.col("row_no").cast("long") if "row_no" in frame.columns else F.monotonically_increasing_id()
        by_volume = F.col("by_volume") if "by_volume" in frame.columns else F.lit(False)
        seq = F.struct(
            F.lit(i).alias("input"),
            F.when(by_volume, F.col("hostname")).otherwise("").alias("h"),
            F.when(by_volume, F.col("volume")).otherwise("").alias("v"),
            (F.col("row_file") if "row_file" in frame.columns else F.lit("")).alias("file"),
            (F.col("row_block") if "row_block" in frame.columns else F.lit(0)).cast("long").alias("block"),
            row_no.alias("row"),
        )
        have = set(frame.columns)
        out.append(frame.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in CATALOG], _deleted(frame).alias("deleted"), seq.alias("seq")))
    return reduce(DataFrame.unionByName, out)


def _live(rows: DataFrame) -> DataFrame:
    """The arrivals after the last tombstone of their key."""
    if "deleted" not in rows.columns:
        return rows
    gone = F.max(F.when(F.col("deleted"), F.col("seq"))).over(Window.partitionBy(*KEY))
    return rows.withColumn("_gone", gone).filter(F.col("_gone").isNull() | (F.col("seq") > F.col("_gone"))).drop("_gone", "deleted")


def _with_state(rows: DataFrame) -> DataFrame:
    """The live arrivals with acc (the digest, where it is accepted) and before (the digest the key had)."""
    rows = _live(rows)
    w = Window.partitionBy(*KEY).orderBy("seq")
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    r = rows.withColumn("sha512", F.when(F.col("sha512") != "", F.col("sha512")))
    r = r.withColumn("newest", F.max("scanned_at").over(prior))
    r = r.withColumn("acc", F.when(F.col("newest").isNull() | (F.col("scanned_at") >= F.col("newest")), F.col("sha512")))
    return r.withColumn("before", F.coalesce(F.last("acc", ignorenulls=True).over(prior), F.first("sha512", ignorenulls=True).over(prior)))


def merge_fold(rows: DataFrame) -> DataFrame:
    """One row for each key.  rows: a catalog's columns and seq (anything that orders the arrivals).

    mount_point and os are the volume's, from its first arrival.  sha_from_older_scan marks a
    digest that is older than the size and mtime beside it.
    """
    r = _with_state(rows)
    newest = F.struct("scanned_at", "seq")
    has = F.col("sha512").isNotNull()
    out = r.groupBy(*KEY).agg(
        F.max_by(F.struct("path", "size", "mtime"), newest).alias("new"),
        F.max("scanned_at").alias("scanned_at"),
        F.max_by(F.struct("sha512", "scanned_at"), F.when(F.col("acc").isNotNull(), F.col("seq"))).alias("acc"),
        F.min_by(F.struct("sha512", "scanned_at"), F.when(has, F.col("seq"))).alias("fill"),
    )
    digest = F.coalesce("acc", "fill")
    return out.select(
        *KEY, F.col("new.path").alias("path"), F.col("new.size").alias("size"), F.col("new.mtime").alias("mtime"),
        digest["sha512"].alias("sha512"), "scanned_at", F.coalesce(digest["scanned_at"] < F.col("scanned_at"), F.lit(False)).alias("sha_from_older_scan"),
    )


def merge_volumes(rows: DataFrame, now: int) -> DataFrame:
    """One row for each volume that has files: mount point and system of its first arrival, scanned now."""
    v = rows.filter(~_deleted(rows)).groupBy("hostname", "volume").agg(F.min_by(F.struct("mount_point", "os"), "seq").alias("first"))
    return v.select("hostname", "volume", F.col("first.mount_point").alias("mount_point"), F.col("first.os").alias("os"), F.lit(now).cast("long").alias("scanned_at"))


def merge_catalogs(rows: DataFrame, now: int) -> DataFrame:
    """The merged catalog with its volumes' mount points and systems."""
    volumes = merge_volumes(rows, now).select("hostname", "volume", "mount_point", "os")
    return merge_fold(rows).join(volumes, ["hostname", "volume"]).select(*CATALOG_COLUMNS)


def merge_counters(rows: DataFrame) -> DataFrame:
    """One row, of live arrivals: total, conflicts (arrivals at a known key), hash_disagreements (digest differs from the one known then)."""
    r = _with_state(rows)
    known = F.row_number().over(Window.partitionBy(*KEY).orderBy("seq")) > 1
    r = r.select(known.alias("known"), (F.col("before").isNotNull() & F.col("sha512").isNotNull() & (F.col("before") != F.col("sha512"))).alias("differs"))
    return r.agg(
        F.count("*").alias("total"), F.coalesce(F.sum(F.col("known").cast("long")), F.lit(0)).alias("conflicts"),
        F.coalesce(F.sum(F.col("differs").cast("long")), F.lit(0)).alias("hash_disagreements"),
    )


def hash_disagreements(rows: DataFrame) -> DataFrame:
    """The arrivals whose digest differs from the one known then: key and both digests."""
    r = _with_state(rows)
    return r.filter(F.col("before") != F.col("sha512")).select(*KEY, F.col("before").alias("known_sha512"), "sha512")


def upsert(catalog: DataFrame, news: DataFrame) -> DataFrame:
    """A scan's rows over a catalog's: new path, size, mtime and time; a digest stays unless there is a new one.  News keys must be unique."""
    old, new = catalog_rows(catalog).alias("o"), catalog_rows(news).alias("n")
    j = old.join(new, KEY, "full_outer")
    hit = F.col("n.size").isNotNull()
    pick = {c: F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in CATALOG_COLUMNS if c not in KEY}
    pick["sha512"] = F.coalesce(F.col("n.sha512"), F.col("o.sha512"))
    return j.select(*[(pick[c] if c in pick else F.col(c)).alias(c) for c in CATALOG_COLUMNS])


def set_digests(catalog: DataFrame, digests: DataFrame) -> DataFrame:
    """Fills in digests by key (key columns and sha512); other columns stay."""
    d = digests.select(*KEY, F.col("sha512").alias("_new"))
    out = catalog.join(d, KEY, "left").withColumn("sha512", F.coalesce("_new", "sha512"))
    return out.select(*[c for c in catalog.columns])


def delete_rows(catalog: DataFrame, gone: DataFrame) -> DataFrame:
    """The catalog without the keys of gone."""
    return catalog.join(exchanged(gone.select(*KEY).distinct()), KEY, "left_anti")


def upsert_volume(volumes: DataFrame, hostname: str, volume: str, mount_point: str | None, os: str | None, now: int) -> DataFrame:
    """Volumes with one added or renewed; its number stays, a new one follows the largest."""
    spark = volumes.sparkSession
    one = spark.createDataFrame([(hostname, volume, mount_point, os, now)], "hostname string, volume string, mount_point string, os string, scanned_at long")
    top = volumes.agg(F.coalesce(F.max("volume_id"), F.lit(0)).alias("m")).first().m
    j = volumes.alias("o").join(one.alias("n"), ["hostname", "volume"], "full_outer")
    hit = F.col("n.scanned_at").isNotNull()
    return j.select(
        F.coalesce("o.volume_id", F.lit(top + 1)).cast("long").alias("volume_id"), "hostname", "volume",
        *[F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in ("mount_point", "os", "scanned_at")],
    )
