"""Catalogs made of the star-schema tables, for queries that a SQL engine can check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BITS = 256  # SQL engines at hand have no SHA-512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, missing: int = 0) -> DataFrame:
    """source and lang as host and volume; missing: every so many documents lack their digest."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("d"), F.col("doc_id") % 7, F.lit("/"), F.col("doc_id") % 5, F.lit("/doc"), "doc_id")
    sha = F.sha2("text", BITS)
    if missing:
        sha = F.when(F.col("doc_id") % missing != 0, sha)
    return d.select(
        F.col("source").alias("hostname"), F.concat(F.lit("/mnt/"), "lang").alias("mount_point"), F.col("doc_id").alias("mtime"), F.lit("linux").alias("os"),
        path.alias("path"), path.alias("path_norm"), (F.lit(1000) + F.col("doc_id") % 50).alias("scanned_at"), sha.alias("sha512"),
        F.octet_length("text").cast("long").alias("size"), F.col("lang").alias("volume"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals of few keys, out of order: for the merge fold."""
    e = table(spark, sf_dir, "events")
    path = F.concat("event_type", F.lit("/u"), "user_id")
    props = F.when(F.col("event_id") % 4 != 0, F.col("props"))
    return e.select(
        F.concat(F.lit("h"), F.col("user_id") % 3).alias("hostname"), F.concat(F.lit("/m"), F.col("event_id") % 9).alias("mount_point"), F.col("event_id").alias("mtime"),
        F.lit("linux").alias("os"), path.alias("path"), path.alias("path_norm"), (F.floor(F.col("value") * 100) % 50).cast("long").alias("scanned_at"),
        F.sha2(props, BITS).alias("sha512"), F.octet_length("props").cast("long").alias("size"), F.concat(F.lit("v"), F.col("user_id") % 2).alias("volume"),
        F.col("event_id").alias("seq"),
    )


def part_trees(spark: SparkSession, sf_dir: str, later: bool = False) -> DataFrame:
    """Directory trees with many copies, four levels deep; each part is a file of its own.

    A hundred parts are one directory on five hosts with two volumes each, in most of which the
    same files have the same content.  Parts of size 48 and more have no digest; those of size 49
    have sizes of their own.  later: the catalog some time on, when files of parts of size 7 have
    another content and those of size 8 are gone.
    """
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", (F.col("p_partkey") % 100).alias("r"), F.expr("p_partkey div 100").alias("g"))
    p = p.withColumns({"s": F.expr("(r div 10) % 5"), "f": F.expr("r div 50")})
    path = F.concat(F.lit("t"), F.col("g") % 4, F.lit("/g"), "g", F.lit("/s"), "s", F.lit("/f"), "f")
    content = F.when(F.col("p_size") % 10 == 0, F.col("p_name")).otherwise(F.concat(F.lit("part "), F.expr("(g * 10 + s * 2 + f) div 3")))
    if later:
        p = p.filter("p_size <> 8")
        content = F.when(F.col("p_size") == 7, F.concat(F.lit("new "), "p_partkey")).otherwise(content)
    volume = F.concat(F.when(F.col("r") % 5 == 4, "x").otherwise("v"), F.expr("(r div 5) % 2"))
    own = p.select(F.concat(F.lit("Brand#"), 11 + F.col("r") % 5).alias("hostname"), volume.alias("volume"), path.alias("path_norm"), path.alias("path"), "p_partkey", "p_size", content.alias("content"))
    return own.select(
        "hostname", "volume", "path_norm", "path", (F.length("content") + F.when(F.col("p_size") == 49, F.col("p_partkey") * 1000).otherwise(0)).cast("long").alias("size"),
        F.when(F.col("p_size") < 48, F.sha2("content", BITS)).alias("sha512"),
    )
