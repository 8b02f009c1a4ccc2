"""Sources and sinks: file systems, SQLite catalogs, JSON lines, Parquet stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arkivist.schema import LOG
from arkivist.ship import ship
from arkivist.sources.fswalk import WalkSource
from arkivist.sources.jsonl import read_jsonl, sniff
from arkivist.sources.sqlite_catalog import CatalogSource, SqliteCatalog
from arkivist.sources.store import CatalogStore


def register(spark: SparkSession) -> None:
    """Makes the fswalk and sqlite_catalog formats known to the session."""
    ship(spark)
    spark.dataSource.register(WalkSource)
    spark.dataSource.register(CatalogSource)


def read_catalog(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """The rows of a catalog of any format, with whatever says their order of arrival."""
    kind = sniff(spark, path)
    if kind == "sqlite":
        register(spark)
        return spark.read.format("sqlite_catalog").load(path)
    if kind == "jsonl":
        return read_jsonl(spark, path, LOG, lenient=lenient)
    if kind == "store":
        return CatalogStore(spark, path).rows()
    return spark.read.parquet(path)


def open_catalog(spark: SparkSession, path: str) -> CatalogStore | SqliteCatalog:
    """A catalog by its path: SQLite files by their suffix or content, anything else a store."""
    if path.lower().endswith((".sqlite", ".db")) or (SqliteCatalog(spark, path).exists() and sniff(spark, path) == "sqlite"):
        return SqliteCatalog(spark, path)
    return CatalogStore(spark, path)
