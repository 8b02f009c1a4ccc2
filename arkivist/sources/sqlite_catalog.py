"""Catalogs in SQLite files: a Spark data source to read them, and a writer.

spark.read.format("sqlite_catalog").load(path) gives the flat catalog rows of all volumes,
in partitions by ranges of row numbers; by_volume and row_no keep their order of arrival.
"""

from __future__ import annotations

import os
import sqlite3
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from arkivist.operators.common import catalog_rows, empty
from arkivist.schema import CATALOG, CATALOG_COLUMNS, SCHEMA_VERSION
from arkivist.ship import ship
from arkivist.sources.jsonl import append_log

ROWS_AT_ONCE = 250_000
SCHEMA = "file_id long, hostname string, mount_point string, mtime long, os string, path string, path_norm string, scanned_at long, sha512 string, size long, volume string, by_volume boolean, row_no long"

# Tables, columns and indexes of a catalog file, by the names other programs look for.
DDL = (
    "CREATE TABLE meta (key TEXT PRIMARY KEY, value TEXT)",
    "CREATE TABLE volumes (volume_id INTEGER PRIMARY KEY AUTOINCREMENT, hostname TEXT NOT NULL, volume TEXT NOT NULL, mount_point TEXT, os TEXT, scanned_at INTEGER, UNIQUE (hostname, volume))",
    "CREATE TABLE files (file_id INTEGER PRIMARY KEY AUTOINCREMENT, volume_id INTEGER NOT NULL REFERENCES volumes (volume_id) ON DELETE CASCADE, path TEXT NOT NULL, path_norm TEXT NOT NULL, "
    "size INTEGER NOT NULL, mtime INTEGER NOT NULL, sha512 TEXT, scanned_at INTEGER NOT NULL, UNIQUE (volume_id, path_norm))",
    "CREATE INDEX idx_files_sha512 ON files (sha512) WHERE sha512 IS NOT NULL",
    "CREATE INDEX idx_files_size ON files (size)",
    "CREATE INDEX idx_files_volume_path ON files (volume_id, path_norm)",
)


def connect(path: str) -> sqlite3.Connection:
    """Read-only; a missing file or another schema version is an error."""
    if not os.path.isfile(path):
        raise FileNotFoundError(f"no such catalog: {path}")
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    version = con.execute("SELECT value FROM meta WHERE key = 'schema_version'").fetchone()
    if not version or str(version[0]) != str(SCHEMA_VERSION):
        raise ValueError(f"catalog {path} has schema version {version and version[0]}, not {SCHEMA_VERSION}")
    return con


def read_meta(path: str) -> dict[str, str]:
    con = connect(path)
    try:
        return dict(con.execute("SELECT key, value FROM meta"))
    finally:
        con.close()


class Span(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class CatalogReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        con = connect(self.path)
        low, high = con.execute("SELECT min(file_id), max(file_id) FROM files").fetchone()
        con.close()
        return [Span(0, 0)] if low is None else [Span(a, min(a + ROWS_AT_ONCE, high + 1)) for a in range(low, high + 1, ROWS_AT_ONCE)]

    def read(self, partition: Span):
        con = connect(self.path)
        con.text_factory = lambda b: b.decode("utf-8", "replace")
        try:
            found = con.execute(
                "SELECT f.file_id, v.hostname, v.mount_point, f.mtime, v.os, f.path, f.path_norm, f.scanned_at, nullif(f.sha512, ''), f.size, v.volume, f.file_id "
                "FROM files f JOIN volumes v USING (volume_id) WHERE f.file_id >= ? AND f.file_id < ?",
                (partition.low, partition.high),
            )
            for *facts, row_no in found:
                yield (*facts, True, row_no)
        finally:
            con.close()


class CatalogSource(DataSource):
    @classmethod
    def name(cls):
        return "sqlite_catalog"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return CatalogReader(self.options)


def writer(path: str, wait: float = 5.0) -> sqlite3.Connection:
    """A connection that holds the file's write lock; what a killed writer left in its log is taken in first."""
    con = sqlite3.connect(path, timeout=wait, isolation_level=None)
    try:
        con.execute("BEGIN IMMEDIATE")
    except sqlite3.OperationalError as e:
        con.close()
        raise BlockingIOError(f"catalog {path} is in use by another writer: {e}") from e
    return con


def probe(path: str) -> None:
    """Raises BlockingIOError where another writer is at work."""
    con = writer(path, 0.0)
    con.execute("ROLLBACK")
    con.close()


def _fill(con: sqlite3.Connection, rows: DataFrame, now: int, volumes: list[dict]) -> int:
    """Volumes and rows into empty tables; rows are streamed in order: one file has one writer."""
    ids: dict[tuple, int] = {}

    def volume(hostname, name, mount_point, system, scanned_at) -> int:
        key = (hostname, name)
        if key not in ids:
            ids[key] = con.execute("INSERT INTO volumes (hostname, volume, mount_point, os, scanned_at) VALUES (?, ?, ?, ?, ?)", (*key, mount_point, system, scanned_at)).lastrowid
        return ids[key]

    n = 0
    for v in volumes:
        volume(v["hostname"], v["volume"], v["mount_point"], v["os"], v["scanned_at"])
    for r in rows.select(*CATALOG_COLUMNS).orderBy("hostname", "volume", "path_norm").toLocalIterator(prefetchPartitions=True):
        number = volume(r.hostname, r.volume, r.mount_point, r.os, now)
        con.execute("INSERT INTO files (volume_id, path, path_norm, size, mtime, sha512, scanned_at) VALUES (?, ?, ?, ?, ?, ?, ?)", (number, r.path, r.path_norm, r.size, r.mtime, r.sha512, r.scanned_at))
        n += 1
    return n


def write_catalog(rows: DataFrame, path: str, dataset: str | None = None, now: int | None = None, volumes: list[dict] | None = None) -> int:
    """A catalog as a new SQLite file on the driver; an existing file is refused.  Returns the number of rows."""
    if os.path.exists(path):
        raise FileExistsError(f"exists already: {path}")
    now = int(time.time()) if now is None else now
    con = writer(path)
    try:
        for statement in DDL:
            con.execute(statement)
        con.executemany("INSERT INTO meta VALUES (?, ?)", [("schema_version", str(SCHEMA_VERSION)), ("created_at", str(now)), *([("dataset_name", dataset)] if dataset else [])])
        n = _fill(con, rows, now, volumes or [])
        con.execute("COMMIT")
    except BaseException:
        con.close()
        os.remove(path)
        raise
    con.close()
    return n


class SqliteCatalog:
    """A catalog file with the interface of a CatalogStore; a commit is one transaction in the file."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        return os.path.exists(self.path)

    def facts(self) -> dict:
        meta = read_meta(self.path)
        return {"schema_version": int(meta["schema_version"]), "dataset_name": meta.get("dataset_name"), "created_at": int(meta.get("created_at") or 0)}

    def create(self, dataset: str | None = None, now: int | None = None) -> SqliteCatalog:
        write_catalog(empty(self.spark, CATALOG), self.path, dataset, now)
        return self

    def open_or_create(self, dataset: str | None = None, now: int | None = None) -> SqliteCatalog:
        if not self.exists():
            return self.create(dataset, now)
        self.facts()
        probe(self.path)
        return self

    def meta_get(self, key: str) -> str | None:
        connect(self.path).close()
        return read_meta(self.path).get(key)

    def meta_put(self, key: str, value) -> None:
        con = sqlite3.connect(self.path)
        with con:
            con.execute("INSERT INTO meta (key, value) VALUES (?, ?) ON CONFLICT (key) DO UPDATE SET value = excluded.value", (key, value))
        con.close()

    def rows(self) -> DataFrame:
        ship(self.spark)
        self.spark.dataSource.register(CatalogSource)
        return catalog_rows(self.spark.read.format("sqlite_catalog").load(self.path))

    def volumes(self) -> list[dict]:
        con = connect(self.path)
        names = ("hostname", "volume", "mount_point", "os", "scanned_at")
        found = [dict(zip(names, r, strict=True)) for r in con.execute("SELECT hostname, volume, mount_point, os, scanned_at FROM volumes ORDER BY hostname, volume")]
        con.close()
        return found

    def upsert_volume(self, hostname: str, volume: str, mount_point: str | None, system: str | None, now: int) -> None:
        con = sqlite3.connect(self.path)
        with con:
            con.execute(
                "INSERT INTO volumes (hostname, volume, mount_point, os, scanned_at) VALUES (?, ?, ?, ?, ?) "
                "ON CONFLICT (hostname, volume) DO UPDATE SET mount_point = excluded.mount_point, os = excluded.os, scanned_at = excluded.scanned_at",
                (hostname, volume, mount_point, system, now),
            )
        con.close()

    def log(self, rows: DataFrame, hashlog: str | None = None) -> None:
        append_log(rows, hashlog or f"{self.path}.hashlog.jsonl")

    def commit(self, rows: DataFrame, volumes: list[dict] | None = None) -> None:
        """Makes rows the catalog's content.  The file's own journal undoes a commit that breaks off."""
        facts, volumes = self.facts(), self.volumes() if volumes is None else volumes
        con = writer(self.path)
        try:
            con.execute("DELETE FROM files")
            con.execute("DELETE FROM volumes")
            _fill(con, rows, facts["created_at"], volumes)
            con.execute("COMMIT")
        finally:
            con.close()
