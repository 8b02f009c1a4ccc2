"""The native catalog: a folder of Parquet snapshots, and the hash log beside it.

    <path>/CURRENT         the number of the snapshot that counts, and the catalog's facts (JSON)
    <path>/v=<number>      the rows, partitioned by host and volume
    <path>/claim=<number>  taken by the one commit that may make this snapshot
    <path>.hashlog.jsonl   JSON lines, one for each row ever written (see append_log)

A commit writes a new snapshot, claims its number, then swaps CURRENT by a rename.  A commit
onto another snapshot than the one that was read is refused, so no writer undoes another's work.
Readers of an older snapshot keep it until the next commit but one.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arkivist.operators.common import catalog_rows, empty, filesystem
from arkivist.schema import CATALOG, CATALOG_COLUMNS, SCHEMA_VERSION
from arkivist.sources.jsonl import append_log


class CatalogStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._read: int | None = None  # the snapshot that rows() gave last

    def _at(self, name: str):
        return filesystem(self.spark, f"{self.path}/{name}")

    def exists(self) -> bool:
        fs, where = self._at("CURRENT")
        return fs.exists(where)

    def facts(self) -> dict:
        """schema_version, created_at, dataset_name, snapshot, volumes."""
        fs, where = self._at("CURRENT")
        if not fs.exists(where):
            raise FileNotFoundError(f"no catalog at {self.path}")
        facts = json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.path}/CURRENT").collect()))  # a few lines
        if facts.get("schema_version") != SCHEMA_VERSION:
            raise ValueError(f"catalog {self.path} has schema version {facts.get('schema_version')}, not {SCHEMA_VERSION}")
        return facts

    def create(self, dataset: str | None = None, now: int | None = None) -> CatalogStore:
        if self.exists():
            raise FileExistsError(f"exists already: {self.path}")
        self._swap({"schema_version": SCHEMA_VERSION, "created_at": int(time.time()) if now is None else now, "dataset_name": dataset, "snapshot": 0, "volumes": []})
        return self

    def open_or_create(self, dataset: str | None = None, now: int | None = None) -> CatalogStore:
        return self if self.exists() else self.create(dataset, now)

    def _swap(self, facts: dict) -> None:
        jvm = self.spark.sparkContext._jvm
        fs, new = self._at("CURRENT.new")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(facts, sort_keys=True).encode()))
        out.close()
        _, where = self._at("CURRENT")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        option = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        option[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fs.makeQualified(new), fs.makeQualified(where), option)

    def meta_get(self, key: str):
        return self.facts().get(key)

    def meta_put(self, key: str, value) -> None:
        self._swap(self.facts() | {key: value})

    def rows(self) -> DataFrame:
        snapshot = self._read = self.facts()["snapshot"]
        if not snapshot:
            return empty(self.spark, CATALOG)
        return self.spark.read.schema(CATALOG).parquet(f"{self.path}/v={snapshot}").select(*CATALOG_COLUMNS)

    def volumes(self) -> list[dict]:
        """hostname, volume, mount_point, os, scanned_at: one entry for each volume."""
        return self.facts()["volumes"]

    def upsert_volume(self, hostname: str, volume: str, mount_point: str | None, os: str | None, now: int) -> None:
        facts = self.facts()
        rest = [v for v in facts["volumes"] if (v["hostname"], v["volume"]) != (hostname, volume)]
        rest.append({"hostname": hostname, "volume": volume, "mount_point": mount_point, "os": os, "scanned_at": now})
        facts["volumes"] = sorted(rest, key=lambda v: (v["hostname"], v["volume"]))
        self._swap(facts)

    def log(self, rows: DataFrame, hashlog: str | None = None) -> None:
        append_log(rows, hashlog or f"{self.path}.hashlog.jsonl")

    def _claim(self, number: int) -> None:
        fs, where = self._at(f"claim={number}")
        if self.facts()["snapshot"] != number - 1 or fs.exists(where):
            raise BlockingIOError(f"another writer is at {self.path}, or broke off there (then remove {where})")
        fs.create(where, False).close()

    def commit(self, rows: DataFrame, volumes: list[dict] | None = None) -> None:
        """Makes rows the catalog's content."""
        facts = self.facts()
        old, number = facts["snapshot"], facts["snapshot"] + 1
        if self._read is not None and self._read != old:
            raise BlockingIOError(f"{self.path} was changed by another writer since it was read")
        keyed = catalog_rows(rows)
        keyed.repartition("hostname", "volume", F.pmod(F.xxhash64("path_norm"), F.lit(64))).write.mode("overwrite").partitionBy("hostname", "volume").parquet(f"{self.path}/v={number}")
        facts["snapshot"] = number
        if volumes is not None:
            facts["volumes"] = volumes
        self._claim(number)
        self._swap(facts)
        self._read = number
        for name in (f"v={old - 1}", f"claim={old}"):
            fs, where = self._at(name)
            fs.delete(where, True)
