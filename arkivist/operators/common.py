"""What operators share: joins whose hot keys can be split, and written intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager, nullcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arkivist.schema import CATALOG, KEY

_own: dict[str, str] = {}
#: Written tables that are still there, in the order they were made.
_made: list[DataFrame] = []
_at_exit: dict[SparkSession, set[str]] = {}


def redealt(frame: DataFrame, *keys: str) -> DataFrame:
    """The same frame, of which Spark no longer knows that it is dealt out by keys.

    An aggregate by a key leaves its rows dealt out by that key, so a join on it would use
    this as it is and the other side could not be split where a key is hot.  Dealt out anew,
    the join is a plain one, and adaptive execution splits its skewed partitions.
    """
    kinds = dict(frame.dtypes)

    def same(c: str) -> Column:
        if kinds[c] == "bigint":
            return F.bitwise_not(F.bitwise_not(F.col(c)))
        return F.reverse(F.reverse(F.col(c)))

    return frame.withColumns({k: same(k) for k in keys})


def exchanged(frame: DataFrame) -> DataFrame:
    """The same frame, hinted for a join that exchanges and sorts both sides.

    Spark decides on a broadcast by the size of the files below, which are compressed, and does not count the
    rows that an explode adds, so a side that grows with the catalog can look small.  The driver collects it
    whole; and adaptive execution, which learns the real size, keeps to the plan that has fewer exchanges.
    """
    return frame.hint("merge")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.  Where it names none, a
    temporary folder does on a local master; anywhere else each executor would write to its own
    disk, so that is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set; tables between stages need a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="arkivist_catalog_")
    return _own["dir"]


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    fs, where = filesystem(spark, path)
    fs.delete(where, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may have ended before
        pass


def _remove_rest() -> None:
    for spark, paths in _at_exit.items():
        for path in paths:
            _remove_quietly(spark, path)


atexit.register(_remove_rest)


#: Spark's setting by which a query takes its shuffle files with it when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end(spark: SparkSession):
    """Queries that begin inside it remove their shuffle files when they end; else these stay until the driver
    happens to collect its garbage, and the disk holds those of several stages."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(frame: DataFrame, name: str, clean: bool = False) -> DataFrame:
    """The frame written to the shared folder and read again: its lineage ends there; with clean, its shuffle files do too."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/arkivist/{name}-{uuid.uuid4().hex}"
    with shuffles_end(spark) if clean else nullcontext():
        frame.write.parquet(path)
    _at_exit.setdefault(spark, set()).add(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out._arkivist_path = path
    _made.append(out)
    return out


def forget(frame: DataFrame) -> None:
    """Removes a written table that nothing reads any more."""
    if path := getattr(frame, "_arkivist_path", None):
        _made[:] = [x for x in _made if x is not frame]
        _at_exit.get(frame.sparkSession, set()).discard(path)
        _remove_quietly(frame.sparkSession, path)


@contextmanager
def scratch():
    """Forgets, at its end, all tables that were written inside it but those that were appended to what it gives."""
    before, keep = len(_made), []
    try:
        yield keep
    finally:
        for frame in _made[before:]:
            if not any(frame is k for k in keep):
                forget(frame)


def catalog_rows(frame: DataFrame) -> DataFrame:
    """Any frame with a catalog's columns in the catalog's types; missing optional ones are null, an empty digest is none."""
    have = set(frame.columns)
    rows = frame.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in CATALOG])
    return rows.withColumn("sha512", F.when(F.col("sha512") != "", F.col("sha512")))


def same_key(a: DataFrame, b: DataFrame) -> Column:
    out = F.lit(True)
    for c in KEY:
        out = out & (a[c] == b[c])
    return out


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
