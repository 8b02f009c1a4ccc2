"""JSON lines: catalogs, hash logs and worklists; and telling an input's format."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arkivist.operators.common import filesystem, remove, shared_dir
from arkivist.schema import CATALOG, CATALOG_COLUMNS, KEY, LOG, WORKLIST

BAD = "_corrupt_record"
SQLITE_MAGIC = b"SQLite format 3"
COPY_BYTES = 1 << 20


def with_places(lines: DataFrame) -> DataFrame:
    """Lines with where they stand: row_file, row_block and (inside these) row_no."""
    return lines.select("value", F.col("_metadata.file_path").alias("row_file"), F.col("_metadata.file_block_start").alias("row_block"))


def parse(lines: DataFrame, schema: T.StructType = CATALOG, lenient: bool = False) -> DataFrame:
    """Rows of lines with their places.  Blank lines and lines without a single known field count
    for nothing; a malformed line is an error unless lenient."""
    lines = lines.withColumn("row_no", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    full = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    parsed = lines.withColumn("r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}))
    bad = F.col(f"r.{BAD}").isNotNull() | F.col("r").isNull()
    if lenient:
        parsed = parsed.filter(~bad)
    else:
        fault = F.raise_error(F.concat(F.lit("malformed JSON line: "), F.substring("value", 1, 200)))
        parsed = parsed.withColumn("r", F.when(bad, fault.cast(full)).otherwise(F.col("r")))
    return parsed.select(*[F.col(f"r.{c}").alias(c) for c in schema.names], "row_file", "row_block", "row_no")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = CATALOG, lenient: bool = False) -> DataFrame:
    """Rows of a file, or of a folder's files by name, with their order: row_file, row_block and row_no."""
    return parse(with_places(spark.read.text(path)), schema, lenient)


def read_worklist(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, WORKLIST).select(*WORKLIST.names)


def to_lines(rows: DataFrame) -> DataFrame:
    """One JSON text for each row: keys in order, nulls written out."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value"))


def log_lines(rows: DataFrame) -> DataFrame:
    """Catalog rows as lines; a tombstone (deleted) names its key and time only.  Without a path
    it counts for nothing to readers that do not know tombstones."""
    if "deleted" not in rows.columns:
        return to_lines(rows.select(*CATALOG_COLUMNS))
    gone = F.to_json(F.struct("deleted", "hostname", "path_norm", "scanned_at", "volume"))
    row = F.to_json(F.struct(*sorted(CATALOG_COLUMNS)), {"ignoreNullFields": "false"})
    return rows.select(F.when(F.col("deleted"), gone).otherwise(row).alias("value"))


def tombstones(keys: DataFrame, now: int) -> DataFrame:
    """Log rows that say that keys are gone."""
    own = keys.select(*KEY, F.lit(True).alias("deleted"), F.lit(now).cast("long").alias("scanned_at"))
    have = set(own.columns)
    return own.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in LOG])


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of JSON lines."""
    to_lines(rows).write.mode(mode).text(path)


def _is_local(fs) -> bool:
    return fs.getScheme() == "file"


def _parts(fs, folder) -> list:
    return sorted((s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())


def concatenate(spark: SparkSession, folder: str, path: str, append: bool = False) -> None:
    """Makes one file of a folder's parts, by name; append: at the end of what the file has.
    Bytes go from stream to stream in the JVM, a buffer at a time."""
    jvm = spark.sparkContext._jvm
    fs, where = filesystem(spark, folder)
    to_fs, to = filesystem(spark, path)
    own = to if append else jvm.org.apache.hadoop.fs.Path(f"{path}.new-{uuid.uuid4().hex}")
    if to.getParent() is not None:
        to_fs.mkdirs(to.getParent())
    if _is_local(to_fs):  # a plain file, without a checksum file beside it
        out = jvm.java.io.FileOutputStream(own.toUri().getPath(), append)
        to_fs.delete(jvm.org.apache.hadoop.fs.Path(to.getParent(), f".{to.getName()}.crc"), False)
    else:
        out = to_fs.append(own) if append and to_fs.exists(own) else to_fs.create(own, True)
    try:
        for part in _parts(fs, where):
            stream = fs.open(part)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, COPY_BYTES, False)
            finally:
                stream.close()
    finally:
        out.close()
    if not append:
        to_fs.delete(to, True)
        to_fs.rename(own, to)


def write_lines(lines: DataFrame, path: str) -> None:
    """One file of lines, in the frame's order: other programs read it."""
    parts = f"{shared_dir(lines.sparkSession)}/lines-{uuid.uuid4().hex}"
    lines.write.text(parts)
    concatenate(lines.sparkSession, parts, path)
    remove(lines.sparkSession, parts)


def append_log(rows: DataFrame, path: str, segments: bool | None = None) -> None:
    """Appends catalog rows (and tombstones) to a hash log.

    On a local file system, where one host writes its own log, the log is one file.  Elsewhere, or
    with segments, it is a folder whose files bear the number of the append and of the part, so
    that their names are in the order of writing; so are their times, by which streams take them.
    """
    spark = rows.sparkSession
    fs, where = filesystem(spark, path)
    if segments is None:
        segments = not _is_local(fs) or (fs.exists(where) and fs.getFileStatus(where).isDirectory())
    lines = log_lines(rows)
    if not segments:
        parts = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
        lines.write.text(parts)
        concatenate(spark, parts, path, append=True)
        remove(spark, parts)
        return
    parts = f"{path.rstrip('/')}/_new-{uuid.uuid4().hex}"
    lines.write.text(parts)
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    have = [s for s in fs.listStatus(where) if s.getPath().getName().startswith("segment-")]
    number = 1 + max((int(s.getPath().getName().split("-")[1]) for s in have), default=0)
    new = _parts(fs, path_of(parts))
    first = max((s.getModificationTime() for s in have), default=0) + 1
    first = max([first, *[fs.getFileStatus(p).getModificationTime() for p in new]])
    for i, part in enumerate(new):
        target = path_of(where, f"segment-{number:012d}-{i:06d}.jsonl")
        fs.setTimes(part, first + i, -1)
        fs.rename(part, target)
    remove(spark, parts)


def sniff(spark: SparkSession, path: str) -> str:
    """'jsonl', 'sqlite' or 'parquet', by suffix and else by the first bytes."""
    low = path.rstrip("/").lower()
    if low.endswith(".jsonl"):
        return "jsonl"
    if low.endswith((".sqlite", ".db")):
        return "sqlite"
    if low.endswith(".parquet"):
        return "parquet"
    fs, where = filesystem(spark, path)
    if not fs.exists(where):
        raise FileNotFoundError(f"no such input: {path}")
    if fs.getFileStatus(where).isDirectory():
        current = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where, "CURRENT")
        return "store" if fs.exists(current) else "parquet"
    stream = fs.open(where)
    try:
        head = bytes(stream.read() & 0xFF for _ in range(min(16, fs.getFileStatus(where).getLen())))
    finally:
        stream.close()
    return "sqlite" if head.startswith(SQLITE_MAGIC) else "jsonl"
