"""What the operators share: sessions, written tables, column access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arkivist.operators.common import filesystem, forget, written
from arkivist.ship import ship

__all__ = ["apart", "fold_crc", "forget", "hashed_side", "session", "table", "texts_of", "written"]

#: Rows of an Arrow batch; with the slices of textvec this bounds a Python worker.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session(df: DataFrame) -> SparkSession:
    """The frame's session, with Arrow batches of bounded size.  The setting stays: frames are
    evaluated after the operator has returned."""
    spark = df.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text (string); columns of these types go through as they are, so
    that plans which read them twice are alike and share an exchange."""
    have = dict(docs.dtypes)
    return docs.select(*[F.col(c) if have[c] == t else F.col(c).cast(t).alias(c) for c, t in (("doc_id", "bigint"), ("text", "string"))])


def apart(col: str):
    """The same number by another name: what was aggregated by it is dealt out anew, in an
    exchange whose hot partitions can be split."""
    return F.bitwise_not(F.bitwise_not(F.col(col)))


#: A written table may be the built side of a hash join up to so many bytes (on disk) a partition.
HASHED_BYTES = 8 << 20


def hashed_side(frame: DataFrame) -> DataFrame:
    """A written table, hinted as the built side of a shuffled hash join if its size, which is looked
    up, is small for a task; otherwise as it is, for a join that can spill."""
    spark = frame.sparkSession
    fs, where = filesystem(spark, frame._arkivist_path)
    per_task = fs.getContentSummary(where).getLength() / int(spark.conf.get("spark.sql.shuffle.partitions"))
    return frame.hint("shuffle_hash") if per_task <= HASHED_BYTES else frame


def fold_crc(column: str, mod: int):
    """crc32 of an id's decimal text, modulo mod."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(mod))
