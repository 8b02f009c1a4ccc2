"""Hilbert-curve sharding.

Metadata (document id, size, source, language) is quantised to a few bits a dimension, at
the quantiles of its values, so that cells are in the order of the values (names by their first
bytes) and about equally full; rows are sorted by the index of their cell on the Hilbert curve, and the sorted order is
cut into runs.  Neighbouring cells share most coordinates, so each run covers a compact
box in every dimension and a reader that filters on any of them skips whole files.

Only ids, sizes, checksums and curve indexes move; the texts stay where they are read.
The order is a range partitioning on (curve index, id), so a hot source or language is
split between partitions like any other run.  Positions come from one number for each
partition (its row count), never from a window over all rows.
"""

from __future__ import annotations

import operator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arkivist.llm.base import session, written

BITS = 6


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of integer points (rows), each coordinate below 2 ** bits.

    The transposed form of the index is built by undoing the rotations of the curve's
    sub-cubes from the top bit down, then by a Gray decoding; its bits are interleaved.
    """
    x = np.array(coords, dtype=np.int64, copy=True).T  # a row for each dimension
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for d in range(dims):
            high = (x[d] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] ^= swap
        q >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where(x[-1] & q, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            index = (index << 1) | ((x[d] >> b) & 1)
    return index


def _curve(bits: int):
    @F.pandas_udf("long")
    def index(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([a, b, c, d], axis=1), bits))

    return index


def _name_key(column):
    """A number that grows with a name's order: its first seven bytes."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(column, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")


def quantile_cells(frame: DataFrame, columns: list[str], bits: int) -> list:
    """For each number column an expression of its cell, by the cuts at its quantiles; null is cell 0.

    A value that holds several cuts takes the middle of them: at their edge, a few rows more or
    less of another value would move it across the bounds of the curve's larger boxes.
    """
    side = 1 << bits
    shares = [i / side for i in range(1, side)]
    cuts = frame.agg(*[F.percentile_approx(c, shares, 20 * side).alias(c) for c in columns]).first()  # side numbers a column

    def cell(c: str):
        own = [int(x) for x in (cuts[c] or [])] if cuts else []
        twice = [F.when(F.col(c) > x, 2).when(F.col(c) == x, 1).otherwise(0) for x in sorted(own)]
        return F.when(F.col(c).isNull(), 0).otherwise(F.shiftright(reduce(operator.add, twice, F.lit(0)), 1)).cast("int").alias(c)

    return [cell(c) for c in columns]


def hilbert_shards(docs: DataFrame, shards: int = 16, bits: int = BITS) -> DataFrame:
    """Shards of near-equal row counts along the curve.

    Returns doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null) and
    curve (the index).  Counts of any two shards differ by one at most.  Equal texts are not
    kept together: the order is the curve's alone.  Null text: size 1 and the checksum of the
    empty string.  A null id, source or language, and a source or language column that is
    missing, takes coordinate 0.  Ties on the curve go by id, then checksum; repeated rows are
    rows of their own.  An empty table gives no rows.
    """
    session(docs)
    has = docs.columns
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = [(F.col(c).cast("string") if c in has else F.lit(None).cast("string")) for c in ("source", "lang")]
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"),
        *[_name_key(x).alias(c) for c, x in zip(("x2", "x3"), names, strict=True)],
    ).withColumns({"x0": F.col("doc_id"), "x1": F.col("size")})
    point = base.select("doc_id", "size", "text_crc32", *quantile_cells(base, ["x0", "x1", "x2", "x3"], bits))
    keyed = point.select("doc_id", "size", "text_crc32", _curve(bits)("x0", "x1", "x2", "x3").alias("curve"))
    order = ["curve", "doc_id", "text_crc32"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The id of a sorted partition in the upper bits, the place in it in the lower 33.
    placed = written(placed.withColumn("at", F.monotonically_increasing_id()), "hilbert")
    part = F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # One row for each partition: as many rows as the session has shuffle partitions.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy()).alias("total"))
    ranked = placed.withColumn("part", part).join(F.broadcast(offsets), "part")
    ranked = ranked.withColumn("rank", F.col("base") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    shard = F.expr(f"(rank * {shards}) div total")
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return (
        ranked.withColumn("shard", shard)
        .withColumn("slot", (F.col("rank") - first).cast("long"))
        .select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
            "slot", F.lit(None).cast("int").alias("grown_shard"), "curve",
        )
    )
