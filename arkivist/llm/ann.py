"""Approximate nearest neighbours by shifted space-filling curves.

1. Vectors are projected by several random rotations to a few dimensions, each projection is
   shifted by another share of its whole domain, quantised and ordered along a Hilbert curve; the
   orders are range-partitioned and cut into runs of ``RUN`` vectors.  A query meets its own
   run and the two beside it on every curve, and the candidates are reranked by exact inner
   products.
2. The k-th score so found is a floor.  The first curve's order is cut into blocks, whose centres
   and radii (a bounded number of them) show each query which blocks may hold a vector that
   reaches its floor; query and block meet by a join on the block, in chunks of queries.  This
   makes the result exact; on clustered vectors it skips most blocks, on isotropic ones (where
   no curve can tell near from far) it skips few.

Vectors of different lengths have no inner product: those of each length are searched among
themselves.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arkivist.llm.base import session, written
from arkivist.llm.sharding import hilbert_index

CURVES, DIMS, BITS, RUN = 3, 5, 6, 512
#: Rows of a block of the exact step, unless that makes more than MOST_BLOCKS (whose centres every task gets); queries of a chunk.
BLOCK, MOST_BLOCKS, QUERIES = 2048, 1 << 16, 1024
SEED = 20

PAIR = "query_id long, vec_id long, score double"


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, v and its length d: one row for each vec_id (the smallest vector of repeated ids).  Rows without an
    id, null, empty and zero vectors, and those with null or non-finite components take no part."""
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    return v.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("d", F.size("v"))


@functools.cache
def rotations(dims: int, curves: int) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    m = min(DIMS, dims)
    return np.stack([np.linalg.qr(rng.normal(size=(dims, dims)))[0][:, :m] for _ in range(curves)])


def matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, always summed in the same order."""
    return (q * x).sum(axis=1)


def top_pairs(qid, q, vid, x, k, floor=None):
    """(query_id, vec_id, score) of each query's best k rows, ties to smaller vec_id."""
    if not len(qid) or not len(vid):
        return [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
    s = q @ x.T
    s[qid[:, None] == vid[None, :]] = -np.inf
    # rounding differs between a product of matrices and exact(): a little slack
    low = np.full(len(qid), -np.inf) if floor is None else floor - 1e-9
    if len(vid) > k:
        low = np.maximum(low, np.partition(s, len(vid) - k, axis=1)[:, -k] - 1e-9)
    a, b = np.nonzero((s >= low[:, None]) & (s > -np.inf))
    score = exact(q[a], x[b])
    order = np.lexsort((vid[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    keep = rank < k
    return [qid[a[keep]], vid[b[keep]], score[keep]]


def _batch(cols):
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "score"])


def _keyed(v: DataFrame) -> DataFrame:
    """d, curve, key, vec_id, v: a row of each vector for every curve."""

    def key(batches):
        for batch in batches:
            size = batch.column("d").to_numpy()
            for d in np.unique(size).tolist():
                b = batch.filter(pa.array(size == d))
                x = matrix(b.column("v"))
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                for c, rot in enumerate(rotations(d, CURVES)):
                    # a component of a unit vector is about 1 / sqrt(d) wide: cells over four of them, shifted by c / CURVES of all that
                    p = np.clip(unit @ rot * np.sqrt(d) / 4 + 0.5, 0, 1) + c / CURVES
                    cell = np.minimum(np.floor(p * (1 << BITS)), (2 << BITS) - 1).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([b.column("d"), pa.array(np.full(len(x), c, np.int32)), pa.array(hilbert_index(cell, BITS + 1)), b.column("vec_id"), b.column("v")], ["d", "curve", "key", "vec_id", "v"])

    return v.select("vec_id", "v", "d").mapInArrow(key, f"d int, curve int, key long, vec_id long, v {dict(v.dtypes)['v']}")


def _ranked(v: DataFrame) -> DataFrame:
    """The vectors on every curve, with pos: the place in the order of vectors of one length on one curve."""
    parts = int(v.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["d", "curve", "key", "vec_id"]
    placed = _keyed(v).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = written(placed.withColumn("at", F.monotonically_increasing_id()), "curves")
    part = F.shiftright("at", 33)
    # as many rows as partitions, curves and lengths
    offsets = placed.groupBy("d", "curve", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("d", "curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("d", "curve", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = placed.withColumn("part", part).join(F.broadcast(offsets), ["d", "curve", "part"])
    return ranked.select("d", "curve", "vec_id", "v", (F.col("at") - F.col("first") + F.col("base")).alias("pos"))


def _met(met: DataFrame, keys: list[str], k: int, every: int) -> DataFrame:
    """Each group's queries (ask) reranked among its other rows."""

    def rerank(t: pa.Table) -> pa.Table:
        ask = t.column("ask").to_numpy()
        vid = t.column("vec_id").to_numpy()
        x = matrix(t.column("v").combine_chunks())
        floor = t.column("floor").cast(pa.float64()).fill_null(-np.inf).to_numpy() if "floor" in t.column_names else np.full(len(vid), -np.inf)
        return pa.Table.from_batches([_batch(top_pairs(vid[ask], x[ask], vid[~ask], x[~ask], k, floor[ask]))])

    return met.groupBy(*keys).applyInArrow(rerank, PAIR)


def _centres(rows: DataFrame) -> list:
    """(d, block, centre, radius) of the blocks: BLOCK rows or more each, MOST_BLOCKS at most of a length."""

    def centre(t: pa.Table) -> pa.Table:
        x = matrix(t.column("v").combine_chunks())
        mid = x.mean(axis=0)
        far = np.sqrt(((x - mid) ** 2).sum(axis=1).max())
        return pa.table({"d": t.column("d")[:1], "block": t.column("block")[:1], "mid": pa.array([mid.tolist()], pa.list_(pa.float64())), "far": pa.array([far])})

    return rows.groupBy("d", "block").applyInArrow(centre, "d int, block long, mid array<double>, far double").collect()


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, complete: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row whose vec_id is divisible by every.

    Rows without an id, and null, empty, zero and non-finite vectors, take no part; of rows that
    share an id the smallest vector does.  Ties go to the smaller vec_id.  Products are summed in
    double precision over the vectors as they are.  Vectors are compared with those of their own
    length.  complete=False gives what the curves' windows alone find.  Fewer candidates than k:
    all of them.  An empty table gives no rows.  Other columns are not read.
    """
    spark = session(vectors)
    v = written(valid(vectors), "vectors")
    ranked = _ranked(v)
    runs = ranked.withColumn("run", F.expr(f"pos div {RUN}")).drop("pos")
    asks = runs.filter(F.col("vec_id") % every == 0)
    asks = asks.select("d", "curve", F.explode(F.array(F.col("run") - 1, F.col("run"), F.col("run") + 1)).alias("run"), F.lit(True).alias("ask"), "vec_id", "v")
    near = _met(asks.unionByName(runs.withColumn("ask", F.lit(False))), ["d", "curve", "run"], k, every)
    near = written(best(near, k), "windows")
    if not complete:
        return near.select("query_id", "rank", "vec_id", "score")
    floors = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    sizes = {r.d: r.n for r in v.groupBy("d").agg(F.count("*").alias("n")).collect()}  # as many as there are lengths
    if not sizes:
        return near.select("query_id", "rank", "vec_id", "score")
    wide = F.coalesce(*[F.when(F.col("d") == d, F.lit(max(BLOCK, -(-n // MOST_BLOCKS)))) for d, n in sizes.items()])
    rows = written(ranked.filter("curve = 0").select("d", "vec_id", "v", F.floor(F.col("pos") / wide).alias("block")), "blocks")
    by_size: dict[int, list] = {}
    for r in _centres(rows):
        by_size.setdefault(r.d, []).append((r.block, r.mid, r.far))
    shared = spark.sparkContext.broadcast({d: (np.array([x[0] for x in c]), np.array([x[1] for x in c]), np.array([x[2] for x in c])) for d, c in by_size.items()})  # MOST_BLOCKS centres a length

    def reach(batches):
        for batch in batches:
            size = batch.column("d").to_numpy()
            for d in np.unique(size).tolist():
                b = batch.filter(pa.array(size == d))
                block, mid, far = shared.value[d]
                q = matrix(b.column("v"))
                floor = b.column("floor").cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                can = q @ mid.T + np.linalg.norm(q, axis=1)[:, None] * far >= floor[:, None] - 1e-9
                a, at = np.nonzero(can)
                own = b.take(pa.array(a))
                yield pa.RecordBatch.from_arrays([own.column("d"), pa.array(block[at]), own.column("vec_id"), own.column("v"), own.column("floor")], ["d", "block", "vec_id", "v", "floor"])

    asked = v.filter(F.col("vec_id") % every == 0).join(floors, F.col("vec_id") == F.col("query_id"), "left").select("d", "vec_id", "v", "floor")
    asked = asked.mapInArrow(reach, f"d int, block long, vec_id long, v {dict(v.dtypes)['v']}, floor double")
    chunks = max(1, -(-v.filter(F.col("vec_id") % every == 0).count() // QUERIES))
    asked = asked.select("d", "block", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).alias("chunk"), F.lit(True).alias("ask"), "vec_id", "v", "floor")
    each = rows.select("d", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), F.lit(False).alias("ask"), "vec_id", "v", F.lit(None).cast("double").alias("floor"))
    past = _met(asked.unionByName(each), ["d", "block", "chunk"], k, every)
    every_one = near.select("query_id", "vec_id", "score").unionByName(past)
    return best(every_one, k).select("query_id", "rank", "vec_id", "score")


def best(pairs: DataFrame, k: int) -> DataFrame:
    """Each query's best k distinct pairs."""
    one = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return one.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k)
