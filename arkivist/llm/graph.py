"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arkivist.llm.base import forget, written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of all ends of the edges (a, b); component is the smallest id.

    In each round every vertex merges into the neighbour (or itself) whose hash is smallest,
    and the edges between merged vertices are contracted; new hashes in each round make long
    chains shrink by a constant factor.  Every aggregate is a minimum, so hubs combine before
    they are shuffled.
    """
    e = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    maps = []
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min(F.xxhash64("b")).alias("m"))
        m = written(to.select(F.col("a").alias("id"), F.least(F.xxhash64("a"), F.col("m")).alias("to")), "merge")
        maps.append(m)
        a, b = m.select(F.col("id").alias("a"), F.col("to").alias("x")), m.select(F.col("id").alias("b"), F.col("to").alias("y"))
        c = e.join(a, "a").join(b, "b").filter("x != y")
        before, e = e, written(c.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        forget(before)
    if not maps:
        return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    label = maps[0]
    for m in maps[1:]:
        step = m.select(F.col("id").alias("to"), F.col("to").alias("next"))
        label = label.join(step, "to", "left").select("id", F.coalesce("next", "to").alias("to"))
    label = written(label, "labels")
    for m in maps:
        forget(m)
    forget(e)
    least = label.groupBy("to").agg(F.min("id").alias("component"))
    again = least.select(F.bitwise_not(F.bitwise_not(F.col("to"))).alias("to"), "component")
    return label.join(again, "to").select("id", "component")
