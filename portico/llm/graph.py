"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, remove


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return tuple(row)


def components(edges: DataFrame, path: str) -> DataFrame:
    """(node, component) of every node with an edge in edges (u, v); the component is its smallest node.

    Each round is a few joins and aggregates on node ids and goes to a table under path; rounds grow
    with the logarithm of the longest chain. Hubs are safe: minima are pre-aggregated and the joins
    have one row per node on one side, so Spark can split the other.
    """
    now = keep(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{path}/0")
    mark, step = _mark(now), 0
    while mark[0]:
        step += 1
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = keep(small.select("e.u", "e.v").filter("u <> v").distinct(), f"{path}/{step}")
        remove(edges.sparkSession, f"{path}/{step - 1}")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
