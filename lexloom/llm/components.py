"""Connected components of an edge table, by large-star and small-star rounds.

Every round is two aggregations and joins on node ids. Nothing reaches the driver but two numbers. Each round's edges are
a table in the shared folder, so lost executors cost at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import discard, materialize


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Link each node's larger neighbours (large star), or its smaller ones and itself (small star), to the least of all."""
    rows = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")) if small else _both(edges)
    least = rows.groupBy(F.col("u").alias("n")).agg(F.least(F.min("v"), F.col("n")).alias("m"))
    linked = rows.join(least, F.col("u") == F.col("n"))
    if not small:
        return linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    return linked.select("v", "m").unionByName(least.select(F.col("n").alias("v"), "m")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) for every node with an edge. edges: u, v (long, not null); loops
    and repeated edges change nothing; an empty table gives an empty result."""
    edges = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last or not now[0]:
            break
        last, old = now, edges
        edges = materialize(_star(_star(edges, small=False), small=True), "edges")
        discard(old)
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
