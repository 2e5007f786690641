"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _with_least(edges: DataFrame) -> DataFrame:
    """Each (u, v) in both directions, with the least of u and its neighbours as m.

    Aggregates first and joins back, so a hub's edges can be split over tasks.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) for each endpoint of an edge: component_id is the least id reachable.

    Self links and repeated edges do no harm, null endpoints are left out, no edges give no rows. Rounds go on until
    one changes nothing, however many that takes; their number grows with the logarithm of the graph.
    """
    both = edges.where(f"{a} is not null and {b} is not null and {a} <> {b}")
    now = materialize(both.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if not state["n"] or mark == tuple(state):
            break
        mark = tuple(state)
        two_way = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(two_way).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small_in = large.where("u <> v").distinct()
        small = _with_least(small_in)
        linked = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        before, now = now, materialize(linked.where("u <> v").distinct(), "edges")
        discard(before)
    parent = now.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return parent.union(roots)
