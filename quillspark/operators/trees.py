"""Trees in preorder: parents, subtrees and ancestors of nodes of any depth.

The nearest earlier node that is less deep is found by a fold with a stack inside chunks of CHUNK nodes, and between chunks
by their stacks: what a chunk leaves of an incoming stack is what lies below its least value, and that rule is associative,
so the stacks before all chunks come from log2(chunks) rounds of joining each chunk with the one 1, 2, 4.. before it. A
stack is never higher than the tree is deep; no document is put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import tables

CHUNK = 256
_ENTRY = "struct<v:bigint,n:bigint>"


def _below(stack: Column, v: Column) -> Column:
    return F.filter(stack, lambda e: e["v"] < v)


def nearest_less(rows: DataFrame, key: str, at: str, value: str, wanted: str, chunk: int = CHUNK) -> DataFrame:
    """rows with `near`: the `at` of the nearest earlier row of the key whose value is less than `wanted` of this one, else null.

    `wanted` is at most one more than the value.
    """
    turn = F.row_number().over(Window.partitionBy(key).orderBy(at)) - 1
    each = rows.select(key, F.col(at).cast("bigint").alias("n"), F.col(value).cast("bigint").alias("v"), F.col(wanted).cast("bigint").alias("q"), F.floor(turn / chunk).cast("bigint").alias("chunk"))
    held = tables.written(each.groupBy(key, "chunk").agg(F.array_sort(F.collect_list(F.struct("n", "v", "q"))).alias("rows"), F.min("v").alias("least")), "chunks")
    empty = F.array().cast(f"array<{_ENTRY}>")
    entry = lambda r: F.struct(r["v"].alias("v"), r["n"].alias("n"))
    push = lambda stack, r: F.concat(_below(stack, r["v"]), F.array(entry(r)))
    out = held.select(key, "chunk", "least", F.aggregate("rows", empty, push).alias("stack"))
    most = held.agg(F.max("chunk")).first()[0] or 0
    reach = 1
    while reach <= most:
        out = tables.written(out, "stacks")
        before = out.select(key, (F.col("chunk") + reach).alias("chunk"), F.col("stack").alias("_stack"), F.col("least").alias("_least"))
        met = out.join(before, [key, "chunk"], "left")
        # The stack first: a fold's own functions would take `least` for the column of that name made before it.
        kept = met.withColumn("stack", F.concat(_below(F.coalesce("_stack", empty), F.col("least")), "stack"))
        out = kept.select(key, "chunk", F.least("least", "_least").alias("least"), "stack")
        reach *= 2
    incoming = out.select(key, (F.col("chunk") + 1).alias("chunk"), F.col("stack").alias("first"))
    start = F.struct(F.coalesce("first", empty).alias("stack"), F.array().cast("array<struct<n:bigint,near:bigint>>").alias("said"))

    def step(acc: Column, r: Column) -> Column:
        near = F.try_element_at(_below(acc["stack"], r["q"]), F.lit(-1))["n"]
        return F.struct(push(acc["stack"], r).alias("stack"), F.concat(acc["said"], F.array(F.struct(r["n"].alias("n"), near.alias("near")))).alias("said"))

    said = held.join(incoming, [key, "chunk"], "left").select(key, F.explode(F.aggregate("rows", start, step, lambda acc: acc["said"])).alias("s")).select(key, F.col("s.n").alias("_n"), "s.near")
    return rows.join(said.withColumnRenamed(key, "_key"), (F.col(key) == F.col("_key")) & (F.col(at) == F.col("_n"))).drop("_key", "_n")


def preorder(nodes: DataFrame, key: str, at: str = "at", depth: str = "depth", chunk: int = CHUNK) -> DataFrame:
    """nodes in preorder with parent (null for a root) and last, the last node of the subtree.

    A node x is an ancestor of y when x.at < y.at <= x.last.
    """
    up = nearest_less(nodes.withColumn("_v", F.col(depth)), key, at, "_v", "_v", chunk).withColumnRenamed("near", "parent").drop("_v")
    # Looking back from the end: the nearest later node that is no deeper begins what follows the subtree.
    back = up.withColumns({"_at": -F.col(at), "_v": 2 * F.col(depth), "_q": 2 * F.col(depth) + 1})
    found = nearest_less(back, key, "_at", "_v", "_q", chunk).withColumn("_next", -F.col("near"))
    ends = found.drop("near", "_at", "_v", "_q")
    # The last node before that one, in the order of the key; the key's last node where there is none.
    before = nodes.select(F.col(key).alias("_key"), F.col(at).alias("_here"), F.lag(at).over(Window.partitionBy(key).orderBy(at)).alias("_last"))
    final = nodes.groupBy(F.col(key).alias("_k2")).agg(F.max(at).alias("_end"))
    met = ends.join(before, (F.col(key) == F.col("_key")) & (F.col("_next") == F.col("_here")), "left").join(final, F.col(key) == F.col("_k2"))
    return met.withColumn("last", F.when(F.col("_next").isNull(), F.col("_end")).otherwise(F.col("_last"))).drop("_next", "_key", "_here", "_last", "_k2", "_end")


def ancestors(tree: DataFrame, asked: DataFrame, key: str, at: str = "at") -> DataFrame:
    """key, at, ancestor, distance of asked nodes (key, at): parents, and parents of parents, by doubling.

    Each round knows all ancestors up to a distance and joins them with themselves, so a depth of n takes log2(n) rounds.
    """
    now = tables.written(tree.where("parent is not null").select(F.col(key).alias("k"), F.col(at).cast("bigint").alias("n"), F.col("parent").cast("bigint").alias("a")), "jumps")
    out = asked.select(F.col(key).alias("k"), F.col(at).cast("bigint").alias("n"), F.col(at).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("distance"))
    out, hop = tables.written(out, "ancestors"), 1
    while not now.isEmpty():
        jump = now.select("k", F.col("n").alias("a"), F.col("a").alias("up"))
        further = out.join(jump, ["k", "a"]).select("k", "n", F.col("up").alias("a"), (F.col("distance") + hop).alias("distance"))
        out = tables.written(out.unionByName(further), "ancestors")
        now = tables.written(now.join(jump, ["k", "a"]).select("k", "n", F.col("up").alias("a")), "jumps")
        hop *= 2
    return out.where("distance > 0").select(F.col("k").alias(key), F.col("n").alias(at), F.col("a").alias("ancestor"), "distance")
