"""Connected components of a written table of edges, with joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, ws, max_rounds: int = 64) -> DataFrame:
    """(a, b) to (node, comp): the smallest node that each node of an edge reaches.

    In a round every node hooks to its smallest neighbour if that is smaller, chains are shortened by pointer doubling, and edges
    are drawn between the roots. Each step is a written table. A result that has not settled raises.
    """
    live = ws.materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    known = None
    for k in range(max_rounds):
        hooks = live.groupBy("a").agg(F.min("b").alias("up")).withColumnRenamed("a", "node")
        roots = live.select(F.col("b").alias("node")).distinct().join(hooks, "node", "left_anti").withColumn("up", F.col("node"))
        parent = ws.materialize(hooks.unionByName(roots), f"hooks-{k}")
        for j in range(max_rounds):
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("over"))
            doubled = ws.materialize(parent.join(above, "up").select("node", F.col("over").alias("up"), (F.col("over") != F.col("up")).alias("moved")), f"up-{k}-{j}")
            parent = doubled.select("node", "up")
            if not doubled.filter("moved").limit(1).count():
                break
        known = parent.withColumnRenamed("up", "comp") if known is None else ws.materialize(
            known.join(parent.select(F.col("node").alias("comp"), "up"), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
            .unionByName(parent.select("node", F.col("up").alias("comp")).join(known, "node", "left_anti")), f"known-{k}")
        a, b = (parent.select(F.col("node").alias(c), F.col("up").alias(f"r{c}")) for c in "ab")
        drawn = live.join(a, "a").join(b, "b").filter("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct()
        live = ws.materialize(drawn, f"drawn-{k}")
        if not live.limit(1).count():
            return known
    raise RuntimeError("components have not settled")
