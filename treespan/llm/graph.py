"""Connected components of an undirected graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h or 0


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) of every node of ``edges`` (a, b).

    Large-star and small-star rounds: the first links each node's larger neighbours to its
    smallest, the second its smaller ones; the edges end as stars around the smallest nodes, in a
    number of rounds that grows with the logarithm of the graph's size. Each round is a table in
    the shared folder. Smallest neighbours are partial sums joined back to the edges, so a node
    with a third of all edges is never one task's group.

    Loops and null ends are ignored; repeated edges count once; no edges give no rows.
    """
    kind = edges.schema[0].dataType.simpleString()
    now = edges.toDF("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(now, "edges")
    state = _state(now)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = now.union(now.select("b", "a")).toDF("a", "b")
        low = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m"))
        large = now.select(F.col("b").alias("a"), F.col("a").alias("v")).join(low, "a").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        new = written(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        was, state = state, _state(new)
        forget(now)
        now = new
        if was == state:
            break
    else:
        raise RuntimeError(f"the components did not settle in {most_rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(now.select("b", "b").distinct()).select(F.col("node").cast(kind), F.col("component").cast(kind))
