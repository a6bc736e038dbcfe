"""Connected components of a graph of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node reachable by edges, for every node of an edge; a table that the caller drops.

    Each round sends every node's larger neighbours to its smallest one, then its smaller ones too, until no edge changes;
    then all edges lead to the smallest node of their component. Both steps are an aggregate and a join. A round's edges
    are written to the shared folder, those of the round before deleted. Null ends are dropped; loops and repeated edges
    do no harm; no edges give no rows.
    """
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u is not null and v is not null").distinct())
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    last, settled = state(now), False
    while last[0] and not settled:
        both = now.union(now.select("v", "u")).filter("u <> v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        loops = now.filter("u = v")
        # Small step: a node's smaller neighbours, and itself, to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u <> v")
        before, now = now, written(small.union(loops).distinct())
        dropped(before)
        old, last = last, state(now)
        settled = old == last
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = written(found.union(found.select("component", "component")).groupBy("node").agg(F.min("component").alias("component")))
    dropped(now)
    return out
