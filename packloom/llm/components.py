"""Connected components of an edge table, by randomised contraction."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table


def _united(frames):
    """Union-find over one bounded edge list: (node, root)."""
    edges = [f for f in frames if len(f)]
    if not edges:
        return
    edges = pd.concat(edges)
    parent: dict[int, int] = {}

    def find(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    for u, v in zip(edges["u"].tolist(), edges["v"].tolist(), strict=True):
        a, b = find(u), find(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pd.DataFrame({"node": nodes, "root": [find(x) for x in nodes]})


def components(edges: DataFrame, in_one_task: int = 100_000) -> DataFrame:
    """Nodes of ``edges`` (u long, v long) with a root that a component's
    nodes share: columns node, root. Isolated nodes are not in it.

    Each round every node hooks onto the neighbour (or itself) that hashes
    lowest this round, and the edges are rewritten between the hooks, so the
    graph shrinks geometrically whatever its shape; hubs only ever meet a
    ``min`` with map-side partial aggregation. When at most ``in_one_task``
    edges are left - a checked bound - one task unites them.
    """
    left = stage_table(edges.where("u != v").select("u", "v").distinct(), "edges")
    hooks, k = [], 0
    while left.limit(in_one_task + 1).count() > in_one_task:
        both = left.union(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min(F.struct(F.xxhash64("v", F.lit(k)), F.col("v"))).alias("m"))
        own = F.struct(F.xxhash64("u", F.lit(k)), F.col("u").alias("v"))
        hook = stage_table(near.select(F.col("u").alias("node"), F.least("m", own)["v"].alias("root")), "hooks")
        hooks.append(hook)
        left = (
            left.join(hook.select(F.col("node").alias("u"), F.col("root").alias("a")), "u")
            .join(hook.select(F.col("node").alias("v"), F.col("root").alias("b")), "v")
            .where("a != b")
            .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
        )
        left = stage_table(left.distinct(), "edges")
        k += 1
    roots = stage_table(left.coalesce(1).mapInPandas(_united, "node long, root long"), "roots")
    for hook in reversed(hooks):
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
        roots = hook.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return roots
