"""Connected components of a link table, by alternating large and small stars over local forests.

Every step is a join and a partial aggregate; no node's neighbours are ever gathered. As a round's edges are
written, every ``FOREST`` of them, which stand in one task, are replaced by the stars of their own components, as a
combiner does: less is shuffled, and few rounds are needed. Each round is a written table in the shared
folder. The rounds end when the edges are stars around their smallest node, no later than after a number that
grows with the logarithm of the largest component's diameter."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, lean, written

#: Edges for a task, and nodes that it holds at once.
FOREST = 200_000


def _forest(batches):
    root: dict = {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def flush(kind):
        pairs = [(x, low) for x in root if (low := find(x)) != x]
        root.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], kind) for i in (0, 1)], names=["u", "v"])

    kind = None
    for b in batches:
        kind = b.column(0).type
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(root.setdefault(u, u)), find(root.setdefault(v, v))
            if x != y:
                root[max(x, y)] = min(x, y)
        if len(root) >= FOREST:
            yield flush(kind)
    if root:
        yield flush(kind)


def _packed(edges: DataFrame) -> DataFrame:
    """u > v: the edges, each task's as stars of its own components. Tasks follow the number of edges."""
    held = written(edges, "cc-round")
    out = written(held.coalesce(math.ceil(held.count() / FOREST) or 1).mapInArrow(lean(_forest), edges.schema), "cc")
    drop(held)
    return out


def _stars(edges: DataFrame) -> bool:
    """Whether every edge leads from a node of that edge alone to a centre."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("leaf")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("leaf")))
    met = ends.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.count("*").alias("all"))
    return met.where("leaf > 0 and all > 1").agg(F.count("*")).head()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """links: a, b (no nulls; integers, strings or binary). Returns node, label: the smallest node that it reaches;
    only linked nodes."""
    edges = _packed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"))
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        last, edges = edges, _packed(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        drop(last)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
