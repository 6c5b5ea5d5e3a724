"""Connected components as a distributed loop of joins; nothing of the graph reaches the driver but counts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize


def components(edges: DataFrame, name: str = "components", files: int = 0) -> DataFrame:
    """(node, component) for every node of the edges (u, v): component is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014), each an aggregation and an equi-join
    on a node, until every edge points at its component's smallest node. Null ends, loops and repeated
    edges are allowed and have no effect. files: of each table written on the way, as in materialize(). An empty edge table gives an empty result.
    """
    now = materialize(edges.where("u is not null and v is not null and u <> v").selectExpr("greatest(u, v) as u", "least(u, v) as v").distinct(), name, files)
    before = None
    while True:
        both = now.union(now.selectExpr("v as u", "u as v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").selectExpr("v as u", "m as v").where("u <> v")
        low = large.selectExpr("greatest(u, v) as u", "least(u, v) as v").distinct()
        m = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(m, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        later = materialize(small, name, files)
        state = later.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        drop(now)
        now = later
        if state == before:
            break
        before = state
    return now.selectExpr("u as node", "v as component").union(now.selectExpr("v as node", "v as component").distinct())


def smallest(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each node's smallest node reachable, from labels so far and more edges (a, b): minima along edges and pointer jumping."""
    a, b, parent = parent[a], parent[b], parent.copy()
    while True:
        low = np.minimum(parent[a], parent[b])
        np.minimum.at(parent, a, low)
        np.minimum.at(parent, b, low)
        jumped = parent[parent]
        if np.array_equal(jumped, parent) and np.array_equal(parent[a], parent[b]):
            return parent
        parent = jumped
