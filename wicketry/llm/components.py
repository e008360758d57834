"""Connected components of an edge table by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, with_minimum


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (smallest node reachable) for every node of ``edges``.

    Each round points nodes at the smallest neighbour known. A node's edges are dealt by salt wherever they meet its
    minimum, so a hub may hold any share of the edges. Rounds end when nothing changes, a logarithmic number.
    """
    e = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = cut(e, "edges")
    before = None
    while True:
        # large star: a node and its larger neighbours go to the smallest of the node and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_minimum(both, "u", "v", "m").select(F.greatest("u", "v").alias("u"), F.least("m", "u").alias("v")).filter("u > v").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        small = with_minimum(large, "u", "v", "m").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        nxt = cut(small, "edges")
        mark = nxt.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        drop_cut(e)
        e = nxt
        if mark == before:
            break
        before = mark
    tops = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
