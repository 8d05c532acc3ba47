"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import removed, written


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v, m): every pair with the smallest of u and its partners.

    The minimum is pre-aggregated before its shuffle; the join has nothing above it that
    needs a key's rows together, so a hub's rows can be split over tasks.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (two long columns).

    Only nodes with an edge to another node are returned.  Self loops, repeated edges
    and nulls are ignored; no edges give no rows.  Rounds alternate a large star (every
    larger neighbour to the least one) and a small star (every smaller neighbour to the
    least one) until nothing changes, which takes about log2 of the longest chain.  Each
    round is written to the shared folder; nothing but two numbers a round reaches the driver.
    """
    spark = edges.sparkSession
    a, b = edges.columns[:2]
    ea, eb = F.col(f"`{a}`").cast("long"), F.col(f"`{b}`").cast("long")
    cur = edges.select(F.greatest(ea, eb).alias("u"), F.least(ea, eb).alias("v")).where("u > v").distinct()
    cur = written(cur, "edges")
    state = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large)
        moved = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        kept = small.select("u", F.col("m").alias("v"))
        nxt = written(moved.unionByName(kept).distinct(), "edges")
        now = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        removed(spark, cur)
        cur = nxt
        if now == state:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now
