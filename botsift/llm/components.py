"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is a pair of aggregates and joins over edges; edges between rounds are tables in
the shared folder, so a lost executor repeats one round at most and nothing grows on the driver
(two numbers a round reach it). A node with very many neighbours is dealt into parts by their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botsift.llm.common import HOT_ROWS, join_dealt
from botsift.session import discard, materialize


def _least(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, least): the smallest neighbour of each node."""
    return edges.groupBy(F.col(u).alias("node")).agg(F.min(v).alias("least"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge.

    Edges are undirected and may repeat; loops and edges with a null end are left out. Nodes
    without an edge aren't returned. An empty table gives an empty table.
    """
    pair = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    pair = pair.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct()
    pair = materialize(pair, "edges")
    spark, seen = edges.sparkSession, None
    while True:
        state = pair.agg(F.count(F.lit(1)), F.countDistinct("hi"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            break
        seen = tuple(state)
        # large-star: each node sends its larger neighbours to its smallest one (or to itself)
        both = pair.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            pair.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        larger = pair.select(F.col("lo").alias("node"), F.col("hi").alias("v"))
        large = join_dealt(larger, _least(both, "u", "v"), "node", hot_rows, state[0]).select(
            F.col("v").alias("hi"), F.least("node", "least").alias("lo"))
        # the edge from a node to its own smallest neighbour stays, so that a pair with one edge does
        own = both.groupBy("u").agg(F.min("v").alias("v")).where("v < u").select(
            F.col("u").alias("hi"), F.col("v").alias("lo"))
        large = materialize(large.unionByName(own).distinct(), "large-star")
        # small-star: each node sends its smaller neighbours, and itself, to the smallest of them
        smaller = large.select(F.col("hi").alias("node"), F.col("lo").alias("v"))
        small = join_dealt(smaller, _least(large, "hi", "lo"), "node", hot_rows, 2 * state[0]).where("v <> least").select(
            F.col("v").alias("hi"), F.col("least").alias("lo"))
        stars = large.groupBy("hi").agg(F.min("lo").alias("lo"))
        before, pair = pair, materialize(small.unionByName(stars).distinct(), "small-star")
        discard(spark, large)
        discard(spark, before)
    labelled = pair.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return labelled.unionByName(pair.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
