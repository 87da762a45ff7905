"""Connected components by alternating large-star and small-star steps, each an aggregation and an equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm.workspace import Workspace


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """From (a, b), longs, to (node, component): the least node that can be reached, for every node of an edge.

    A step keeps at most one row per edge. Minima are pre-aggregated before they are shuffled, and the joins that
    bring them back are inner equi-joins with one row per key on one side, which adaptive execution may split when
    a node has very many neighbours.
    """
    now = work.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = work.cut(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(least.select("a", F.col("m").alias("b")))
        small = work.cut(small.distinct(), "small")
        work.drop(now)
        work.drop(large)
        now, last, state = small, state, _state(small)
        if state == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Number of edges and an order-free hash of them, by which a step that changes nothing is seen."""
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]
