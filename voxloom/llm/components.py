"""Connected components of an edge table by alternating large-star and small-star steps.

Labels are the smallest node of each component. Every step is a grouped minimum (combined
before the shuffle) and an equality join whose hot keys can be split, so a hub with
any number of neighbours is not gathered in one task. Each round's edges are
written to the shared folder, which cuts the lineage; rounds grow with the logarithm of the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.shared import drop_written, written

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges a > b. Large: link larger neighbours to the least one; small: smaller ones."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        out = edges.withColumnRenamed("a", "u").join(least, "u").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return out.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of `edges` (a, b: long, in any order; loops are ignored)."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        new = written(_star(_star(now, True), False), "edges")
        # stars at last: no node is both a leaf and a centre, and no leaf has two centres
        state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        done = state(new) == state(now)
        drop_written(now)
        now = new
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
