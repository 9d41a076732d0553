"""Connected components by contraction, in DataFrame operations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledger_analytics.llm.storage import Stored


def components(edges: DataFrame) -> DataFrame:
    """Component of every node of ``edges`` (a, b: long): rows (node, root).

    ``root`` is a node of the component, the same for all its nodes. Every round each
    node moves to the neighbour (or stays) that comes first in an order drawn anew, twice
    in a row, and edges between merged nodes vanish; the number of nodes falls by a
    constant factor a round whatever the shape of the graph. Each round's tables are
    written to the shared checkpoint folder; nothing is collected but their row counts.
    """
    spark = edges.sparkSession
    stored = Stored(spark)
    spark_edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live, count = stored.write(spark_edges)
    both = live.selectExpr("a AS node").unionByName(live.selectExpr("b AS node"))
    mapped, _ = stored.write(both.distinct().withColumn("root", F.col("node")))
    step = 0
    while count:
        ends = live.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            live.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(step)).alias("h"), F.col(c).alias("x"))
        first = ends.groupBy("u").agg(F.min(rank("v")).alias("m")).select("u", F.least(rank("u"), "m")["x"].alias("to"))
        first, _ = stored.write(first)
        hop = first.select(F.col("u").alias("to"), F.col("to").alias("to2"))
        moves, _ = stored.write(first.join(hop, "to").select("u", F.col("to2").alias("to")))
        a, b = moves.toDF("a", "to_a"), moves.toDF("b", "to_b")
        contracted = (
            live.join(a, "a").join(b, "b").where("to_a <> to_b")
            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        )
        new_live, count = stored.write(contracted)
        new_mapped, _ = stored.write(
            mapped.join(moves.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        )
        stored.keep(new_live, new_mapped)
        live, mapped, step = new_live, new_mapped, step + 1
    return mapped


def spanning_pairs(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer than ``n`` pairs that connect the same nodes 0..n-1 as the pairs (i, j)."""
    label = np.arange(n)
    while len(i):
        low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        open_ = low != high
        if not open_.any():
            break
        i, j = i[open_], j[open_]
        np.minimum.at(label, high[open_], low[open_])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]
