"""Connected components of an undirected edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depweave.session import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): each node that an edge touches, with the smallest node it is connected to.

    Alternating large-star and small-star steps.  Both are a map-side combined minimum and a
    join back, so a node with very many neighbours is never gathered in one task; every step
    is checkpointed, as the lineage would double otherwise.  Self-loops keep their node.
    """
    given = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null")
    nodes = given.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    current = cut(given.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(current)
    while state[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(root.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        )
        current = cut(small)
        after = _state(current)
        if after == state:
            break
        state = after
    roots = current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _state(edges: DataFrame) -> tuple:
    """A fingerprint of an edge set: its size and order-free hash sums."""
    return tuple(
        edges.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))
        ).first()
    )


def numbered(values: DataFrame, column: str) -> DataFrame:
    """(column, number): distinct values numbered from 0 in their order, without one task that sorts them all.

    Values are dealt by range and kept (checkpointed) with their range; only the ranges' counts are summed in one place.
    """
    ranged = cut(values.select(column).distinct().repartitionByRange(F.col(column)).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(column))
    return ranged.join(before, "_range").select(column, (F.col("_before") + within - 1).alias("number"))
