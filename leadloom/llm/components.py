"""Connected components of a graph given by its edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import remove, shared_folder, written


def _larger(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the least node it knows."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").filter("u != v").distinct()


def _smaller(edges: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the least of them. Edges go from the smaller node u to the larger v."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(least, "v").select(F.col("m").alias("a"), F.col("u").alias("b")).filter("a != b")
    kept = least.select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.union(kept).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of ``edges`` (a, b), with the least node that it is connected to.

    Each round is a written table of at most as many rows as there are edges; the number of rounds grows with the logarithm of the longest path.
    Null ends and loops are left out."""
    spark = edges.sparkSession
    now = edges.filter("a != b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    folder, previous, before, number = shared_folder(spark), None, None, 0
    while True:
        path = f"{folder}/{number}"
        now.write.parquet(path)
        now = spark.read.schema("u long, v long").parquet(path)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if previous:
            remove(spark, previous)
        if tuple(state) == before or not state[0]:
            break
        previous, before, number = path, tuple(state), number + 1
        now = _smaller(_larger(now))
    stars = now.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))
    return stars.unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def grouped(df: DataFrame, groups: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the component of the node in ``column`` as ``name``; a node that is in no group is one of its own."""
    got = groups.select(F.col("node").alias(column), F.col("component").alias(f"{name}_"))
    return df.join(got, column, "left").withColumn(name, F.coalesce(f"{name}_", column)).drop(f"{name}_")


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) of ``groups`` (node, component) once ``links`` (a, b) join them: each end is a component of ``groups``, or a node that is in none.

    Of all links between two groups one is followed, so the edges grow with the pairs of groups that are linked, not with the pairs of their members."""
    wider = components(links)
    old = grouped(groups, wider, "component", "wider").select("node", F.col("wider").alias("component"))
    return written(old.unionByName(wider.join(groups, "node", "left_anti")))
