"""Components that are kept in a stored table and grow by new nodes and new edges only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.graph import components, cut
from tidemark.storage import Spec, exists, load, save

TABLE = Spec(("id",), "cluster")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """id, cluster (the smallest id of the component) of all nodes so far."""
    return load(spark, path).select("id", "cluster")


def grow(nodes: DataFrame, edges: DataFrame, path: str, report: dict | None = None) -> None:
    """Adds nodes (id) and edges (a, b) to the components at path.

    Edges are looked up in the table and become edges between clusters, of which only those that differ are joined into
    components; members of clusters that take another's name are written again, and nothing else. Edges to ids that are no
    nodes, and null ids, don't count; nodes and edges that are there already change nothing. `report`, if given, takes the
    rows that were touched: new nodes, and members that changed their cluster.
    """
    spark = nodes.sparkSession
    new = nodes.where("id IS NOT NULL").select("id").distinct()
    if exists(spark, path):
        new = new.join(labels(spark, path).select("id"), "id", "left_anti")
    added = save(new.withColumn("cluster", F.col("id")), path, TABLE, distinct=True)
    known = labels(spark, path)
    side = lambda x: known.select(F.col("id").alias(x), F.col("cluster").alias(f"c{x}"))
    met = cut(edges.select("a", "b").join(side("a"), "a").join(side("b"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    moved = 0
    if not met.isEmpty():
        ends = met.select(F.col("a").alias("id")).union(met.select("b")).distinct()
        renamed = components(ends, met, closed=True).where("id <> cluster").select(F.col("id").alias("old"), F.col("cluster").alias("new"))
        moved = save(known.join(renamed, F.col("cluster") == F.col("old")).select("id", F.col("new").alias("cluster")), path, TABLE, distinct=True)
    if report is not None:
        report |= {"added": added, "moved": moved}
