"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is one aggregation and one join over the edges. In large-star steps, where a vertex may have any number of
neighbours, the aggregate is written first, so that both sides of the join are plain shuffles and Spark's skew handling
splits stars of any size. The steps halve paths, so their number grows with the logarithm of the longest one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktrail.llm.common import materialize


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Move every vertex's larger (``both``: all larger of all) neighbours to its smallest one."""
    around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else edges
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    least = materialize(least, "least") if both else least
    moved = around.join(least, "a")
    if both:
        out = moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of ``edges`` (two columns of one type): the smallest id it can reach.

    Loops and repeated edges change nothing; edges with a null end are left out.
    """
    first, second = edges.columns
    edges = edges.select(F.greatest(first, second).alias("a"), F.least(first, second).alias("b")).filter(F.col(first).isNotNull() & F.col(second).isNotNull())
    ids = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    current = materialize(edges.filter("a <> b").distinct(), "edges")
    before = None
    while True:
        current = materialize(_star(_star(current, True), False), "edges")
        now = tuple(current.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a") % (1 << 40))).first())
        if now == before:
            break
        before = now
    return ids.join(current.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").withColumn("component", F.coalesce("component", "id"))
