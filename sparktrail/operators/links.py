"""Connected components of an edge table, by repeated smallest-label steps over DataFrames."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: through the session's shared folder where one is set, else, in local mode, a temporary one."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        path = f"{folder.rstrip('/')}/links-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    if spark.sparkContext.getCheckpointDir() is None:
        import tempfile

        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="links-"))
    return df.checkpoint()


#: Bytes up to which a table is broadcast, as counted from the text of its rows.
BROADCAST_BYTES = 16 << 20


def small(df: DataFrame) -> DataFrame:
    """``df`` (what callers state), to be broadcast if its rows take at most ``BROADCAST_BYTES``; as it is otherwise, so
    that Spark chooses a join that does not need it in one piece."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))) + 64)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) for edges (a, b) of any ordered type: the smallest id that each vertex can reach.

    Every round a vertex takes the smallest label around it and then the label of that label, so paths halve.
    """
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")))
    while True:
        around = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        nearer = labels.join(around, "id").select("id", F.least("component", "m").alias("component"), F.col("component").alias("was"))
        jump = nearer.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = written(nearer.join(jump, "component", "left").select("id", F.least("component", F.coalesce("further", "component")).alias("component"), "was"))
        labels = new.select("id", "component")
        if new.filter("component <> was").isEmpty():
            return labels
