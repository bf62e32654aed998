"""Lines of text files with their numbers, for files of any length: a file may be read by many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def numbered(spark: SparkSession, path: str, glob: str, nested: bool = False) -> DataFrame:
    """(file, line_no, line) of every line of the files below a folder that match a glob; numbers begin at 0.

    Spark splits long files. A line's number is its place in its split, by a window over one split (which is bounded),
    plus the lines of the splits before it in the file; of those the driver's plan holds one count for each split. Lines
    end at line feeds, carriage returns or both, as Spark's reader takes them.
    """
    raw = spark.read.option("pathGlobFilter", glob).text(path, recursiveFileLookup=nested)
    meta = F.col("_metadata")
    own = raw.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("_split"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
    within = F.row_number().over(Window.partitionBy("file", "_split").orderBy("_at")) - 1
    sizes = raw.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("_split")).groupBy("file", "_split").agg(F.count("*").alias("_n"))
    so_far = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("file", "_split", F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_before"))
    placed = own.withColumn("_place", within).join(before, ["file", "_split"])
    return placed.select("file", (F.col("_before") + F.col("_place")).cast("int").alias("line_no"), "line")
