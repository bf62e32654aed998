"""Things computed once and kept: vectors of action texts, renewed where the text has changed, and tables by schema."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktrail.functions.text import first_filled

# The texts of an action that get a vector, and how much of each counts.
DIMENSIONS = ("command", "path", "purpose", "reasoning", "response", "error")
TEXT_CAP = 2000


def texts(actions: DataFrame) -> DataFrame:
    """(sid, idx, dim, text, sha1): the texts of actions that are not blank, trimmed and capped, with a fingerprint."""
    of: dict[str, Column] = {d: F.col(d) if d in actions.columns else F.lit(None).cast("string") for d in DIMENSIONS}
    if "root" in actions.columns:
        of["path"] = first_filled(of["path"], "root")
    rows = F.array(*(F.struct(F.lit(d).alias("dim"), F.left(F.trim(c), F.lit(TEXT_CAP)).alias("text")) for d, c in of.items()))
    out = actions.select("sid", "idx", F.explode(rows).alias("t")).select("sid", "idx", "t.*").filter("text <> ''")
    return out.withColumn("sha1", F.substring(F.sha1("text"), 1, 16))


def stale(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """Texts whose vector is missing or belongs to another text."""
    return wanted.join(cached.select("sid", "idx", "dim", "sha1"), ["sid", "idx", "dim", "sha1"], "left_anti")


def hashed_counts(batch: list[str], dims: int = 384) -> np.ndarray:
    """Normalised counts of hashed words and word pairs: an encoder that needs no model."""
    out = np.zeros((len(batch), dims), np.float32)
    for i, text in enumerate(batch):
        words = text.lower().split()
        for token in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
            out[i, int.from_bytes(hashlib.blake2b(token.encode(), digest_size=4).digest()) % dims] += 1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def encoded(rows: DataFrame, encoder: Callable[[list[str]], np.ndarray] = hashed_counts) -> DataFrame:
    """(sid, idx, dim, sha1, vector) of texts, batch by batch on the executors."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="text").assign(vector=[v.tolist() for v in encoder(batch["text"].tolist())])

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "text")
    return rows.mapInPandas(encode, f"{kinds}, vector array<float>")


def renewed(wanted: DataFrame, cached: DataFrame, encoder: Callable[[list[str]], np.ndarray] = hashed_counts) -> DataFrame:
    """The vectors of all wanted texts: kept where the fingerprint is the same, made anew elsewhere."""
    kept = cached.join(wanted.select("sid", "idx", "dim", "sha1"), ["sid", "idx", "dim", "sha1"], "left_semi")
    fresh = encoded(stale(wanted, cached), encoder)
    return kept.select(fresh.columns).unionByName(fresh)


def stamp(spark: SparkSession, sources: Sequence[str]) -> str:
    """What the files below some paths are known by: their names, sizes and times of change."""
    found = []
    for source in sources:
        at = spark._jvm.org.apache.hadoop.fs.Path(source)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        files = fs.listFiles(at, True) if fs.exists(at) else None
        while files is not None and files.hasNext():
            one = files.next()
            found.append(f"{one.getPath()} {one.getLen()} {one.getModificationTime()}")
    return "\n".join(sorted(found))


def kept_path(root: str, name: str, schema_of: DataFrame, told: str = "") -> str:
    """Where a table is kept: another schema, or other sources (``told``), is another folder, so a stale one is never read
    by mistake and none is written over while it may be read."""
    return f"{root.rstrip('/')}/{hashlib.sha256((schema_of.schema.json() + told).encode()).hexdigest()[:12]}/{name}"


def kept(df: DataFrame, root: str, name: str, fresh: bool = False, sources: Sequence[str] = ()) -> DataFrame:
    """``df`` as kept under ``root``, written there first if it is not, if a file below ``sources`` has changed since, or
    if it has to be made anew (``fresh``: no other job may read it then)."""
    spark = df.sparkSession
    path = kept_path(root, name, df, stamp(spark, sources))
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if fresh or not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
