"""Operator 8: embedding near-duplicates by an exact metric range join.

On unit vectors a cosine of at least c is a distance of at most r = sqrt(2 - 2c). Equal vectors of one label become a
class first, however many copies there are. The classes of a label begin as one cell. A cell with more than ``CELL``
vectors at home gets a pivot for every ``CELL`` of them, ``PIVOTS`` at most, chosen by a hash, and is parted: a vector's
home is the part of its nearest pivot. By the triangle inequality a vector x of part i can only be within r of a vector of
part j if it is within r of the plane between the two pivots, so

    d(x, p_j)^2 - d(x, p_i)^2 <= 2 r d(p_i, p_j)

and x visits the parts j > i for which that holds. Parts that are still too large are parted again, level after level, so
the number of cells grows with the number of vectors and none with it. At the end cells are joined independently. Two
vectors of a cell meet unless both were visitors at one level (they meet elsewhere then), in chunks of at most about
``CHUNK`` rows a side, so that neither a frequent label nor a crowded cell meets in one task. A task gives for each
vector the number of vectors linked and one edge to the first vector of its group of linked ones, so a dense cell gives no
more rows than it has vectors.

Cosines are computed in double precision from the vectors as they are; those within 1e-9 of the threshold again, with
exactly rounded sums. Vectors that are null, zero or hold null or non-finite components, and those with a null label or
id, link with nothing (a null id gives a null component, and is kept). Vectors of different lengths are not compared.
Rows of one id and vector count as one vector; rows of one id with several vectors (or labels) are several vectors, each
with its own links, and each a way to its id. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktrail.llm.common import materialize, small, table
from sparktrail.llm.components import components
from sparktrail.llm.topk import finite

CELL, PIVOTS, CHUNK = 4096, 64, 4096
#: Levels of parts, at most: cells of 64^8 * 4096 vectors are enough.
LEVELS = 8
_CELL = ["label", "dim", "cell"]


def _stack(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_numpy()).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _parted(radius: float, level: int):
    """Homes and visits of a chunk of one cell's vectors, given the cell's pivots."""

    def parted(vectors: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        columns = [*_CELL, "rep", "copies", "v", "visits"]
        if not len(vectors) or not len(pivots):
            return pd.DataFrame({c: [] for c in columns})
        pivots = pivots.sort_values("number")
        x, p = _unit(_stack(vectors["v"])), _unit(_stack(pivots["v"]))
        d2 = np.maximum(2 - 2 * (x @ p.T), 0)
        home = d2.argmin(axis=1)
        between = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0))
        near = d2 - d2[np.arange(len(x)), home][:, None] <= 2 * radius * between[home] + 1e-9
        near &= np.arange(len(p))[None, :] > home[:, None]
        row, part = np.nonzero(near)
        row, part = np.concatenate((np.arange(len(x)), row)), np.concatenate((home, part))
        out = vectors.iloc[row].reset_index(drop=True)
        out["cell"] = out["cell"] * (PIVOTS + 1) + part + 1
        out["visits"] = out["visits"] | np.where(np.arange(len(row)) < len(x), 0, 1 << level)
        return out[columns]

    return parted


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two, which rounds nothing, so that squares of its largest component stay in range."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _linked(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of ``a`` and ``b`` have at least that cosine."""
    ua, ub = _unit(a), _unit(b)
    a, b = _scaled(a), _scaled(b)
    out = np.empty((len(a), len(b)), bool)
    for at in range(0, len(a), 1024):
        c = ua[at : at + 1024] @ ub.T
        out[at : at + 1024] = c >= cosine
        for i, j in zip(*np.nonzero(np.abs(c - cosine) <= 1e-9), strict=True):
            x, y = a[at + i].tolist(), b[j].tolist()
            exact = math.sumprod(x, y) / (math.sqrt(math.sumprod(x, x)) * math.sqrt(math.sumprod(y, y)))
            out[at + i, j] = exact >= cosine
    return out


def _groups(links: np.ndarray) -> np.ndarray:
    """For each vertex of a symmetric link matrix the first vertex it can reach."""
    first = np.arange(len(links))
    while True:
        least = np.minimum(first, np.where(links, first[None, :], len(links)).min(axis=1, initial=len(links)))
        least = least[least]
        if (least == first).all():
            return first
        first = least


def _joined(cosine: float):
    def joined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep", ignore_index=True)
        left, right = np.flatnonzero(rows["left"]), np.flatnonzero(rows["right"])
        out = {"rep": [], "links": [], "to": []}
        if len(left) and len(right):
            v, rep, copies = _stack(rows["v"]), rows["rep"].to_numpy(), rows["copies"].to_numpy()
            same = bool((rows["left"] & rows["right"]).all())
            links = _linked(v[left], v[right], cosine)
            if same:
                np.fill_diagonal(links, False)
            count = np.zeros(len(rows), np.int64)
            count[left] += links @ copies[right]
            if not same:
                count[right] += links.T @ copies[left]
            some = np.flatnonzero(count)
            where = np.full(len(rows), -1)
            where[some] = np.arange(len(some))
            i, j = np.nonzero(links)
            square = np.zeros((len(some), len(some)), bool)
            square[where[left[i]], where[right[j]]] = square[where[right[j]], where[left[i]]] = True
            to = _groups(square)
            out = {"rep": rep[some], "links": count[some], "to": rep[some][to]}
        return pd.DataFrame(out)

    return joined


def _part(cells: DataFrame, sizes: DataFrame, radius: float, level: int, chunk: int) -> DataFrame:
    """The vectors of too large cells (``sizes``: homes, pivots, chunks of each) in their parts."""
    # enough rows for the pivots of a cell by a hash, then exactly as many
    dealt = cells.join(sizes, _CELL)
    some = F.least(F.lit(1.0), F.col("pivots") * 4.0 / F.col("homes") + 64.0 / F.col("homes"))
    few = dealt.filter((F.col("visits") == 0) & (F.pmod(F.xxhash64("rep", F.lit(level)), F.lit(1 << 30)) < some * (1 << 30)))
    chosen = few.groupBy(*_CELL).agg(F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("rep").alias("o"), "rep", "v"))), 1, PIVOTS).alias("p"), F.max("pivots").alias("pivots"), F.max("chunks").alias("chunks"))
    chosen = chosen.select(*_CELL, "pivots", "chunks", F.posexplode("p").alias("number", "one")).filter("number < pivots")
    chosen = chosen.select(*_CELL, "number", "one.v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("part")).toDF("p_label", "p_dim", "p_cell", "number", "v", "p_part")
    parts = dealt.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("chunks"))).select(*_CELL, "part", "rep", "copies", "v", "visits")
    return parts.groupBy(*_CELL, "part").cogroup(chosen.groupBy("p_label", "p_dim", "p_cell", "p_part")).applyInPandas(_parted(radius, level), cells.schema)


def range_join(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", cell: int = CELL, pivots: int = PIVOTS, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id (smallest id reachable by links) and kept."""
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be over 0 and at most 1")
    if not 2 <= pivots <= PIVOTS:
        raise ValueError(f"pivots must be from 2 to {PIVOTS}")
    own = vectors.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    valid = F.col("id").isNotNull() & F.col("label").isNotNull() & finite("v") & F.exists("v", lambda x: x != 0)
    key = F.when(valid, F.struct(F.col("label"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), F.col("v")).alias("h2")))
    own = own.withColumn("key", key)
    # a class is known by a number from here on, since several classes may have rows of one id
    classes = own.filter("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.count_distinct("id").alias("copies"), F.first("v").alias("v"))
    double = F.transform("v", lambda x: x.cast("double"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("rep"), "key", "key.label", F.size("v").alias("dim"), "id", "copies", double.alias("v")), "classes")

    radius = math.sqrt(2 - 2 * cosine)
    cells = classes.select("label", "dim", F.lit(0).cast("long").alias("cell"), "rep", "copies", "v", F.lit(0).cast("long").alias("visits"))
    done = []
    for level in range(LEVELS):
        sizes = cells.groupBy(*_CELL).agg(F.count_if(F.col("visits") == 0).alias("homes"), F.ceil(F.count("*") / chunk).alias("chunks")).filter(F.col("homes") > cell)
        sizes = small(materialize(sizes.withColumn("pivots", F.least(F.ceil(F.col("homes") / cell), F.lit(pivots))), "sizes"))
        if sizes.isEmpty():
            break
        done.append(cells.join(sizes, _CELL, "left_anti"))
        cells = materialize(_part(cells, sizes, radius, level, chunk), "cells")
    for part in done:
        cells = cells.unionByName(part)

    crowd = cells.groupBy(*_CELL, "visits").agg(F.ceil(F.count("*") / chunk).alias("chunks")).groupBy(*_CELL).agg(F.map_from_entries(F.collect_list(F.struct("visits", "chunks"))).alias("crowd"))
    cells = cells.join(materialize(crowd, "crowd"), _CELL)  # written, so that a crowded cell can be split
    zero = F.lit(0).cast("long")
    me = F.struct(F.col("visits").alias("visits"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("crowd")[F.col("visits")]).alias("chunk"))
    chunks = lambda e: F.transform(F.sequence(zero, e["value"] - 1), lambda c: F.struct(e["key"].alias("visits"), c.alias("chunk")))
    # those that were no visitors at a level where this one was
    met = F.flatten(F.transform(F.filter(F.map_entries("crowd"), lambda e: e["key"].bitwiseAND(F.col("visits")) == 0), chunks))
    tasks = cells.withColumn("me", me).select(*_CELL, "rep", "copies", "v", "me", F.explode(met).alias("other"))
    tasks = tasks.select(*_CELL, "rep", "copies", "v", F.least("me", "other").alias("a"), F.greatest("me", "other").alias("b"), (F.col("me") <= F.col("other")).alias("left"), (F.col("me") >= F.col("other")).alias("right"))
    found = tasks.groupBy(*_CELL, "a", "b").applyInPandas(_joined(cosine), "rep long, links long, to long")
    found = materialize(found, "links")

    group = components(found.select("rep", "to"))
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of_class = classes.select("key", "rep", "id", "copies").join(linked, "rep", "left").join(group.select(F.col("id").alias("rep"), "component"), "rep", "left")
    of_class = of_class.withColumn("component", F.coalesce("component", "rep"))
    least = of_class.groupBy("component").agg(F.min("id").alias("component_id"))
    of_class = of_class.join(materialize(least, "least"), "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = own.select("id", "key").join(of_class, "key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op8_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of one label."""
    return range_join(table(spark, sf_dir, "embeddings"))
