"""Operator 6: exact top-k inner products by no-random-access aggregation.

Vectors are quantised to integers, floor(``scale`` * x). Candidates are dealt by a hash into blocks of about ``BLOCK``
rows, queries into blocks of about ``QUERIES``, and each pair of blocks is one group of one task, so no task holds more
than two blocks. Within a candidate block there is a sorted list for each dimension. A query reads all lists from their
good ends (from the top where its component is positive, from the bottom where it is negative, not at all where it is
0), one after another position, in rounds that grow. Where a round leaves more than half of the candidates in reach, as in
random data of many dimensions, reading on would touch nearly every position of every list; then the lists are left, and
the scores of the block's candidates are one matrix product, which is the sum that the lists would give. Of every candidate met so far it keeps the sum of what has been read
of it and in which lists that was. Its lower bound adds the worst value of each list in which it has not been met, its
upper bound the value at the reading depth, which also bounds the candidates that no list has shown. Reading stops when,
besides the k of the best lower bounds, neither a candidate that was met nor one that was not can reach the k-th best
lower bound, or when the lists end. Then, and only then, the scores of those k (and of any that are level with them) are
resolved from their vectors. Every step is exact, so the k best of all blocks are the k best of all candidates.

Every candidate is sent to each block of queries, and each pair of blocks gives k rows for a query: with N candidates and
Q queries that is N * Q / QUERIES vectors and Q * k * N / BLOCK rows of three numbers, of which Spark keeps k by query
before they are shuffled. Both grow with the product, as an exact search over data without structure must.

Vectors that are null or hold a null or non-finite component take no part; neither do rows with a null id. Vectors are
only compared to vectors of the same number of components. Integers of any size are exact: rows with components too large
for sums in double precision are compared by Python's integers, a block of them at a time. A score beyond the range of a
64-bit integer is ranked by its true value and returned as the nearest end of that range. Ties go to the smaller id.
Rows with the query's own id are not its candidates. Repeated rows are repeated candidates and repeated queries give
their result once; an id with several vectors asks once with each, and has a ranking for each. An empty table, or one without queries, gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktrail.llm.common import materialize, small, table

#: Candidates and queries of a block.
BLOCK, QUERIES = 4096, 1024


def finite(vector: str) -> Column:
    """True for arrays of which every component is there and finite."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & ok, F.lit(False))


class Lists:
    """The sorted lists of a block of integer vectors; ``read`` counts the positions that queries have read, ``products``
    the queries for which a product took over."""

    #: The part of the lists that the first round reads; later ones read twice as deep as the one before.
    FIRST = (1 / 16,)

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")  # ties then go to the smaller id
        self.ids, self.vectors = ids[order], vectors[order]
        up = np.argsort(self.vectors, axis=0, kind="stable").T
        self.order = np.concatenate((up[:, ::-1], up)).astype(np.int32)  # of each dimension the list from its top, then from its bottom
        dims = np.arange(vectors.shape[1])
        self.values = self.vectors[self.order, np.concatenate((dims, dims))[:, None]]
        self.read = self.products = 0

    def top(self, queries: np.ndarray, k: int, own: Sequence) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of the k candidates of highest score, best first, for each query, without those of its own id."""
        left = [self._read(query, k, one) for query, one in zip(queries, own, strict=True)]
        # where many candidates are left, the scores of all queries at once
        ended = np.array([len(of) > max(k, len(self.ids) // 8) for of in left], bool)
        self.products += int(ended.sum())
        whole = iter((self.vectors @ queries[ended].T).T)
        for query, of, end in zip(queries, left, ended, strict=True):
            scores = next(whole)[of] if end else self.vectors[of] @ query
            best = np.argsort(-scores, kind="stable")[:k]
            yield self.ids[of[best]], scores[best]

    def _read(self, query: np.ndarray, k: int, own: object) -> np.ndarray:
        """The candidates that can still be among the k best when reading stops."""
        n = len(self.ids)
        used = np.flatnonzero(query)
        weight = query[used]
        lists = np.where(weight > 0, used, used + len(query))
        worst = self.values[lists, -1] * weight
        lower = np.full(n, worst.sum(), self.vectors.dtype)
        left, depth = np.flatnonzero(self.ids != own), 0
        rounds = iter([int(n * part) for part in self.FIRST])
        while depth < n and len(left) > k and len(used):
            until = next(rounds, 2 * depth if 2 * len(left) < n else n)
            until = min(n, max(until, depth + 1))
            if until == n:
                break
            self.read += (until - depth) * len(used)
            values = self.values[lists, depth:until] * weight[:, None]
            _add(lower, self.order[lists, depth:until], values - worst[:, None])
            depth = until
            # what has not been read of a candidate is at most the value at the depth; of one that no list has shown, all
            more = values[:, -1] - worst
            upper = lower + more.sum()
            met = self.order[lists, :depth]
            _add(upper, met, np.broadcast_to(-more[:, None], met.shape))
            left = left[upper[left] >= _nth(lower[left], k)]
        return left


def _add(total: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    if total.dtype == object:
        np.add.at(total, at.ravel(), values.ravel())
    else:
        total += np.bincount(at.ravel(), values.ravel(), len(total))


def _nth(values: np.ndarray, k: int) -> object:
    """The k-th largest value."""
    return sorted(values)[-k] if values.dtype == object else np.partition(values, len(values) - k)[len(values) - k]


def _quantised(rows: pd.Series, scale: float) -> np.ndarray:
    """floor(scale * x): doubles where all are exact, or else Python's integers."""
    x = np.stack(rows.to_numpy()).astype(np.float64)
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    if np.isfinite(scaled).all() and np.abs(scaled).max(initial=0) < 1 << 53:
        return scaled
    return np.array([[math.floor(Fraction(v) * Fraction(scale)) for v in row] for row in x.tolist()], object)


def _small(vectors: np.ndarray) -> np.ndarray:
    """The rows whose inner products with each other are exact in double precision."""
    bar = math.isqrt((1 << 53) // max(1, vectors.shape[1]))
    return np.abs(vectors).max(axis=1, initial=0) < bar


_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _searched(k: int, scale: float):
    def search(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out: tuple[list, ...] = ([], [], [], [], [])
        if len(asked) and len(there):
            queries, vectors = _quantised(asked["v"], scale), _quantised(there["v"], scale)
            ids, own, numbers = there["id"].to_numpy(), asked["id"].to_numpy(), asked["row"].to_numpy()
            plain, easy = _small(vectors), _small(queries)
            whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
            parts = [(plain, easy, lambda x: x.astype(np.float64)), (~plain, easy, whole), (np.ones(len(ids), bool), ~easy, whole)]
            for rows, asking, exact in parts:  # plain with plain; large candidates; large queries with all
                if not rows.any() or not asking.any():
                    continue
                lists = Lists(ids[rows], exact(vectors[rows]))
                for one, number, (found, scores) in zip(own[asking], numbers[asking], lists.top(exact(queries[asking]), k, own[asking]), strict=True):
                    values = [int(s) for s in scores]
                    out[0].extend([one] * len(found))
                    out[1].extend(found.tolist())
                    out[2].extend(min(max(v, _LEAST), _MOST) for v in values)
                    # beyond the range, text that sorts like the number
                    out[3].extend(None if _LEAST < v < _MOST else str(10**700 + v) for v in values)
                    out[4].extend([number] * len(found))
        return pd.DataFrame({"query_id": out[0], "id": out[1], "score": out[2], "beyond": out[3], "row": out[4]})

    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector: str = "embedding", block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, id, score): for each row for which ``is_query`` holds its ``k`` best other rows."""
    asking = vectors.select(F.col(id_col).alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"), F.col(vector).alias("v")).filter(F.col("id").isNotNull() & finite("v"))
    rows = materialize(asking.select("id", "query", F.size("v").alias("dim"), F.transform("v", lambda x: x.cast("double")).alias("v"), F.monotonically_increasing_id().alias("row")), "vectors")
    sizes = materialize(rows.groupBy("dim").agg(F.ceil(F.count("*") / block).alias("blocks"), F.ceil(F.count_if("query") / query_block).alias("query_blocks")), "sizes")
    rows = rows.join(small(sizes), "dim").filter("query_blocks > 0")
    kind = vectors.schema[id_col].dataType

    own_block, own_query_block = F.pmod(F.xxhash64("row"), F.col("blocks")), F.pmod(F.xxhash64("id"), F.col("query_blocks"))
    candidates = rows.withColumn("cb", own_block).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_blocks") - 1)))
    queries = rows.filter("query").dropDuplicates(["id", "v"]).withColumn("qb", own_query_block).withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

    schema = T.StructType([T.StructField("query_id", kind), T.StructField("id", kind), T.StructField("score", T.LongType()), T.StructField("beyond", T.StringType()), T.StructField("row", T.LongType())])
    key = ["dim", "cb", "qb"]
    asked = queries.select(*key, "id", "v", "row").toDF("q_dim", "q_cb", "q_qb", "id", "v", "row").groupBy("q_dim", "q_cb", "q_qb")
    found = asked.cogroup(candidates.select(*key, "id", "v").groupBy(*key)).applyInPandas(_searched(k, scale), schema)
    order = Window.partitionBy("query_id", "row").orderBy(F.col("score").desc(), F.col("beyond").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op6_no_random_access_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best others of every twentieth vector."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
