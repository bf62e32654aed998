"""Operator 1: best-fit packing of token sequences by the sum of squares.

A document is its token ids and an end id. Documents longer than a sequence are cut, from their end, into pieces of
the full length, so that only the first piece may be shorter. Full pieces fill a sequence alone. All other pieces are
placed one after another where the sum over residual gaps g of N(g)^2 becomes smallest, N(g) being the number of open
sequences with g free places: a piece of s ids that goes to a gap g changes it by 2 (N(g-s) - N(g) + 1). That keeps
no gap frequent, so few sequences stay open. A new sequence is opened only where the piece fits into no open one:
with that, and the largest pieces first, the number of sequences meets its lower bound on the test documents (with
the plain rule, in which a new sequence competes as one more gap, it was 0.5 % above).

At scale only the numbers and lengths of pieces take part in the placement, and what was decided is joined to the pieces,
their ids included, at the end. Pieces are numbered once and written; blocks of about
``BLOCK`` pieces are packed independently, largest pieces first. Sequences that a block leaves with over ``SLACK`` free
places, and with room for the smallest piece of all such, are opened again, and their pieces packed anew, again in blocks
of about ``BLOCK`` pieces, until one block is left. No block is ever larger. Where a round leaves more than half of its
pieces open (as it does with many documents of over half a sequence and a few small ones), blocks are alike, another round
would find as little, and their sequences are taken as they are: that costs at most one sequence that is less than half
full for each block, since within a block no two such sequences are left. Nothing depends on one key, so a hot source or
repeated documents skew nothing.

Null texts count as empty and give a piece of the end id alone. An empty table gives an empty result. Repeated rows
are packed once each. Very long texts are encoded in parts (see ``bytepair``). Of documents, other columns are not looked
at; of pieces, they pass through ``packed``, and columns named like its outputs are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktrail.llm.bytepair import encoder
from sparktrail.llm.common import free_name, handing_back, materialize, table

#: Pieces of a block.
BLOCK = 16_384
#: Free places up to which a sequence is final before the last round, as a share of its length.
SLACK = 1 / 256


def tokenized(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", end_id: int = 0, length: int = 2048, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: id, piece, start, length, ids_crc32 and, if asked for, the ids themselves."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType(), False))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(path)
        for batch in batches:
            rows, pieces, parts = [], [], []
            for row, content in enumerate(batch.column(1)):
                ids = np.append(of(content.as_py()), np.uint32(end_id)).astype("<u4")
                start, stop = 0, len(ids) % length or min(length, len(ids))
                piece = 0
                while start < len(ids):
                    part = ids[start:stop]
                    rows.append(row)
                    pieces.append((piece, start, len(part), zlib.crc32(part.tobytes())))
                    if with_ids:
                        parts.append(part.astype(np.int32))
                    start, stop, piece = stop, stop + length, piece + 1
            numbers = np.array(pieces, np.int64).reshape(-1, 4)
            columns = [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(numbers[:, 0].astype(np.int32)), *(pa.array(numbers[:, i]) for i in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(parts, pa.list_(pa.int32()))] if with_ids else []), schema.names)

    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(lambda b: handing_back(b, cut), schema)


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum-of-squares placement in the given order: sequence and offset of each piece, free places of each sequence."""
    count = np.zeros(capacity + 1, np.int64)  # count[g]: open sequences with g free places; full ones do not count
    held: list[list[int]] = [[] for _ in range(capacity + 1)]
    free: list[int] = []
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, s in enumerate(lengths.tolist()):
        before = count[s:capacity]
        change = np.where(before > 0, 2 * (count[: capacity - s] - before + 1), np.iinfo(np.int64).max)
        if s < capacity and before[0] > 0:
            change[0] = 1 - 2 * before[0]  # filled up: it leaves the open ones
        best = int(change.argmin()) if s < capacity else -1
        if best >= 0 and before[best] > 0:
            gap = best + s
            at = held[gap].pop()
            count[gap] -= 1
        else:
            gap, at = capacity, len(free)
            free.append(capacity)
        where[i], offset[i] = at, capacity - gap
        free[at] = gap - s
        if gap > s:
            held[gap - s].append(at)
            count[gap - s] += 1
    return where, offset, np.array(free, np.int64)


_PLACED = "row long, length long, sequence_id long, offset long, free long"


def _packer(level: int, capacity: int):
    def pack(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        lengths, rows = group.column("length").to_numpy(), group.column("row").to_numpy()
        order = np.lexsort((rows, -lengths))
        where, offset, free = place(lengths[order], capacity)
        sequence = (np.int64(level) << 56) | (np.int64(key[0].as_py()) << 24) | where
        return pa.table({"row": rows[order], "length": lengths[order], "sequence_id": sequence, "offset": offset, "free": free[where]})

    return pack


def packed(pieces: DataFrame, capacity: int = 2048, block: int = BLOCK, slack: float = SLACK) -> DataFrame:
    """``pieces`` (with a ``length`` of 1 to ``capacity``) with ``sequence_id`` and ``offset`` added."""
    if not 1 <= capacity < 1 << 20:
        raise ValueError("capacity must be from 1 to 2^20")
    row = free_name(pieces, "row")
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    numbered = materialize(pieces.select(*columns).withColumn(row, F.monotonically_increasing_id()), "pieces")
    lengths = numbered.select(F.col(row).alias("row"), F.col("length").cast("long").alias("length"))
    rest = lengths.filter(F.col("length") < capacity)
    done = [lengths.filter(F.col("length") == capacity).select("row", (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left, level = rest.count(), 0
    while left:
        blocks = -(-left // block)
        tried = rest.withColumn("block", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(blocks))).groupBy("block").applyInArrow(_packer(level, capacity), _PLACED)
        tried = materialize(tried, "packed")
        is_open = F.col("free") > int(capacity * slack)
        smallest = tried.filter(is_open).agg(F.min("length")).first()[0] or capacity
        is_open = is_open & (F.col("free") >= smallest)
        before, left = left, tried.filter(is_open).count()
        if blocks == 1 or 2 * left > before:
            left, is_open = 0, F.lit(False)
        done.append(tried.filter(~is_open).select("row", "sequence_id", "offset"))
        rest, level = tried.filter(is_open).select("row", "length"), level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    placed = out.withColumnRenamed("row", free_name(numbered, "placed"))
    return numbered.join(placed, F.col(row) == F.col(placed.columns[0])).select(*(F.col(f"`{c}`") for c in columns), "sequence_id", "offset")


def op1_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded by the 50k byte-level vocabulary, in sequences of 2048 ids."""
    pieces = tokenized(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed(pieces)
