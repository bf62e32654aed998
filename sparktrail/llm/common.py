"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_written: list[tuple[SparkSession, str]] = []


#: Rows of a block of texts that a Python worker holds several times over while it works on them.
BATCH_ROWS = 512
#: Bytes up to which a table is broadcast, as counted from its rows.
BROADCAST_BYTES = 16 << 20


def handing_back(batches: Iterator, of: Callable[[Iterator], Iterator]) -> Iterator:
    """What ``of`` makes of ``batches``; at its end the worker, which later stages use again, gives freed memory back
    to the system, where its allocators can."""
    yield from of(batches)
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_ROWS rows for what is run inside; afterwards the session is as it was."""
    before = spark.conf.get(_BATCHES)
    spark.conf.set(_BATCHES, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCHES, before)


def per_text(out: T.StructType, make: Callable[[], Callable[[str | None], tuple]]) -> Callable[[Column], Column]:
    """An Arrow function of a text column that gives the struct ``out``; ``make`` prepares what tells it for one text.

    A batch is read BATCH_ROWS texts at a time, so that a worker holds few texts besides the batch itself.
    """
    kind = to_arrow_type(out)

    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tell = make()
        for batch in batches:
            rows = []
            for at in range(0, len(batch), BATCH_ROWS):
                rows += [tell(t) for t in batch.slice(at, BATCH_ROWS).to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)], fields=list(kind))

    @F.arrow_udf(out)
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return handing_back(batches, told)

    return apply


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is configured, a temporary one in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="sparktrail-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/sparktrail-{what}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives a lost executor."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    with _small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_order(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` (a written table) with ``name``, the number of each row from 0 on in a total order.

    Rows are dealt out by ranges of the order, so rows that share a key do not share a task, and numbered task by task;
    the driver gets one count for each task. The result is written.
    """
    at = free_name(rows, "at")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    written, task = materialize(dealt, "ordered"), F.shiftright(F.col(f"`{at}`"), 33)
    before, starts = 0, []
    for number, n in sorted(tuple(r) for r in written.groupBy(task.alias("task")).agg(F.count("*").alias("n")).collect()):
        starts.append((number, before))
        before += n
    start = F.broadcast(rows.sparkSession.createDataFrame(starts, "`_task` long, `_start` long"))
    numbered = written.join(start, task == F.col("_task"))
    return numbered.select(*(F.col(f"`{c}`") for c in rows.columns), (F.col("_start") + F.col(f"`{at}`").bitwiseAND((1 << 33) - 1)).alias(name))


def running_sums(rows: DataFrame, key: str, place: str, columns: list[str], block: int = 4096) -> DataFrame:
    """``rows`` with each of ``columns`` (long) replaced by its sum over the rows of the key up to this one.

    ``place`` counts the rows of a key (0 or 1, 2, ...). Sums are taken by blocks of places, then over the blocks of a
    key, so a key of any number of rows is spread over tasks.
    """
    number = F.floor(F.col(place) / block).cast("long")
    within = Window.partitionBy(key, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.withColumn("_block", number)
    if not (rows.agg(F.max(place)).first()[0] or 0) >= block:  # one block each: nothing comes before it
        return inner.withColumns({c: F.sum(c).over(within) for c in columns}).drop("_block")
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = inner.groupBy(key, "_block").agg(*(F.sum(c).alias(f"_{c}") for c in columns))
    sums = sums.select(F.col(key).alias("_key"), F.col("_block").alias("_of"), *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in columns))
    summed = inner.withColumns({c: F.sum(c).over(within) for c in columns})
    both = summed.join(sums, (F.col(key) == F.col("_key")) & (F.col("_block") == F.col("_of")))
    return both.withColumns({c: F.col(c) + F.col(f"_{c}") for c in columns}).drop("_block", "_key", "_of", *(f"_{c}" for c in columns))


def _row_bytes(schema: T.StructType) -> Column:
    """About the bytes of a row: those of strings, binaries and arrays as they are, 16 for any other field."""
    total = F.lit(16)
    for field in schema.fields:
        kind, column = field.dataType, F.col(f"`{field.name}`")
        if isinstance(kind, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(column), F.lit(0))
        elif isinstance(kind, T.ArrayType):
            total = total + F.greatest(F.size(column), F.lit(0)) * 24
        total = total + 16
    return total


def small(df: DataFrame, bound: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (a written table), to be broadcast if its rows take at most ``bound`` bytes and to be shuffled otherwise."""
    taken = df.agg(F.sum(_row_bytes(df.schema).cast("long"))).first()[0] or 0
    return F.broadcast(df) if taken <= bound else df


def filesystem(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of ``path``; works for any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    fs, at = filesystem(spark, path)
    fs.delete(at, True)


def tables_since(n: int | None = None) -> int | list[str]:
    """How many tables have been written to the shared folder; with such a number, the paths of those written since."""
    return len(_written) if n is None else [path for _, path in _written[n:]]


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


def fold(column: str, k: int) -> Column:
    """crc32 of the id as text, modulo k: the split into learning and held-out rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(k)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
