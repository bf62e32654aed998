"""Operator 5: MinHash near-duplicate detection by fast similarity sketching.

1. Every text's set of distinct word shingles gets a sketch of ``bands * rows`` coordinates. Round after round each
   shingle is thrown into a coordinate by a hash of its own; a coordinate keeps the smallest (round, value). After as
   many rounds as there are coordinates, round i throws all shingles into coordinate i, so every coordinate fills, and
   large sets need two or three rounds. Coordinates of two sets agree with the probability of their Jaccard
   similarity, with the concentration of independent samples. Bands of coordinates are hashed; at 32 bands of 5 rows
   two sets of similarity 0.8 share none with a probability of 3e-6.
2. Equal sets (by a 128-bit fingerprint) become one class, represented by its smallest id, so thousands of exact copies
   cost as much as one.
3. In each band bucket of several classes the one with the most company is the centre, and all others are compared to
   it, so a group of n near copies costs about n comparisons. Where that leaves a bucket with several components, its
   texts are joined once more, on shingles: two similar sets share one of the rarest shingles of each (the first
   n - ceil(0.8 n) + 1 in one order for all), and the first one they share comes early enough in both for the rest to
   make up the intersection. Pairs across components for which that holds are compared. That loses no link and passes
   over the many texts that only have a common passage in common.
4. Comparisons are exact: intersection and union of the full sets of shingles, as words. Hashes only choose candidates
   (and count shingles, to within a chance of 2^-64 for a pair of shingles, and tell equal sets by two independent hashes
   of each shingle, 128 bits together).

Words are runs of other bytes than ASCII white space; A-Z are lower-cased. A text with fewer words than a shingle has
its whole word sequence as only element. Null, empty and blank texts have an empty set and link with nothing; an empty
table gives an empty result. Very long texts are hashed whole, one at a time. Rows of one id, if an id repeats, belong
together. A row with a null id links with nothing and is kept. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktrail.llm.common import handing_back, materialize, small, table
from sparktrail.llm.components import components
from sparktrail.llm.words import Words, blocks, mix

_U = np.uint64
#: Counters of shingles from which their order is made: what the driver gets is bounded by them.
COUNTERS = 1 << 20


def _whole(hashes: np.ndarray) -> np.ndarray:
    """One hash of a text with fewer words than a shingle."""
    value = np.array([len(hashes)], _U)
    for h in hashes:
        value = mix(value * _U(0x9E3779B97F4A7C15) + h)
    return value


def shingles(words: Words, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block."""
    hashes = words.hashes()
    runs = words.runs(hashes, size)
    for i in range(words.n_docs):
        a, b = int(words.first[i]), int(words.first[i + 1])
        yield np.unique(runs[a : b - size + 1]) if b - a >= size else _whole(hashes[a:b]) if b > a else np.empty(0, _U)


def shingles_twice(words: Words, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As ``shingles``, each with the second, independent hash of the same shingles."""
    one, two = words.hashes(0), words.hashes(1)
    runs, others = words.runs(one, size, 0), words.runs(two, size, 1)
    for i in range(words.n_docs):
        a, b = int(words.first[i]), int(words.first[i + 1])
        if b - a >= size:
            values, at = np.unique(runs[a : b - size + 1], return_index=True)
            yield values, others[a : b - size + 1][at]
        elif b > a:
            yield _whole(one[a:b]), _whole(two[a:b])
        else:
            yield np.empty(0, _U), np.empty(0, _U)


class Sketcher:
    """Sketches of ``bands * rows`` coordinates, and their band hashes."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.t = bands, rows, bands * rows
        random = np.random.default_rng(5)
        self.seeds = random.integers(1, 1 << 63, 2 * self.t, dtype=np.int64).astype(_U)
        self.factors = random.integers(1, 1 << 63, self.t, dtype=np.int64).astype(_U).reshape(bands, rows) | _U(1)
        self.own = random.integers(1, 1 << 63, bands, dtype=np.int64).astype(_U)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        """(round << 32 | value) of every coordinate of a set that is not empty."""
        t, done = self.t, 0
        sketch = np.full(t, np.iinfo(np.uint64).max, _U)
        while done < 2 * t and sketch.max() == np.iinfo(np.uint64).max:
            rounds = np.arange(done, min(2 * t, done + max(1, 2048 // len(values))))
            thrown = mix(values[None, :] ^ self.seeds[rounds][:, None])
            where = ((thrown >> _U(32)) * _U(t)) >> _U(32)
            where[rounds >= t] = (rounds[rounds >= t] - t).astype(_U)[:, None]
            kept = (rounds.astype(_U)[:, None] << _U(32)) | (thrown & _U(0xFFFFFFFF))
            np.minimum.at(sketch, where.ravel().astype(np.intp), kept.ravel())
            done = int(rounds[-1]) + 1
        return sketch

    def band_hashes(self, sketch: np.ndarray) -> np.ndarray:
        return mix((mix(sketch).reshape(self.bands, self.rows) * self.factors).sum(1, dtype=_U) ^ self.own)


def sketches(docs: DataFrame, id_col: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """(id, n, fp1, fp2, bands): size and fingerprint of each set, and its band hashes (null for the empty set)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(bands, rows)
        for batch in batches:
            n, fp1, fp2, found = [], [], [], []
            for _, words in blocks(batch.column(1), lower=True):
                for values, others in shingles_twice(words, size):
                    n.append(len(values))
                    fp1.append(int(mix(values).sum(dtype=_U).astype(np.int64)))
                    fp2.append(int(mix(others).sum(dtype=_U).astype(np.int64)))
                    found.append(sketcher.band_hashes(sketcher(values)).astype(np.int64) if len(values) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(fp1, pa.int64()), pa.array(fp2, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["id", "n", "fp1", "fp2", "bands"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("fp1", T.LongType()), T.StructField("fp2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(lambda b: handing_back(b, sketch), schema)


def shingle_sets(docs: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """(id, set): the sorted distinct shingle hashes of each text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, words in blocks(batch.column(1), lower=True):
                found = [values.astype(np.int64) for values in shingles(words, size)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(found)), pa.array(found, pa.list_(pa.int64()))], ["id", "set"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("set", T.ArrayType(T.LongType()))])
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(lambda b: handing_back(b, sets), schema)


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets of shingles, as words and not as hashes, are similar enough."""

    def of(text: str | None) -> set:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        return set(zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else {tuple(words)} - {()}

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i in range(batch.num_rows):
                one, two = of(batch.column(2)[i].as_py()), of(batch.column(3)[i].as_py())
                shared = len(one & two)
                if shared * 100 >= (len(one) + len(two) - shared) * percent:
                    kept.append(i)
            rows = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows)], ["a", "b"])

    named = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}"))
    both = pairs.join(named("b"), "b").join(named("a"), "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(lambda b: handing_back(b, confirm), pairs.select("a", "b").schema).distinct()


def _prefixes(open_sets: DataFrame, percent: int) -> DataFrame:
    """(id, n, component, token, place): of each set as many of its shingles, in one order for all sets, as a similar
    set cannot be without all of, and the place of each in that order. The order puts the shingles that most sets have
    last, so the ones that tell sets apart are left; any order gives every pair, the counts only spare comparisons, so
    shingles may share one of ``COUNTERS`` counters, and a counter is kept as its logarithm."""
    counter = F.pmod("token", F.lit(COUNTERS))
    counted = open_sets.select(F.explode("set").alias("token")).groupBy(counter.cast("int").alias("c")).agg(F.log2(F.count("*")).alias("l")).toArrow()
    often = np.zeros(COUNTERS, np.uint8)
    often[counted.column("c").to_numpy()] = np.minimum(4 * counted.column("l").to_numpy(), 255)

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, tokens, places = [], [], []
            flat, ends = batch.column(1).flatten().to_numpy(), batch.column(1).offsets.to_numpy()
            for i, values in enumerate(np.split(flat, ends[1:-1] - ends[0])):
                weight = often[values % COUNTERS]
                k = len(values) - -(-len(values) * percent // 100) + 1
                tokens.append(values[np.lexsort((values, weight))[:k]])
                rows.append(np.full(len(tokens[-1]), i))
                places.append(np.arange(1, len(tokens[-1]) + 1))
            take = pa.array(np.concatenate(rows)) if rows else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), batch.column(3).take(take), pa.array(np.concatenate(tokens) if tokens else [], pa.int64()), pa.array(np.concatenate(places) if places else [], pa.int64())], ["id", "n", "component", "token", "place"])

    kind = open_sets.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("n", T.LongType()), T.StructField("component", kind), T.StructField("token", T.LongType()), T.StructField("place", T.LongType())])
    return open_sets.select("id", "set", "n", "component").mapInArrow(prefix, schema)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, bands: int = 32, rows: int = 5) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable by links) and kept.

    Two texts link if 100 * intersection >= ``percent`` * union of their sets of ``size``-word shingles.
    """
    sketched = materialize(sketches(docs, id_col, text, size, bands, rows), "sketches")
    member = sketched.filter("n > 0 and id is not null").select("id", "n", "fp1", "fp2")
    classes = member.groupBy("n", "fp1", "fp2").agg(F.min("id").alias("rep"))
    classes = materialize(classes, "classes")

    in_buckets = sketched.filter("n > 0").join(classes.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").select("id", "n", F.explode("bands").alias("band"))
    shared = in_buckets.groupBy("band").agg(F.count("*").alias("company")).filter("company > 1")
    buckets = materialize(in_buckets.join(shared, "band"), "buckets")

    weight = buckets.groupBy("id").agg(F.sum("company").alias("weight"))
    centre = buckets.join(weight, "id").groupBy("band").agg(F.max(F.struct("weight", "id", "n")).alias("c")).select("band", F.col("c.id").alias("centre"), F.col("c.n").alias("of_centre"))
    alike = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent  # noqa: E731  sizes alone rule other pairs out
    tried = buckets.join(centre, "band").filter((F.col("id") != F.col("centre")) & alike("n", "of_centre")).select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    tried = materialize(tried, "pairs")

    wanted = small(materialize(buckets.select("id").distinct(), "ids")).withColumnRenamed("id", "_wanted")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).filter("id is not null")
    texts = materialize(texts.join(wanted, F.col("id") == F.col("_wanted"), "left_semi"), "texts")

    links = materialize(_confirmed(tried, texts, size, percent), "links")
    label = materialize(components(links), "labels")
    spread = buckets.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_bands = spread.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("band")
    left = spread.join(open_bands, "band", "left_semi").select("id", "n", "component").distinct()
    open_sets = materialize(shingle_sets(texts.join(left.select("id").distinct(), "id", "left_semi"), "id", "text", size), "sets").join(left, "id")
    prefixes = materialize(_prefixes(materialize(open_sets, "open"), percent), "prefixes")
    mixed = prefixes.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("token")
    rest = prefixes.join(mixed, "token", "left_semi")
    one, two = rest.alias("x"), rest.alias("y")
    # the first shingle that two sets share leaves room for an intersection that is large enough
    room = 1 + F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    enough = room * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent
    across = one.join(two, (F.col("x.token") == F.col("y.token")) & (F.col("x.component") < F.col("y.component")) & alike("x.n", "y.n") & enough)
    across = across.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    more = materialize(_confirmed(materialize(across, "pairs"), texts, size, percent), "links")
    if not more.isEmpty():
        label = materialize(components(links.unionByName(more)), "labels")

    final = classes.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("n", "fp1", "fp2", F.coalesce("component", "rep").alias("component_id"))
    out = sketched.select("id", "n", "fp1", "fp2").join(final, ["n", "fp1", "fp2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op5_fast_similarity_sketching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents by two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)
