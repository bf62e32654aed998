"""Operator 11: importance resampling of documents towards a target distribution, by hashed word n-grams.

Features of a text are its runs of 1 to ``longest`` consecutive words, repeats counted, each hashed to one of ``buckets``
buckets. A bucket's gain is the logarithm of its smoothed share in the target over that in the corpus; a document's
weight is the sum of the gains of its features. A draw without replacement takes the largest weights after Gumbel noise
that a hash of the id gives, so it is the same in every run.

Features are enumerated by suffix arrays. The words of a block of texts (about ``BLOCK_BYTES``, or one longer text)
become ids, and all their suffixes are sorted by their first words, doubling the compared length until it reaches
``longest``. In that order equal n-grams stand side by side: where neighbours have a common prefix of fewer than n words,
a run of another n-gram begins. Each run is hashed once, however often it occurs in the block, and its bucket is scattered
to its occurrences. Corpus and target are counted that way in one pass each, every task adding up its own counts first, so
the driver gets ``buckets`` numbers and no more; a second pass over the corpus scores it with them.

The draw needs a total order of the scores: rows are dealt out by ranges of (score, id) and numbered task by task, so no
task sees more than its range, however many documents share a score.

Words are runs of ASCII letters and digits and of other than ASCII characters; A-Z alone are lower-cased. Null, empty and
wordless texts have no features, weight 0, and are never drawn where a document needs a word. Very long texts make a block
of their own. Rows of one id are scored each, and have the same noise; of rows alike in score and id any order is taken. A
null id has the noise of the empty text and comes first among equals. An empty corpus gives an empty result; an empty
target leaves t and T at 0. Of documents, other columns than id and text are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktrail.llm.common import handing_back, in_order, materialize, table

#: Bytes of texts whose words make one suffix array.
BLOCK_BYTES = 4 << 20
#: Every byte as it stands in a word, or a space where it stands in none.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


class Suffixes:
    """The word-id suffix array of a block of texts, sorted by ``depth`` words at least."""

    def __init__(self, texts: list[bytes | None], depth: int):
        words: list[bytes] = []
        ends = []
        for text in texts:
            words += (text or b"").translate(_BYTES).split()
            ends.append(len(words))
        coded = pa.array(words, pa.binary()).dictionary_encode()
        self.vocabulary = coded.dictionary.to_pylist()
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.ends = np.array(ends, np.int64)
        self.sizes = np.diff(self.ends, prepend=0)
        #: words from each one to the end of its text
        self.room = np.repeat(self.ends, self.sizes) - np.arange(len(words))
        self.depth = depth
        self.order = self._sorted()
        self.shared = self._shared()

    def _sorted(self) -> np.ndarray:
        n, rank, length = len(self.ids), self.ids + 1, 1
        while True:
            narrow = rank.astype(np.uint16) if rank.max(initial=0) < 1 << 16 else rank  # sorted by radix
            if length >= self.depth or not n:
                return np.argsort(narrow, kind="stable")
            after = np.where(self.room > length, rank[np.minimum(np.arange(n) + length, n - 1)], 0)
            rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64) + 1
            length *= 2

    def _shared(self) -> np.ndarray:
        """Common words of each suffix and the one before it in the order, up to the depth."""
        a, b = self.order[:-1], self.order[1:]
        both = np.minimum(self.room[a], self.room[b])
        out, alive = np.zeros(len(a), np.int64), np.ones(len(a), bool)
        for k in range(self.depth):
            rows = np.flatnonzero(alive & (both > k))
            same = rows[self.ids[a[rows] + k] == self.ids[b[rows] + k]]
            alive = np.zeros(len(a), bool)
            alive[same] = True
            out[same] += 1
        return out

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each distinct n-gram: where its run begins in the order, its occurrences, and its CRC-32; a run of
        suffixes shorter than n words has no occurrences."""
        first = np.concatenate(([0], np.flatnonzero(self.shared < n) + 1)) if len(self.order) else np.empty(0, np.int64)
        sizes = np.diff(first, append=len(self.order))
        at = self.order[first]
        sizes_of = np.where(self.room[at] >= n, sizes, 0)
        words = [self.vocabulary[i] for i in self.ids[at].tolist()] if n == 1 else [b" ".join(self.vocabulary[i] for i in self.ids[p : p + n].tolist()) for p in at.tolist()]
        return first, sizes_of, np.fromiter(map(zlib.crc32, words), np.int64, len(words))

    def buckets(self, n: int, buckets: int) -> np.ndarray:
        """The bucket of the n-gram that begins at each word, -1 where the text has no n more words."""
        first, occurs, codes = self.runs(n)
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.repeat(np.where(occurs > 0, codes % buckets, -1), np.diff(first, append=len(self.order)))
        return out

    def counts(self, longest: int, buckets: int) -> np.ndarray:
        """Features in each bucket."""
        total = np.zeros(buckets, np.int64)
        for n in range(1, longest + 1):
            _, occurs, codes = self.runs(n)
            np.add.at(total, codes % buckets, occurs)
        return total

    def weights(self, longest: int, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of each text, and the sum of their gains."""
        own = np.append(gains, 0)  # the last one is read where no feature begins
        total = np.zeros(len(self.order), np.int64)
        for n in range(1, longest + 1):
            total += own[self.buckets(n, len(gains))]
        sums = np.concatenate(([0], np.cumsum(total)))
        features = sum(np.maximum(self.sizes - n + 1, 0) for n in range(1, longest + 1))
        return features, sums[self.ends] - sums[self.ends - self.sizes]


def blocks(texts: pa.Array, depth: int, limit: int = BLOCK_BYTES, rows: int = 512) -> Iterator[Suffixes]:
    """Suffix arrays of blocks of an Arrow array of texts, in its order."""
    own: list[bytes | None] = []
    size = 0
    for lo in range(0, len(texts), rows):
        for text in texts.slice(lo, rows).cast(pa.binary()).to_pylist():
            if own and size + len(text or b"") > limit:
                yield Suffixes(own, depth)
                own, size = [], 0
            own.append(text)
            size += len(text or b"")
    if own:
        yield Suffixes(own, depth)


@dataclass(frozen=True)
class Model:
    """Gains of the buckets, and how features are made."""

    gains: np.ndarray
    longest: int


def bucket_counts(texts: DataFrame, text: str, longest: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in blocks(batch.column(0), longest):
                total += block.counts(longest, buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    counted = texts.select(F.col(text).alias("text")).mapInArrow(lambda b: handing_back(b, count), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in materialize(counted.groupBy("bucket").agg(F.sum("n").alias("n")), "counts").collect():
        out[row.bucket] = row.n
    return out


def fit(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", longest: int = 2, buckets: int = 10_000) -> Model:
    """Gains in thousandths: floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets))))."""
    if longest < 1 or buckets < 1:
        raise ValueError("longest and buckets must be at least 1")
    s, t = bucket_counts(docs, text, longest, buckets), bucket_counts(target, target_text, longest, buckets)
    all_s, all_t = float(s.sum()) + buckets, float(t.sum()) + buckets
    gains = [math.floor(1000 * math.log((float(b) + 1) * all_s / ((float(a) + 1) * all_t))) for a, b in zip(s.tolist(), t.tolist(), strict=True)]
    return Model(np.array(gains, np.int64), longest)


def weighted(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of every row."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for block in blocks(batch.column(1), model.longest):
                features, weights = block.weights(model.longest, model.gains)
                ids = batch.column(0).slice(at, len(weights))
                at += len(weights)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (block.sizes, features, weights))], schema.names)

    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(lambda b: handing_back(b, score), schema)


def gumbel(id_col: Column, seed: int) -> Column:
    """Noise in thousandths, told by the id: floor(-1000 * ln(-ln((h + 0.5) / 2^32))), h 32 bits of a hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, seed: int = 2024, longest: int = 2, buckets: int = 10_000, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_features, weight, score and rank (null unless drawn).

    ``percent`` of the documents of at least ``min_words`` words are drawn (rounded down), the highest scores first, ties
    to the smaller id.
    """
    if not 0 <= percent <= 100:
        raise ValueError("percent must be from 0 to 100")
    model = fit(docs, target, text, longest=longest, buckets=buckets)
    scored = materialize(weighted(docs, model, id_col, text).withColumnRenamed(id_col, "id"), "weights")
    scored = scored.withColumns({"score": F.col("weight") + gumbel(F.col("id"), seed), "row": F.monotonically_increasing_id()})
    scored = materialize(scored, "scores")
    eligible = scored.filter(F.col("n_words") >= min_words)
    n = eligible.count() * percent // 100
    ranked = in_order(eligible, [F.desc("score"), F.asc("id"), F.asc("row")], "place")
    drawn = ranked.withColumn("rank", F.when(F.col("place") < n, F.col("place") + 1))
    out = drawn.drop("place").unionByName(scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents of 20 words and more, drawn towards the benchmark texts by single words."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), longest=1)


#: CRC-32 of the text ``w`` in DuckDB, given the list ``t`` of the table ``crc``.
CRC_TABLE_SQL = """
crc AS (SELECT list(v ORDER BY b) AS t FROM (
  SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
  FROM (SELECT unnest(range(256)) AS b)))"""
CRC_SQL = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, 1 + octet_length(encode({w}))), lambda i: CAST('0x' || substr(hex(encode({w})), 2 * i - 1, 2) AS BIGINT))), lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)])), 4294967295)"""

OP11_SQL = rf"""
WITH {CRC_TABLE_SQL},
said AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), wanted AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), own AS (SELECT r, unnest(words) AS w FROM said),
per_word AS (SELECT w, count(*) AS n, 0 AS m FROM own GROUP BY w UNION ALL SELECT w, 0, count(*) FROM wanted GROUP BY w),
words AS (SELECT w, sum(n) AS n, sum(m) AS m FROM per_word GROUP BY w),
coded AS (SELECT w, n, m, {CRC_SQL.format(w="w")} % 10000 AS bucket FROM words, crc),
buckets AS (SELECT bucket, CAST(sum(n) AS DOUBLE) AS s, CAST(sum(m) AS DOUBLE) AS t FROM coded GROUP BY bucket),
totals AS (SELECT sum(s) AS s, sum(t) AS t FROM buckets),
gains AS (SELECT b.bucket, CAST(floor(1000 * ln((b.t + 1) * (a.s + 10000) / ((b.s + 1) * (a.t + 10000)))) AS BIGINT) AS gain FROM buckets b, totals a),
weights AS (SELECT r, sum(gain) AS weight FROM own JOIN coded USING (w) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, len(words) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM said LEFT JOIN weights USING (r)
), placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) FILTER (WHERE n_features >= 20) OVER () * 10 // 100 AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= n THEN place END AS rank FROM placed"""
