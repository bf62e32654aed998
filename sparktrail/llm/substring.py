"""Operator 9: removal of passages that an earlier document has, by level-wise doubling.

A window is ``window`` consecutive words of one document. A word goes if a window over it also starts in a document
with a smaller id. Windows are found level by level; the lengths of the levels double up to the window's (13, 25 and 50
words for 50), and only what several documents have at one length is extended to the next:

1. The first level looks at runs of the shortest length. Of those that lie in a window the one with the smallest hash
   stands for it, its anchor. The choice depends on the words alone, so equal windows choose equal anchors, and only
   some 5 % of all positions are compared at all. Kept: anchors that two documents have.
2. Each further level extends an anchor to its length within the windows that chose it: to the right, or to the left for
   windows that end too early for that. Kept: extensions that two documents have. This goes on until nothing is left (then
   no word goes) or the next length is the window's.
3. At the window's length, first one window of each extension is compared, the last that chose it. Inside a repeated
   passage documents agree on it, and the next one is less than a window away, so those that repeat cover the inside.
   Then all windows of those extensions around which words are left that the first ones did not decide: the two ends of
   a passage, and passages of little more than a window. They are compared in every document that has them.

No window of twice the length is looked at: it would remove no word that windows of this length do not. Anchors and
extensions are compared by 64-bit hashes, which only choose candidates, full windows by 128 bits. All comparisons are
aggregations to the smallest id for a hash and joins with one row for each hash, so a passage that a third of all
documents share costs no more than its length, and no pairs are formed; the aggregates are written, so both sides
of such a join are plain shuffles and Spark splits a hot hash.

Words are runs of other bytes than ASCII white space, unchanged. Null, empty and blank texts have no words. An empty
table gives an empty result. Very long texts are hashed and cleaned whole, one at a time. Of rows with one id each is
cleaned by its own text, and they never remove words from each other. Rows with a null id remove nothing and are left as
they are. Other columns pass through ``without_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sparktrail.llm.common import BATCH_ROWS, free_name, handing_back, materialize, small, table
from sparktrail.llm.words import Words, blocks


def lengths(window: int) -> list[int]:
    """The lengths of the levels: the window's, its half (rounded up), and on while a half has over 16 words."""
    out = [window]
    while len(out) == 1 or out[0] > 16:
        out.insert(0, -(-out[0] // 2))
    return out


def _lowest(runs: np.ndarray, width: int) -> np.ndarray:
    """For each window the position of the smallest (the first of equal ones) of its ``width`` runs."""
    view = np.lib.stride_tricks.sliding_window_view(runs, width)
    return view.argmin(axis=1) + np.arange(len(view))


def _anchored(words: Words, window: int) -> tuple | None:
    """(hashes of words, valid windows, anchor of each) of a block of texts."""
    if len(words.start) < window:
        return None
    first, hashes = lengths(window)[0], words.hashes()
    return hashes, words.whole(window), _lowest(words.runs(hashes, first), window - first + 1)


def _full(words: Words, hashes: np.ndarray, window: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes of the windows that begin at ``place``."""
    return words.runs(hashes, window)[place].view(np.int64), words.runs(words.hashes(1), window, 1)[place].view(np.int64)


def _selected(docs: DataFrame, window: int) -> DataFrame:
    """(id, key, pos, at, n, left, h0, h1, .., g1, g2): anchors and their extensions by level; n words has the text;
    ``left`` tells extensions to the left; g1 and g2 hash the last window that chose the extension, which begins ``at``."""
    short = lengths(window)[:-1]

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, words in blocks(batch.column(2), lower=False):
                found = _anchored(words, window)
                if found is None:
                    continue
                hashes, valid, anchor = found
                begin = np.flatnonzero(valid)
                # a window whose anchor leaves no room for the half to its right extends it to the left
                left = anchor[begin] - begin + short[-1] > window
                chosen, last = np.unique((anchor[begin] * 2 + left)[::-1], return_index=True)
                left, chosen, last = chosen % 2 == 1, chosen // 2, begin[::-1][last]
                doc = words.doc[chosen]
                level = []
                for size in short:
                    runs = words.runs(hashes, size)
                    level.append(pa.array(runs[np.where(left, chosen + short[0] - size, chosen)].view(np.int64)))
                g1, g2 = _full(words, hashes, window, last)
                rows = pa.array(doc + at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows),
                        batch.column(1).take(rows),
                        pa.array((chosen - words.first[doc]).astype(np.int32)),
                        pa.array((last - words.first[doc]).astype(np.int32)),
                        pa.array((words.first[doc + 1] - words.first[doc]).astype(np.int32)),
                        pa.array(left),
                        *level,
                        pa.array(g1),
                        pa.array(g2),
                    ],
                    schema.names,
                )

    long = T.LongType()
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), T.StructField("key", long), T.StructField("pos", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("left", T.BooleanType()), *(T.StructField(f"h{i}", long) for i in range(len(short))), T.StructField("g1", long), T.StructField("g2", long)])
    return docs.select("id", "key", "text").mapInArrow(lambda b: handing_back(b, select), schema)


def _undecided(window: int, level: str):
    """(left, hash) of the extensions of a document around which words are left that removable windows do not cover."""
    first, half = lengths(window)[0], lengths(window)[-2]

    def undecided(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [np.empty((0, 2), np.int64)]
            for rows, n in zip(batch["rows"], batch["n"], strict=True):
                pos, at, hashes = (np.array([r[c] for r in rows], np.int64) for c in ("pos", "at", level))
                goes, later, left = (np.array([r[c] for r in rows], bool) for c in ("goes", "later", "left"))
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, at[goes], 1)
                np.add.at(edge, at[goes] + window, -1)
                over = np.concatenate(([0], np.cumsum(np.cumsum(edge)[:-1] == 0)))
                # where the windows that chose an extension begin and end
                begin = np.where(left, pos - (window - first), pos - (window - half))
                end = np.where(left, pos + half - 1, pos + window)
                wanted = later & (over[np.minimum(end, n)] > over[np.maximum(begin, 0)])
                out.append(np.stack((left[wanted].astype(np.int64), hashes[wanted]), 1))
            found = np.unique(np.concatenate(out), axis=0)
            yield pd.DataFrame({"left": found[:, 0] == 1, level: found[:, 1]})

    return undecided


def _windows_at(docs: DataFrame, window: int) -> DataFrame:
    """(g1, g2, id, key, pos): the full windows whose anchor begins in one of the spans in ``at``."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, words in blocks(batch.column(2), lower=False):
                found = _anchored(words, window)
                if found is None:
                    continue
                hashes, valid, anchor = found
                asked = np.zeros(len(words.start) + 1, bool)
                for i, spans in enumerate(batch.column(3).slice(at, words.n_docs).to_pylist()):
                    for span in spans:
                        asked[words.first[i] + span["start"] : words.first[i] + span["stop"]] = True
                place = np.flatnonzero(valid & asked[anchor])
                doc = words.doc[place]
                g1, g2 = _full(words, hashes, window, place)
                rows = pa.array(doc + at)
                yield pa.RecordBatch.from_arrays([pa.array(g1), pa.array(g2), batch.column(0).take(rows), batch.column(1).take(rows), pa.array((place - words.first[doc]).astype(np.int32))], ["g1", "g2", "id", "key", "pos"])

    kind = docs.schema["id"].dataType
    schema = T.StructType([T.StructField("g1", T.LongType()), T.StructField("g2", T.LongType()), T.StructField("id", kind), T.StructField("key", T.LongType()), T.StructField("pos", T.IntegerType())])
    return docs.select("id", "key", "text", "at").mapInArrow(lambda b: handing_back(b, windows), schema)


def _spans(rows: DataFrame, gap: int, width: int) -> DataFrame:
    """(id, key, start, stop) of the positions of each document, those no further than ``gap`` apart in one span that
    ends ``width`` after the last one."""
    order = Window.partitionBy("id", "key").orderBy("pos")
    new = F.coalesce(F.col("pos") - F.lag("pos").over(order) > gap, F.lit(True)).cast("int")
    numbered = rows.withColumn("_new", new).withColumn("_span", F.sum("_new").over(order))
    return numbered.groupBy("id", "key", "_span").agg(F.min("pos").alias("start"), (F.max("pos") + width).alias("stop")).drop("_span")


def _by_document(spans: DataFrame, name: str) -> DataFrame:
    """(id, key, spans): the spans of each document, broadcast to the texts while they take few bytes in all."""
    out = spans.groupBy("id", "key").agg(F.collect_list(F.struct("start", "stop")).alias(name))
    return small(materialize(out, name))


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose ``keys`` two documents have, and in ``later`` whether one of them has a smaller id."""
    first = rows.groupBy(*keys).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").drop("hi")
    # written, so that the join shuffles both sides anew and a hot key can be split
    return rows.join(materialize(first, "first"), keys).withColumn("later", F.col("id") > F.col("lo")).drop("lo")


def repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """(id, key, start, stop): the spans of words (from 0, the last one excluded) that have to go from each document.

    ``key`` is xxhash64 of the text, which tells rows with one id apart.
    """
    if window < 2:
        raise ValueError("window must be at least 2")
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), F.col(text).alias("text")).filter("id is not null and text is not null")
    rows = materialize(_selected(docs, window), "anchors")
    for level in [c for c in rows.columns if c.startswith("h")]:
        before = [c for c in rows.columns if c.startswith("h") and c < level]
        rows = materialize(_repeated(rows.drop("later", *before), ["left", level]), level)
        if rows.isEmpty():
            break

    last = _repeated(rows.select("g1", "g2", "id", "key", "at"), ["g1", "g2"])
    inside = materialize(last.filter("later").select("id", "key", "at").distinct(), "inside")
    marked = rows.drop("g1", "g2").join(inside.withColumn("goes", F.lit(True)), ["id", "key", "at"], "left").withColumn("goes", F.coalesce("goes", F.lit(False)))
    of_doc = marked.groupBy("id", "key").agg(F.collect_list(F.struct("pos", "at", level, "left", "later", "goes")).alias("rows"), F.max("n").alias("n"), F.max("later").alias("any"))
    open_ones = materialize(of_doc.filter("any").select("rows", "n").mapInPandas(_undecided(window, level), f"left boolean, {level} long").distinct(), "open")
    asked = _spans(rows.join(open_ones, ["left", level], "left_semi").select("id", "key", "pos").distinct(), window, 1)
    ends = materialize(_windows_at(docs.join(_by_document(asked, "at"), ["id", "key"]), window), "windows")
    return _spans(inside.withColumnRenamed("at", "pos").unionByName(_repeated(ends, ["g1", "g2"]).filter("later").select("id", "key", "pos")), window, window)


def _kept(raw: bytes, spans) -> tuple[int, list[bytes]]:
    words = raw.split()
    kept = np.ones(len(words), bool)
    for span in spans if spans is not None else ():
        kept[span["start"] : span["stop"]] = False
    return len(words), words if kept.all() else [words[i] for i in np.flatnonzero(kept)]


_OUT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType())])


def _cleaned(with_text: bool):
    kind = to_arrow_type(_OUT)

    def one(text: str | None, spans: list | None) -> tuple:
        raw = (text or "").encode("utf-8", "surrogatepass")
        n, kept = _kept(raw, spans)
        joined = b" ".join(kept)
        # a text that nothing goes from stays as it is
        new = (text if n == len(kept) else joined.decode("utf-8", "surrogatepass")) if with_text else None
        return n, n - len(kept), hashlib.sha256(joined).hexdigest(), new

    def all_of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            rows = []
            for at in range(0, len(texts), BATCH_ROWS):
                rows += map(one, texts.slice(at, BATCH_ROWS).to_pylist(), spans.slice(at, BATCH_ROWS).to_pylist())
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)], fields=list(kind))

    @F.arrow_udf(_OUT)
    def cleaned(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return handing_back(batches, all_of)

    return cleaned


def _with_repeats(docs: DataFrame, id_col: str, text: str, window: int, with_text: bool) -> tuple[DataFrame, str]:
    """``docs`` with a struct of what is left of each text, and the name of that column."""
    of_id, of_key, key, spans, cleaned = (free_name(docs, n) for n in ("of_id", "of_key", "text_key", "spans", "cleaned"))
    found = _by_document(repeats(docs, id_col, text, window), spans).withColumnsRenamed({"id": of_id, "key": of_key})
    keyed = docs.withColumn(key, F.xxhash64(text))
    joined = keyed.join(found, (F.col(id_col) == F.col(of_id)) & (F.col(key) == F.col(of_key)), "left")
    return joined.withColumn(cleaned, _cleaned(with_text)(F.col(text), F.col(spans))), cleaned


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """``docs`` with repeated passages cut from ``text`` (words joined by one space where any was cut)."""
    out, cleaned = _with_repeats(docs, id_col, text, window, True)
    return out.select(*(F.col(cleaned)["kept_text"].alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns))


def op9_level_wise_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-word passages of documents before it."""
    out, cleaned = _with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", 50, False)
    return out.select("doc_id", f"{cleaned}.n_words", f"{cleaned}.n_removed", f"{cleaned}.kept_sha256")
