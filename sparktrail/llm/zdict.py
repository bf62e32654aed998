"""Compressed lengths under raw-content zstandard dictionaries, for the two compression classifiers."""

from __future__ import annotations

import re
import zlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_OTHER = re.compile(r"[\W\d_]+")


class Gauge:
    """Compressed lengths of byte strings under one dictionary; ``options`` are zstandard compression parameters."""

    def __init__(self, content: bytes, level: int, window: int, **options: int):
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(content), source_size=window, write_content_size=False, write_checksum=False, write_dict_id=False, **options)
        data.precompute_compress(compression_params=how)
        self._compress = zstandard.ZstdCompressor(dict_data=data, compression_params=how).compress

    def lengths(self, windows: list[bytes]) -> np.ndarray:
        compress = self._compress
        return np.fromiter((len(compress(w)) for w in windows), np.int64, len(windows))


def plain(text: str) -> str:
    """Lower case, every run of other characters than letters one space: punctuation and digits say little of either."""
    return f" {_OTHER.sub(' ', text.lower()).strip()} "


def windows(text: str, size: int) -> list[bytes]:
    """The whole text in windows of about ``size`` bytes that end at white space where there is any near the end."""
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) <= size:
        return [raw]
    found, at = [], 0
    while len(raw) - at > size:
        cut = raw.rfind(b" ", at + size // 2, at + size)
        cut = at + size if cut < 0 else cut
        found.append(raw[at:cut])
        at = cut
    found.append(raw[at:])
    return found


def labelled_sample(docs: DataFrame, keys: DataFrame, per_label: int, max_labels: int, max_chars: int) -> list:
    """At most ``per_label`` rows of each label as (id, label, text of up to ``max_chars`` characters), those of the
    ``max_labels`` most frequent labels: what the driver gets is bounded by the three parameters.

    ``docs`` has (id, text), ``keys`` (id, label). Ids are chosen by a hash, the same ones in every run, in
    two scans of narrow columns, one for the number of rows of each label and one for the ids; texts are then picked out by
    the chosen ids. Longer texts give a slice that begins at a place chosen by the hash. An id that occurs with several texts gives
    one of them.
    """
    frequent = keys.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "label").limit(max_labels)
    # a share of the ids in which about twice as many as are wanted lie, then exactly as many
    share = F.least(F.lit(1.0), (2.0 * per_label + 64) / F.col("n")) * (1 << 30)
    some = keys.join(F.broadcast(frequent), "label").filter(F.pmod(F.xxhash64("id", F.lit("share")), F.lit(1 << 30)) < share)
    order = Window.partitionBy("label").orderBy(F.pmod(F.xxhash64("id", F.lit("share")), F.lit(1 << 30)), "id")
    chosen = some.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= per_label)
    start = F.pmod(F.xxhash64("id", F.lit("slice")), F.greatest(F.length("text") - max_chars, F.lit(0)) + 1) + 1
    # at most per_label * max_labels ids
    picked = docs.join(F.broadcast(chosen.select("id", "label", "n")), "id").withColumn("text", F.substring("text", start.cast("int"), F.lit(max_chars)))
    rows = picked.groupBy("id", "label", "n").agg(F.min("text").alias("text")).collect()
    return sorted(rows, key=lambda r: (-r["n"], str(r["label"]), zlib.crc32(str(r["id"]).encode()), str(r["id"])))
