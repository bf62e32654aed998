"""Operator 3: language identification by compression.

``fit`` learns one raw-content zstandard dictionary for each language from a bounded sample of labelled rows: short
snippets of many documents, so that no passage that documents share fills a dictionary. ``identify`` compresses every
whole text, window by window, under each dictionary and takes the language whose compressed length is smallest. Matches
count from three bytes on and are searched for optimally, so the same compressor tells a few words and whole books apart.
``score`` turns the differences of the lengths into a share of 0 to 1; ``accepted`` is false where the margin between the
two smallest lengths is narrower than ``min_margin`` of the smallest, and for texts without a letter. With a single
language there is no second length, and it is accepted.

Null texts, and texts without a letter, get ``und``, score 0 and are not accepted. Very long texts are read window by
window. Equal lengths go to the most frequent language, have no margin and are not accepted. Repeated rows are told each;
when learned from, an id counts once. Rows whose language is null are not learned from, and of more than ``max_languages``
languages only the most frequent ones are. With no labelled row at all, every text is ``und``; an empty table gives an
empty result. Other columns pass through; columns named like the outputs are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktrail.llm.common import fold, free_name, per_text, table
from sparktrail.llm.zdict import Gauge, labelled_sample, plain, windows

UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_OUT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("accepted", T.BooleanType())])


@dataclass(frozen=True)
class LanguageModel:
    """A dictionary for each language; ``level`` and ``window`` as used when compressing."""

    dictionaries: dict[str, bytes]
    level: int = 6
    window: int = 4096
    min_margin: float = 0.002
    bits_scale: float = 0.25


def fit(rows: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_language: int = 800, dictionary_bytes: int = 49_152, max_languages: int = 200) -> LanguageModel:
    """Learn from at most ``docs_per_language`` rows of each language, hash-chosen, a slice of each."""
    rows = rows.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0))
    docs, keys = rows.select(F.col(id_col).alias("id"), F.col(text).alias("text")), rows.select(F.col(id_col).alias("id"), F.col(lang).alias("label"))
    texts: dict[str, bytearray] = {}
    for row in labelled_sample(docs, keys, docs_per_language, max_languages, dictionary_bytes // docs_per_language):
        texts.setdefault(row["label"], bytearray()).extend(plain(row["text"]).encode("utf-8", "surrogatepass"))
    return LanguageModel({k: bytes(v[:dictionary_bytes]) for k, v in texts.items()})


#: Compression parameters of all dictionaries: matches of three bytes at least, chosen optimally.
_SEARCH = {"min_match": 3, "window_log": 17, "hash_log": 16, "chain_log": 17, "search_log": 4, "strategy": zstandard.STRATEGY_BTOPT}


class Classifier:
    """The model in a Python worker."""

    def __init__(self, model: LanguageModel):
        self.model, self.names = model, list(model.dictionaries)
        self.gauges = [Gauge(d, model.level, model.window, **_SEARCH) for d in model.dictionaries.values()]

    def __call__(self, text: str | None) -> tuple[str, float, float, bool]:
        if not text or not self.names or not _LETTER.search(text):
            return UNKNOWN, 0.0, 0.0, False
        cut = windows(plain(text), self.model.window)
        total = np.array([int(g.lengths(cut).sum()) for g in self.gauges], np.float64)
        best = int(total.argmin())
        weights = np.exp(np.maximum(-(total - total[best]) * 8 * np.log(2) * self.model.bits_scale, -700))
        if len(total) == 1:
            return self.names[0], 1.0, 1.0, True
        margin = float((np.delete(total, best).min() - total[best]) / total[best])
        return self.names[best], float(1 / weights.sum()), margin, margin >= self.model.min_margin


def predictor(model: LanguageModel):
    """A function of a text column: a struct of lang_pred, score, margin and accepted."""
    return per_text(_OUT, lambda: Classifier(model))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score, margin and accepted added."""
    told = free_name(docs, "told")
    kept = [c for c in docs.columns if c not in _OUT.names]
    return docs.withColumn(told, predictor(model)(F.col(text))).select(*kept, f"{told}.*")


def op3_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(fold("doc_id", 4) != 2))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "margin", "accepted")
