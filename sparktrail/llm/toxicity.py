"""Operator 10: toxicity by compression distance.

``fit`` trains pairs of zstandard dictionaries, one on toxic and one on ordinary text, on a bounded sample of labelled
rows. The sample is split by place: one part of the ordinary documents gives the ground, short snippets of many of them;
then zstandard's trainer makes a dictionary of the toxic documents, and in the same way one of the ordinary documents
that are not in the ground, each out of what the ground does not compress (words of which it saves no byte), since all
else is at the same distance from both. Each of the two is put behind the same ground. A second pair has ground and
ordinary documents exchanged, so that what the ground happens to hold matters less; for the same reason a word counts
as not compressed where most of several grounds save nothing of it. ``rate`` compresses each window of
every whole text under all dictionaries: a window's gain is the bytes that the toxic dictionary saves against the
ordinary one, as the mean over the pairs. A marker that all dictionaries hold ends every window; without it zstandard
would store a short window raw whenever only one of its words is found. The gains of a text (the largest ones, their sum
and mean, shares and numbers of windows over some bars) give its score through a logistic curve calibrated on labelled
documents that no dictionary has seen, both labels counting the same; ``predicted`` is 1 from ``threshold`` on.

Null and empty texts have no gain and get the score of a text without any. Very long texts are read window by window.
Rows without a label, or without text, are not learned from; with no labelled row, too few to train on or rows of one
label only, every score is 0. An id that is labelled twice, or occurs with several texts, is learned from once for each
label. Repeated rows are rated each; an empty table gives an empty result. Other columns pass through; columns named like
the outputs are replaced.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktrail.llm.common import fold, free_name, per_text, table
from sparktrail.llm.zdict import Gauge, labelled_sample, plain, windows

_OUT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


@dataclass(frozen=True)
class ToxicityModel:
    """Pairs of (ordinary, toxic) dictionaries and the calibrated curve: means and scales of the features, weights."""

    pairs: tuple[tuple[bytes, bytes], ...] = ()
    means: tuple[float, ...] = ()
    scales: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    level: int = 6
    window: int = 128
    threshold: float = 0.7


#: Compression parameters of all dictionaries: matches of five bytes at least, found through chains.
_SEARCH = {"window_log": 19, "hash_log": 17, "chain_log": 18, "search_log": 5, "min_match": 5, "strategy": zstandard.STRATEGY_LAZY2}
#: Grounds of which most must not know a word; a single one may hold a stray toxic word.
GROUNDS = 3
_MARKER = b"|<0123456789#ABCDEFGHIJKLMNOPQRSTUVWXYZ>"


def _features(gain: np.ndarray) -> np.ndarray:
    """What the gains of a text's windows say of it."""
    best = np.zeros(4)
    top = np.sort(gain)[::-1][:4]
    best[: len(top)] = top
    over = [gain >= bar for bar in (3, 4, 5, 6)]
    sums = [np.log1p(np.maximum(gain, 0).sum()), np.maximum(gain, 0).mean(), np.minimum(gain, 0).mean(), np.log(len(gain))]
    return np.array([1.0, best[0], best[1], best[2] + best[3], *sums, *(np.log1p(o.sum()) for o in over), *(o.mean() for o in over[:3])])


class Scorer:
    """The model in a Python worker."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.gauges = [tuple(Gauge(d, model.level, model.window, **_SEARCH) for d in pair) for pair in model.pairs]

    def features(self, text: str | None) -> np.ndarray:
        cut = [w + _MARKER for w in windows(plain(text or ""), self.model.window)]
        return _features(sum(ordinary.lengths(cut) - toxic.lengths(cut) for ordinary, toxic in self.gauges) / len(self.gauges))

    def __call__(self, text: str | None) -> tuple[float, int]:
        if not self.gauges:
            return 0.0, 0
        z = float(((self.features(text) - self.model.means) / self.model.scales) @ np.array(self.model.weights))
        score = float(1 / (1 + np.exp(-np.clip(z, -60, 60))))
        return score, int(score >= self.model.threshold)


def _ground(texts: list[str], size: int, turn: int = 0) -> bytes:
    """Short snippets of all texts, of ``size`` bytes in all at most; other ones each ``turn``."""
    n = max(40, size // len(texts))
    snippets = (t[(at := (i * 7919 + 511 + turn * 104_729) % max(1, len(t) - n)) : at + n] for i, t in enumerate(texts))
    return "".join(snippets).encode("utf-8", "surrogatepass")[:size]


def _unknown(model: ToxicityModel, grounds: list[bytes]) -> Callable[[str], bytes]:
    """A function that leaves of a text the words of which most ``grounds`` save no byte; words too short to match go.

    To say where the marker is costs a byte more or less by ground, as a probe that none of them can know tells.
    """
    nothing, *gauges = (Gauge(g + _MARKER, model.level, model.window, **_SEARCH) for g in [b"", *grounds])
    probe = b" 0#1#2#3#4 " + _MARKER
    more = [g.lengths([probe])[0] - nothing.lengths([probe])[0] for g in gauges]
    known: dict[str, bool] = {}

    def new(word: str) -> bool:
        if word not in known:
            raw = f" {word} ".encode("utf-8", "surrogatepass")
            whole = nothing.lengths([raw + _MARKER])[0]
            saved = sum(bool(g.lengths([raw + _MARKER])[0] < whole + m) for g, m in zip(gauges, more, strict=True))
            known[word] = len(raw) <= _SEARCH["min_match"] or 2 * saved > len(gauges)
        return not known[word]

    return lambda text: f" {' '.join(w for w in text.split() if new(w))} ".encode("utf-8", "surrogatepass")


def _trained(texts: list[str], left: Callable[[str], bytes], size: int) -> bytes:
    """The end, where its best parts are, of the dictionary that zstandard trains on what is left of the texts."""
    samples = [raw[at : at + 64] for raw in map(left, texts) for at in range(0, len(raw), 64)]
    try:
        return zstandard.train_dictionary(size + 256, [s for s in samples if len(s) >= 8], k=32, d=6).as_bytes()[-size:]
    except zstandard.ZstdError:  # too little is left to choose from
        return b"".join(samples)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", docs_per_label: int = 3000, max_chars: int = 20_000, ground_bytes: int = 98_304, own_bytes: int = 1536) -> ToxicityModel:
    """Learn from at most ``docs_per_label`` documents of each label, hash-chosen, up to ``max_chars`` characters of each."""
    said = labels.filter(F.col(label).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).distinct()
    known = docs.filter(F.col(id_col).isNotNull() & (F.length(text) > 0)).select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    sample = labelled_sample(known, known.select("id").distinct().join(said, "id"), docs_per_label, 2, max_chars)
    return learn(*([plain(r["text"]) for r in sample if r["label"] == k] for k in (1, 0)), ground_bytes, own_bytes)


def learn(toxic: list[str], ordinary: list[str], ground_bytes: int, own_bytes: int) -> ToxicityModel:
    """The model of some toxic and some ordinary texts, in plain form."""
    if len(toxic) < 3 or len(ordinary) < 3:
        return ToxicityModel()
    shown = [t for i, t in enumerate(toxic) if i % 3 < 2]
    pairs = []
    for base, other in itertools.permutations((ordinary[0::3], ordinary[1::3])):
        ground, *others = (_ground(base, ground_bytes, turn) for turn in range(GROUNDS))
        left = _unknown(ToxicityModel(), [ground, *others])
        own = [_trained(texts, left, own_bytes) for texts in (other, shown)]
        size = max(map(len, own))
        pairs.append(tuple(ground + part.rjust(size, b"\0") + _MARKER for part in own))
    scorer = Scorer(ToxicityModel(tuple(pairs)))
    unseen = [(t, 1.0) for t in toxic[2::3]] + [(t, 0.0) for t in ordinary[2::3]]
    x, y = np.array([scorer.features(t) for t, _ in unseen]), np.array([v for _, v in unseen])
    means, scales = x.mean(0), x.std(0) + 1e-9
    means[0], scales[0] = 0.0, 1.0
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    return ToxicityModel(tuple(pairs), tuple(means.tolist()), tuple(scales.tolist()), tuple(_logistic((x - means) / scales, y, weight).tolist()))


def scorer(model: ToxicityModel) -> Callable:
    """A function of a text column: a struct of score and predicted."""
    return per_text(_OUT, lambda: Scorer(model))


def rate(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` with score and predicted added."""
    told = free_name(docs, "told")
    kept = [c for c in docs.columns if c not in _OUT.names]
    return docs.withColumn(told, scorer(model)(F.col(text))).select(*kept, f"{told}.*")


def learnable(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that may be learned from: all but the fold that is held out."""
    return docs.filter(fold(id_col, 3) != 1)


def op10_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(learnable(docs), table(spark, sf_dir, "labels"))
    return rate(docs.select("doc_id", "text"), model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
