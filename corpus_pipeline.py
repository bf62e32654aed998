"""From raw documents to packed training sequences, as five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``:

1. ``toxicity``: documents rated toxic (score 0.7 or more) go.
2. ``language``: documents whose language cannot be told go: no letters, or a narrow margin.
3. ``near_dedup``: of each group of near duplicates (five-word shingles, similarity 0.8) the document of the smallest
   id stays.
4. ``substring_dedup``: passages of 50 words that an earlier document has are cut; a document of which no word is left
   goes.
5. ``packing``: what is left is encoded and packed into sequences of 2048 ids; the result has one row for each piece of a
   document, with its ids, its sequence and its place there.

Tables that a stage writes for itself are removed when the next one begins: its result has been written by then.

Null texts are not toxic; they and texts without letters go in stage 2, so stages 3 to 5 see texts. Empty tables pass
through as empty tables. Extra columns of ``documents`` pass through the first four stages.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktrail.llm import langid, near, packing, substring, toxicity
from sparktrail.llm.common import fold, free_name, materialize, remove, shared_path, small, table, tables_since

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables of the stage before.
_left: list[str] = []


def _tidy(stage: Stage) -> Stage:
    """The stage; it begins by removing what the one before has written for itself."""

    @wraps(stage)
    def tidied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            remove(spark, _left.pop())
        before = tables_since()
        out = stage(spark, docs, sf_dir)
        _left.extend(tables_since(before))
        return out

    return tidied


def _having(docs: DataFrame, said: Column, condition: str) -> DataFrame:
    """The rows of ``docs`` of whose struct ``said`` the condition (on ``said``) holds, with the columns of ``docs``.

    They are written here, so that texts go to Python in small batches whatever the session is set to.
    """
    name = free_name(docs, "said")
    kept = docs.withColumn(name, said).filter(condition.replace("said", name)).select(*(F.col(f"`{c}`") for c in docs.columns))
    return materialize(kept, "kept")


@_tidy
def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(toxicity.learnable(docs), table(spark, sf_dir, "labels"))
    return _having(docs, toxicity.scorer(model)(F.col("text")), "said.predicted = 0")


@_tidy
def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.filter(fold("doc_id", 4) != 2))
    return _having(docs, langid.predictor(model)(F.col("text")), "said.accepted")


@_tidy
def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = free_name(docs, "gone")
    dropped = materialize(near.near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct(), "dropped")
    return docs.join(small(dropped), F.col("doc_id") == F.col(gone), "left_anti")


@_tidy
def _substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = materialize(substring.without_repeats(docs), "left")  # in small batches, too
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).filter(F.length("text") > 0)


@_tidy
def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(packing.tokenized(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True))


STAGES: list[tuple[str, Stage]] = [("toxicity", _toxicity), ("language", _language), ("near_dedup", _near_dedup), ("substring_dedup", _substring_dedup), ("packing", _packing)]

#: Compression, sketches and tokenization have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
