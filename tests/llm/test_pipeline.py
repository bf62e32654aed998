"""The pipeline stage by stage on the smallest tables, and on odd ones."""

import json

import public_tokenizers
import pytest

import corpus_pipeline
from sparktrail.llm import bytepair
from sparktrail.llm.catalog import ORACLES, QUERIES


def _through(spark, docs, sf_dir, tmp_path):
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before, columns = docs, docs.columns
        path = str(tmp_path / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    return out


def test_stages(spark, sf_dir, tmp_path):
    out = _through(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir, tmp_path)
    for name in ("toxicity", "language", "near_dedup"):
        before, after = ({tuple(r) for r in df.collect()} for df in out[name])
        assert after <= before and len(after) > 0.7 * len(before)
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in out["substring_dedup"])
    assert after.keys() <= before.keys() and all(len(t) <= len(before[i]) for i, t in after.items())
    words = set()
    for text in after.values():
        w = text.split()
        for p in range(len(w) - 49):
            key = tuple(w[p : p + 50])
            assert text.split().count(w[p]) > 1 or key not in words
            words.add(key)
    packed = out["packing"][1].collect()
    assert {r.doc_id for r in packed} == set(after)
    encode, ids = bytepair.encoder(public_tokenizers.path("byte_bpe_50k.json")), {}
    for r in sorted(packed, key=lambda r: (r.doc_id, r.piece)):
        ids.setdefault(r.doc_id, []).extend(r.ids)
    assert all(ids[i] == [*encode(text).tolist(), 0] for i, text in after.items())


def test_odd_documents(spark, sf_dir, tmp_path):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, "x " * 50000, "en", "s", 1), (4, "the same words again and again in a text " * 3, "en", "s", 1), (5, "the same words again and again in a text " * 3, "en", "s", 1), (5, "the same words again and again in a text " * 3, "en", "s", 1)]
    extra = "predicted score said gone _id _cleaned _toxicity _language _text_key _spans _key row piece length ids told id label".split()
    docs = spark.createDataFrame([(*r, *extra) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{e} string" for e in extra))
    out = _through(spark, docs, sf_dir, tmp_path)
    kept = out["near_dedup"][1].collect()
    assert {r.doc_id for r in kept} == {3, 4} and {tuple(r)[5:] for r in kept} == {tuple(extra)}


def test_empty_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    assert _through(spark, docs, sf_dir, tmp_path)["packing"][1].count() == 0


def test_registry(sf_dir):
    import __spark_entry__ as entry

    names = entry.queries()
    assert sorted(n.split("_")[0] for n in QUERIES) == sorted(f"op{i}" for i in range(1, 14)) and set(QUERIES) <= set(names) and "pipeline" in names
    assert set(ORACLES) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    rows = sorted(json.dumps(r) for r in result.fetchall())
    assert rows == sorted(json.dumps([r[c] for c in columns]) for r in QUERIES[name](spark, sf_dir).collect())
