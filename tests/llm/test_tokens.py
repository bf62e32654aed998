"""Byte-level BPE and packing: against the tokenizers library, by round trip, and for odd inputs."""

import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from sparktrail.llm import bytepair, packing

JSON, MULTI = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "\n\n a", "x" * 3000, "naïve café — 日本語 🙂", "it's we'll", "a b c", "<|endoftext|> is an added token", "a  <|endoftext|> \n<|endoftext|><|endoftext|>b <|endoftext| <|ENDOFTEXT|>", "x" * 99_990 + " <|endoftext|> y" * 9, " ".join("word%d" % i for i in range(60000)), "tab\t\tend ", "\x00\x01"]


def _reference(texts):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_equal_those_of_tokenizers(spark, sf_dir):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    ids = bytepair.encoder(JSON)
    for text, want in zip(texts, _reference(texts), strict=True):
        assert ids(text).tolist() == want


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="not a plain byte-level vocabulary"):
        bytepair.encoding(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("run", [" " * 2_000_000, "\n" * 2_000_000, " \n\t\u3000" * 500_000, " " * 12_000, "\x1c" * 12_000 + "\x85" * 12_000])
@pytest.mark.parametrize("around", [("a", "b"), ("a", ""), ("", "1"), ("", ""), ("!", "\x1c!"), ("x <|endoftext|>", "<|endoftext|> y")])
def test_long_white_space(run, around):
    text = around[0] + run + around[1]
    want = _reference([text])[0]
    assert bytepair.encoder(JSON)(text).tolist() == want
    enc = bytepair.encoding(MULTI)
    n, _, back = bytepair.digest(enc, text)
    assert n == len(bytepair.token_ids(enc, text)) and back == hashlib.sha256(text.encode()).hexdigest()
    if len(run) < 100_000:
        assert bytepair.token_ids(enc, text).tolist() == enc.encode_ordinary(text)


def test_control_characters_are_no_place_to_cut():
    text = "!" * 100_000 + "\x1c" * 100_000 + "!" * 50
    assert bytepair.token_ids(bytepair.encoding(MULTI), text).tolist() == bytepair.encoding(MULTI).encode_ordinary(text)


@pytest.mark.parametrize("size", [1, 7, 50])
def test_parts_are_safe(size):
    enc = bytepair.encoding(MULTI)
    rng = random.Random(size)
    for _ in range(300):
        text = "".join(rng.choice(["a", "Bc", " ", "  ", "\n", "\t", "'s", "12", "é", "!?", " ", "　"]) for _ in range(rng.randint(0, 60)))
        cut = list(bytepair.parts(text, size))
        assert "".join(cut) == text
        assert sum((enc.encode_ordinary(p) for p in cut), []) == enc.encode_ordinary(text)


def test_round_trip_query(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(0, None, "twice")], "doc_id long, text string, ids string")
    rows = bytepair.round_trip(docs, MULTI).collect()
    assert len(rows) == len(ODD) + 1
    enc = bytepair.encoding(MULTI)
    for r in rows:
        text = ODD[r.doc_id] or ""
        ids = enc.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    back = bytepair.decode(bytepair.encode(docs, MULTI), MULTI).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back)
    assert bytepair.round_trip(docs.limit(0), MULTI).count() == 0


def _check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_whole(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionAll(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = packing.packed(packing.tokenized(docs, JSON)).collect()
    n = _check_packed(rows, 2048)
    assert n <= -(-sum(r.length for r in rows) // 2048) + 2
    encode, seen = bytepair.encoder(JSON), {}
    for r in rows:
        seen.setdefault(r.doc_id, []).append(r)
    assert seen.keys() == texts.keys()
    for key, own in seen.items():
        ids = np.append(encode(texts[key]), 0).astype("<u4")
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and [r.start for r in own] == [sum(p.length for p in own[:i]) for i in range(len(own))]
        assert all(r.length == 2048 for r in own[1:]) and sum(r.length for r in own) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)


def test_packing_in_rounds(spark):
    rng = random.Random(3)
    pieces = spark.createDataFrame([(i % 7, rng.choice([1, 5, 30, 49, 50, 64, 99, 100]), "x", "y") for i in range(5000)], "doc_id long, length long, row string, placed string")
    rows = packing.packed(pieces, capacity=100, block=64).collect()
    assert len(rows) == 5000 and _check_packed(rows, 100) <= sum(r.length for r in rows) / 100 * 1.05
    assert {(r.row, r.placed) for r in rows} == {("x", "y")}
    assert packing.packed(pieces.limit(0), capacity=100).count() == 0


@pytest.mark.parametrize("small", [0, 40])
def test_no_block_grows_where_pieces_do_not_combine(spark, monkeypatch, small):
    """Pieces of over half a sequence, without and with a few that could join any of them."""
    seen = spark.sparkContext.accumulator(0)
    place = packing.place

    def counted(lengths, capacity):
        if len(lengths) > 1500:
            seen.add(1)
        return place(lengths, capacity)

    monkeypatch.setattr(packing, "place", counted)
    rng = random.Random(5)
    lengths = [rng.randint(1100, 1999) for _ in range(8000)] + [rng.randint(1, 9) for _ in range(small)]
    rows = packing.packed(spark.createDataFrame([(x,) for x in lengths], "length long"), block=1000).collect()
    assert len(rows) == len(lengths) and _check_packed(rows, 2048) <= 8000 + (small > 0)
    assert seen.value == 0


def test_placement_is_the_sum_of_squares_rule():
    rng = np.random.default_rng(0)
    lengths = np.sort(rng.integers(1, 21, 300))[::-1]
    where, offset, _ = packing.place(lengths, 20)
    count, free = {}, []
    for s, at, o in zip(lengths.tolist(), where.tolist(), offset.tolist(), strict=True):
        fits = sorted(g for g, n in count.items() if n and g >= s)
        score = lambda g: sum(n * n for n in ({**count, g: count[g] - 1} | ({g - s: count.get(g - s, 0) + 1} if g > s else {})).values())  # noqa: B023, E731
        gap = min(fits, key=lambda g: (score(g), g)) if fits else 20
        if not fits:
            free.append(20)
        else:
            count[gap] -= 1
        assert free[at] == gap and o == 20 - gap
        free[at] = gap - s
        if gap > s:
            count[gap - s] = count.get(gap - s, 0) + 1


def test_ids_of_any_kind_pass_through(spark):
    docs = spark.createDataFrame([(None, "a b"), (2**60 + 1, None), (3, "x " * 3000)], "doc_id long, text string")
    rows = packing.packed(packing.tokenized(docs, JSON, with_ids=True)).collect()
    assert {r.doc_id for r in rows} == {None, 2**60 + 1, 3} and all(len(r.ids) == r.length for r in rows)
    named = spark.createDataFrame([("x", "a b")], "doc_id string, text string")
    assert packing.packed(packing.tokenized(named, JSON)).first().doc_id == "x"
