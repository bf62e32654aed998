"""Operator 7: byte-level BPE encoding and decoding with a local rank file.

``encode`` gives every row's token ids, ``decode`` the bytes that ids stand for.

Long texts are cut before a white-space character that follows another kind of character. No alternative of the
splitting pattern matches across such a place (white space only ever leads a match) and the only look-ahead of the
pattern inspects the end of a run of white space, which never ends a part; so the matches of the parts are the
matches of the whole text, and memory stays near one part's size. A text without such a place is encoded whole.
The regular expressions of the library give up on about a million white-space characters in a row. The pattern takes such
a run, or all of it but its last character where something follows, as one match, so runs of ``LONG_RUN`` characters are
found by a linear scan and encoded as one piece, without the pattern; that is the result the library would give.

A ``tokenizer.json`` is read as the tokenizers library reads it, its added tokens included: their strings in a text are
those tokens, and the texts between them are encoded on their own. Only byte-level files with the usual splitting pattern
are taken, others are refused. A rank file has no added tokens.

Null texts count as empty: no ids, empty bytes. Repeated rows are encoded once each; an empty table gives an empty
result. Other columns pass through; a column named like the output is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktrail.llm.common import per_text, table

#: Characters of a part of a long text, at least.
PART_CHARS = 100_000
#: White-space characters from which on a run of them is taken out before the pattern sees it.
LONG_RUN = 10_000
# White space as the splitting pattern knows it (Unicode's property, which is not Python's).
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(rf"(?<=[^{_SPACE}])[{_SPACE}]")
_RUN = re.compile(rf"(?<![{_SPACE}])[{_SPACE}]{{{LONG_RUN},}}")


def _byte_of_char() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _spec(path: str) -> dict:
    """A byte-level ``tokenizer.json``; refused where it says more than vocabulary, merges and plain added tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    odd = spec.get("normalizer") or spec.get("post_processor") or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or odd or any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", ())):
        raise ValueError(f"{path}: not a plain byte-level vocabulary")
    return spec


def ranks_of_json(path: str) -> dict[bytes, int]:
    """Ranks of a byte-level ``tokenizer.json`` whose merges are listed in the order of their ids."""
    spec = _spec(path)
    model, chars = spec["model"], _byte_of_char()
    special = {t["content"] for t in spec.get("added_tokens", ())}
    ranks = {bytes(chars[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
    made = [ranks["".join(m.split(" ") if isinstance(m, str) else m).translate(_Chars(chars)).encode("latin-1")] for m in model["merges"]]
    if made != sorted(made):
        raise ValueError(f"{path}: merges are not in the order of ids")
    return ranks


class _Chars(dict):
    def __init__(self, chars: dict[str, int]):
        super().__init__({ord(c): chr(b) for c, b in chars.items()})


def ranks_of_file(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """The encoding of a local rank file (or byte-level tokenizer.json); one for each Python worker."""
    ranks = ranks_of_json(path) if path.endswith(".json") else ranks_of_file(path)
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _cut(text: str, size: int) -> Iterator[str]:
    at = 0
    while len(text) - at > size:
        found = _CUT.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def parts(text: str, size: int = PART_CHARS) -> Iterator[str | bytes]:
    """Cut a text at safe boundaries into parts of ``size`` characters or, up to the next boundary, more; a long run of
    white space is a part in bytes, one match of the pattern."""
    at = 0
    for run in _RUN.finditer(text) if len(text) >= LONG_RUN else ():
        if run.start() > at:
            yield from _cut(text[at : run.start()], size)
        at = run.end() if run.end() == len(text) else run.end() - 1
        yield text[run.start() : at].encode()
    if at < len(text):
        yield from _cut(text[at:] if at else text, size)


def part_ids(enc: tiktoken.Encoding, part: str | bytes) -> np.ndarray:
    """The ids of one part."""
    if isinstance(part, bytes):
        return np.array(enc._encode_single_piece(part), np.uint32)
    return enc.encode_to_numpy(part, disallowed_special=())


def token_ids(enc: tiktoken.Encoding, text: str | None) -> np.ndarray:
    """The ids of a whole text as unsigned 32-bit integers."""
    if not text:
        return np.empty(0, np.uint32)
    found = [part_ids(enc, p) for p in parts(text)]
    return found[0] if len(found) == 1 else np.concatenate(found)


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str | None], np.ndarray]:
    """A function that gives the ids of a whole text; one for each Python worker."""
    enc = encoding(path)
    added = {t["content"]: t["id"] for t in _spec(path).get("added_tokens", ())} if path.endswith(".json") else {}
    if not added:
        return lambda text: token_ids(enc, text)
    cut = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))))

    def ids(text: str | None) -> np.ndarray:
        if not text or not cut.search(text):
            return token_ids(enc, text)
        found, at = [], 0
        for m in cut.finditer(text):
            found += [token_ids(enc, text[at : m.start()]), np.array([added[m.group()]], np.uint32)]
            at = m.end()
        return np.concatenate([*found, token_ids(enc, text[at:])])

    return ids


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the array of token ids of ``text`` (empty for null)."""

    @F.pandas_udf(T.ArrayType(T.IntegerType(), False))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = encoder(path)
        for batch in batches:
            yield pd.Series([of(t).astype(np.int32) for t in batch], dtype=object)

    return docs.withColumn(out, ids(F.col(text)))


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the raw bytes that the array ``ids`` stands for (null for null)."""

    @F.pandas_udf(T.BinaryType())
    def joined(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path)
        for batch in batches:
            yield pd.Series([None if x is None else enc.decode_bytes(list(x)) for x in batch], dtype=object)

    return rows.withColumn(out, joined(F.col(ids)))


_DIGEST = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def digest(enc: tiktoken.Encoding, text: str | None) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the ids in decimal joined by commas, SHA-256 of the bytes decoded from the ids.

    Part after part, so a very long text never has all its ids as Python objects at once.
    """
    n, of_ids, of_bytes, first = 0, hashlib.sha256(), hashlib.sha256(), True
    for part in parts(text or ""):
        found = part_ids(enc, part).tolist()
        if found:
            of_ids.update(("" if first else ",").encode() + ",".join(map(str, found)).encode())
            of_bytes.update(enc.decode_bytes(found))
            first, n = False, n + len(found)
    return n, of_ids.hexdigest(), of_bytes.hexdigest()


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, then decoded, then digested."""

    digests = per_text(_DIGEST, lambda: partial(digest, encoding(path)))
    return docs.select(F.col(id_col), digests(F.col(text)).alias("d")).select(id_col, "d.*")


def op7_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by the multilingual rank file; the decoded digest equals that of the text's UTF-8 bytes."""
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
