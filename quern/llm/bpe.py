"""Byte-level BPE by the tiktoken library from a local rank file.

Long texts are split at boundaries where no match of the pattern can cross, so the library seldom
sees more than ``span`` characters at once. A part that is longer for want of such boundaries (a long
run of blanks or of one script without blanks) is split into the pattern's matches by ``regex``, and the
library merges each alone: its own splitter fails on runs of a million blanks. The ids are the same
either way. Decoding joins the raw bytes of the ids, so every text comes back byte for byte.

A cut is safe right before a blank that follows a letter or digit and precedes a letter or digit:
a match that reaches the blank from the left has ended there, and the next match starts with it.

Defined results: null text: as the empty one, no ids; a text without a safe boundary is encoded match
by match; special strings are ordinary text; repeated rows and null ids: one result row for each
input row; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.llm.common import id_and_text, per_batch, texts, tokenizer_path

#: Fixed value: the published split pattern of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_MATCH = regex.compile(PATTERN)
_SAFE = regex.compile(r"(?<=[\p{L}\p{N}]) (?=[\p{L}\p{N}])")


@lru_cache(4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def spans(text: str, span: int = 1 << 16) -> list[str]:
    """The text in pieces cut at safe boundaries, each of ``span`` characters or a little more."""
    out, at = [], 0
    while len(text) - at > span:
        m = _SAFE.search(text, at + span)
        if m is None:
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def encode(text: str, path: str, span: int = 1 << 16) -> list[int]:
    enc = encoding(path)
    out: list[int] = []
    for part in spans(text, span):
        if len(part) <= 2 * span:
            out += enc.encode_ordinary(part)
        else:
            for m in _MATCH.finditer(part):
                out += enc._encode_single_piece(m.group().encode())
    return out


def decode(ids: list[int], path: str) -> bytes:
    return encoding(path).decode_bytes(ids)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the ids of every text as array<int>."""
    path = path or tokenizer_path("byte_bpe_multi_50k.tiktoken")

    def start():
        return lambda b: {"doc_id": b.column("doc_id"), "ids": [encode(x, path) for x in texts(b)]}

    kind = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return per_batch(id_and_text(docs), kind, start)


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the raw bytes that the ids of each row stand for."""
    path = path or tokenizer_path("byte_bpe_multi_50k.tiktoken")

    def start():
        def f(b: pa.RecordBatch) -> dict:
            return {"doc_id": b.column("doc_id"), "bytes": [decode(x or [], path) for x in b.column("ids").to_pylist()]}

        return f

    return per_batch(rows.select("doc_id", "ids"), "doc_id long, bytes binary", start)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: both ways in one pass, nothing shuffled."""
    path = path or tokenizer_path("byte_bpe_multi_50k.tiktoken")

    def sha(x: bytes) -> str:
        return hashlib.sha256(x).hexdigest()

    def start():
        def f(batch: pa.RecordBatch) -> dict:
            n, of_ids, of_bytes = [], [], []
            for x in texts(batch):
                ids = encode(x, path)
                n.append(len(ids))
                of_ids.append(sha(",".join(map(str, ids)).encode()))
                of_bytes.append(sha(decode(ids, path)))
            return {"doc_id": batch.column("doc_id"), "n_tokens": n, "ids_sha256": of_ids, "decoded_sha256": of_bytes}

        return f

    return per_batch(id_and_text(docs), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", start)


