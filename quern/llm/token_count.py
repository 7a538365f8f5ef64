"""Token counts by a whole-token shortcut.

Before any text is read, the driver encodes every vocabulary string alone: those that give exactly one
token are proven whole tokens and sent to the workers, so a pre-token equal to one costs a table lookup. Only the other
pre-tokens are merged, once per distinct one. Each distinct pre-token of a text is looked up once
and weighted by its count.

Defined results:
* null or empty text: 0 bytes, 0 tokens.
* special strings inside a text count as the library treats them: one token, cutting the text.
* texts over a million characters: pre-tokens are found one by one, not as a list; the counts are the same.
* repeated rows and null ids: one result row for each input row. Other columns are ignored.
"""

from __future__ import annotations

import os
from collections import Counter
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quern.llm.common import id_and_text, per_batch, resident, texts, tokenizer_path

#: Fixed value: the published split pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(4)
def proof(path: str) -> tuple[frozenset[str], tuple[str, ...]]:
    """The whole tokens of a tokenizer file (as many as its vocabulary at most) and its special strings."""
    t = _tokenizer(path)
    special = [x.content for x in t.get_added_tokens_decoder().values()]
    strings = [s for s in (t.decode([i]) for i in range(t.get_vocab_size())) if s and "�" not in s and s not in special]
    encoded = t.encode_batch(strings, add_special_tokens=False)
    found = regex.compile(PATTERN)
    return frozenset(s for s, e in zip(strings, encoded, strict=True) if len(e.ids) == 1 and found.fullmatch(s)), tuple(special)


class TokenCounter:
    """At most ``memory`` merged pre-tokens are kept, of 64 characters at most each."""

    def __init__(self, path: str, proven: tuple[frozenset[str], tuple[str, ...]] | None = None, memory: int = 1 << 18):
        self.whole, self.special = proven or proof(path)
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pieces = regex.compile(PATTERN)
        self.merged: dict[str, int] = {}
        self.memory, self.tokenizer = memory, _tokenizer(path)

    def alone(self, piece: str) -> int:
        return len(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def _plain(self, text: str) -> int:
        n, whole, merged = 0, self.whole, self.merged
        found = (m.group() for m in self.pieces.finditer(text)) if len(text) > 1 << 20 else iter(self.pieces.findall(text))
        while part := Counter(islice(found, 1 << 16)):
            for piece, times in part.items():
                if piece in whole:
                    n += times
                    continue
                k = merged.get(piece)
                if k is None:
                    k = self.alone(piece)
                    if len(piece) <= 64:
                        if len(merged) >= self.memory:
                            merged.clear()
                        merged[piece] = k
                n += k * times
        return n

    def count(self, text: str) -> int:
        if not any(x in text for x in self.special):
            return self._plain(text)
        cuts = len(self.cut.findall(text))
        return cuts + sum(self._plain(x) for x in self.cut.split(text) if x)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) for every row."""
    path = path or tokenizer_path("byte_bpe_50k.json")
    proven = docs.sparkSession.sparkContext.broadcast(proof(path))

    def start():
        counter = resident(("token-count", path), lambda: TokenCounter(path, proven.value))

        def f(batch: pa.RecordBatch) -> dict:
            own = texts(batch)
            n = np.array([counter.count(x) for x in own], np.int64)
            size = np.array([len(x.encode()) for x in own], np.int64)
            return {"doc_id": batch.column("doc_id"), "n_bytes": size, "n_tokens": n, "over_limit": n > limit}

        return f

    return per_batch(id_and_text(docs), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", start)
