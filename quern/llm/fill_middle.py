"""Fill-in-middle: a text's middle moves to its end, behind marks.

The tokenizers library's Split pre-tokenizer, isolating each match of a pattern, gives every unit's
code-point offsets without any training. The array of their ends is all that a cut needs: its length
is n, the k-th end is where a prefix of k units ends. Texts over ``chunk`` code points are split in
runs cut between a word and the blank after it, where a unit always ends; the offsets are the same.

Defined results:
* null text: empty, and plain with no units.
* a text that holds a mark stays plain, so that restoring is exact.
* null ids hash as the empty text; repeated rows give a row each, cut alike; an empty table gives none.
* other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import id_and_text, per_batch, resident, texts

#: A unit: a word with the blanks before it, or the blanks that end a text.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
WORD_END = re.compile(r"[^\x20\x09-\x0D][\x20\x09-\x0D]")


def runs(text: str, chunk: int) -> Iterator[str]:
    """The text in runs of ``chunk`` code points or more, cut only after a word that a blank follows."""
    at = 0
    while len(text) - at > chunk:
        end = WORD_END.search(text, at + chunk - 1)
        if end is None:
            break
        yield text[at : end.start() + 1]
        at = end.start() + 1
    yield text[at:] if at else text


class Units:
    def __init__(self, pattern: str = UNIT, chunk: int = 1 << 16):
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.split, self.chunk = Split(Regex(pattern), behavior="isolated"), chunk

    def ends(self, text: str) -> np.ndarray:
        """Code-point offset of every unit's end."""
        at, out = 0, []
        for run in runs(text, self.chunk):
            found = self.split.pre_tokenize_str(run)
            out.append(np.fromiter((x[1][1] for x in found), np.int64, len(found)) + at)
            at += len(run)
        return np.concatenate(out)


def arrange(text: str, ends: np.ndarray, h: list[int], rate: int = 50, spm: int = 80) -> tuple[str, int | None, int | None, str]:
    """form, prefix_chars, middle_chars and the output of one text, by four hashes."""
    if not text or any(x in text for x in MARKS) or h[2] % 100 >= rate:
        return "plain", None, None, text
    cuts = sorted(x % (len(ends) + 1) for x in h[:2])
    a, b = (int(ends[k - 1]) if k else 0 for k in cuts)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, rate: int = 50, spm: int = 80, seed: str = "42") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the output text, for every row."""

    def start():
        units = resident("fill-middle", Units)

        def f(batch: pa.RecordBatch) -> dict:
            out = {k: [] for k in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")}
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).digest()
                h = [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]
                ends = units.ends(text)
                for name, v in zip(out, (doc, len(ends), *arrange(text, ends, h, rate, spm)), strict=True):
                    out[name].append(v)
            return out

        return f

    return per_batch(
        id_and_text(docs), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string", start
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output of its form was made of."""
    parts = F.split(output, "|".join(MARKS), -1)
    order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    plain = output
    return reduce(
        lambda other, x: F.when(form == x, F.concat(*(F.get(parts, F.lit(k)) for k in order[x]))).otherwise(other), order, plain
    )


def fill_report(docs: DataFrame) -> DataFrame:
    """What op12 returns: the outputs and the texts rebuilt from them, as digests."""
    out = fill_in_middle(docs)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
