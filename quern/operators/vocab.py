"""Vocabulary analytics: n-grams, extension, padding."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.metadata import ordinal


def char_ngrams(df: DataFrame, longest: int = 3, memory: int = 200_000) -> DataFrame:
    """token, n over all character 1-, 2- and 3-grams of text.

    Each task counts n-grams batch by batch and sends a row for each distinct one when ``memory`` of them
    are held, so the shuffle carries counts, not characters. A long text is read in pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["token", "n"])
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                whole = text.as_py() or ""
                for at in range(0, len(whole), 1 << 16):
                    part = whole[at : at + (1 << 16) + longest - 1]  # an n-gram counts where it begins
                    size = min(1 << 16, len(whole) - at)
                    held.update(part[:size])
                    for k in range(2, longest + 1):
                        held.update(map("".join, zip(*(part[j : size + j] for j in range(k)))))
                    if len(held) > memory:
                        yield rows()
        yield rows()

    return df.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def top_tokens(counts: DataFrame, least: int, top: int) -> DataFrame:
    return counts.filter(F.col("n") >= least).orderBy(F.col("n").desc(), "token").limit(top)


def code_points(spark, first: int, last: int) -> DataFrame:
    """token for each code point of the range, both ends included."""
    one = F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE")
    return spark.range(first, last + 1).select(one.alias("token"))


def extended(vocab: DataFrame, candidates: DataFrame) -> DataFrame:
    """vocab (token, id) and the distinct candidates it lacks, with ids from the largest one on, in token
    order."""
    new = candidates.select("token").distinct().join(vocab.select("token"), "token", "left_anti")
    start = vocab.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("top"))
    numbered = ordinal(new, "token").crossJoin(F.broadcast(start))  # one row
    return vocab.select("token", F.col("id").cast("long").alias("id")).unionByName(numbered.select("token", (F.col("top") + 1 + F.col("ordinal")).cast("long").alias("id")))


def matched_to_size(vocab: DataFrame, spare: DataFrame, size: int) -> DataFrame:
    """vocab filled to ``size`` with spare tokens (token, rank) that it lacks, then <pad_n>; or cut to its
    smallest ids."""
    spark = vocab.sparkSession
    n = vocab.count()
    if n >= size:
        return vocab.filter(F.col("id") < size)
    have = spare.join(vocab.select("token"), "token", "left_anti").orderBy("rank", "token").limit(size - n)
    have = ordinal(have, "rank", "token")
    filled = vocab.select("token", F.col("id").cast("long").alias("id")).unionByName(have.select("token", (F.lit(n) + F.col("ordinal")).cast("long").alias("id")))
    at = filled.count()
    pads = spark.range(at, size).select(F.concat(F.lit("<pad_"), (F.col("id") - at).cast("string"), F.lit(">")).alias("token"), "id")
    return filled.unionByName(pads)


def from_json(text: Column) -> tuple[Column, Column]:
    """A vocabulary document's tokens as map<string,int>, whichever form it has: map or list."""
    as_map = F.from_json(F.get_json_object(text, "$.model.vocab"), "map<string,int>")
    as_list = F.from_json(F.get_json_object(text, "$.model.vocab"), "array<string>")
    listed = F.map_from_entries(F.transform(as_list, lambda t, i: F.struct(t, i)))
    return F.coalesce(as_map, listed), F.coalesce(F.size(as_map), F.size(as_list))
