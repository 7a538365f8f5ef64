"""Line dedup (native: DataFrame functions only).

Lines are hashed and range-partitioned by (hash, document), with position as the secondary sort;
each range streams to one first occurrence per hash and document, and what is left is
pre-aggregated before it meets in one place by hash. The text never travels in this step: it
gives a compressed keep bitmap per document (64 lines a word, words that keep every line left out),
which is joined to the text at the end.

A hot line costs one row per range partition that holds it, never a group in a task. Joins are
by hash or by document and may be split by adaptive execution.

Defined results:
* null or empty text: one empty line, kept; the text becomes ''.
* a line's holders are the distinct doc_ids of the rows that hold it, whatever their texts.
* a null doc_id: each distinct text without an id is a holder; it is never the largest one unless all
  are without an id, in which case the line stays.
* ties (the same line twice in the largest document): all its lines there stay.
* other columns are left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import BLANK, id_and_text
from quern.session import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line stripped of blanks at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def _named(docs: DataFrame) -> DataFrame:
    return id_and_text(docs).withColumn("text_key", F.xxhash64("text"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, text_key, keep): keep maps a word index to the 64 keep bits of its lines.

    Documents that keep every line have no row; words without a dropped line have no entry.
    text_key is the text's hash, so rows that share a doc_id are told apart.
    """
    lines = (
        _named(docs)
        .select("doc_id", "text_key", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .filter(F.length("line") >= min_chars)
        .withColumn("line", line_key(F.col("line")))
        .filter(F.length("line") >= min_chars)
        .select(
            "doc_id",
            "text_key",
            "pos",
            F.xxhash64("line").alias("h1"),
            F.xxhash64(F.lit(7), "line").alias("h2"),
        )
    )
    lines = stored(lines, "lines")
    # the range partitioning satisfies the window, so the first occurrences stream from one sort
    holder = ["h1", "h2", "doc_id", "alone"]
    firsts = (
        lines.withColumn("alone", F.when(F.col("doc_id").isNull(), F.col("text_key")))
        .repartitionByRange(*holder)
        .withColumn("nth", F.row_number().over(W.partitionBy(*holder).orderBy("pos")))
        .filter("nth = 1")
    )
    repeated = (
        firsts.groupBy("h1", "h2")
        .agg(F.count("*").alias("holders"), F.max("doc_id").alias("keeper"))
        .filter((F.col("holders") >= min_docs) & F.col("keeper").isNotNull())
        .select("h1", "h2", "keeper")
    )
    repeated = stored(repeated, "repeated-lines")
    dropped = lines.join(repeated, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    words = dropped.groupBy("doc_id", "text_key", F.expr("cast(pos div 64 as int)").alias("word")).agg(
        F.expr("~bit_or(shiftleft(1L, cast(pos % 64 as int)))").alias("bits")
    )
    return words.groupBy("doc_id", "text_key").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("keep")
    )


def _kept_text(text: Column, keep: Column) -> Column:
    def stays(_line: Column, i: Column) -> Column:
        # keep[i / 64] is null for a word that keeps all its lines
        bits = F.try_element_at(keep, F.shiftright(i, 6))
        return F.coalesce(F.call_function("getbit", bits, i % 64), F.lit(1)) == 1

    return F.when(keep.isNull(), text).otherwise(
        F.array_join(F.filter(F.split(text, "\n"), stays), "\n")
    )


def _joined(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """row (all columns of docs as one struct, so that no name clashes), kept and n_dropped."""
    maps = stored(keep_bitmaps(docs, min_chars, min_docs), "keep-bitmaps")
    wide = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"),
    )
    hit = wide["doc_id"].eqNullSafe(maps["doc_id"]) & (wide["text_key"] == maps["text_key"])
    dropped = F.aggregate(
        F.map_values("keep"), F.lit(0).cast("long"), lambda n, b: n + 64 - F.bit_count(b).cast("long")
    )
    text = F.coalesce(F.col("row").getField("text"), F.lit(""))
    # the maps grow with the texts: one way of joining at every size
    return wide.join(maps.hint("merge"), hit, "left").select(
        "row",
        _kept_text(text, F.col("keep")).alias("kept"),
        F.coalesce(dropped, F.lit(0).cast("long")).alias("n_dropped"),
    )


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs, same columns, without the repeated lines; n_chars, if present, is recounted."""
    out = _joined(docs, min_chars, min_docs)
    new = {"text": F.col("kept")} | (
        {"n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    )
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def line_report(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped and kept_sha256 of the text that stays."""
    text = F.coalesce(F.col("row").getField("text"), F.lit(""))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return _joined(docs.select("doc_id", "text"), min_chars, min_docs).select(
        F.col("row").getField("doc_id").cast("long").alias("doc_id"),
        lines.cast("long").alias("n_lines"),
        "n_dropped",
        F.sha2(F.col("kept"), 256).alias("kept_sha256"),
    )
