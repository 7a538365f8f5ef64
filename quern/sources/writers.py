"""Writers. Every writer takes a folder; Spark writes a file for each partition into it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMATS = ("csv", "json", "metadata.txt", "ljspeech")


def metadata(df: DataFrame, path: str, mode: str = "overwrite", header: bool = True) -> None:
    df.write.mode(mode).csv(path, sep="|", header=header, quoteAll=False, escape='"')


def appended(df: DataFrame, path: str) -> None:
    metadata(df, path, "append")


def raw_lines(df: DataFrame, path: str, *columns: str) -> None:
    """Unquoted a|b|c lines: a text that holds a pipe gives a longer line."""
    df.select(F.concat_ws("|", *columns).alias("value")).write.mode("overwrite").text(path)


def csv_rows(df: DataFrame, path: str, *columns: str, sep: str = "|") -> None:
    """Rows without a header; only fields that hold the separator, a quote or a line break are quoted."""

    def field(c: str) -> Column:
        x = F.coalesce(F.col(c).cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
        alone = F.lit(len(columns) == 1) & (x == "")  # a row of one empty field is no empty line
        return F.when(x.rlike(f'[{re.escape(sep)}"\r\n]') | alone, quoted).otherwise(x)

    df.select(F.concat_ws(sep, *map(field, columns)).alias("value")).write.mode("overwrite").text(path)


def exported(df: DataFrame, path: str, kind: str) -> None:
    """csv, json, metadata.txt (name|text|speaker) or ljspeech (stem|text|text) lines."""
    from quern.functions.paths import stem

    if kind == "csv":
        metadata(df, path)
    elif kind == "json":
        df.write.mode("overwrite").json(path)
    elif kind == "metadata.txt":
        raw_lines(df, path, "audio_file", "text", "speaker_name")
    elif kind == "ljspeech":
        raw_lines(df.withColumn("__stem", stem(F.col("audio_file"))), path, "__stem", "text", "text")
    else:
        raise ValueError(f"unknown format {kind}; known are {', '.join(FORMATS)}")


def report(df: DataFrame, path: str) -> None:
    """A one-row document as JSON text."""
    df.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def version(df: DataFrame, root: str, stamp: str) -> str:
    """Writes a new version beside the old ones instead of changing files; gives its path."""
    path = f"{root}/version={stamp}"
    df.write.mode("errorifexists").parquet(path)
    return path


def subtitles(cues: DataFrame, path: str) -> None:
    """One SRT text a source, a row each."""
    from quern.sources.subtitles import to_srt

    to_srt(cues).select("text").write.mode("overwrite").text(path, lineSep="\n\n\n")


def vocabulary(vocab: DataFrame, path: str) -> None:
    """{"model": {"vocab": {token: id}}}; a vocabulary is one document by its format."""
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("token", "id"))))
    doc = vocab.agg(entries.alias("vocab")).select(F.to_json(F.struct(F.struct("vocab").alias("model"))).alias("value"))
    doc.coalesce(1).write.mode("overwrite").text(path)


def word_list(df: DataFrame, path: str, column: str = "word") -> None:
    df.select(F.col(column).cast("string").alias("value")).distinct().orderBy("value").write.mode("overwrite").text(path)


def phoneme_cache(df: DataFrame, folder: str, fingerprint: str) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{fingerprint}")


def copy_plan(df: DataFrame, out: str) -> DataFrame:
    """src_path, dst_path, action for each row with a path and a new name; copying is not part of a plan."""
    same = F.col("path") == F.concat(F.lit(out + "/"), F.col("name"))
    return df.select(F.col("path").alias("src_path"), F.concat(F.lit(out + "/"), "name").alias("dst_path"), F.when(same, "keep").otherwise("copy").alias("action"))


def summary_lines(df: DataFrame) -> list[str]:
    """Readable lines of a one-row result."""
    row = df.first()
    return [f"{k}: {v:.2f}" if isinstance(v, float) else f"{k}: {v}" for k, v in row.asDict().items()] if row else ["no rows"]


def tokenizer_config(spark, path: str, use_phonemes: bool) -> None:
    report(spark.range(1).select(F.lit(use_phonemes).alias("use_phonemes")), path)
