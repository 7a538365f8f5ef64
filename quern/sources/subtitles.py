"""Subtitle formats: source_id and whole text to source_id, idx, start, end, text, and back.

All parsing is split and regular expressions in the JVM; one text is one row, so files are read with
wholetext.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import numbers
from quern.functions.text import collapse, html_unescape


def read_files(spark, path: str) -> DataFrame:
    """source_id (path) and text of each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_id"), F.col("value").alias("text"))


def _cues(df: DataFrame, rows: Column) -> DataFrame:
    """rows: array<struct<start,end,text>>; blank texts go, idx counts what stays."""
    kept = F.filter(rows, lambda r: r["start"].isNotNull() & r["end"].isNotNull() & (r["text"] != ""))
    return df.select("source_id", F.posexplode(kept).alias("idx", "c")).select("source_id", (F.col("idx") + 1).alias("idx"), "c.start", "c.end", "c.text")


def parse_srt(df: DataFrame, check_order: bool = False) -> DataFrame:
    """SRT: number, times, text lines; lines are joined by a space. check_order: end > start only."""
    blocks = F.split(F.replace(F.col("text"), F.lit("\r"), F.lit("")), r"\n\s*\n")
    times = r"(\d+:\d+:\d+[,.]\d+)\s*-->\s*(\d+:\d+:\d+[,.]\d+)"

    def cue(b: Column) -> Column:
        body = F.regexp_extract(b, rf"(?s){times}[^\n]*\n(.*)", 3)
        return F.struct(
            numbers.srt_seconds(F.regexp_extract(b, times, 1)).alias("start"),
            numbers.srt_seconds(F.regexp_extract(b, times, 2)).alias("end"),
            collapse(F.replace(body, F.lit("\n"), F.lit(" "))).alias("text"),
        )

    out = _cues(df, F.transform(blocks, cue))
    return out.filter(F.col("end") > F.col("start")) if check_order else out


def to_srt(cues: DataFrame) -> DataFrame:
    """source_id and SRT text. Times are rounded to milliseconds first, then formatted."""
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")

    def stamp(t: Column) -> Column:
        return F.format_string("%02d:%02d:%02d,%03d", F.floor(t / 3600000), F.floor(t % 3600000 / 60000), F.floor(t % 60000 / 1000), t % 1000)

    block = F.concat_ws("\n", F.col("idx").cast("string"), F.concat(stamp(ms("start")), F.lit(" --> "), stamp(ms("end"))), "text")
    rows = cues.select("source_id", "idx", block.alias("b"))
    return rows.groupBy("source_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "b"))), lambda x: x["b"]), "\n\n").alias("text")
    )


def vtt_to_srt(text: Column) -> Column:
    """WebVTT: the header goes, full stops in timing lines become commas."""
    lines = F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n")
    body = F.filter(lines, lambda x: ~x.rlike("^(WEBVTT|Kind:|Language:|NOTE)"))
    return F.array_join(F.transform(body, lambda x: F.when(F.contains(x, F.lit("-->")), F.replace(x, F.lit("."), F.lit(","))).otherwise(x)), "\n")


def parse_timedtext(df: DataFrame) -> DataFrame:
    """XML <text start= dur=> elements."""
    found = F.regexp_extract_all("text", F.lit(r'(?s)(<text [^>]*>.*?</text>)'), F.lit(1))

    def cue(x: Column) -> Column:
        start = F.regexp_extract(x, r'start="([\d.]+)"', 1).try_cast("double")
        dur = F.coalesce(F.regexp_extract(x, r'dur="([\d.]+)"', 1).try_cast("double"), F.lit(0.0))
        return F.struct(start.alias("start"), (start + dur).alias("end"), collapse(html_unescape(F.regexp_extract(x, r"(?s)>(.*)</text>", 1))).alias("text"))

    return _cues(df, F.transform(found, cue))


JSON3 = "events array<struct<tStartMs:double,dDurationMs:double,segs:array<struct<utf8:string>>>>"


def parse_json3(df: DataFrame) -> DataFrame:
    """JSON captions: events with segments; milliseconds."""
    doc = F.from_json("text", JSON3)
    events = F.filter(doc["events"], lambda e: e["segs"].isNotNull())

    def cue(e: Column) -> Column:
        start = e["tStartMs"] / 1000
        joined = F.array_join(F.transform(e["segs"], lambda s: s["utf8"]), "")
        return F.struct(start.alias("start"), (start + F.coalesce(e["dDurationMs"], F.lit(0.0)) / 1000).alias("end"), collapse(joined).alias("text"))

    return _cues(df, F.transform(events, cue))


def is_srt(text: Column) -> Column:
    return F.contains(text, F.lit("-->")) & text.rlike(r"^\s*\d+\s*(\n|$)")


def from_transcript(rows: DataFrame) -> DataFrame:
    """start and duration to start and end."""
    return rows.withColumn("end", F.col("start") + F.col("duration")).drop("duration")
