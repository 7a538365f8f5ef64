"""The provided tables as the engine's relations, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import spread, table

#: metadata over documents: audio_file, text, speaker_name, pos, lang
META_SQL = """meta AS (
  SELECT 'wavs/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.wav' AS audio_file, text, source AS speaker_name,
         doc_id AS pos, lang FROM documents)"""


def meta(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.concat(F.lit("wavs/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".wav")).alias("audio_file"),
        "text",
        F.col("source").alias("speaker_name"),
        F.col("doc_id").alias("pos"),
        "lang",
    )


#: clips over lineitem: audio_file, duration (quantity), split (by return flag), speaker_name, pos
CLIPS_SQL = """clips AS (
  SELECT 'wavs/' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) || '.wav' AS audio_file,
         l_quantity AS duration, CASE WHEN l_returnflag = 'R' THEN 'eval' ELSE 'train' END AS split,
         CAST(l_suppkey AS VARCHAR) AS speaker_name, l_orderkey * 10 + l_linenumber AS pos, l_linestatus AS text FROM lineitem)"""


def clips(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("wavs/"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"), F.lit(".wav")).alias("audio_file"),
        F.col("l_quantity").alias("duration"),
        F.when(F.col("l_returnflag") == "R", "eval").otherwise("train").alias("split"),
        F.col("l_suppkey").cast("string").alias("speaker_name"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.col("l_linestatus").alias("text"),
    )


#: cues over events: source_id (user), idx, start, end (seconds), text, confidence
CUES_SQL = """cues AS (
  SELECT user_id AS source_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS INTEGER) AS idx,
         CAST(ms AS DOUBLE) / 1000 AS "start", CAST(ms + CAST(floor(value * 100) AS BIGINT) AS DOUBLE) / 1000 AS "end",
         event_type || CAST(event_id AS VARCHAR) AS text, (event_id % 100) / 100.0::DOUBLE AS confidence
  FROM (SELECT *, (epoch_us(ts) - 1704067200000000) // 6000000 AS ms FROM events))"""


def cues(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    since = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))")
    ms = F.floor(since / 6000000).cast("long")
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", ms.alias("ms"))
    return e.select(
        F.col("user_id").alias("source_id"),
        F.row_number().over(W.partitionBy("user_id").orderBy("ms", "event_id")).alias("idx"),
        (F.col("ms").cast("double") / 1000).alias("start"),
        ((F.col("ms") + F.floor(F.col("value") * 100)).cast("double") / 1000).alias("end"),
        F.concat("event_type", F.col("event_id").cast("string")).alias("text"),
        ((F.col("event_id") % 100) / F.lit(100.0)).alias("confidence"),
    )


#: steps over events by user: epoch, train loss and validation loss
STEPS_SQL = """steps AS (
  SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS epoch,
         value / 100 AS val_loss, (value * 0.6 + event_id % 13) / 100 AS train_loss FROM events)"""


def steps(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    return table(spark, sf, "events").select(
        F.col("user_id").alias("run"),
        F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("epoch"),
        (F.col("value") / 100).alias("val_loss"),
        ((F.col("value") * F.lit(0.6) + F.col("event_id") % 13) / 100).alias("train_loss"),
    )


#: Ethiopic text: the letters of each document in another script
LATIN, FIDEL = "abcdefghijklmnopqrstuvwxyz", "አበቸደእፈገሀኢጀከለመነኦጰቀረሰተኡቨወጠየዘ"
FIDEL_SQL = f"""fidel AS (
  SELECT doc_id, translate(lower(text), '{LATIN}', '{FIDEL}') AS text, lang FROM documents)"""


def fidel(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text", "lang")).select("doc_id", F.translate(F.lower("text"), LATIN, FIDEL).alias("text"), "lang")
