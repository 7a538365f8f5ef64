"""Registered queries on sources, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans import views as v
from quern.plans.registry import query
from quern.session import shared_dir, table
from quern.sources import readers, subtitles, writers
from quern.streaming import incremental


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_META_LINE = f"WITH {v.META_SQL}, m AS (SELECT audio_file, replace(text, chr(10), ' ') AS text, speaker_name FROM meta)"


def _flat(spark, sf) -> DataFrame:
    return v.meta(spark, sf).select("audio_file", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"), "speaker_name")


@query("s01_metadata_csv", f"{_META_LINE} SELECT audio_file, nullif(text, '') AS text, speaker_name FROM m")
def s01(spark, sf):
    path = _folder(spark, "s01")
    writers.metadata(_flat(spark, sf), path)
    return spark.read.schema(readers.METADATA).csv(path, sep="|", header=True, escape='"')


@query("s02_ragged_rows", "SELECT CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 3 END AS n_fields, count(*) AS n FROM customer GROUP BY 1")
def s02(spark, sf):
    path = _folder(spark, "s02")
    line = F.concat_ws("|", "c_name", "c_mktsegment", F.when(F.col("c_custkey") % 3 != 0, F.lit("x")))
    table(spark, sf, "customer").select(line.alias("value")).write.text(path)
    return readers.ragged_rows(spark, path).groupBy("n_fields").agg(F.count("*").alias("n"))


@query("s03_named_columns_csv", "SELECT c_name AS name, c_mktsegment AS segment FROM customer")
def s03(spark, sf):
    path = _folder(spark, "s03")
    table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).write.csv(path, sep=",", header=True)
    return readers.any_columns(spark, path, ",")


@query("s04_header_repair", "SELECT c_name AS audio_file, c_mktsegment AS text, 'speaker' AS speaker_name FROM customer UNION ALL SELECT s_name, 'x', 'speaker' FROM supplier")
def s04(spark, sf):
    a, b = _folder(spark, "s04a"), _folder(spark, "s04b")
    one = table(spark, sf, "customer").select(F.col("c_name").alias("audio_file"), F.col("c_mktsegment").alias("text"), F.lit("speaker").alias("speaker_name"))
    two = table(spark, sf, "supplier").select(F.col("s_name").alias("audio_file"), F.lit("x").alias("text"), F.lit("speaker").alias("speaker_name"))
    writers.metadata(one, a, header=True)
    writers.metadata(two, b, header=False)
    return readers.metadata_with_or_without_header(spark, a).unionByName(readers.metadata_with_or_without_header(spark, b))


@query("s05_language_sidecar", "SELECT 'amh' AS lang, 'unknown' AS missing")
def s05(spark, sf):
    path = _folder(spark, "s05")
    spark.createDataFrame([(" amh ",)], "value string").coalesce(1).write.text(path)
    lang, none = readers.language_of(spark, path), readers.language_of(spark, path + "-none")
    return spark.range(1).select(F.lit(lang).alias("lang"), F.lit(none).alias("missing"))


@query("s06_history_json", "SELECT (CAST(c_custkey AS BIGINT)) AS num_segments, c_name AS title, c_acctbal AS duration FROM customer")
def s06(spark, sf):
    one = F.struct(F.lit("youtube").alias("type"), F.col("c_name").alias("title"), F.col("c_acctbal").alias("duration"), F.col("c_custkey").alias("num_segments"))
    doc = table(spark, sf, "customer").groupBy((F.col("c_custkey") % 8).alias("k")).agg(F.to_json(F.struct(F.collect_list(one).alias("datasets"))).alias("value"))
    return readers.history_of(doc).select("num_segments", "title", "duration")


@query("s07_vocabulary_json", "SELECT n_name AS token, n_nationkey AS id FROM nation UNION ALL SELECT r_name, CAST(row_number() OVER (ORDER BY r_name) - 1 AS INTEGER) FROM region")
def s07(spark, sf):
    n = table(spark, sf, "nation").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("vocab"))
    as_map = n.select(F.to_json(F.struct(F.struct("vocab").alias("model"))).alias("value"))
    r = table(spark, sf, "region").agg(F.sort_array(F.collect_list("r_name")).alias("vocab"))
    as_list = r.select(F.to_json(F.struct(F.struct("vocab").alias("model"))).alias("value"))
    return readers.vocabulary_of(as_map).unionByName(readers.vocabulary_of(as_list))


_EV = "e AS (SELECT user_id AS source_id, event_id, CAST(event_id AS DOUBLE) AS s, value FROM events)"


def _ev(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("source_id"), "event_id", F.col("event_id").cast("double").alias("s"), "value")


@query("s10_vtt_to_srt", "SELECT event_id, '1' || chr(10) || '00:00:01,500 --> 00:00:02,000' || chr(10) || 'say 1.5 ' || event_type AS text FROM events")
def s10(spark, sf):
    vtt = F.concat(F.lit("WEBVTT\nKind: captions\nLanguage: am\n1\n00:00:01.500 --> 00:00:02.000\nsay 1.5 "), "event_type")
    return table(spark, sf, "events").select("event_id", subtitles.vtt_to_srt(vtt).alias("text"))


@query("s11_timedtext", "SELECT event_id AS source_id, event_id + 0.5::DOUBLE AS \"start\", event_id + 2.0::DOUBLE AS \"end\", 'a & ' || event_type AS text FROM events")
def s11(spark, sf):
    xml = F.concat(F.lit('<transcript><text start="'), "event_id", F.lit('.5" dur="1.5">a &amp; '), "event_type", F.lit('</text><text start="1" dur="1"> </text></transcript>'))
    docs = table(spark, sf, "events").select(F.col("event_id").alias("source_id"), xml.alias("text"))
    return subtitles.parse_timedtext(docs).select("source_id", "start", "end", "text")


@query("s12_json3", "SELECT event_id AS source_id, CAST(event_id AS DOUBLE) AS \"start\", event_id + 0.25::DOUBLE AS \"end\", 'hi ' || event_type AS text FROM events")
def s12(spark, sf):
    doc = F.concat(F.lit('{"events":[{"tStartMs":'), (F.col("event_id") * 1000).cast("string"), F.lit(',"dDurationMs":250,"segs":[{"utf8":"hi "},{"utf8":"'), "event_type", F.lit('"}]},{"tStartMs":5}]}'))
    docs = table(spark, sf, "events").select(F.col("event_id").alias("source_id"), doc.alias("text"))
    return subtitles.parse_json3(docs).select("source_id", "start", "end", "text")


@query("s13_is_srt", "SELECT event_id, event_id % 2 = 0 AS srt FROM events")
def s13(spark, sf):
    t = F.when(F.col("event_id") % 2 == 0, "1\n00:00:01,000 --> 00:00:02,000\nx").otherwise("WEBVTT\n00:00:01.000 --> 00:00:02.000")
    return table(spark, sf, "events").select("event_id", subtitles.is_srt(t).alias("srt"))


@query("s14_transcript_rows", f"WITH {_EV} SELECT source_id, event_id, s AS \"start\", s + value AS \"end\" FROM e")
def s14(spark, sf):
    rows = _ev(spark, sf).withColumnRenamed("s", "start").withColumnRenamed("value", "duration")
    return subtitles.from_transcript(rows)


@query("s15_url_list", "SELECT page_id, 'https://youtu.be/' || CAST(page_id AS VARCHAR) AS url FROM pages UNION ALL SELECT page_id, 'https://www.youtube.com/watch?v=' || CAST(page_id AS VARCHAR) FROM pages")
def s15(spark, sf):
    p = F.col("page_id").cast("string")
    free = F.concat(F.lit(' "https://youtu.be/'), p, F.lit('", '), F.col("url"), F.lit("\n'https://www.youtube.com/watch?v="), p, F.lit("' "))
    return table(spark, sf, "pages").select("page_id", F.explode(readers.url_list(free)).alias("url"))


@query("s16_url_lines", "SELECT 'https://youtu.be/' || CAST(page_id AS VARCHAR) AS url FROM pages WHERE page_id % 3 = 0")
def s16(spark, sf):
    r = F.col("page_id") % 3
    line = F.when(r == 0, F.concat(F.lit("'https://youtu.be/"), "page_id", F.lit("'"))).when(r == 1, F.lit("# https://youtu.be/x")).otherwise(F.lit("  "))
    return readers.url_lines(table(spark, sf, "pages").select(line.alias("value")))


_LIST = "f AS (SELECT 'data/' || CAST(p_partkey % 7 AS VARCHAR) || '/clip' || CAST(p_partkey AS VARCHAR) || CASE p_partkey % 4 WHEN 0 THEN '.wav' WHEN 1 THEN '.MP3' WHEN 2 THEN '.flac' ELSE '.txt' END AS path FROM part)"


def _list(spark, sf):
    r = F.col("p_partkey") % 4
    end = F.when(r == 0, ".wav").when(r == 1, ".MP3").when(r == 2, ".flac").otherwise(".txt")
    return table(spark, sf, "part").select(F.concat(F.lit("data/"), (F.col("p_partkey") % 7).cast("string"), F.lit("/clip"), F.col("p_partkey").cast("string"), end).alias("path"))


@query("s17_audio_listing", f"WITH {_LIST} SELECT path FROM f WHERE lower(path) SIMILAR TO '.*[.](wav|mp3|flac)' AND path LIKE '%clip1%'")
def s17(spark, sf):
    return readers.listing(_list(spark, sf), (".wav", ".mp3", ".flac"), "clip1")


@query("s18_count_by_folder", f"WITH {_LIST} SELECT regexp_replace(path, '/[^/]*$', '') AS folder, count(*) AS n FROM f GROUP BY 1")
def s18(spark, sf):
    return readers.count_by_folder(_list(spark, sf))


@query("s19_staged_datasets", f"{_META_LINE} SELECT 'temp_dataset_' || speaker_name AS dataset, count(*) AS n FROM m GROUP BY 1")
def s19(spark, sf):
    root = _folder(spark, "s19")
    rows = _flat(spark, sf).withColumn("text", F.lit("x"))
    rows.withColumn("d", F.concat(F.lit("temp_dataset_"), "speaker_name")).repartition("d").write.partitionBy("d").csv(root, sep="|", header=True)
    found = readers.staged(spark, f"{root}/d=temp_dataset_*")
    return found.groupBy(F.substr("dataset", F.lit(3)).alias("dataset")).agg(F.count("*").alias("n"))


@query("s23_checkpoint_listing", "SELECT o_custkey AS run_no, o_orderkey AS step, o_orderkey % 9 = 0 AS is_best FROM orders WHERE o_orderkey % 5 <> 0")
def s23(spark, sf):
    k = F.col("o_orderkey")
    name = F.concat(F.when(k % 5 == 0, "notes_").when(k % 9 == 0, "best_model_").otherwise("checkpoint_"), k.cast("string"), F.when(k % 5 == 0, ".txt").otherwise(".pth"))
    files = table(spark, sf, "orders").select(F.concat(F.lit("runs/"), F.col("o_custkey").cast("string"), F.lit("/"), name).alias("path"), F.lit(1048576).alias("length"), F.col("o_orderdate").alias("modificationTime"))
    return readers.checkpoints(files).select(F.split_part("run", F.lit("/"), F.lit(2)).cast("long").alias("run_no"), "step", "is_best")


@query("s24_proxy_lines", "SELECT 'http://10.0.0.' || CAST(s_suppkey AS VARCHAR) AS proxy FROM supplier WHERE s_suppkey % 2 = 0")
def s24(spark, sf):
    line = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(" http://10.0.0."), F.col("s_suppkey").cast("string"))).otherwise("# none")
    return readers.proxy_lines(table(spark, sf, "supplier").select(line.alias("value")))


@query("p30_cookie_audit", "SELECT true AS has_header, count(*) FILTER (WHERE s_suppkey > 0) AS cookies, ['APISID', 'LOGIN_INFO', 'SAPISID', 'SSID'] AS missing, count(*) FILTER (WHERE s_suppkey % 3 = 1 AND s_suppkey > 0) AS expired FROM supplier")
def p30(spark, sf):
    k = F.col("s_suppkey")
    cookie = F.concat_ws("\t", F.lit(".host"), F.lit("TRUE"), F.lit("/"), F.lit("FALSE"), F.when(k % 3 == 1, "5").otherwise("99999"), F.when(k % 2 == 0, "SID").otherwise("HSID"), F.lit("v"))
    lines = table(spark, sf, "supplier").select(F.when(k == 0, "# Netscape HTTP Cookie File").otherwise(cookie).alias("value"))
    return readers.cookie_audit(lines, 1000)


@query("s26_wav_duration", "SELECT p_partkey, (p_partkey * 100 + 44 - 44) / (22050 * 2) AS duration FROM part")
def s26(spark, sf):
    return table(spark, sf, "part").select("p_partkey", readers.wav_duration(F.col("p_partkey") * 100 + 44, 22050).alias("duration"))


@query("s27_decode_bytes", "SELECT s_suppkey, 'Ünï ' || s_name AS text FROM supplier")
def s27(spark, sf):
    t = F.concat(F.lit("Ünï "), F.col("s_name"))
    content = F.when(F.col("s_suppkey") % 2 == 0, F.encode(t, "UTF-8")).otherwise(F.encode(t, "ISO-8859-1"))
    return readers.decoded_subtitles(table(spark, sf, "supplier").select("s_suppkey", content.alias("content")))


@query("s28_phoneme_cache", "SELECT s_suppkey, s_name FROM supplier")
def s28(spark, sf):
    folder = _folder(spark, "s28")
    assert readers.phoneme_cache(spark, folder, "ab") is None
    writers.phoneme_cache(table(spark, sf, "supplier").select("s_suppkey", "s_name"), folder, "ab")
    return readers.phoneme_cache(spark, folder, "ab")


# --- sinks: written, then read back -----------------------------------------------------------


@query("k02_append", "SELECT count(*) * 2 AS n FROM supplier")
def k02(spark, sf):
    path = _folder(spark, "k02")
    rows = table(spark, sf, "supplier").select(F.col("s_name").alias("audio_file"), F.lit("t").alias("text"), F.lit("s").alias("speaker_name"))
    writers.appended(rows, path)
    writers.appended(rows, path)
    return readers.metadata(spark, path).agg(F.count("*").alias("n"))


@query("k03_csv_rows", '''SELECT CAST(p_partkey AS VARCHAR) || '|' || CASE WHEN p_partkey % 3 = 0 THEN '"say ""' || p_brand || '""|"' ELSE p_name END || '|' AS value FROM part''')
def k03(spark, sf):
    path = _folder(spark, "k03")
    said = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('say "'), "p_brand", F.lit('"|'))).otherwise(F.col("p_name"))
    writers.csv_rows(table(spark, sf, "part").select("p_partkey", said.alias("text"), F.lit("").alias("speaker_name")), path, "p_partkey", "text", "speaker_name")
    return spark.read.text(path)


@query("k11_save_phoneme_cache", "SELECT s_suppkey, 'second ' || s_name AS ipa FROM supplier")
def k11(spark, sf):
    """A second save of the same fingerprint takes the place of the first."""
    folder = _folder(spark, "k11")
    for save in ("first ", "second "):
        rows = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit(save), "s_name").alias("ipa"))
        writers.phoneme_cache(rows, folder, "ab")
    return readers.phoneme_cache(spark, folder, "ab").select("s_suppkey", "ipa")


@query("k04_raw_lines", "SELECT c_name || '|' || c_mktsegment AS value FROM customer")
def k04(spark, sf):
    path = _folder(spark, "k04")
    writers.raw_lines(table(spark, sf, "customer"), path, "c_name", "c_mktsegment")
    return spark.read.text(path)


@query("k05_exports", "SELECT 'ljspeech' AS kind, s_name || '|t|t' AS value FROM supplier UNION ALL SELECT 'metadata.txt', s_name || '.wav|t|s' FROM supplier")
def k05(spark, sf):
    rows = table(spark, sf, "supplier").select(F.concat("s_name", F.lit(".wav")).alias("audio_file"), F.lit("t").alias("text"), F.lit("s").alias("speaker_name"))
    out = None
    for kind in ("ljspeech", "metadata.txt"):
        path = _folder(spark, "k05")
        writers.exported(rows, path, kind)
        got = spark.read.text(path).select(F.lit(kind).alias("kind"), "value")
        out = got if out is None else out.unionByName(got)
    return out


@query("k06_json_report", "SELECT count(*) AS n, sum(s_acctbal) AS total FROM supplier")
def k06(spark, sf):
    path = _folder(spark, "k06")
    writers.report(table(spark, sf, "supplier").agg(F.count("*").alias("n"), F.sum("s_acctbal").alias("total")), path)
    return spark.read.schema("n bigint, total double").json(path)


@query("k07_versions", "SELECT count(*) AS n FROM nation")
def k07(spark, sf):
    return spark.read.parquet(writers.version(table(spark, sf, "nation"), _folder(spark, "k07"), "20240101")).agg(F.count("*").alias("n"))


@query("k09_vocabulary_json", "SELECT n_name AS token, n_nationkey AS id FROM nation")
def k09(spark, sf):
    path = _folder(spark, "k09")
    writers.vocabulary(table(spark, sf, "nation").select(F.col("n_name").alias("token"), F.col("n_nationkey").alias("id")), path)
    return readers.vocabulary(spark, path)


@query("k13_word_list", "SELECT DISTINCT p_type AS value FROM part")
def k13(spark, sf):
    path = _folder(spark, "k13")
    writers.word_list(table(spark, sf, "part"), path, "p_type")
    return spark.read.text(path)


@query("k14_copy_plan", "SELECT 'in/' || s_name AS src_path, 'out/' || s_name AS dst_path, 'copy' AS action FROM supplier")
def k14(spark, sf):
    return writers.copy_plan(table(spark, sf, "supplier").select(F.concat(F.lit("in/"), "s_name").alias("path"), F.col("s_name").alias("name")), "out")


# --- streams over the events table --------------------------------------------------------------


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A file stream over one table: the pattern matches the file or its parts."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", False).parquet(_dir(spark, sf, name))


def _dir(spark: SparkSession, sf: str, name: str) -> str:
    """Streams read folders: a table that is one file is laid out as a folder of the shared storage."""
    path = _folder(spark, f"stream-{name}")
    table(spark, sf, name).write.parquet(path)
    return path


@query("x01_unseen_sources", "SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 50 = 0)")
def x01(spark, sf):
    d = table(spark, sf, "documents")
    return incremental.unseen_sources(d.select("source").distinct(), d.filter("doc_id % 50 = 0"))


@query("x02_stream_dedup", "SELECT sha256(text) AS h, min(doc_id) AS doc_id FROM documents WHERE text <> '' GROUP BY 1")
def x02(spark, sf):
    s = _stream(spark, sf, "documents").select(F.when(F.col("text") != "", F.sha2("text", 256)).alias("h"), "doc_id")
    return incremental.ContentMerge(_folder(spark, "x02"), "h", "doc_id").run(s)


@query("x03_session_runs", """WITH l AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS run FROM l) SELECT user_id, count(*) AS n FROM r GROUP BY user_id, run""")
def x03(spark, sf):
    s = _stream(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    w = F.session_window("ts", "2 hours")
    out = s.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", "n")
    return incremental.drained(out, "x03", "complete")


@query("x03_speech_runs", f"""WITH {v.CUES_SQL}, t AS (SELECT source_id, CAST(round("start" * 1000000) AS BIGINT) AS a, CAST(round("start" * 1000000) AS BIGINT) + CAST(round(greatest("end" - "start", 0) * 1000000) AS BIGINT) AS b FROM cues),
m AS (SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY source_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 500000 THEN 0 ELSE 1 END AS new FROM t),
r AS (SELECT *, sum(new) OVER (PARTITION BY source_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT source_id, min(a) AS start_us, max(b) AS end_us, count(*) AS n FROM r GROUP BY source_id, run""")
def x03b(spark, sf):
    path = _folder(spark, "x03")
    ts = F.timestamp_micros(F.round(F.col("start") * 1_000_000).cast("long"))
    v.cues(spark, sf).select("source_id", ts.alias("ts"), (F.col("end") - F.col("start")).alias("duration")).write.parquet(path)
    s = spark.readStream.schema("source_id bigint, ts timestamp, duration double").parquet(path)
    out = incremental.drained(incremental.speech_runs(s, 0.5, "1 minute", "source_id"), "x03b", "complete")
    return out.select("source_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("x04_stream_early_stop", """WITH RECURSIVE steps AS (SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS epoch, value / 100 AS loss FROM events),
f AS (SELECT run, epoch, loss AS best, 0 AS bad, false AS stopped FROM steps WHERE epoch = 1 UNION ALL
  SELECT n.run, n.epoch, CASE WHEN NOT f.stopped AND n.loss < f.best - 0.001::DOUBLE THEN n.loss ELSE f.best END, CASE WHEN f.stopped THEN f.bad WHEN n.loss < f.best - 0.001::DOUBLE THEN 0 ELSE f.bad + 1 END,
    f.stopped OR (NOT n.loss < f.best - 0.001::DOUBLE AND f.bad + 1 >= 10) FROM f JOIN steps n ON n.run = f.run AND n.epoch = f.epoch + 1)
SELECT * FROM f""")
def x04(spark, sf):
    path = _folder(spark, "x04")
    v.steps(spark, sf).select("run", "epoch", F.col("val_loss").alias("loss")).write.parquet(path)
    s = spark.readStream.schema("run bigint, epoch int, loss double").parquet(path)
    return incremental.drained(incremental.early_stopping(s, 10, 0.001), "x04")


@query("x05_stream_divergence", f"""WITH {v.STEPS_SQL} SELECT run, epoch, coalesce(lag(train_loss, 2) OVER w > lag(train_loss, 1) OVER w AND lag(train_loss, 1) OVER w > train_loss AND lag(val_loss, 2) OVER w < lag(val_loss, 1) OVER w AND lag(val_loss, 1) OVER w < val_loss, false) AS diverging,
 train_loss > 0 AND val_loss / train_loss > 3 AS wide_gap FROM steps WINDOW w AS (PARTITION BY run ORDER BY epoch)""")
def x05(spark, sf):
    path = _folder(spark, "x05")
    v.steps(spark, sf).select("run", "epoch", "train_loss", "val_loss").write.parquet(path)
    s = spark.readStream.schema("run bigint, epoch int, train_loss double, val_loss double").parquet(path)
    return incremental.drained(incremental.divergence(s), "x05")
