"""Registered queries on metadata relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import numbers, paths
from quern.operators import metadata as m
from quern.plans import views as v
from quern.plans.registry import query
from quern.session import table

_BIN = """CASE WHEN length(text) > 0 AND length(text) <= 50 THEN 'short' WHEN length(text) > 50 AND length(text) <= 100 THEN 'medium'
 WHEN length(text) > 100 AND length(text) <= 150 THEN 'long' WHEN length(text) > 150 THEN 'very_long' END"""
_STRIP = r"regexp_replace(coalesce(text, ''), '^[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}]+|[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}]+$', '', 'g')"
_SPLIT = f"""binned AS (SELECT *, {_BIN} AS bin FROM meta WHERE {_BIN} IS NOT NULL),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5('42|' || audio_file), audio_file) AS nth,
         count(*) OVER (PARTITION BY bin) AS n FROM binned
),
parted AS (SELECT *, CASE WHEN nth <= greatest(1, floor(n * CAST(0.1 AS DOUBLE))) THEN 'val' ELSE 'train' END AS split FROM numbered)"""


@query("z00_split_report", f"""WITH {v.META_SQL}, {_SPLIT},
r AS (
  SELECT count(*) FILTER (WHERE split <> 'val') AS n_train, count(*) FILTER (WHERE split = 'val') AS n_val,
    avg(length(text)) FILTER (WHERE split <> 'val') AS train_mean, avg(length(text)) FILTER (WHERE split = 'val') AS val_mean,
    stddev_pop(length(text)) FILTER (WHERE split <> 'val') AS train_std, stddev_pop(length(text)) FILTER (WHERE split = 'val') AS val_std
  FROM parted
),
d AS (SELECT *, abs(train_mean - val_mean) / train_mean * 100 AS drift_pct, 100.0::DOUBLE * n_val / (n_train + n_val) AS val_pct FROM r)
SELECT *, CASE WHEN drift_pct < 5 THEN 'excellent' WHEN drift_pct < 10 THEN 'good' WHEN drift_pct < 20 THEN 'acceptable' ELSE 'poor' END AS drift_verdict,
  CASE WHEN val_pct BETWEEN 8 AND 15 THEN 'optimal' WHEN val_pct BETWEEN 5 AND 20 THEN 'acceptable' ELSE 'off' END AS size_verdict FROM d""")
def z00(spark, sf):
    return m.split_drift(m.stratified_split(v.meta(spark, sf)))


@query("u11_stratified_split", f"WITH {v.META_SQL}, {_SPLIT} SELECT audio_file, bin, split FROM parted")
def u11(spark, sf):
    return m.stratified_split(v.meta(spark, sf)).select("audio_file", "bin", "split")


@query("a05_length_histogram", f"WITH {v.META_SQL} SELECT {_BIN} AS bin, count(*) AS n, avg(length(text)) AS mean_chars FROM meta WHERE {_BIN} IS NOT NULL GROUP BY 1")
def a05(spark, sf):
    return m.length_histogram(v.meta(spark, sf))


@query("p01_duration_filter", f"WITH {v.CLIPS_SQL} SELECT audio_file, duration FROM clips WHERE duration BETWEEN 1 AND 18")
def p01(spark, sf):
    return m.duration_filter(v.clips(spark, sf)).select("audio_file", "duration")


@query("p01_duration_report", f"""WITH {v.CLIPS_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE duration BETWEEN 1 AND 18) AS valid,
  count(*) FILTER (WHERE NOT coalesce(duration BETWEEN 1 AND 18, false)) AS filtered FROM clips""")
def p01r(spark, sf):
    return m.duration_report(v.clips(spark, sf))


@query("p02_index_filter", f"WITH {v.CLIPS_SQL} SELECT audio_file FROM clips WHERE CAST(split_part(split_part(audio_file, '_', 2), '.', 1) AS BIGINT) >= 5")
def p02(spark, sf):
    return m.index_filter(v.clips(spark, sf), 5).select("audio_file")


@query("p03_arity_check", """SELECT count(*) AS n_rows, count(*) FILTER (WHERE len(string_split(c_name || '|' || c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN '|x' ELSE '' END, '|')) <> 3) AS n_bad FROM customer""")
def p03(spark, sf):
    line = F.concat_ws("|", "c_name", "c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "x"))
    fields = F.size(F.split(line, r"\|"))
    return table(spark, sf, "customer").agg(F.count("*").alias("n_rows"), F.count_if(fields != 3).alias("n_bad"))


@query("p04_path_repair", f"""WITH {v.META_SQL},
f AS (SELECT DISTINCT CASE WHEN toxic = 0 THEN 'wavs/' ELSE 'dataset/wavs/' END || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.wav' AS path FROM labels)
SELECT coalesce(a.path, b.path) AS audio_file, meta.pos AS pos FROM meta
LEFT JOIN f a ON a.path = meta.audio_file LEFT JOIN f b ON b.path = 'dataset/' || meta.audio_file WHERE coalesce(a.path, b.path) IS NOT NULL""")
def p04(spark, sf):
    name = F.concat(F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".wav"))
    files = table(spark, sf, "labels").select(F.concat(F.when(F.col("toxic") == 0, "wavs/").otherwise("dataset/wavs/"), name).alias("path"))
    prefixes = ("finetune_models/dataset/wavs", "dataset/wavs", "wavs")
    return m.repaired_paths(v.meta(spark, sf), files, prefixes).select("audio_file", "pos")


@query("p05_speaker_column", f"""WITH {v.META_SQL} SELECT audio_file, CASE WHEN lower(trim(lang)) IN ('am', 'amh', 'en', 'speaker', 'unknown', '') THEN 'speaker' ELSE lang END AS speaker_name FROM meta""")
def p05(spark, sf):
    return v.meta(spark, sf).select("audio_file", m.speaker_column(F.col("lang")).alias("speaker_name"))


@query("p06_text_counters", f"""WITH {v.META_SQL} SELECT speaker_name, count(*) AS n_rows, count(*) FILTER (WHERE length({_STRIP}) = 0) AS n_empty,
  count(*) FILTER (WHERE length({_STRIP}) BETWEEN 1 AND 2) AS n_short FROM meta GROUP BY speaker_name""")
def p06(spark, sf):
    return m.text_counters(v.meta(spark, sf), "speaker_name")


@query("p07_size_gates", f"""WITH {v.META_SQL}, c AS (SELECT speaker_name, count(*) AS n FROM meta GROUP BY 1)
SELECT speaker_name, n, CASE WHEN n < 20 THEN 'fail' WHEN n < 50 THEN 'warn' ELSE 'pass' END AS train_verdict,
  CASE WHEN n < 3 THEN 'fail' WHEN n < 5 THEN 'warn' ELSE 'pass' END AS eval_verdict FROM c""")
def p07(spark, sf):
    n = F.col("n")
    return v.meta(spark, sf).groupBy("speaker_name").agg(F.count("*").alias("n")).select(
        "speaker_name", "n", m.size_gate(n, 20, 50).alias("train_verdict"), m.size_gate(n, 3, 5).alias("eval_verdict")
    )


@query("p08_validation_report", f"""WITH {v.META_SQL}, s AS (SELECT *, CASE WHEN pos % 10 = 0 THEN 'eval' ELSE 'train' END AS split FROM meta),
g AS (SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE coalesce(audio_file, '') = '') AS n_no_file,
  count(*) FILTER (WHERE lower(trim(lang)) IN ('am', 'amh', 'en', 'speaker', 'unknown', '')) AS n_speaker_fixed,
  count(*) FILTER (WHERE length({_STRIP}) = 0) AS n_empty, count(*) FILTER (WHERE length({_STRIP}) BETWEEN 1 AND 2) AS n_short FROM s GROUP BY split),
w AS (SELECT *, CASE WHEN split = 'train' THEN CASE WHEN n_rows < 20 THEN 'fail' WHEN n_rows < 50 THEN 'warn' ELSE 'pass' END
  ELSE CASE WHEN n_rows < 3 THEN 'fail' WHEN n_rows < 5 THEN 'warn' ELSE 'pass' END END AS size_verdict FROM g)
SELECT *, size_verdict <> 'fail' AND n_no_file = 0 AND n_empty = 0 AS valid FROM w""")
def p08(spark, sf):
    rows = v.meta(spark, sf).withColumn("split", F.when(F.col("pos") % 10 == 0, "eval").otherwise("train"))
    return m.validation_report(rows.withColumn("speaker_name", F.col("lang")))


@query("p09_first_issues", f"""WITH {v.META_SQL}, x AS (SELECT meta.*, l.doc_id IS NOT NULL AS there, coalesce(l.quality, 0) = 1 AS good FROM meta LEFT JOIN labels l ON l.doc_id = meta.pos),
i AS (SELECT audio_file, pos, CASE WHEN NOT there THEN 'missing file' WHEN length({_STRIP}) < 3 THEN 'short text' WHEN NOT good THEN 'poor audio' END AS issue FROM x)
SELECT audio_file, issue FROM i WHERE issue IS NOT NULL ORDER BY pos LIMIT 10""")
def p09(spark, sf):
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("pos"), "quality", F.lit(True).alias("there"))
    rows = v.meta(spark, sf).join(labels, "pos", "left")
    there, good = F.coalesce("there", F.lit(False)), F.coalesce("quality", F.lit(0)) == 1
    return m.first_issue(rows, there, good).filter("issue is not null").orderBy("pos").limit(10).select("audio_file", "issue")


@query("p22_structure_check", """SELECT source, list_sort(list_filter(['metadata_train.csv', 'metadata_eval.csv', 'lang.txt', 'wavs'],
  lambda x: NOT list_contains(list(DISTINCT CASE n_chars % 7 WHEN 0 THEN 'metadata_train.csv' WHEN 1 THEN 'metadata_eval.csv' WHEN 2 THEN 'lang.txt' WHEN 3 THEN 'wavs' ELSE 'x' END), x))) AS missing
FROM documents GROUP BY source""")
def p22(spark, sf):
    names = F.array(*[F.lit(x) for x in ("metadata_train.csv", "metadata_eval.csv", "lang.txt", "wavs", "x")])
    rows = table(spark, sf, "documents").select("source", F.element_at(names, (F.least(F.col("n_chars") % 7, F.lit(4)) + 1).cast("int")).alias("name"))
    need = F.array(*[F.lit(x) for x in ("metadata_train.csv", "metadata_eval.csv", "lang.txt", "wavs")])
    return rows.groupBy("source").agg(F.sort_array(F.array_except(need, F.collect_set("name"))).alias("missing"))


@query("p23_small_dataset", "SELECT source, count(*) < 3000 AS small FROM documents GROUP BY source")
def p23(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg((F.count("*") < 3000).alias("small"))


_TIMING_ROWS = """t AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_custkey AS VARCHAR) END AS start_time, CASE WHEN o_orderkey % 5 = 0 THEN '9.5' END AS end_time,
  CASE WHEN o_orderkey % 5 = 1 THEN '1.25' WHEN o_orderkey % 5 = 2 THEN 'bad' END AS "start", CASE WHEN o_orderkey % 5 IN (1, 2) THEN '2.5' END AS "end",
  CASE WHEN o_orderkey % 5 = 2 THEN '3.5-4.75' WHEN o_orderkey % 5 = 3 THEN '5.5:6.25' END AS "timestamp",
  'clip_' || CAST(o_orderkey AS VARCHAR) || '_7.5_' || CAST(o_custkey AS VARCHAR) || '.25.wav' AS audio_file FROM orders)"""


@query("p29_timing", f"""WITH {_TIMING_ROWS}
SELECT k, CASE k % 5 WHEN 0 THEN CAST(start_time AS DOUBLE) WHEN 1 THEN 1.25 WHEN 2 THEN 3.5 WHEN 3 THEN 5.5 ELSE 7.5 END AS "start",
  CASE k % 5 WHEN 0 THEN 9.5 WHEN 1 THEN 2.5 WHEN 2 THEN 4.75 WHEN 3 THEN 6.25 ELSE CAST(regexp_extract(audio_file, '_(\\d+\\.25)', 1) AS DOUBLE) END AS "end" FROM t""")
def p29(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey")
    r = F.col("k") % 5
    rows = o.select(
        "k",
        F.when(r == 0, F.col("o_custkey").cast("string")).alias("start_time"),
        F.when(r == 0, "9.5").alias("end_time"),
        F.when(r == 1, "1.25").when(r == 2, "bad").alias("start"),
        F.when(r.isin(1, 2), "2.5").alias("end"),
        F.when(r == 2, "3.5-4.75").when(r == 3, "5.5:6.25").alias("timestamp"),
        F.concat(F.lit("clip_"), F.col("k").cast("string"), F.lit("_7.5_"), F.col("o_custkey").cast("string"), F.lit(".25.wav")).alias("audio_file"),
    )
    return m.timing(rows).select("k", "timing.start", "timing.end")


# --- joins ------------------------------------------------------------------------------------

_PAIR = """s AS (SELECT doc_id, 'subs/Clip' || CAST(doc_id % 700 AS VARCHAR) || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '_2025am' ELSE '.fr' END || '.srt' AS srt FROM documents),
md AS (SELECT vec_id AS pos, 'media/CLIP' || CAST(vec_id % 400 AS VARCHAR) || '.mp4' AS path FROM embeddings)"""


@query("j01_pair_by_name", rf"""WITH {_PAIR},
l AS (SELECT lower(regexp_extract(path, '([^/]*)\.mp4$', 1)) AS stem, arg_max(path, pos) AS media FROM md GROUP BY 1),
k AS (SELECT srt, lower(regexp_extract(srt, '([^/]*)\.srt$', 1)) AS k1, regexp_replace(lower(regexp_extract(srt, '([^/]*)\.srt$', 1)), '[._-]?(20\d\d)?({paths.LANGUAGE_MARKS})$', '') AS k2 FROM s)
SELECT srt, coalesce(a.media, b.media) AS media FROM k LEFT JOIN l a ON a.stem = k1 LEFT JOIN l b ON b.stem = k2 AND k2 <> k1 WHERE coalesce(a.media, b.media) IS NOT NULL""")
def j01(spark, sf):
    d = table(spark, sf, "documents")
    mark = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, "_2025am").otherwise(".fr")
    subs = d.select(F.concat(F.lit("subs/Clip"), (F.col("doc_id") % 700).cast("string"), mark, F.lit(".srt")).alias("srt"))
    media = table(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"), F.concat(F.lit("media/CLIP"), (F.col("vec_id") % 400).cast("string"), F.lit(".mp4")).alias("path"))
    return m.pair_by_name(subs, media)


_FILES = "files AS (SELECT 'wavs/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.wav' AS audio_file FROM labels)"


def _files(spark, sf):
    return table(spark, sf, "labels").select(F.concat(F.lit("wavs/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".wav")).alias("audio_file"))


@query("j02_existing_files", f"WITH {v.META_SQL}, {_FILES} SELECT audio_file, speaker_name FROM meta WHERE audio_file IN (SELECT audio_file FROM files)")
def j02(spark, sf):
    return m.existing(v.meta(spark, sf), _files(spark, sf), "audio_file").select("audio_file", "speaker_name")


@query("j03_removed_and_kept", f"WITH {v.META_SQL}, {_FILES} SELECT audio_file, CASE WHEN audio_file IN (SELECT audio_file FROM files) THEN 'removed' ELSE 'kept' END AS status FROM meta")
def j03(spark, sf):
    rows, files = v.meta(spark, sf).select("audio_file"), _files(spark, sf)
    return m.existing(rows, files, "audio_file").withColumn("status", F.lit("removed")).unionByName(m.missing(rows, files, "audio_file").withColumn("status", F.lit("kept")))


@query("j04_rename_paths", f"""WITH {v.META_SQL}, r AS (SELECT lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.wav' AS old, 'merged_' || lpad(CAST(doc_id + 100 AS VARCHAR), 8, '0') || '.wav' AS new FROM labels)
SELECT pos, 'wavs/' || coalesce(r.new, substr(audio_file, 6)) AS audio_file FROM meta LEFT JOIN r ON r.old = substr(audio_file, 6)""")
def j04(spark, sf):
    lab = table(spark, sf, "labels")
    mapping = lab.select(F.concat(F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".wav")).alias("old"), paths.merged_name(F.col("doc_id") + 100).alias("new"))
    return m.renamed(v.meta(spark, sf), mapping).select("pos", "audio_file")


@query("j05_hash_dedup", f"""WITH {v.META_SQL}, h AS (SELECT *, CASE WHEN pos % 97 <> 0 THEN sha256(text) END AS h FROM meta), b AS (SELECT DISTINCT h FROM h WHERE pos % 2 = 0 AND h IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY pos) AS nth FROM h WHERE pos % 2 = 1)
SELECT audio_file, CASE WHEN n.h IS NULL THEN 'error' WHEN b.h IS NOT NULL THEN 'duplicate' WHEN nth = 1 THEN 'added' ELSE 'duplicate' END AS status FROM n LEFT JOIN b ON b.h = n.h""")
def j05(spark, sf):
    rows = v.meta(spark, sf).withColumn("h", F.when(F.col("pos") % 97 != 0, F.sha2("text", 256)))
    return m.merge_by_content(rows.filter("pos % 2 = 0"), rows.filter("pos % 2 = 1"), "h", "pos").select("audio_file", "status")


_QUEUE = """q AS (SELECT o_orderkey AS queue_id, CASE WHEN o_orderkey % 2 = 0 THEN 'srt' ELSE 'audio' END AS type, 'f' || CAST(o_custkey AS VARCHAR) AS file_name, md5(CAST(o_custkey % 50 AS VARCHAR)) AS file_hash FROM orders),
hi AS (SELECT c_custkey AS pos, CASE WHEN c_custkey % 3 = 0 THEN 'srt' ELSE 'audio' END AS type, 'f' || CAST(c_custkey * 2 AS VARCHAR) AS file_name, CASE WHEN c_custkey % 10 = 0 THEN md5(CAST(c_custkey AS VARCHAR)) END AS file_hash FROM customer)"""


@query("j06_processed_files", f"WITH {_QUEUE} SELECT queue_id, min(hi.pos) AS found_at FROM q LEFT JOIN hi ON q.type = hi.type AND (q.file_name = hi.file_name OR q.file_hash = hi.file_hash) GROUP BY queue_id")
def j06(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    queue = o.select(
        F.col("o_orderkey").alias("queue_id"), F.when(F.col("o_orderkey") % 2 == 0, "srt").otherwise("audio").alias("type"),
        F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("file_name"), F.md5((F.col("o_custkey") % 50).cast("string")).alias("file_hash"),
    )
    history = c.select(
        F.col("c_custkey").alias("pos"), F.when(F.col("c_custkey") % 3 == 0, "srt").otherwise("audio").alias("type"),
        F.concat(F.lit("f"), (F.col("c_custkey") * 2).cast("string")).alias("file_name"), F.when(F.col("c_custkey") % 10 == 0, F.md5(F.col("c_custkey").cast("string"))).alias("file_hash"),
    )
    return m.processed_files(queue, history).select("queue_id", "found_at")


@query("j07_processed_videos", """SELECT page_id FROM pages p WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id % 200 = p.page_id % 300 AND d.lang = CASE WHEN p.page_id % 2 = 0 THEN 'en' ELSE 'fr' END AND d.source <> 'src0')""")
def j07(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", (F.col("page_id") % 300).alias("video_id"), F.when(F.col("page_id") % 2 == 0, "en").otherwise("fr").alias("language"))
    seen = table(spark, sf, "documents").filter("source <> 'src0'").select((F.col("doc_id") % 200).alias("video_id"), F.col("lang").alias("language")).distinct()
    return pages.join(seen, ["video_id", "language"], "left_semi").select("page_id")


@query("j08_unprocessed_sources", """WITH s AS (SELECT c_custkey, 'in/o' || CAST(c_custkey AS VARCHAR) || '.mp4' AS source FROM customer), r AS (SELECT 'wavs/o' || CAST(o_orderkey * 2 AS VARCHAR) || '_' || CAST(o_custkey AS VARCHAR) || '_0.wav' AS audio_file FROM orders)
SELECT source FROM s WHERE NOT EXISTS (SELECT 1 FROM r WHERE split_part(audio_file, '_', 1) = 'wavs/' || split_part(split_part(source, '/', 2), '.', 1))""")
def j08(spark, sf):
    s = table(spark, sf, "customer").select(F.concat(F.lit("in/o"), F.col("c_custkey").cast("string"), F.lit(".mp4")).alias("source"))
    r = table(spark, sf, "orders").select(F.concat(F.lit("wavs/o"), (F.col("o_orderkey") * 2).cast("string"), F.lit("_"), F.col("o_custkey").cast("string"), F.lit("_0.wav")).alias("audio_file"))
    return m.unprocessed_sources(s, r)


@query("j14_language_compatible", """WITH l AS (SELECT source, min(lang) AS lang FROM documents WHERE doc_id % 2 = 0 GROUP BY source), r AS (SELECT source, min(lang) AS lang FROM documents WHERE doc_id % 2 = 1 GROUP BY source)
SELECT coalesce(l.source, r.source) AS source, coalesce(l.lang = r.lang, true) AS compatible FROM l FULL JOIN r ON l.source = r.source""")
def j14(spark, sf):
    d = table(spark, sf, "documents")
    one = lambda k, n: d.filter(F.col("doc_id") % 2 == k).groupBy("source").agg(F.min("lang").alias(n))
    return one(0, "a").join(one(1, "b"), "source", "full").select("source", F.coalesce(F.col("a") == F.col("b"), F.lit(True)).alias("compatible"))


# --- sets, order, splits ----------------------------------------------------------------------


@query("w20_keep_first", f"WITH {v.META_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY pos) AS nth FROM meta) SELECT audio_file FROM n WHERE nth = 1")
def w20(spark, sf):
    return m.keep_first(v.meta(spark, sf), ["text"], "pos").select("audio_file")


@query("u01_union_all", f"WITH {v.META_SQL} SELECT speaker_name, count(*) AS n FROM (SELECT * FROM meta UNION ALL SELECT * FROM meta WHERE pos % 3 = 0) GROUP BY speaker_name")
def u01(spark, sf):
    rows = v.meta(spark, sf)
    return rows.unionByName(rows.filter("pos % 3 = 0")).groupBy("speaker_name").agg(F.count("*").alias("n"))


@query("u02_union_distinct", f"WITH {v.META_SQL} SELECT text, lang FROM meta WHERE pos % 3 <> 1 UNION SELECT text, lang FROM meta WHERE pos % 3 <> 2")
def u02(spark, sf):
    rows = v.meta(spark, sf).select("text", "lang", "pos")
    return rows.filter("pos % 3 <> 1").unionByName(rows.filter("pos % 3 <> 2")).drop("pos").distinct()


@query("u03_merge_keep_first", f"""WITH {v.META_SQL}, u AS (SELECT 0 AS src, pos, audio_file, speaker_name FROM meta WHERE pos % 3 <> 1
  UNION ALL SELECT 1, pos, 'wavs/' || lpad(CAST(pos - pos % 4 AS VARCHAR), 8, '0') || '.wav', 'new' FROM meta WHERE pos % 3 <> 2),
n AS (SELECT *, row_number() OVER (PARTITION BY audio_file ORDER BY src, pos) AS nth FROM u) SELECT audio_file, speaker_name, src FROM n WHERE nth = 1""")
def u03(spark, sf):
    rows = v.meta(spark, sf).select("audio_file", "speaker_name", "pos")
    other = rows.filter("pos % 3 <> 2").select(F.concat(F.lit("wavs/"), F.lpad((F.col("pos") - F.col("pos") % 4).cast("string"), 8, "0"), F.lit(".wav")).alias("audio_file"), F.lit("new").alias("speaker_name"), "pos")
    return m.merged([rows.filter("pos % 3 <> 1"), other]).select("audio_file", "speaker_name", "src")


@query("u05_except", "SELECT DISTINCT lang, source, n_chars FROM documents WHERE doc_id % 2 = 0 EXCEPT SELECT lang, source, n_chars FROM documents WHERE doc_id % 2 = 1")
def u05(spark, sf):
    d = table(spark, sf, "documents")
    return d.filter("doc_id % 2 = 0").select("lang", "source", "n_chars").distinct().subtract(d.filter("doc_id % 2 = 1").select("lang", "source", "n_chars"))


@query("u06_intersect", "SELECT lang, source, n_chars % 60 AS size FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT lang, source, n_chars % 60 FROM documents WHERE doc_id % 2 = 1")
def u06(spark, sf):
    d = table(spark, sf, "documents")
    return d.filter("doc_id % 2 = 0").selectExpr("lang", "source", "n_chars % 60 AS size").intersect(d.filter("doc_id % 2 = 1").selectExpr("lang", "source", "n_chars % 60 AS size"))


@query("u07_standard_merge", f"""WITH {v.META_SQL}, {_FILES}, e AS (SELECT *, CASE WHEN pos % 10 = 0 THEN 1 ELSE 0 END AS split_ord FROM meta WHERE audio_file IN (SELECT audio_file FROM files))
SELECT pos, 'wavs/merged_' || lpad(CAST(row_number() OVER (ORDER BY pos % 3, split_ord, pos) - 1 AS VARCHAR), 8, '0') || '.wav' AS audio_file FROM e""")
def u07(spark, sf):
    rows = m.existing(v.meta(spark, sf), _files(spark, sf), "audio_file")
    rows = rows.withColumn("ds_ord", F.col("pos") % 3).withColumn("split_ord", F.when(F.col("pos") % 10 == 0, 1).otherwise(0))
    return m.renumbered(rows, 0, "ds_ord", "split_ord", "pos").select("pos", "audio_file")


@query("w01_renumber", f"WITH {v.META_SQL} SELECT pos, 'wavs/merged_' || lpad(CAST(row_number() OVER (ORDER BY pos) + 41 AS VARCHAR), 8, '0') || '.wav' AS audio_file FROM meta")
def w01(spark, sf):
    return m.renumbered(v.meta(spark, sf), 42, "pos").select("pos", "audio_file")


def _random_sql(take: str) -> str:
    return f"""WITH {v.META_SQL}, n AS (SELECT audio_file, row_number() OVER (ORDER BY md5('42|' || audio_file), audio_file) AS nth, count(*) OVER () AS n FROM meta)
SELECT audio_file, CASE WHEN nth <= {take} THEN 'eval' ELSE 'train' END AS split FROM n"""


@query("u08_split_train_floor", _random_sql("n - floor(n * CAST(0.85 AS DOUBLE))"))
def u08(spark, sf):
    return m.random_split(v.meta(spark, sf), "train_floor").select("audio_file", "split")


@query("u09_split_eval_floor", _random_sql("floor(n * CAST(0.15 AS DOUBLE))"))
def u09(spark, sf):
    return m.random_split(v.meta(spark, sf), "eval_floor").select("audio_file", "split")


@query("u10_split_eval_min3", _random_sql("CASE WHEN n >= 3 THEN greatest(3, floor(n * CAST(0.15 AS DOUBLE))) ELSE n END"))
def u10(spark, sf):
    return m.random_split(v.meta(spark, sf), "eval_min3").select("audio_file", "split")


@query("u12_replicate", f"WITH {v.META_SQL} SELECT audio_file, CAST(copy AS INTEGER) AS copy FROM meta, range(1, 4) t(copy)")
def u12(spark, sf):
    return m.repeated_rows(v.meta(spark, sf), 3).select("audio_file", "copy")


@query("u13_template_rows", "SELECT p_partkey, t.n AS form, CASE t.n WHEN 0 THEN p_name WHEN 1 THEN p_name || ' ነው' ELSE p_name || ' እና red widget' END AS text FROM part, (VALUES (0), (1), (2)) t(n)")
def u13(spark, sf):
    forms = F.array(F.col("p_name"), F.concat("p_name", F.lit(" ነው")), F.concat("p_name", F.lit(" እና red widget")))
    return table(spark, sf, "part").select("p_partkey", F.posexplode(forms).alias("form", "text"))


@query("o01_history", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 20")
def o01(spark, sf):
    return table(spark, sf, "events").orderBy(F.col("ts").desc_nulls_last(), "event_id").limit(20).select("event_id", "ts")


@query("o02_sorted_metadata", f"WITH {v.META_SQL} SELECT audio_file FROM meta ORDER BY audio_file")
def o02(spark, sf):
    return v.meta(spark, sf).select("audio_file").orderBy("audio_file")


@query("o05_preview", f"WITH {v.META_SQL} SELECT audio_file, CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END AS preview FROM meta ORDER BY pos LIMIT 5")
def o05(spark, sf):
    from quern.functions.text import preview

    return v.meta(spark, sf).orderBy("pos").limit(5).select("audio_file", preview(F.col("text")).alias("preview"))


@query("o08_remove_by_index", f"WITH {v.META_SQL} SELECT audio_file FROM meta WHERE pos <> 7")
def o08(spark, sf):
    return v.meta(spark, sf).filter("pos <> 7").select("audio_file")


@query("o09_append_history", "SELECT 'youtube' AS type, CAST(page_id AS VARCHAR) AS name FROM pages UNION ALL SELECT 'file', source FROM documents")
def o09(spark, sf):
    a = table(spark, sf, "pages").select(F.lit("youtube").alias("type"), F.col("page_id").cast("string").alias("name"))
    return a.unionByName(table(spark, sf, "documents").select(F.lit("file").alias("type"), F.col("source").alias("name")))


@query("o10_old_checkpoints", "WITH n AS (SELECT o_custkey AS run, o_orderkey AS checkpoint, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS nth FROM orders) SELECT run, checkpoint FROM n WHERE nth > 5")
def o10(spark, sf):
    from pyspark.sql import Window as W

    o = table(spark, sf, "orders")
    newest = W.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), "o_orderkey")
    return o.withColumn("nth", F.row_number().over(newest)).filter("nth > 5").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("checkpoint"))


# --- aggregations -----------------------------------------------------------------------------


@query("a01_dataset_statistics", f"""WITH {v.CLIPS_SQL}, r AS (SELECT count(*) AS total, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split <> 'train') AS eval,
  sum(duration) AS total_s, coalesce(sum(duration) FILTER (WHERE split = 'train'), 0.0) AS train_s, coalesce(sum(duration) FILTER (WHERE split <> 'train'), 0.0) AS eval_s FROM clips)
SELECT *, total_s / 60 AS total_min, total_s / 3600 AS total_h, CASE WHEN total > 0 THEN total_s / total ELSE 0 END AS avg_s,
  CASE WHEN eval > 0 THEN train / eval ELSE 0 END AS ratio, total_s / 3600 >= 10 AS ten_hours FROM r""")
def a01(spark, sf):
    return m.dataset_statistics(v.clips(spark, sf))


@query("a02_quick_statistics", f"WITH {v.META_SQL} SELECT speaker_name, count(*) AS n, count(*) * CAST(10.0 AS DOUBLE) / 3600 AS hours FROM meta GROUP BY speaker_name")
def a02(spark, sf):
    return v.meta(spark, sf).groupBy("speaker_name").agg(F.count("*").alias("n"), (F.count("*") * F.lit(10.0) / 3600).alias("hours"))


@query("a03_project_statistics", f"""WITH {v.CLIPS_SQL} SELECT count(*) AS n, sum(duration) AS total_s, avg(duration) AS avg_s, min(duration) AS min_s, max(duration) AS max_s,
  CAST(sum(length(text)) AS BIGINT) + count(*) - 1 AS chars, CAST(sum(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))) AS BIGINT) AS words,
  CAST(sum(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))) AS DOUBLE) / count(*) AS avg_words, count(DISTINCT speaker_name) AS speakers FROM clips""")
def a03(spark, sf):
    return m.project_statistics(v.clips(spark, sf))


@query("a04_history_statistics", "SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'view') AS youtube, count(*) FILTER (WHERE event_type = 'click') AS srt, CAST(sum(event_id % 17) AS BIGINT) AS segments, sum(value) AS duration, count(DISTINCT event_type) AS languages FROM events")
def a04(spark, sf):
    return table(spark, sf, "events").agg(
        F.count("*").alias("total"), F.count_if(F.col("event_type") == "view").alias("youtube"), F.count_if(F.col("event_type") == "click").alias("srt"),
        F.sum(F.col("event_id") % 17).alias("segments"), F.sum(F.coalesce("value", F.lit(0.0))).alias("duration"), F.count_distinct("event_type").alias("languages"),
    )


@query("a09_batch_summary", f"WITH {v.CLIPS_SQL} SELECT speaker_name, count(*) AS n, sum(duration) AS total_s, avg(duration) AS avg_s FROM clips GROUP BY speaker_name")
def a09(spark, sf):
    return v.clips(spark, sf).groupBy("speaker_name").agg(F.count("*").alias("n"), F.sum("duration").alias("total_s"), F.avg("duration").alias("avg_s"))


@query("a13_status_rates", f"WITH {v.META_SQL}, s AS (SELECT CASE WHEN text = '' THEN 'empty' WHEN lang = 'en' THEN 'kept' ELSE 'converted' END AS status FROM meta) SELECT status, count(*) AS n, count(*) / sum(count(*)) OVER () AS rate FROM s GROUP BY status")
def a13(spark, sf):
    status = F.when(F.col("text") == "", "empty").when(F.col("lang") == "en", "kept").otherwise("converted")
    by = v.meta(spark, sf).groupBy(status.alias("status")).agg(F.count("*").alias("n"))
    return by.crossJoin(F.broadcast(by.agg(F.sum("n").alias("all")))).select("status", "n", (F.col("n") / F.col("all")).alias("rate"))


@query("a18_next_number", f"WITH {v.CLIPS_SQL} SELECT speaker_name, max(CAST(regexp_extract(audio_file, '_(\\d+)\\.wav', 1) AS BIGINT)) + 1 AS next FROM clips GROUP BY speaker_name")
def a18(spark, sf):
    return v.clips(spark, sf).groupBy("speaker_name").agg(m.next_number(paths.stem(F.col("audio_file"))).alias("next"))


@query("a20_vocab_sizes", "SELECT count(DISTINCT len(embedding)) = 1 AS consistent, max(len(embedding)) AS size FROM embeddings")
def a20(spark, sf):
    return table(spark, sf, "embeddings").agg((F.count_distinct(F.size("embedding")) == 1).alias("consistent"), F.max(F.size("embedding")).cast("long").alias("size"))


@query("a21_staged_counts", f"WITH {v.CLIPS_SQL} SELECT speaker_name AS dataset, split, count(*) AS n FROM clips GROUP BY 1, 2")
def a21(spark, sf):
    return v.clips(spark, sf).groupBy(F.col("speaker_name").alias("dataset"), "split").agg(F.count("*").alias("n"))


@query("a22_bytes_freed", "SELECT sum(n_chars) / 1048576 AS mb FROM documents WHERE source = 'src1'")
def a22(spark, sf):
    return table(spark, sf, "documents").filter("source = 'src1'").agg((F.sum("n_chars") / 1048576).alias("mb"))


@query("a23_fingerprint", f"WITH {v.META_SQL} SELECT substr(sha256(CAST(CAST(sum(CAST(('0x' || substr(sha256(audio_file || '|' || speaker_name), 1, 15)) AS BIGINT)) AS HUGEINT) AS VARCHAR)), 1, 16) AS fingerprint FROM meta")
def a23(spark, sf):
    return m.fingerprint(v.meta(spark, sf), "audio_file", "speaker_name")


@query("a24_merge_totals", f"""WITH {v.META_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY pos % 4, pos) AS nth FROM meta)
SELECT pos % 4 AS dataset_ord, count(*) FILTER (WHERE nth = 1) AS added, count(*) FILTER (WHERE nth > 1) AS duplicates FROM n GROUP BY 1""")
def a24(spark, sf):
    from pyspark.sql import Window as W

    nth = F.row_number().over(W.partitionBy("text").orderBy(F.col("pos") % 4, "pos"))
    rows = v.meta(spark, sf).withColumn("nth", nth)
    return rows.groupBy((F.col("pos") % 4).alias("dataset_ord")).agg(F.count_if(F.col("nth") == 1).alias("added"), F.count_if(F.col("nth") > 1).alias("duplicates"))


@query("a25_latest_model", "SELECT o_custkey AS run, arg_max(o_orderkey, (o_orderdate, -o_orderkey)) AS latest FROM orders GROUP BY o_custkey")
def a25(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", -F.col("o_orderkey"))).alias("latest"))


@query("a27_existing_hashes", "SELECT DISTINCT md5(text) AS h FROM documents WHERE text <> ''")
def a27(spark, sf):
    return table(spark, sf, "documents").filter("text <> ''").select(F.md5("text").alias("h")).distinct()


_WAV = """w AS (SELECT 'clip' || CAST(c_custkey % 40 AS VARCHAR) || '.wav' AS name, c_custkey AS size, 'ds' || CAST(c_nationkey AS VARCHAR) AS ds FROM customer),
mn AS (SELECT 'clip' || CAST(s_suppkey AS VARCHAR) || '.wav' AS name, s_suppkey AS size FROM supplier)"""


@query("p28_merge_decision", f"""WITH {_WAV} SELECT w.name AS src, w.ds AS ds, w.size AS size, CASE WHEN mn.name IS NULL THEN w.name WHEN mn.size = w.size THEN NULL ELSE split_part(w.name, '.', 1) || '_' || w.ds || '.wav' END AS dst,
  CASE WHEN mn.name IS NULL THEN 'copy' WHEN mn.size = w.size THEN 'skip' ELSE 'rename' END AS action FROM w LEFT JOIN mn ON mn.name = w.name""")
def p28(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    w = c.select(F.concat(F.lit("clip"), (F.col("c_custkey") % 40).cast("string"), F.lit(".wav")).alias("name"), F.col("c_custkey").alias("size"), F.concat(F.lit("ds"), F.col("c_nationkey").cast("string")).alias("ds"))
    mn = s.select(F.concat(F.lit("clip"), F.col("s_suppkey").cast("string"), F.lit(".wav")).alias("name"), F.col("s_suppkey").alias("main_size"))
    same = F.col("main_size") == F.col("size")
    action = F.when(F.col("main_size").isNull(), "copy").when(same, "skip").otherwise("rename")
    dst = F.when(F.col("main_size").isNull(), F.col("name")).when(~same, F.concat(paths.stem(F.col("name")), F.lit("_"), F.col("ds"), F.lit(".wav")))
    return w.join(mn, "name", "left").select(F.col("name").alias("src"), "ds", "size", dst.alias("dst"), action.alias("action"))


# --- paths, hashes, times ---------------------------------------------------------------------


@query("f06_video_id", r"SELECT page_id, nullif(regexp_extract(u, '(?:v=|/)([0-9A-Za-z_-]{11}).*', 1), '') AS id FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://www.youtube.com/watch?v=' || substr(md5(url), 1, 11) ELSE url END AS u FROM pages)")
def f06(spark, sf):
    p = table(spark, sf, "pages")
    url = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), F.substring(F.md5("url"), 1, 11))).otherwise(F.col("url"))
    return p.select("page_id", paths.video_id(url).alias("id"))


@query("f05_youtube_id", """SELECT page_id, CASE page_id % 5 WHEN 0 THEN substr(md5(url), 1, 11) WHEN 1 THEN substr(md5(url), 1, 11) WHEN 2 THEN substr(md5(url), 1, 11) WHEN 3 THEN substr(md5(url), 1, 11) END AS id FROM pages""")
def f05(spark, sf):
    p = table(spark, sf, "pages").withColumn("x", F.substring(F.md5("url"), 1, 11))
    r = F.col("page_id") % 5
    url = (
        F.when(r == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), "x", F.lit("&t=3")))
        .when(r == 1, F.concat(F.lit("https://youtu.be/"), "x")).when(r == 2, F.concat(F.lit("https://www.youtube.com/embed/"), "x", F.lit("?a=1")))
        .when(r == 3, F.concat(F.lit("http://youtube.com/v/"), "x")).otherwise(F.col("url"))
    )
    return p.select("page_id", paths.youtube_id(url).alias("id"))


@query("f07_content_hash", """SELECT page_id, substr(sha256(CASE WHEN n <= 8192 THEN t WHEN n <= 16384 THEN substr(t, 1, 8192) ELSE substr(t, 1, 8192) || substr(t, n - 8191) END), 1, 16) AS h
FROM (SELECT page_id, t, length(t) AS n FROM (SELECT page_id, repeat(md5(url), CAST(page_id % 7 AS INTEGER) * 100) AS t FROM pages))""")
def f07(spark, sf):
    t = F.expr("repeat(md5(url), cast(page_id % 7 as int) * 100)").cast("binary")
    return table(spark, sf, "pages").select("page_id", paths.content_hash(t).alias("h"))


@query("f08_content_hash_middle", """SELECT page_id, substr(sha256(CASE WHEN n <= 16384 THEN t ELSE substr(t, 1, 8192) || substr(t, n - 8191) END), 1, 16) AS h
FROM (SELECT page_id, t, length(t) AS n FROM (SELECT page_id, repeat(md5(url), CAST(page_id % 7 AS INTEGER) * 100) AS t FROM pages))""")
def f08(spark, sf):
    t = F.expr("repeat(md5(url), cast(page_id % 7 as int) * 100)").cast("binary")
    return table(spark, sf, "pages").select("page_id", paths.content_hash(t, True).alias("h"))


@query("f09_path_parts", r"SELECT doc_id, 'a.b/' || source || '.tar.gz' AS path, source || '.tar' AS stem, source || '.tar.gz' AS base, '.gz' AS suffix, 'a.b' AS parent FROM documents")
def f09(spark, sf):
    p = F.concat(F.lit("a.b/"), F.col("source"), F.lit(".tar.gz"))
    return table(spark, sf, "documents").select("doc_id", p.alias("path"), paths.stem(p).alias("stem"), paths.basename(p).alias("base"), paths.suffix(p).alias("suffix"), paths.parent(p).alias("parent"))


@query("f11_step_of_name", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE o_custkey END AS step FROM orders")
def f11(spark, sf):
    r = F.col("o_orderkey") % 4
    name = F.concat(F.when(r == 0, "checkpoint_").when(r == 1, "best_model_").when(r == 2, "model_").otherwise("other_"), F.col("o_custkey").cast("string"), F.lit(".pth"))
    return table(spark, sf, "orders").select("o_orderkey", paths.step_of(name).alias("step"))


@query("f10_padded_names", "SELECT o_orderkey, 'merged_' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || '.wav' AS name FROM orders")
def f10(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", paths.merged_name(F.col("o_orderkey")).alias("name"))


@query("f26_srt_time", """SELECT event_id, printf('%02d:%02d:%02d,%03d', w // 3600, w % 3600 // 60, w % 60, CAST(floor((s - w) * 1000) AS BIGINT)) AS t FROM (SELECT event_id, s, CAST(floor(s) AS BIGINT) AS w FROM (SELECT event_id, value * 37 AS s FROM events))""")
def f26(spark, sf):
    return table(spark, sf, "events").select("event_id", numbers.srt_time(F.col("value") * 37).alias("t"))


@query("f27_srt_seconds", """SELECT event_id, CAST(event_id % 24 AS DOUBLE) * 3600 + (event_id % 60) * 60 + (event_id % 59) + CAST(event_id % 1000 AS DOUBLE) / 1000 AS s FROM events""")
def f27(spark, sf):
    e = F.col("event_id")
    t = F.format_string("%02d:%02d:%02d,%03d", e % 24, e % 60, e % 59, e % 1000)
    return table(spark, sf, "events").select("event_id", numbers.srt_seconds(t).alias("s"))


@query("f28_duration_text", """SELECT event_id, CASE WHEN s < 60 THEN printf('%.1fs', s) WHEN s < 3600 THEN printf('%dm %ds', w // 60, w % 60) ELSE printf('%dh %dm', w // 3600, w % 3600 // 60) END AS d
FROM (SELECT event_id, s, CAST(floor(s) AS BIGINT) AS w FROM (SELECT event_id, CAST(event_id % 9000 AS DOUBLE) + 0.5 * (event_id % 2) AS s FROM events))""")
def f28(spark, sf):
    s = (F.col("event_id") % 9000).cast("double") + F.lit(0.5) * (F.col("event_id") % 2)
    return table(spark, sf, "events").select("event_id", numbers.duration_text(s).alias("d"))


@query("f29_iso_display", "SELECT event_id, replace(left(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), 19), 'T', ' ') AS shown FROM events")
def f29(spark, sf):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return table(spark, sf, "events").select("event_id", F.replace(F.substring(iso, 1, 19), F.lit("T"), F.lit(" ")).alias("shown"))


@query("f30_epoch_of_step", "SELECT o_orderkey, o_orderkey // 569 AS epoch FROM orders")
def f30(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 569).alias("epoch"))


@query("f31_middle_window", "SELECT event_id, CAST(floor((value - 40) / 2) AS BIGINT) AS start_s FROM events WHERE value > 40")
def f31(spark, sf):
    return table(spark, sf, "events").filter("value > 40").select("event_id", F.floor((F.col("value") - 40) / 2).alias("start_s"))


@query("f32_db_to_amplitude", "SELECT event_id, pow(10.0, -value / 20) AS a FROM events")
def f32(spark, sf):
    return table(spark, sf, "events").select("event_id", numbers.db_to_amplitude(-F.col("value")).alias("a"))
