"""Registered queries that join operators to pipelines, and small rules."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.functions import g2p, paths
from quern.functions import tables as t
from quern.functions import text as x
from quern.operators import metadata as m
from quern.operators import segments as g
from quern.operators import signal as sg
from quern.operators import training as tr
from quern.plans import q_metadata, q_segments, q_signal, q_sources, q_text
from quern.plans import views as v
from quern.plans.registry import query
from quern.session import shared_dir, stored, table
from quern.sources import readers, subtitles, writers

# --- text -------------------------------------------------------------------------------------


@query("f13_language_mark", rf"""SELECT doc_id, regexp_replace(s, '[._-]?(20\d\d)?({paths.LANGUAGE_MARKS})$', '') AS stem FROM (SELECT doc_id, source || '_2025' || lang AS s FROM documents)""")
def f13(spark, sf):
    return table(spark, sf, "documents").select("doc_id", paths.without_language(F.concat("source", F.lit("_2025"), "lang")).alias("stem"))


@query("f43_hybrid_text", f"WITH {q_text._SYM} SELECT p_partkey, {q_text._collapse(q_text._each_number('z', '[0-9]+', q_text._am('CAST({m} AS BIGINT)')))} AS text FROM (SELECT p_partkey, {q_text._symbols_sql('s')} AS z FROM sy)")
def f43(spark, sf):
    return q_text._sym(spark, sf).select("p_partkey", g2p.hybrid_text(F.col("s")).alias("text"))


@query("f61_labiovelars", f"WITH {v.FIDEL_SQL}, f AS (SELECT doc_id, translate(text, 'ቀከገ', 'ቍኳዃ') AS s FROM fidel) SELECT doc_id, {q_text._replaces('s', t.LABIOVELARS_FALLBACK.items())} AS ipa FROM f")
def f61(spark, sf):
    s = F.translate("text", "ቀከገ", "ቍኳዃ")
    return v.fidel(spark, sf).select("doc_id", g2p.labiovelars(s).alias("ipa"))


@query("f65_basic_convert")
def f65(spark, sf):
    return v.fidel(spark, sf).select("doc_id", g2p.basic_convert(F.col("text")).alias("ipa"))


@query("j16_phrase_lookup", f"WITH {v.FIDEL_SQL} SELECT doc_id, {q_text._lookup_sql('s')} AS ipa FROM (SELECT doc_id, text || ' ቋንቋ ጓደኛ።' AS s FROM fidel)")
def j16(spark, sf):
    return v.fidel(spark, sf).select("doc_id", g2p.lookup(F.concat("text", F.lit(" ቋንቋ ጓደኛ።"))).alias("ipa"))


@query("p17_contains_ethiopic_narrow", f"WITH {v.FIDEL_SQL} SELECT doc_id, regexp_matches(text, '[\\x{{1200}}-\\x{{137F}}]') AS amharic FROM fidel")
def p17(spark, sf):
    return v.fidel(spark, sf).select("doc_id", x.is_ethiopic(F.col("text"), False).alias("amharic"))


@query("p31_backend_choice", "SELECT 'rule_based' AS auto, 'epitran' AS preferred, 'transphone' AS fallback, CAST(NULL AS VARCHAR) AS none")
def p31(spark, sf):
    have = ["transphone", "epitran", "rule_based"]
    picks = {"auto": readers.chosen_backend(["rule_based"]), "preferred": readers.chosen_backend(have, "Epitran"), "fallback": readers.chosen_backend(have, "x"), "none": readers.chosen_backend(have, "x", False)}
    return spark.range(1).select(*[F.lit(p).cast("string").alias(k) for k, p in picks.items()])


# --- statistics, sets ---------------------------------------------------------------------------


@query("a06_split_drift_by_language", f"""WITH {v.META_SQL}, {q_metadata._SPLIT}, r AS (SELECT lang, avg(length(text)) FILTER (WHERE split <> 'val') AS a, avg(length(text)) FILTER (WHERE split = 'val') AS b, stddev_pop(length(text)) AS sd FROM parted GROUP BY lang)
SELECT lang, a AS train_mean, b AS val_mean, sd, abs(a - b) / a * 100 AS drift_pct FROM r""")
def a06(spark, sf):
    n, val = F.length("text"), F.col("split") == "val"
    r = m.stratified_split(v.meta(spark, sf)).groupBy("lang").agg(F.avg(F.when(~val, n)).alias("train_mean"), F.avg(F.when(val, n)).alias("val_mean"), F.stddev_pop(n).alias("sd"))
    return r.withColumn("drift_pct", F.abs(F.col("train_mean") - F.col("val_mean")) / F.col("train_mean") * 100)


@query("a19_merge_report", f"""WITH {v.META_SQL}, u AS (SELECT 0 AS src, pos, audio_file FROM meta WHERE pos % 2 = 0 UNION ALL SELECT 1, pos, 'wavs/' || lpad(CAST(pos - pos % 4 AS VARCHAR), 8, '0') || '.wav' FROM meta WHERE pos % 2 = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY audio_file ORDER BY src, pos) AS nth FROM u) SELECT count(*) AS n_before, count(*) FILTER (WHERE nth = 1) AS n_after, count(*) FILTER (WHERE nth = 1 AND src = 1) AS n_added FROM n""")
def a19(spark, sf):
    rows = v.meta(spark, sf).select("audio_file", "pos")
    new = rows.filter("pos % 2 = 1").select(F.concat(F.lit("wavs/"), F.lpad((F.col("pos") - F.col("pos") % 4).cast("string"), 8, "0"), F.lit(".wav")).alias("audio_file"), "pos")
    done = m.merged([rows.filter("pos % 2 = 0"), new]).agg(F.count("*").alias("n_after"), F.count_if(F.col("src") == 1).alias("n_added"))
    return rows.agg(F.count("*").alias("n_before")).crossJoin(F.broadcast(done))


@query("a26_batch_audio_totals", f"WITH {v.CLIPS_SQL} SELECT count(DISTINCT speaker_name) AS files, count(*) AS segments, sum(duration) AS duration FROM clips")
def a26(spark, sf):
    per = v.clips(spark, sf).groupBy("speaker_name").agg(F.count("*").alias("n"), F.sum("duration").alias("d"))
    return per.agg(F.count("*").alias("files"), F.sum("n").alias("segments"), F.sum("d").alias("duration"))


@query("u04_union_of_lists", "SELECT source, list_sort(list_distinct(list(lang) || ['amh', 'en'])) AS langs FROM documents GROUP BY source")
def u04(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.sort_array(F.array_union(F.collect_set("lang"), F.array(F.lit("amh"), F.lit("en")))).alias("langs"))


@query("u16_bpe_vocabulary", "SELECT n_name AS token, n_nationkey AS id FROM nation")
def u16(spark, sf):
    """Nested or flat vocabulary documents give the same relation."""
    vocab = table(spark, sf, "nation").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("vocab"))
    return readers.vocabulary_of(vocab.select(F.to_json(F.struct(F.struct("vocab").alias("model"))).alias("value")))


@query("o04_top_ngrams", f"WITH {q_signal._GRAMS} SELECT token, n FROM g WHERE n >= 5 ORDER BY n DESC, token LIMIT 100")
def o04(spark, sf):
    from quern.operators import vocab as vo

    return vo.top_tokens(vo.char_ngrams(table(spark, sf, "documents")), 5, 100)


# --- sources and sinks --------------------------------------------------------------------------


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("s20_preferred_files", "SELECT 'a_train_filtered.csv' AS train, 'a_eval.csv' AS eval")
def s20(spark, sf):
    names = ["a_train.csv", "a_train_filtered.csv", "a_eval.csv", "x.txt"]
    return spark.range(1).select(F.lit(",".join(readers.preferred_files(names, "train"))).alias("train"), F.lit(",".join(readers.preferred_files(names, "eval"))).alias("eval"))


@query("s22_log_losses_by_epoch", f"""WITH {v.STEPS_SQL},
n AS (SELECT run, epoch, last_value(CASE WHEN epoch % 5 <> 4 THEN epoch END IGNORE NULLS) OVER (PARTITION BY run ORDER BY epoch) AS now FROM steps),
x AS (SELECT run, epoch, CAST((epoch % 13) || '.5' AS DOUBLE) AS loss, 2 AS kind, 0 AS nth FROM steps WHERE epoch % 4 = 0
  UNION ALL SELECT run, epoch, CAST((epoch % 17) || '.25' AS DOUBLE), 1, 0 FROM steps WHERE epoch % 5 = 4
  UNION ALL SELECT run, now, CAST((epoch % 11) || '.75' AS DOUBLE), 0, -epoch FROM n WHERE epoch % 2 = 0 AND now IS NOT NULL)
SELECT run, epoch, arg_max(loss, (kind, nth)) AS eval_loss FROM x GROUP BY 1, 2""")
def s22(spark, sf):
    """Log texts with all three patterns, one a run; an epoch whose own line has a loss opens no section."""
    e = F.col("epoch")
    s = lambda c: c.cast("string")
    lines = F.array(
        F.when(e % 5 == 4, F.concat(F.lit(" > EPOCH: "), s(e), F.lit(" --> EVALUATION AVERAGE LOSS: "), s(e % 17), F.lit(".25"))).otherwise(F.concat(F.lit("> EPOCH: "), s(e), F.lit("/40"))),
        F.when(e % 4 == 0, F.concat(F.lit("Epoch "), s(e), F.lit(" ended with avg_loss: "), s(e % 13), F.lit(".5"))).otherwise("x"),
        F.when(e % 2 == 0, "--> EVALUATION").otherwise("y"),
        F.concat(F.lit(" | > avg_loss: "), s(e % 11), F.lit(".75")),
    )
    rows = v.steps(spark, sf).groupBy("run").agg(F.sort_array(F.collect_list(F.struct("epoch", F.array_join(lines, "\n").alias("s")))).alias("all"))
    return tr.eval_loss_by_epoch(tr.log_lines(rows.select("run", F.array_join(F.col("all.s"), "\n").alias("text"))))


@query("o07_longest_first", f"SELECT old, new, CAST(row_number() OVER (ORDER BY length(old) DESC, pos) AS INTEGER) AS rank FROM (VALUES {', '.join(f'({i}, {q_text._q(a)}, {q_text._q(b)})' for i, (a, b) in enumerate(t.ABBREVIATIONS.items()))}) v(pos, old, new)")
def o07(spark, sf):
    """Replacement rules in the order in which they are tried."""
    return spark.createDataFrame([(a, b, i + 1) for i, (a, b) in enumerate(x.longest_first(t.ABBREVIATIONS))], "old string, new string, rank int")


@query("s21_log_losses_by_step", q_signal.LOSSES_BY_STEP)
def s21(spark, sf):
    """Steps and losses from whole log texts."""
    from quern.operators.training import eval_loss_by_step, log_lines

    lines = q_signal._log(spark, sf).groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n").alias("text"))
    return eval_loss_by_step(log_lines(lines))


@query("s29_projects", "SELECT DISTINCT source AS project, doc_id FROM documents")
def s29(spark, sf):
    root = _folder(spark, "s29")
    table(spark, sf, "documents").select("source", "doc_id").distinct().withColumn("project", F.col("source")).write.partitionBy("project").parquet(root)
    return spark.read.parquet(root).select("project", "doc_id")


@query("k01_metadata_csv", f"{q_sources._META_LINE} SELECT audio_file, nullif(text, '') AS text, speaker_name FROM m")
def k01(spark, sf):
    path = _folder(spark, "k01")
    writers.metadata(q_sources._flat(spark, sf), path)
    return spark.read.schema(readers.METADATA).csv(path, sep="|", header=True, escape='"')


@query("k08_subtitle_files", f"WITH {v.CUES_SQL} SELECT source_id, count(*) AS n FROM cues GROUP BY source_id")
def k08(spark, sf):
    srt = subtitles.to_srt(v.cues(spark, sf))
    return srt.select("source_id", F.regexp_count("text", F.lit("-->")).cast("long").alias("n"))


@query("k12_summary", "SELECT 'n: ' || CAST(count(*) AS VARCHAR) AS line FROM documents")
def k12(spark, sf):
    lines = writers.summary_lines(table(spark, sf, "documents").agg(F.count("*").alias("n")))
    return spark.createDataFrame([(s,) for s in lines], "line string")


@query("k16_tokenizer_config", "SELECT true AS stored, false AS given, false AS missing")
def k16(spark, sf):
    path = _folder(spark, "k16")
    writers.tokenizer_config(spark, path, True)
    got = (readers.tokenizer_uses_phonemes(spark, path), readers.tokenizer_uses_phonemes(spark, path, False), readers.tokenizer_uses_phonemes(spark, path + "-none"))
    return spark.range(1).select(*[F.lit(b).alias(k) for k, b in zip(("stored", "given", "missing"), got, strict=True)])


# --- segments -----------------------------------------------------------------------------------


@query("j17_carve_cues", f"""WITH {q_segments._PART}, p AS (SELECT source_id, idx, "start" - 0.2::DOUBLE AS "start", "end" + 0.2::DOUBLE AS "end" FROM a), o AS (SELECT p.source_id, p.idx, b.idx AS bi, least(p."end", b."end") - greatest(p."start", b."start") AS ov FROM p JOIN b ON p.source_id = b.source_id AND p."start" < b."end" AND b."start" < p."end")
SELECT source_id, idx, arg_max(bi, (ov, -bi)) AS region, max(ov) AS overlap FROM o WHERE ov > 0 GROUP BY 1, 2""")
def j17(spark, sf):
    a, b = q_segments._parts(spark, sf)
    return g.best_overlap(a.withColumn("start", F.col("start") - 0.2).withColumn("end", F.col("end") + 0.2), b)


@query("z03_word_dataset", f"""WITH {q_segments._WORDS},
m AS (SELECT *, CASE WHEN right(word, 1) IN ('!', '。', '.', '?') THEN 1 ELSE 0 END AS e, lag("end") OVER w AS p, coalesce(lead("start") OVER w, "end") AS x FROM words WINDOW w AS (PARTITION BY source_id ORDER BY idx)),
s AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY source_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i, CASE WHEN p IS NULL THEN greatest("start" - 0.2::DOUBLE, 0) ELSE greatest("start" - 0.2::DOUBLE, (p + "start") / 2) END AS s0, least(("end" + x) / 2, "end" + 0.2::DOUBLE) AS e0 FROM m),
h AS (SELECT source_id, CAST(i AS BIGINT) AS i, max(e) AS closed, arg_min(s0, idx) AS a, arg_max(e0, idx) AS b FROM s GROUP BY 1, 2),
c AS (SELECT 'wavs/' || CAST(source_id AS VARCHAR) || '_' || lpad(CAST(i AS VARCHAR), 8, '0') || '.wav' AS audio_file FROM h WHERE closed = 1 AND b - a >= 1.0::DOUBLE / 3),
n AS (SELECT audio_file, row_number() OVER (ORDER BY md5('42|' || audio_file), audio_file) AS nth, count(*) OVER () AS n FROM c)
SELECT audio_file, CASE WHEN nth <= floor(n * CAST(0.15 AS DOUBLE)) THEN 'eval' ELSE 'train' END AS split FROM n""")
def z03(spark, sf):
    rows = g.sentences(q_segments._words(spark, sf))
    name = F.concat(F.lit("wavs/"), F.col("source_id").cast("string"), F.lit("_"), F.lpad(F.col("i").cast("string"), 8, "0"), F.lit(".wav"))
    rows = stored(rows.select(name.alias("audio_file"), "text"), "z03")
    return m.random_split(rows, "eval_floor").select("audio_file", "split")


@query("z04_speech_slices")
def z04(spark, sf):
    """Energy segments are snapped to words, merged, cut and given the text of the cue that covers them."""
    a, words = q_segments._parts(spark, sf)
    merged = g.merge_short_speech(g.snap_to_words(a, words).select("source_id", "idx", "start", "end", "confidence"))
    cut = g.split_long(merged, words, 15.0).withColumn("idx", F.col("idx") * 2 + F.col("part"))
    return g.first_overlap_text(cut, words).select("source_id", "idx", "start", "end", "cue_text")


@query("z05_url_dataset", "WITH u AS (SELECT 'https://youtu.be/' || CAST(page_id AS VARCHAR) AS audio_file FROM pages), n AS (SELECT audio_file, row_number() OVER (ORDER BY md5('42|' || audio_file), audio_file) AS nth, count(*) OVER () AS n FROM u) SELECT audio_file || '|' || CASE WHEN nth <= greatest(3, floor(n * CAST(0.15 AS DOUBLE))) THEN 'eval' ELSE 'train' END AS value FROM n")
def z05(spark, sf):
    free = F.concat(F.lit('"https://youtu.be/'), F.col("page_id").cast("string"), F.lit('", '), F.col("url"))
    urls = table(spark, sf, "pages").select(F.explode(readers.url_list(free)).alias("audio_file"))
    path = _folder(spark, "z05")
    writers.raw_lines(m.random_split(urls, "eval_min3"), path, "audio_file", "split")
    return spark.read.text(path)


@query("z06_merge_datasets", f"""WITH {v.META_SQL}, u AS (SELECT 0 AS src, pos, audio_file FROM meta WHERE pos % 2 = 0 UNION ALL SELECT 1, pos, 'wavs/' || lpad(CAST(pos - pos % 4 AS VARCHAR), 8, '0') || '.wav' FROM meta WHERE pos % 2 = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY audio_file ORDER BY src, pos) AS nth FROM u) SELECT src, pos, 'wavs/merged_' || lpad(CAST(row_number() OVER (ORDER BY src, pos) - 1 AS VARCHAR), 8, '0') || '.wav' AS audio_file FROM n WHERE nth = 1""")
def z06(spark, sf):
    rows = v.meta(spark, sf).select("audio_file", "pos")
    new = rows.filter("pos % 2 = 1").select(F.concat(F.lit("wavs/"), F.lpad((F.col("pos") - F.col("pos") % 4).cast("string"), 8, "0"), F.lit(".wav")).alias("audio_file"), "pos")
    merged = stored(m.merged([rows.filter("pos % 2 = 0"), new]), "z06")
    return m.renumbered(merged, 0, "src", "pos").select("src", "pos", "audio_file")


@query("z07_standard_names", f"""WITH {v.CLIPS_SQL}, k AS (SELECT max(CAST(regexp_extract(audio_file, '_(\\d+)\\.wav', 1) AS BIGINT)) + 1 AS next FROM clips)
SELECT audio_file AS old, 'wavs/merged_' || lpad(CAST((SELECT next FROM k) + row_number() OVER (ORDER BY pos) - 1 AS VARCHAR), 8, '0') || '.wav' AS new FROM clips""")
def z07(spark, sf):
    clips = v.clips(spark, sf)
    start = clips.agg(m.next_number(paths.stem(F.col("audio_file"))).alias("n")).first()["n"]
    named = clips.select("pos", F.col("audio_file").alias("old"), "audio_file")
    return m.renumbered(named, start, "pos").select("old", F.col("audio_file").alias("new"))


@query("z08_clips_of_audio", f"WITH {q_signal._D}, {q_signal._runs('list_aggregate(rms, ' + chr(39) + 'median' + chr(39) + ') * 0.3::DOUBLE', 10, 25, 10)}, ok AS (SELECT vec_id FROM (SELECT vec_id, x, {q_signal._rms('x', 16, 4)} AS r FROM d) WHERE list_aggregate(r, 'avg') >= 0.01 AND list_max(list_transform(x, lambda q: abs(q))) <= 0.99 AND list_sum(list_transform(x, lambda q: q * q)) / len(x) >= 1.5 * 0.01) SELECT s.vec_id, s.\"start\", s.\"end\" FROM s JOIN ok ON ok.vec_id = s.vec_id WHERE s.\"end\" - s.\"start\" BETWEEN 0.01 AND 1.0")
def z08(spark, sf):
    d = q_signal._d(spark, sf).filter(sg.passes_gate(F.col("x"), 1.5, 16, 4))
    return d.select("vec_id", F.explode(sg.simple_segments(F.col("x"), q_signal.RATE, 0.01, 1.0)).alias("s")).select("vec_id", "s.start", "s.end")


@query("z09_speech_detection", f"""WITH {q_segments._SPEECH}, q AS (SELECT * FROM speech WHERE "end" - "start" BETWEEN 0.5 AND 15 AND confidence >= 0.5 AND snr >= 10), l AS (SELECT *, CASE WHEN "start" - lag("end") OVER w > 0.5 THEN 1 ELSE 0 END AS new FROM q WINDOW w AS (PARTITION BY source_id ORDER BY idx)),
r AS (SELECT *, sum(new) OVER (PARTITION BY source_id ORDER BY idx) AS run FROM l) SELECT source_id, min(idx) AS idx, arg_min("start", idx) AS "start", arg_max("end", idx) AS "end", count(*) AS n FROM r GROUP BY source_id, run""")
def z09(spark, sf):
    return g.merge_close(g.quality_filter(q_segments._speech(spark, sf))).select("source_id", "idx", "start", "end", "n")


@query("z10_augmented_rows", f"WITH {v.FIDEL_SQL} SELECT doc_id, CAST(copy AS INTEGER) AS copy FROM fidel, range(1, 4) r(copy) WHERE length(regexp_replace(text, '[^ጨጠፀጰቀ]', '', 'g')) >= 2")
def z10(spark, sf):
    return m.repeated_rows(v.fidel(spark, sf).filter(F.regexp_count("text", F.lit("[ጨጠፀጰቀ]")) >= 2), 3).select("doc_id", "copy")
