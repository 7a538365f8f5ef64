"""Registered queries on time segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import numbers
from quern.operators import segments as g
from quern.plans import views as v
from quern.plans.registry import query
from quern.session import table

_C = v.CUES_SQL


def _merge_sql(extra: str = "") -> str:
    return f"""WITH RECURSIVE {_C},
f AS (
  SELECT source_id, idx AS k, idx, "start", "end", text, false AS closed, CAST(NULL AS STRUCT(idx INTEGER, s DOUBLE, e DOUBLE, t VARCHAR)) AS done FROM cues WHERE idx = 1
  UNION ALL
  SELECT f.source_id, n.idx, CASE WHEN j THEN f.idx ELSE n.idx END, CASE WHEN j THEN f."start" ELSE n."start" END, n."end",
         CASE WHEN j THEN f.text || ' ' || n.text ELSE n.text END, NOT j, CASE WHEN NOT j THEN {{'idx': f.idx, 's': f."start", 'e': f."end", 't': f.text}} END
  FROM (SELECT f.*, n AS nx, CASE
      WHEN f."end" - f."start" < 1.0 THEN n."end" - f."start" <= 20.0 AND n."start" - f."end" <= CASE WHEN f."end" - f."start" < 1.0 THEN 3.0 ELSE 1.5 END
      WHEN n."end" - n."start" < 1.0 THEN n."end" - f."start" <= 20.0 AND n."start" - f."end" <= 1.5
      WHEN f."end" - f."start" < 2.0 AND n."end" - n."start" < 2.0 THEN n."end" - f."start" <= 20.0 AND n."start" - f."end" <= 2.25
      ELSE n."start" - f."end" < 0.5 AND n."end" - f."start" <= 20.0 END AS j
    FROM f JOIN cues n ON n.source_id = f.source_id AND n.idx = f.k + 1) f, (SELECT UNNEST([f.nx]) AS n) u(n)
),
merged AS (
  SELECT source_id, done.idx AS idx, done.s AS "start", done.e AS "end", done.t AS text FROM f WHERE closed
  UNION ALL
  SELECT source_id, arg_max(idx, k), arg_max("start", k), arg_max("end", k), arg_max(text, k) FROM f GROUP BY source_id
){extra}"""


_MERGE = _merge_sql().replace(', (SELECT UNNEST([f.nx]) AS n) u(n)', '').replace("n.idx, CASE WHEN j THEN f.idx ELSE n.idx END", "nx.idx, CASE WHEN j THEN f.idx ELSE nx.idx END").replace(
    'CASE WHEN j THEN f."start" ELSE n."start" END, n."end",', 'CASE WHEN j THEN f."start" ELSE nx."start" END, nx."end",'
).replace("CASE WHEN j THEN f.text || ' ' || n.text ELSE n.text END", "CASE WHEN j THEN f.text || ' ' || nx.text ELSE nx.text END")


@query("w03_merge_cues", _MERGE + ' SELECT source_id, idx, "start", "end", text FROM merged')
def w03(spark, sf):
    return g.merge_short_cues(v.cues(spark, sf))


@query("a08_merge_summary", f"""{_MERGE} SELECT (SELECT count(*) FROM cues) AS n_before, (SELECT count(*) FROM merged) AS n_after,
  100.0::DOUBLE * ((SELECT count(*) FROM cues) - (SELECT count(*) FROM merged)) / (SELECT count(*) FROM cues) AS reduction_pct, (SELECT avg("end" - "start") FROM merged) AS mean_s""")
def a08(spark, sf):
    cues = v.cues(spark, sf)
    before = cues.agg(F.count("*").alias("n_before"))
    after = g.merge_short_cues(cues).agg(F.count("*").alias("n_after"), F.avg(F.col("end") - F.col("start")).alias("mean_s"))
    pct = 100.0 * (F.col("n_before") - F.col("n_after")) / F.col("n_before")
    return before.crossJoin(F.broadcast(after)).select("n_before", "n_after", pct.alias("reduction_pct"), "mean_s")


@query("w04_merge_short_speech", f"""WITH RECURSIVE {_C},
f AS (
  SELECT source_id, idx AS k, idx, "start", "end", confidence, false AS closed, CAST(NULL AS STRUCT(idx INTEGER, s DOUBLE, e DOUBLE, c DOUBLE)) AS done FROM cues WHERE idx = 1
  UNION ALL
  SELECT source_id, nx.idx, CASE WHEN j THEN idx ELSE nx.idx END, CASE WHEN j THEN "start" ELSE nx."start" END, nx."end", CASE WHEN j THEN (confidence + nx.confidence) / 2 ELSE nx.confidence END,
         NOT j, CASE WHEN NOT j THEN {{'idx': idx, 's': "start", 'e': "end", 'c': confidence}} END
  FROM (SELECT f.*, n AS nx, n."start" - f."end" <= 0.5 OR f."end" - f."start" < 0.5 AS j FROM f JOIN cues n ON n.source_id = f.source_id AND n.idx = f.k + 1)
),
r AS (SELECT source_id, done.idx AS idx, done.s AS "start", done.e AS "end", done.c AS confidence FROM f WHERE closed
  UNION ALL SELECT source_id, arg_max(idx, k), arg_max("start", k), arg_max("end", k), arg_max(confidence, k) FROM f GROUP BY source_id)
SELECT * FROM r WHERE "end" - "start" >= 0.5""")
def w04(spark, sf):
    return g.merge_short_speech(v.cues(spark, sf))


def _speech(spark, sf):
    return v.cues(spark, sf).withColumn("snr", F.col("idx") % 40 + F.lit(0.5)).withColumn("padded", F.col("idx") % 7 != 0).withColumn("speech_prob", F.col("confidence") * 0.9)


_SPEECH = _C + ", speech AS (SELECT *, idx % 40 + 0.5::DOUBLE AS snr, idx % 7 <> 0 AS padded, confidence * 0.9::DOUBLE AS speech_prob FROM cues)"


@query("w05_merge_close", f"""WITH {_SPEECH}, l AS (SELECT *, CASE WHEN "start" - lag("end") OVER w > 0.5 THEN 1 ELSE 0 END AS new FROM speech WINDOW w AS (PARTITION BY source_id ORDER BY idx)),
r AS (SELECT *, sum(new) OVER (PARTITION BY source_id ORDER BY idx) AS run FROM l)
SELECT source_id, min(idx) AS idx, arg_min("start", idx) AS "start", arg_max("end", idx) AS "end", list_reduce(list(confidence ORDER BY idx), lambda a, x: (a + x) / 2) AS confidence,
  min(snr) AS snr, bool_and(padded) AS padded, count(*) AS n FROM r GROUP BY source_id, run""")
def w05(spark, sf):
    return g.merge_close(_speech(spark, sf))


_NEED = """n AS (SELECT *, 3.0::DOUBLE - ("end" - "start") AS need, lag("end") OVER w AS p, lead("start") OVER w AS x FROM cues WINDOW w AS (PARTITION BY source_id ORDER BY idx)),
m AS (SELECT *, greatest(0.0::DOUBLE, "start" - coalesce(p, 0.0::DOUBLE) - 0.02::DOUBLE) AS back, greatest(0.0::DOUBLE, coalesce(x, 500.0::DOUBLE) - "end" - 0.02::DOUBLE) AS fwd FROM n),
h AS (SELECT *, least(back, need / 2) AS hb, least(fwd, need - least(back, need / 2)) AS hf FROM m),
b AS (SELECT *, hb + greatest(0.0::DOUBLE, least(back - hb, need - hb - hf)) AS mb FROM h),
t AS (SELECT *, CASE WHEN p IS NULL THEN 0 WHEN x IS NULL THEN least(need, back) ELSE mb END AS tb,
  CASE WHEN p IS NULL THEN least(need, fwd) WHEN x IS NULL THEN 0 ELSE hf + greatest(0.0::DOUBLE, least(fwd - hf, need - mb - hf)) END AS tf FROM b)"""


@query("w02_expand_short", f"""WITH {_C}, {_NEED} SELECT source_id, idx, CASE WHEN need > 0 THEN greatest(0.0::DOUBLE, "start" - tb) ELSE "start" END AS "start", CASE WHEN need > 0 THEN least(500.0::DOUBLE, "end" + tf) ELSE "end" END AS "end" FROM t""")
def w02(spark, sf):
    return g.expand_short(v.cues(spark, sf), 3.0, 500.0).select("source_id", "idx", "start", "end")


@query("w22_edge_buffer", f"""WITH {_C}, e AS (SELECT *, lag(idx) OVER w IS NULL AS f, lead(idx) OVER w IS NULL AS l FROM cues WINDOW w AS (PARTITION BY source_id ORDER BY idx))
SELECT source_id, idx, greatest(0.0::DOUBLE, "start" - (0.3::DOUBLE + CASE WHEN f THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)) AS "start", least(440.0::DOUBLE, "end" + (0.3::DOUBLE + CASE WHEN l THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)) AS "end" FROM e""")
def w22(spark, sf):
    return g.edge_buffer(v.cues(spark, sf), 0.3, 440.0).select("source_id", "idx", "start", "end")


@query("w23_generous_padding", f"""WITH {_C} SELECT source_id, idx, greatest(0.0::DOUBLE, "start" - 0.3::DOUBLE) AS "start", least(440.0::DOUBLE, "end" + 0.4::DOUBLE) AS "end", ("end" - 0.5::DOUBLE - "start") >= 0.8::DOUBLE * ("end" - "start") AS trim_ok FROM cues""")
def w23(spark, sf):
    c = v.cues(spark, sf).withColumn("trim_ok", g.accepted_trim(F.col("start"), F.col("end") - 0.5))
    return g.generous_padding(c, audio_len=440.0).select("source_id", "idx", "start", "end", "trim_ok")


_PART = _C + """, a AS (SELECT * FROM cues WHERE idx % 2 = 0 AND "end" > "start"), b AS (SELECT * FROM cues WHERE idx % 2 = 1 AND "end" > "start")"""


def _parts(spark, sf):
    c = v.cues(spark, sf).filter(F.col("end") > F.col("start"))
    return c.filter("idx % 2 = 0"), c.filter("idx % 2 = 1")


@query("j09_first_overlap", f"""WITH {_PART}, o AS (SELECT a.source_id, a.idx, arg_min(b.text, b.idx) AS cue_text FROM a JOIN b ON a.source_id = b.source_id AND a."start" < b."end" AND b."start" < a."end"
  AND (least(a."end", b."end") - greatest(a."start", b."start")) / (a."end" - a."start") > 0.5 GROUP BY 1, 2)
SELECT a.source_id, a.idx, o.cue_text FROM a LEFT JOIN o ON a.source_id = o.source_id AND a.idx = o.idx""")
def j09(spark, sf):
    a, b = _parts(spark, sf)
    return g.first_overlap_text(a, b).select("source_id", "idx", "cue_text")


@query("j10_best_overlap", f"""WITH {_PART}, o AS (SELECT a.source_id, a.idx, b.idx AS bi, least(a."end", b."end") - greatest(a."start", b."start") AS ov FROM a JOIN b ON a.source_id = b.source_id AND a."start" < b."end" AND b."start" < a."end")
SELECT source_id, idx, arg_max(bi, (ov, -bi)) AS region, max(ov) AS overlap FROM o WHERE ov > 0 GROUP BY 1, 2""")
def j10(spark, sf):
    return g.best_overlap(*_parts(spark, sf))


@query("j11_snap_to_words", f"""WITH {_PART},
s AS (SELECT a.source_id, a.idx, arg_min(b."start", (abs(b."start" - a."start"), b."start")) AS ns, arg_min(b."end", (abs(b."end" - a."end"), b."end")) AS ne FROM a JOIN b ON a.source_id = b.source_id GROUP BY 1, 2)
SELECT a.source_id, a.idx, CASE WHEN abs(ns - "start") < 0.2 THEN ns ELSE "start" END AS "start", CASE WHEN abs(ne - "end") < 0.2 THEN ne ELSE "end" END AS "end" FROM a LEFT JOIN s ON a.source_id = s.source_id AND a.idx = s.idx""")
def j11(spark, sf):
    a, b = _parts(spark, sf)
    return g.snap_to_words(a, b).select("source_id", "idx", "start", "end")


@query("j12_contained_words", f"""WITH {_PART} SELECT a.source_id, a.idx, b.idx AS word FROM a JOIN b ON a.source_id = b.source_id AND b."start" >= a."start" AND b."end" <= a."end" """)
def j12(spark, sf):
    a, b = _parts(spark, sf)
    return g.contained(b, a).select("source_id", "idx", F.col("b_idx").alias("word"))


@query("w10_split_long", f"""WITH {_PART},
i AS (SELECT a.source_id, a.idx, a."start", b.idx AS bi, b."end" AS be FROM a JOIN b ON a.source_id = b.source_id AND b."start" >= a."start" AND b."end" <= a."end" WHERE a."end" - a."start" > 6.0),
n AS (SELECT *, row_number() OVER (PARTITION BY source_id, idx ORDER BY bi) AS nth, count(*) OVER (PARTITION BY source_id, idx) AS n, abs(be - "start" - 6.0::DOUBLE * 0.8::DOUBLE) AS off FROM i),
x AS (SELECT source_id, idx, arg_min({{'nth': nth, 'n': n, 'e': be}}, (off, nth)) AS best FROM n GROUP BY 1, 2),
c AS (SELECT a.*, CASE WHEN a."end" - a."start" > 6.0 THEN CASE WHEN best IS NULL THEN (a."start" + a."end") / 2 WHEN best.nth > 1 AND best.nth < best.n THEN best.e END END AS cut FROM a LEFT JOIN x ON a.source_id = x.source_id AND a.idx = x.idx)
SELECT source_id, idx, 0 AS part, "start", coalesce(cut, "end") AS "end", confidence FROM c UNION ALL SELECT source_id, idx, 1, cut, "end", confidence FROM c WHERE cut IS NOT NULL""")
def w10(spark, sf):
    a, b = _parts(spark, sf)
    return g.split_long(a, b, 6.0)


_WORDS = """words AS (
  SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY turn, p) AS INTEGER) AS idx, w AS word, turn * 100 + p * 0.4::DOUBLE AS "start", turn * 100 + p * 0.4::DOUBLE + 0.3::DOUBLE AS "end"
  FROM (SELECT conv_id AS source_id, turn, unnest(range(len(string_split(text, ' ')))) AS p, ' ' || unnest(string_split(text, ' ')) AS w FROM conversations))"""


def _words(spark, sf):
    from pyspark.sql import Window as W

    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("source_id"), "turn", F.posexplode(F.split("text", " ")).alias("p", "w"))
    idx = F.row_number().over(W.partitionBy("source_id").orderBy("turn", "p"))
    start = F.col("turn") * 100 + F.col("p") * F.lit(0.4)
    return c.select("source_id", idx.alias("idx"), F.concat(F.lit(" "), "w").alias("word"), start.alias("start"), (start + 0.3).alias("end"))


@query("w21_sentences", f"""WITH {_WORDS},
m AS (SELECT *, CASE WHEN right(word, 1) IN ('!', '。', '.', '?') THEN 1 ELSE 0 END AS e, lag("end") OVER w AS p, coalesce(lead("start") OVER w, "end") AS x FROM words WINDOW w AS (PARTITION BY source_id ORDER BY idx)),
s AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY source_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i,
  CASE WHEN p IS NULL THEN greatest("start" - 0.2::DOUBLE, 0) ELSE greatest("start" - 0.2::DOUBLE, (p + "start") / 2) END AS s0, least(("end" + x) / 2, "end" + 0.2::DOUBLE) AS e0 FROM m),
g AS (SELECT source_id, CAST(i AS BIGINT) AS i, max(e) AS closed, arg_min(s0, idx) AS "start", arg_max(e0, idx) AS "end", substr(string_agg(word, '' ORDER BY idx), 2) AS text FROM s GROUP BY 1, 2)
SELECT source_id, i, "start", "end", text FROM g WHERE closed = 1 AND "end" - "start" >= 1.0::DOUBLE / 3""")
def w21(spark, sf):
    return g.sentences(_words(spark, sf))


@query("p12_speech_quality", f"""WITH {_SPEECH} SELECT source_id, idx FROM speech WHERE "end" - "start" BETWEEN 0.5 AND 15 AND confidence >= 0.5 AND snr >= 10""")
def p12(spark, sf):
    return g.quality_filter(_speech(spark, sf)).select("source_id", "idx")


@query("p13_high_quality", f"""WITH {_SPEECH} SELECT source_id, idx, confidence >= 0.7 AND snr >= 10 AND speech_prob >= 0.6 AS high FROM speech""")
def p13(spark, sf):
    return _speech(spark, sf).select("source_id", "idx", g.high_quality().alias("high"))


@query("p14_length_guards", f"""WITH {_C} SELECT source_id, idx FROM cues WHERE "end" - "start" >= 0.2 AND length(text) >= 3""")
def p14(spark, sf):
    return v.cues(spark, sf).filter((F.col("end") - F.col("start") >= 0.2) & (F.length("text") >= 3)).select("source_id", "idx")


@query("p15_over_long", f"""WITH {_C} SELECT source_id, idx, "end" - "start" <= 8 AS kept, "end" - "start" <= 16 AS kept_by_speech FROM cues""")
def p15(spark, sf):
    d = F.col("end") - F.col("start")
    return v.cues(spark, sf).select("source_id", "idx", (d <= 8).alias("kept"), (d <= 16).alias("kept_by_speech"))


@query("a10_speech_statistics", f"WITH {_SPEECH} SELECT source_id, avg(snr) AS mean_snr, min(snr) AS min_snr, max(snr) AS max_snr, avg(speech_prob) AS mean_prob, count(*) FILTER (WHERE snr < 10) AS low FROM speech GROUP BY source_id")
def a10(spark, sf):
    return _speech(spark, sf).groupBy("source_id").agg(
        F.avg("snr").alias("mean_snr"), F.min("snr").alias("min_snr"), F.max("snr").alias("max_snr"), F.avg("speech_prob").alias("mean_prob"), F.count_if(F.col("snr") < 10).alias("low")
    )


@query("s09_valid_cues", f"""WITH {_C} SELECT source_id, idx FROM cues WHERE "end" > "start" AND trim(text) <> ''""")
def s09(spark, sf):
    return g.valid(v.cues(spark, sf)).select("source_id", "idx")


_Z = _merge_sql  # the merged cues feed the pipeline


@query("z01_subtitle_dataset", _MERGE + f""", {_NEED.replace('FROM cues WINDOW', 'FROM merged WINDOW').replace('3.0::DOUBLE', '1.0::DOUBLE')},
x0 AS (SELECT source_id, idx, CASE WHEN need > 0 THEN greatest(0.0::DOUBLE, "start" - tb) ELSE "start" END AS "start", CASE WHEN need > 0 THEN least(500.0::DOUBLE, "end" + tf) ELSE "end" END AS "end", text FROM t),
x1 AS (SELECT * FROM x0 WHERE "end" - "start" <= 20.0),
x2 AS (SELECT *, lag(idx) OVER w IS NULL AS fi, lead(idx) OVER w IS NULL AS la FROM x1 WINDOW w AS (PARTITION BY source_id ORDER BY idx)),
x3 AS (SELECT source_id, idx, greatest(0.0::DOUBLE, "start" - (0.2::DOUBLE + CASE WHEN fi THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)) AS "start", least(500.0::DOUBLE, "end" + (0.2::DOUBLE + CASE WHEN la THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)) AS "end", text FROM x2)
SELECT * FROM x3 WHERE "end" - "start" >= 0.2""")
def z01(spark, sf):
    return g.subtitle_dataset(v.cues(spark, sf), 1.0, 20.0, 1.5, 0.2, 500.0)


@query("z02_extracted_segments", f"""WITH {_C}, {_NEED.replace('3.0::DOUBLE', '1.0::DOUBLE')},
x AS (SELECT source_id, idx, CASE WHEN need > 0 THEN greatest(0.0::DOUBLE, "start" - tb) ELSE "start" END AS "start", CASE WHEN need > 0 THEN least(500.0::DOUBLE, "end" + tf) ELSE "end" END AS "end" FROM t)
SELECT source_id, idx, 'wavs/' || CAST(source_id AS VARCHAR) || '_' || lpad(CAST(idx AS VARCHAR), 6, '0') || '.wav' AS audio_file, "end" - "start" AS duration FROM x WHERE "end" - "start" BETWEEN 0.2 AND 20""")
def z02(spark, sf):
    x = g.expand_short(v.cues(spark, sf), 1.0, 500.0).withColumn("duration", F.col("end") - F.col("start")).filter(F.col("duration").between(0.2, 20))
    name = F.concat(F.lit("wavs/"), F.col("source_id").cast("string"), F.lit("_"), F.lpad(F.col("idx").cast("string"), 6, "0"), F.lit(".wav"))
    return x.select("source_id", "idx", name.alias("audio_file"), "duration")


@query("s08_parse_srt", f"""WITH {_C} SELECT source_id, idx, "start", "end", text FROM cues""")
def s08(spark, sf):
    """Cues are written as SRT text per source, then parsed back."""
    from quern.sources import subtitles

    return subtitles.parse_srt(subtitles.to_srt(v.cues(spark, sf)))
