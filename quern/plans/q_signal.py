"""Registered queries on sample arrays, training logs and vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import signal as g
from quern.operators import training as tr
from quern.operators import vocab as vo
from quern.operators import waveforms as wf
from quern.plans import views as v
from quern.plans.registry import query
from quern.session import table

# --- signals: an embedding is a short waveform at 1000 samples a second -------------------------

RATE = 1000
_D = "d AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings)"
_MEAN = "list_aggregate({0}, 'avg')"
_STD = "list_aggregate({0}, 'stddev_pop')"


def _rms(x: str, frame: int, hop: int) -> str:
    return f"list_transform(range(0, len({x}) // {hop} + 1), lambda i: sqrt(coalesce(list_sum(list_transform({x}[greatest(i * {hop} - {frame // 2}, 0) + 1 : i * {hop} - {frame // 2} + {frame}], lambda q: q * q)), 0) / {frame}))"


def _d(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", g.doubles(F.col("embedding")).alias("x"))


@query("w08_rms_frames", f"WITH {_D} SELECT vec_id, {_rms('x', 16, 4)} AS rms FROM d")
def w08(spark, sf):
    return _d(spark, sf).select("vec_id", g.rms_frames(F.col("x"), 16, 4).alias("rms"))


def _runs(limit: str, hop: float, frame: int, hops: int) -> str:
    return f"""r AS (SELECT vec_id, x, {_rms('x', frame, hops)} AS rms FROM d),
l AS (SELECT vec_id, len(x) AS n, rms, {limit} AS lim FROM r), p AS (SELECT vec_id, n, lim, unnest(rms) AS v, unnest(range(len(rms))) AS i FROM l),
o AS (SELECT *, v > lim AS over, coalesce(lag(v > lim) OVER (PARTITION BY vec_id ORDER BY i), false) AS before FROM p),
k AS (SELECT *, sum(CASE WHEN over AND NOT before THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY i) AS run, max(i) OVER (PARTITION BY vec_id) AS top FROM o),
s AS (SELECT vec_id, min(i) * {hop} / {RATE}.0::DOUBLE AS "start", CASE WHEN max(i) = max(top) THEN max(n) / {RATE}.0::DOUBLE ELSE (max(i) + 1) * {hop} / {RATE}.0::DOUBLE END AS "end" FROM k WHERE over GROUP BY vec_id, run)"""


@query("w06_energy_segments", f"WITH {_D}, {_runs(_MEAN.format('rms') + ' + 0.5::DOUBLE * ' + _STD.format('rms'), 20, 50, 20)} SELECT vec_id, \"start\", \"end\" FROM s WHERE (\"end\" - \"start\") * 1000 >= 10")
def w06(spark, sf):
    return _d(spark, sf).select("vec_id", F.explode(g.energy_segments(F.col("x"), RATE, 10)).alias("s")).select("vec_id", "s.start", "s.end")


@query("w07_simple_segments", f"WITH {_D}, {_runs('list_median(rms) * 0.3::DOUBLE', 10, 25, 10).replace('list_median(rms)', 'list_aggregate(rms, ' + chr(39) + 'median' + chr(39) + ')')} SELECT vec_id, \"start\", \"end\" FROM s WHERE \"end\" - \"start\" BETWEEN 0.01 AND 1.0")
def w07(spark, sf):
    return _d(spark, sf).select("vec_id", F.explode(g.simple_segments(F.col("x"), RATE, 0.01, 1.0)).alias("s")).select("vec_id", "s.start", "s.end")


@query("w06_energy_blocks", f"WITH {_D}, {_runs(_MEAN.format('rms') + ' + 0.5::DOUBLE * ' + _STD.format('rms'), 20, 50, 20)} SELECT vec_id, \"start\", \"end\" FROM s WHERE (\"end\" - \"start\") * 1000 >= 10")
def w06b(spark, sf):
    return wf.energy_segments(wf.blocked(table(spark, sf, "embeddings"), "vec_id", "embedding", 60), "vec_id", RATE, 10, 60)


@query("w07_simple_blocks", f"WITH {_D}, {_runs('list_median(rms) * 0.3::DOUBLE', 10, 25, 10).replace('list_median(rms)', 'list_aggregate(rms, ' + chr(39) + 'median' + chr(39) + ')')} SELECT vec_id, \"start\", \"end\" FROM s WHERE \"end\" - \"start\" BETWEEN 0.01 AND 1.0")
def w07b(spark, sf):
    return wf.simple_segments(wf.blocked(table(spark, sf, "embeddings"), "vec_id", "embedding", 30), "vec_id", RATE, 0.01, 1.0, 30)


@query("w09_silence_slices")
def w09(spark, sf):
    plan = g.SilencePlan(RATE, threshold_db=-17.0, least_ms=16, interval_ms=8, hop_ms=2, kept_ms=6)
    return wf.slice_at_silence(wf.blocked(table(spark, sf, "embeddings"), "vec_id", "embedding"), plan, "vec_id")


@query("w24_adaptive_threshold", f"""WITH {_D}, e AS (SELECT vec_id, list_transform(x, lambda q: abs(q)) AS a FROM d), r AS (SELECT vec_id, CASE WHEN list_aggregate(a, 'avg') > 0 THEN list_aggregate(a, 'stddev_samp') / list_aggregate(a, 'avg') ELSE 0 END AS r FROM e)
SELECT vec_id, greatest(0.3::DOUBLE, least(0.9::DOUBLE, CASE WHEN r > 0.5 THEN 0.5::DOUBLE WHEN r > 0.3 THEN 0.5::DOUBLE + 0.05::DOUBLE ELSE 0.5::DOUBLE + 0.15::DOUBLE END)) AS threshold FROM r""")
def w24(spark, sf):
    return _d(spark, sf).select("vec_id", g.adaptive_threshold(F.col("x")).alias("threshold"))


@query("w25_segment_quality", f"""WITH {_D}, e AS (SELECT vec_id, x, list_transform(x, lambda q: abs(q)) AS a FROM d),
m AS (SELECT *, list_aggregate(a, 'avg') AS m, list_aggregate(a, 'stddev_pop') AS s FROM e)
SELECT vec_id, CASE WHEN m > 0 THEN least(1.0::DOUBLE, m * 10) ELSE 0 END AS speech_prob_mean, CASE WHEN m > 0 THEN least(1.0::DOUBLE, s / m) ELSE 0 END AS speech_prob_std, 20.0::DOUBLE AS snr_estimate,
  list_aggregate(a[1:20], 'avg') < m * 0.5::DOUBLE AND list_aggregate(a[len(a) - 19:], 'avg') < m * 0.5::DOUBLE AS has_silence_padding FROM m""")
def w25(spark, sf):
    return _d(spark, sf).select("vec_id", g.segment_quality(F.col("x"), RATE).alias("q")).select("vec_id", "q.*")


@query("p10_clip_quality", f"""WITH {_D}, r AS (SELECT vec_id, x, {_rms('x', 16, 4)} AS rms FROM d), c AS (SELECT *, list_sum(list_transform(x, lambda q: q * q)) / len(x) AS power, list_aggregate(rms, 'quantile_cont', 0.2) AS cut, len(list_filter(x, lambda q: abs(q) > 0.95)) / len(x) AS clip FROM r),
n AS (SELECT *, list_aggregate(list_filter(rms, lambda q: q < cut), 'avg') AS low, list_aggregate(rms, 'avg') AS avg_rms FROM c), s AS (SELECT *, 10 * log10(power / (low * low + 1e-10::DOUBLE)) AS snr FROM n)
SELECT vec_id, snr >= 5 AND clip < 0.01 AS is_valid, snr, avg_rms, clip AS clipping_ratio FROM s""")
def p10(spark, sf):
    return _d(spark, sf).select("vec_id", g.clip_quality(F.col("x"), 5, 16, 4).alias("q")).select("vec_id", "q.*")


@query("p11_segment_gate", f"""WITH {_D}, r AS (SELECT vec_id, x, {_rms('x', 16, 4)} AS rms FROM d) SELECT vec_id, list_aggregate(rms, 'avg') >= 0.01 AND list_max(list_transform(x, lambda q: abs(q))) <= 0.99 AND list_sum(list_transform(x, lambda q: q * q)) / len(x) >= 1.5 * 0.01 AS ok FROM r""")
def p11(spark, sf):
    return _d(spark, sf).select("vec_id", g.passes_gate(F.col("x"), 1.5, 16, 4).alias("ok"))


@query("d10_mono_mean", "SELECT vec_id, list_transform(range(len(embedding)), lambda i: (CAST(embedding[i + 1] AS DOUBLE) + CAST(embedding[len(embedding) - i] AS DOUBLE)) / 2) AS mono FROM embeddings")
def d10(spark, sf):
    return _d(spark, sf).select("vec_id", g.to_mono(F.array("x", F.reverse("x"))).alias("mono"))


# --- training logs ----------------------------------------------------------------------------

_S = v.STEPS_SQL
_LOG = """lg AS (SELECT run, epoch * 3 + k AS line_no, CASE k WHEN 0 THEN '> EPOCH: ' || CAST(epoch % 40 AS VARCHAR) || '/40 STEP: ' || CAST(epoch % 30 AS VARCHAR)
  WHEN 1 THEN CASE WHEN epoch % 3 = 0 THEN 'EVALUATION' WHEN epoch % 3 = 1 THEN '> EPOCH: ' || CAST(epoch % 40 AS VARCHAR) || ' --> EVALUATION AVERAGE LOSS: ' || CAST(epoch % 17 AS VARCHAR) || '.25' ELSE 'x' END
  ELSE ' | > EVAL avg_loss: ' || CAST(epoch % 11 AS VARCHAR) || '.5' END AS line FROM steps, (VALUES (0), (1), (2)) t(k))"""


def _log(spark, sf):
    e = F.col("epoch")
    s = lambda c: c.cast("string")
    lines = F.array(
        F.concat(F.lit("> EPOCH: "), s(e % 40), F.lit("/40 STEP: "), s(e % 30)),
        F.when(e % 3 == 0, "EVALUATION").when(e % 3 == 1, F.concat(F.lit("> EPOCH: "), s(e % 40), F.lit(" --> EVALUATION AVERAGE LOSS: "), s(e % 17), F.lit(".25"))).otherwise("x"),
        F.concat(F.lit(" | > EVAL avg_loss: "), s(e % 11), F.lit(".5")),
    )
    rows = v.steps(spark, sf).select("run", "epoch", F.posexplode(lines).alias("k", "line"))
    return rows.select("run", (F.col("epoch") * 3 + F.col("k")).alias("line_no"), "line")


LOSSES_BY_STEP = f"""WITH {_S}, {_LOG}, g AS (SELECT *, CAST(nullif(regexp_extract(line, 'STEP:\\s*(\\d+)', 1), '') AS BIGINT) AS st, TRY_CAST(nullif(regexp_extract(line, '(?:loss:|avg_loss:)\\s*([\\d.]+)', 1), '') AS DOUBLE) AS loss FROM lg),
c AS (SELECT *, last_value(st IGNORE NULLS) OVER (PARTITION BY run ORDER BY line_no) AS step FROM g)
SELECT run, step, arg_max(loss, line_no) AS eval_loss FROM c WHERE (line LIKE '%EVAL%' OR line LIKE '%Evaluation%') AND step > 0 AND loss IS NOT NULL GROUP BY 1, 2"""


@query("w11_eval_loss_by_step", LOSSES_BY_STEP)
def w11(spark, sf):
    return tr.eval_loss_by_step(_log(spark, sf))


@query("w12_eval_loss_by_epoch", f"""WITH {_S}, {_LOG},
g AS (SELECT *, CAST(nullif(regexp_extract(line, '>\\s*EPOCH:\\s*(\\d+)\\s*-->\\s*EVALUATION\\s+AVERAGE\\s+LOSS:\\s*([\\d.]+)', 1), '') AS BIGINT) AS e1, TRY_CAST(nullif(regexp_extract(line, '>\\s*EPOCH:\\s*(\\d+)\\s*-->\\s*EVALUATION\\s+AVERAGE\\s+LOSS:\\s*([\\d.]+)', 2), '') AS DOUBLE) AS l1,
  CAST(nullif(regexp_extract(line, 'EPOCH:\\s*(\\d+)', 1), '') AS BIGINT) AS ee, TRY_CAST(nullif(regexp_extract(line, 'avg_loss:\\s*([\\d.]+)', 1), '') AS DOUBLE) AS av FROM lg),
c AS (SELECT *, last_value(CASE WHEN e1 IS NULL THEN ee END IGNORE NULLS) OVER (PARTITION BY run ORDER BY line_no) AS now, first_value(av IGNORE NULLS) OVER (PARTITION BY run ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ahead FROM g),
x AS (SELECT run, e1 AS epoch, l1 AS loss, line_no AS k, 1 AS kind FROM c WHERE e1 IS NOT NULL UNION ALL SELECT run, now, ahead, -line_no, 0 FROM c WHERE e1 IS NULL AND now IS NOT NULL AND line LIKE '%EVALUATION%' AND ahead IS NOT NULL)
SELECT run, epoch, arg_max(loss, (kind, k)) AS eval_loss FROM x GROUP BY 1, 2""")
def w12(spark, sf):
    return tr.eval_loss_by_epoch(_log(spark, sf))


@query("w13_loss_changes", f"WITH {_S}, c AS (SELECT run, epoch, val_loss - lag(val_loss) OVER (PARTITION BY run ORDER BY epoch) AS change FROM steps) SELECT *, CASE WHEN change IS NULL THEN 'baseline' WHEN change < 0 THEN 'improved' WHEN change > 0 THEN 'worse' ELSE 'same' END AS status FROM c")
def w13(spark, sf):
    return tr.loss_changes(v.steps(spark, sf).withColumn("loss", F.col("val_loss"))).select("run", "epoch", "change", "status")


@query("w14_divergence", f"""WITH {_S} SELECT run, epoch, coalesce(lag(train_loss, 2) OVER w > lag(train_loss, 1) OVER w AND lag(train_loss, 1) OVER w > train_loss AND lag(val_loss, 2) OVER w < lag(val_loss, 1) OVER w AND lag(val_loss, 1) OVER w < val_loss, false) AS diverging,
 train_loss > 0 AND val_loss / train_loss > 3 AS wide_gap FROM steps WINDOW w AS (PARTITION BY run ORDER BY epoch)""")
def w14(spark, sf):
    return tr.divergence(v.steps(spark, sf)).select("run", "epoch", "diverging", "wide_gap")


def _stop_sql(patience: int, delta: float, first: str) -> str:
    return f"""WITH RECURSIVE {_S}, f AS (
  SELECT run, epoch, {first} UNION ALL
  SELECT n.run, n.epoch, CASE WHEN s.stop IS NULL AND b THEN n.val_loss ELSE best END, CASE WHEN s.stop IS NULL AND b THEN n.epoch ELSE best_epoch END, CASE WHEN s.stop IS NOT NULL THEN bad WHEN b THEN 0 ELSE bad + 1 END,
    CASE WHEN s.stop IS NOT NULL THEN s.stop WHEN NOT b AND bad + 1 >= {patience} THEN n.epoch END
  FROM (SELECT f.*, n, n.val_loss < f.best - {delta}::DOUBLE AS b FROM f JOIN steps n ON n.run = f.run AND n.epoch = f.epoch + 1) s)
SELECT run, arg_max(best, epoch) AS best, arg_max(best_epoch, epoch) AS best_epoch, max(stop) AS stop_epoch FROM f GROUP BY run"""


_FIRST = "val_loss AS best, epoch AS best_epoch, 0 AS bad, CAST(NULL AS INTEGER) AS stop FROM steps WHERE epoch = 1"


@query("w15_early_stop_baseline", _stop_sql(10, 0.001, _FIRST))
def w15(spark, sf):
    return tr.early_stop(v.steps(spark, sf), 10, 0.001, True)


@query("w16_early_stop_patience", _stop_sql(1, 0.01, _FIRST))
def w16(spark, sf):
    return tr.early_stop(v.steps(spark, sf), 1, 0.01, False)


@query("w17_ema", f"WITH {_S} SELECT run, list_reduce(list(val_loss ORDER BY epoch), lambda s, x: 0.1::DOUBLE * x + 0.9::DOUBLE * s) AS ema FROM steps GROUP BY run")
def w17(spark, sf):
    rows = tr.ema(v.steps(spark, sf), 0.9)
    return rows


@query("w17_warmup_rate", "SELECT o_orderkey, CASE WHEN o_orderkey < 1000 THEN 0.01::DOUBLE * o_orderkey / 1000 ELSE 0.01::DOUBLE END AS rate FROM orders")
def w17b(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", tr.warmup_rate(F.col("o_orderkey"), 1000, 0.01).alias("rate"))


@query("a14_loss_summary", f"""WITH {_S}, g AS (SELECT run, arg_min(val_loss, epoch) AS "first", arg_max(val_loss, epoch) AS "last", min(val_loss) AS least, max(val_loss) AS most, arg_min(epoch, (val_loss, epoch)) AS best_epoch, arg_max(epoch, (val_loss, -epoch)) AS worst_epoch FROM steps GROUP BY run),
p AS (SELECT *, ("last" - "first") / "first" * 100 AS change_pct FROM g) SELECT *, CASE WHEN change_pct > 50 THEN 'severe' WHEN change_pct > 20 THEN 'overfitting' WHEN change_pct < -20 THEN 'excellent' ELSE 'stable' END AS verdict FROM p""")
def a14(spark, sf):
    return tr.loss_summary(v.steps(spark, sf).withColumn("loss", F.col("val_loss")))


_CK = _S + ", ck AS (SELECT run, epoch AS step, CASE WHEN epoch % 4 <> 0 THEN epoch % 60 END AS epoch, CASE WHEN run % 3 <> 0 THEN val_loss END AS eval_loss, epoch % 10 = 3 AS is_best FROM steps)"


def _ck(spark, sf):
    e = F.col("epoch")
    return v.steps(spark, sf).select("run", e.alias("step"), F.when(e % 4 != 0, e % 60).alias("epoch"), F.when(F.col("run") % 3 != 0, F.col("val_loss")).alias("eval_loss"), (e % 10 == 3).alias("is_best"))


@query("a15_recommended", f"""WITH {_CK}, r AS (SELECT *, CASE WHEN eval_loss IS NOT NULL THEN 0 WHEN coalesce(epoch <= 5, false) AND is_best THEN 1 WHEN coalesce(epoch <= 5, false) THEN 2 WHEN is_best THEN 3 ELSE 4 END AS k FROM ck),
n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY k, eval_loss NULLS FIRST, CASE WHEN k = 2 THEN -step ELSE step END) AS nth FROM r) SELECT run, step, epoch, eval_loss, is_best FROM n WHERE nth = 1""")
def a15(spark, sf):
    return tr.recommended(_ck(spark, sf))


@query("a16_overfitting", f"""WITH {_CK}, g AS (SELECT run, count(*) AS points, arg_min(eval_loss, step) AS "first", arg_max(eval_loss, step) AS "last", arg_min(step, (eval_loss, step)) AS best_step FROM ck WHERE eval_loss IS NOT NULL GROUP BY run) SELECT *, "last" > 1.5 * "first" AS detected FROM g WHERE points >= 3""")
def a16(spark, sf):
    return tr.overfitting(_ck(spark, sf))


@query("a17_monitor_summary", f"""WITH {_S} SELECT run, arg_min(epoch, (val_loss, epoch)) AS best_epoch, min(val_loss) AS best, arg_max(val_loss / train_loss, epoch) AS final_gap, count(*) FILTER (WHERE train_loss > 0 AND val_loss / train_loss > 3) AS warnings FROM steps GROUP BY run""")
def a17(spark, sf):
    gap = tr.ratio(F.col("val_loss"), F.col("train_loss"))
    return v.steps(spark, sf).groupBy("run").agg(F.min_by("epoch", F.struct("val_loss", "epoch")).alias("best_epoch"), F.min("val_loss").alias("best"), F.max_by(gap, "epoch").alias("final_gap"), F.count_if((F.col("train_loss") > 0) & (gap > 3)).alias("warnings"))


@query("p25_removable", f"""WITH {_CK}, l AS (SELECT *, min(eval_loss) OVER (PARTITION BY run) AS least FROM ck) SELECT run, step FROM l WHERE NOT is_best AND (coalesce(epoch > 20, false) OR coalesce(eval_loss > 1.5 * least, false))""")
def p25(spark, sf):
    return tr.removable(_ck(spark, sf)).select("run", "step")


@query("j13_checkpoint_losses", f"WITH {_CK}, l AS (SELECT run, epoch AS step, train_loss AS loss FROM steps WHERE epoch % 2 = 0) SELECT ck.run, ck.step, l.loss FROM ck LEFT JOIN l ON l.run = ck.run AND l.step = ck.step")
def j13(spark, sf):
    losses = v.steps(spark, sf).filter("epoch % 2 = 0").select("run", F.col("epoch").alias("step"), F.col("train_loss").alias("loss"))
    return tr.with_loss(_ck(spark, sf), losses).select("run", "step", "loss")


@query("o03_checkpoints_by_step", f"WITH {_CK} SELECT run, step FROM ck ORDER BY run, step")
def o03(spark, sf):
    return _ck(spark, sf).select("run", "step").orderBy("run", "step")


# --- vocabularies -----------------------------------------------------------------------------


def _grams(k: int) -> str:
    return f"SELECT unnest(list_transform(range(1, length(text) - {k} + 2), lambda i: substr(text, i, {k}))) AS token FROM documents WHERE length(text) >= {k}"


_GRAMS = "g AS (SELECT token, count(*) AS n FROM (" + " UNION ALL ".join(_grams(k) for k in (1, 2, 3)) + ") GROUP BY token)"


@query("a07_char_ngrams", f"WITH {_GRAMS} SELECT token, n FROM g WHERE n >= 2 ORDER BY n DESC, token LIMIT 1000")
def a07(spark, sf):
    return vo.top_tokens(vo.char_ngrams(table(spark, sf, "documents")), 2, 1000)


_V = "vo AS (SELECT p_type AS token, min(p_partkey) AS id FROM part GROUP BY p_type)"


def _vocab(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_type").alias("token")).agg(F.min("p_partkey").alias("id"))


@query("j15_missing_tokens", f"WITH {_V} SELECT DISTINCT lang AS token FROM documents WHERE lang NOT IN (SELECT token FROM vo) UNION SELECT DISTINCT p_brand FROM part WHERE p_brand NOT IN (SELECT token FROM vo)")
def j15(spark, sf):
    c = table(spark, sf, "documents").select(F.col("lang").alias("token")).unionByName(table(spark, sf, "part").select(F.col("p_brand").alias("token"))).distinct()
    return c.join(_vocab(spark, sf), "token", "left_anti")


@query("u14_extend_vocabulary", f"""WITH {_V}, {_GRAMS}, f AS (SELECT token FROM g WHERE n >= 5 ORDER BY n DESC, token LIMIT 500), e AS (SELECT chr(CAST(i AS INTEGER)) AS token FROM range(4608, 5024) t(i)),
c AS (SELECT token FROM f UNION SELECT token FROM e), n AS (SELECT token, row_number() OVER (ORDER BY token) AS nth FROM c WHERE token NOT IN (SELECT token FROM vo))
SELECT token, id FROM vo UNION ALL SELECT token, (SELECT max(id) FROM vo) + nth FROM n""")
def u14(spark, sf):
    frequent = vo.top_tokens(vo.char_ngrams(table(spark, sf, "documents")), 5, 500).select("token")
    return vo.extended(_vocab(spark, sf), frequent.unionByName(vo.code_points(spark, 0x1200, 0x139F)))


@query("u15_vocabulary_of_size", "WITH vo AS (SELECT n_name AS token, CAST(n_nationkey AS BIGINT) AS id FROM nation), s AS (SELECT chr(CAST(i AS INTEGER)) AS token, i - 4608 AS nth FROM range(4608, 4640) t(i)) SELECT token, id FROM vo UNION ALL SELECT token, 25 + nth FROM s UNION ALL SELECT '<pad_' || CAST(i - 57 AS VARCHAR) || '>', i FROM range(57, 80) t(i)")
def u15(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("token"), F.col("n_nationkey").cast("long").alias("id"))
    spare = vo.code_points(spark, 0x1200, 0x121F).withColumn("rank", F.lit(0))
    return vo.matched_to_size(n, spare, 80)


@query("o06_token_ids", "SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM (SELECT DISTINCT p_name AS token FROM part)")
def o06(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_name").alias("token"))
    none = spark.createDataFrame([], "token string, id long")
    return vo.extended(none, names)
