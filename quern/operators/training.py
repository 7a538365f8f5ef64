"""Training analytics: logs, checkpoints, losses, early stopping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators import folds

NUMBER = r"([\d.]+)"


def log_lines(df: DataFrame) -> DataFrame:
    """run, line_no, line from whole log texts (run, text)."""
    return df.select("run", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def eval_loss_by_step(lines: DataFrame) -> DataFrame:
    """run, step, eval_loss: the last STEP seen applies to an evaluation line; the last loss wins;
    step 0 does not count."""
    w = W.partitionBy("run").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    step = F.nullif(F.regexp_extract("line", r"STEP:\s*(\d+)", 1), F.lit("")).cast("long")
    loss = F.nullif(F.regexp_extract("line", rf"(?:loss:|avg_loss:)\s*{NUMBER}", 1), F.lit("")).try_cast("double")
    seen = lines.withColumn("step", F.last(step, True).over(w)).withColumn("loss", loss)
    evals = seen.filter(F.col("line").rlike("EVAL|Evaluation") & (F.col("step") > 0) & F.col("loss").isNotNull())
    return evals.groupBy("run", "step").agg(F.max_by("loss", "line_no").alias("eval_loss"))


def eval_loss_by_epoch(lines: DataFrame) -> DataFrame:
    """run, epoch, eval_loss by three patterns: a loss on the epoch's own line (the last wins), and,
    where there is none, the first avg_loss within ten lines of an EVALUATION line."""
    grab = lambda p, i: F.nullif(F.regexp_extract("line", p, i), F.lit(""))
    p1 = rf">\s*EPOCH:\s*(\d+)\s*-->\s*EVALUATION\s+AVERAGE\s+LOSS:\s*{NUMBER}"
    p2 = rf"Epoch\s+(\d+)\s+.*?avg_loss:\s*{NUMBER}"
    order = W.partitionBy("run").orderBy("line_no")
    rows = (
        lines.withColumn("e1", F.coalesce(grab(p1, 1), grab(p2, 1)).cast("long"))
        .withColumn("l1", F.coalesce(grab(p1, 2), grab(p2, 2)).try_cast("double"))
        .withColumn("e3", F.when(F.col("e1").isNull(), grab(r"EPOCH:\s*(\d+)", 1).cast("long")))
        .withColumn("avg", grab(rf"avg_loss:\s*{NUMBER}", 1).try_cast("double"))
        .withColumn("now", F.last("e3", True).over(order.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("ahead", F.first("avg", True).over(order.rowsBetween(0, 9)))
    )
    direct = rows.filter("e1 is not null").select("run", F.col("e1").alias("epoch"), F.col("l1").alias("loss"), "line_no", F.lit(1).alias("kind"))
    found = rows.filter(F.col("e1").isNull() & F.col("now").isNotNull() & F.contains("line", F.lit("EVALUATION")) & F.col("ahead").isNotNull())
    later = found.select("run", F.col("now").alias("epoch"), F.col("ahead").alias("loss"), (-F.col("line_no")).alias("line_no"), F.lit(0).alias("kind"))
    # a direct loss beats one found ahead; of direct ones the last, of the others the first
    return direct.unionByName(later).groupBy("run", "epoch").agg(F.max_by("loss", F.struct("kind", "line_no")).alias("eval_loss"))


def with_loss(checkpoints: DataFrame, losses: DataFrame) -> DataFrame:
    return checkpoints.join(losses, ["run", "step"], "left")


def loss_changes(df: DataFrame) -> DataFrame:
    """Loss difference to the epoch before, with a status."""
    d = F.col("loss") - F.lag("loss").over(W.partitionBy("run").orderBy("epoch"))
    rows = df.withColumn("change", d)
    return rows.withColumn("status", F.when(F.col("change").isNull(), "baseline").when(F.col("change") < 0, "improved").when(F.col("change") > 0, "worse").otherwise("same"))


def ratio(a: Column, b: Column) -> Column:
    """a / b of doubles as IEEE 754 has it: over zero infinite, zero over zero NaN, never an error."""
    return F.when(b != 0, a / b).otherwise(a * F.pow(b, F.lit(-1.0)))


def loss_summary(df: DataFrame) -> DataFrame:
    """First, last, least and largest loss with their epochs (the first of equals), change, verdict.
    A run that begins at zero changes by infinity, or NaN if it ends there; both count as severe."""
    out = df.groupBy("run").agg(
        F.min_by("loss", "epoch").alias("first"),
        F.max_by("loss", "epoch").alias("last"),
        F.min("loss").alias("least"),
        F.max("loss").alias("most"),
        F.min_by("epoch", F.struct("loss", "epoch")).alias("best_epoch"),
        F.max_by("epoch", F.struct("loss", -F.col("epoch"))).alias("worst_epoch"),
    )
    pct = ratio(F.col("last") - F.col("first"), F.col("first")) * 100
    verdict = F.when(pct > 50, "severe").when(pct > 20, "overfitting").when(pct < -20, "excellent").otherwise("stable")
    return out.withColumn("change_pct", pct).withColumn("verdict", verdict)


def divergence(df: DataFrame, gap: float = 3.0) -> DataFrame:
    """Per epoch: whether train fell while val rose over three rows, and whether val / train > gap."""
    w = W.partitionBy("run").orderBy("epoch")
    t, v = F.col("train_loss"), F.col("val_loss")
    l = lambda c, k: F.lag(c, k).over(w)  # noqa: E731, E741
    down = (l("train_loss", 2) > l("train_loss", 1)) & (l("train_loss", 1) > t)
    up = (l("val_loss", 2) < l("val_loss", 1)) & (l("val_loss", 1) < v)
    return df.withColumn("diverging", F.coalesce(down & up, F.lit(False))).withColumn("wide_gap", (t > 0) & (v / t > gap))


def early_stop(df: DataFrame, patience: int, least_delta: float, baseline: bool, block: int = folds.BLOCK) -> DataFrame:
    """run, best, best_epoch, stop_epoch (null if it never stops): a fold over the run's epochs.

    A loss counts as better only if it beats the best by more than least_delta; with baseline the first
    loss is the best from the start. The fold goes on after the stop without changing anything.
    """
    return folds.folded(df, "run", "epoch", ["val_loss"], folds.Stopping(patience, least_delta, baseline), block)


def ema(df: DataFrame, decay: float, block: int = folds.BLOCK) -> DataFrame:
    """run and the exponential moving average of its losses in order, starting at the first."""
    return folds.folded(df, "run", "epoch", ["val_loss"], folds.Average(decay), block)


def warmup_rate(step: Column, warmup: int, base: float) -> Column:
    return F.when(step < warmup, base * step / warmup).otherwise(base)


def recommended(df: DataFrame, early: int = 5) -> DataFrame:
    """Per run the checkpoint of least loss; without losses the best early one, else the latest early one,
    else the best, else the first."""
    is_early = F.coalesce(F.col("epoch") <= early, F.lit(False))
    rank = (
        F.when(F.col("eval_loss").isNotNull(), 0).when(is_early & F.col("is_best"), 1).when(is_early, 2).when(F.col("is_best"), 3).otherwise(4)
    )
    tie = F.when(rank == 2, -F.col("step")).otherwise(F.col("step"))
    w = W.partitionBy("run").orderBy(rank, "eval_loss", tie)
    return df.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def overfitting(df: DataFrame) -> DataFrame:
    """Runs of three points at least: whether the last loss is over 1.5 times the first; the best step."""
    out = df.filter("eval_loss is not null").groupBy("run").agg(
        F.count("*").alias("points"), F.min_by("eval_loss", "step").alias("first"), F.max_by("eval_loss", "step").alias("last"), F.min_by("step", F.struct("eval_loss", "step")).alias("best_step")
    )
    return out.filter("points >= 3").withColumn("detected", F.col("last") > 1.5 * F.col("first"))


def removable(df: DataFrame) -> DataFrame:
    """Checkpoints that are not best and late (epoch over 20) or of over 1.5 times the least loss."""
    least = F.min("eval_loss").over(W.partitionBy("run"))
    rows = df.withColumn("__least", least)
    late, bad = F.coalesce(F.col("epoch") > 20, F.lit(False)), F.coalesce(F.col("eval_loss") > 1.5 * F.col("__least"), F.lit(False))
    return rows.filter(~F.col("is_best") & (late | bad)).drop("__least")
