"""Interval algebra on time segments: source_id, idx, start, end (seconds), text or confidence.

Operators whose state depends on all that came before are folds over blocks of rows (folds.py), so one
source may fill any number of tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators import folds


def _by_source(order: str = "idx"):
    return W.partitionBy("source_id").orderBy(order)


def valid(df: DataFrame) -> DataFrame:
    """Segments that end after they start and have a text."""
    return df.filter((F.col("end") > F.col("start")) & (F.trim("text") != ""))


def merge_short_cues(df: DataFrame, least: float = 1.0, most: float = 20.0, max_gap: float = 1.5, block: int = folds.BLOCK) -> DataFrame:
    """Cues merged with their followers by four rules, the first that applies to the pair deciding:

    1. the current cue is shorter than ``least``: gaps up to max_gap, twice that under one second;
    2. the next one is shorter than ``least``: gaps up to max_gap;
    3. both are shorter than two seconds: gaps up to 1.5 max_gap;
    4. gaps under half a second;
    and never beyond ``most`` seconds in all. Texts are joined by a space. idx is the first cue's.
    """
    return folds.folded(df, "source_id", "idx", ["start", "end", "text"], folds.Cues(least, most, max_gap), block)


def merge_short_speech(df: DataFrame, least: float = 0.5, max_gap: float = 0.5, block: int = folds.BLOCK) -> DataFrame:
    """Segments extended over gaps up to max_gap, or while shorter than ``least``; the confidence is
    averaged pairwise; results shorter than ``least`` go. A short segment reaches over any pause.
    """
    out = folds.folded(df, "source_id", "idx", ["start", "end", "confidence"], folds.Speech(least, max_gap), block)
    return out.filter(F.col("end") - F.col("start") >= least)


def merge_close(df: DataFrame, max_gap: float = 0.5, block: int = folds.BLOCK) -> DataFrame:
    """Runs of segments with gaps up to max_gap: first start, last end, pairwise averaged confidence,
    least snr, padding only if all have it."""
    snr = F.col("snr").cast("double")
    return folds.folded(df, "source_id", "idx", ["start", "end", "confidence", snr, "padded"], folds.Close(max_gap), block)


def expand_short(df: DataFrame, least: float, audio_len: Column | float, guard: float = 0.02) -> DataFrame:
    """Cues shorter than ``least`` grow into the free room beside them, never over a neighbour."""
    w = _by_source()
    length = audio_len if isinstance(audio_len, Column) else F.lit(float(audio_len))
    rows = (
        df.withColumn("__prev", F.lag("end").over(w))
        .withColumn("__next", F.lead("start").over(w))
        .withColumn("__need", least - (F.col("end") - F.col("start")))
        .withColumn("__back", F.greatest(F.lit(0.0), F.col("start") - F.coalesce("__prev", F.lit(0.0)) - guard))
        .withColumn("__fwd", F.greatest(F.lit(0.0), F.coalesce("__next", length) - F.col("end") - guard))
    )
    need, back, fwd = F.col("__need"), F.col("__back"), F.col("__fwd")
    half_back = F.least(back, need / 2)
    half_fwd = F.least(fwd, need - half_back)
    more_back = half_back + F.greatest(F.lit(0.0), F.least(back - half_back, need - half_back - half_fwd))
    more_fwd = half_fwd + F.greatest(F.lit(0.0), F.least(fwd - half_fwd, need - more_back - half_fwd))
    first, last = F.col("__prev").isNull(), F.col("__next").isNull()
    take_back = F.when(first, 0.0).when(last, F.least(need, back)).otherwise(more_back)
    take_fwd = F.when(first, F.least(need, fwd)).when(last, 0.0).otherwise(more_fwd)
    short = need > 0
    return (
        rows.withColumn("__s", F.when(short, F.greatest(F.lit(0.0), F.col("start") - take_back)).otherwise(F.col("start")))
        .withColumn("end", F.when(short, F.least(length, F.col("end") + take_fwd)).otherwise(F.col("end")))
        .withColumn("start", F.col("__s"))
        .drop("__prev", "__next", "__need", "__back", "__fwd", "__s")
    )


def edge_buffer(df: DataFrame, buffer: float, audio_len: float, extra: float = 0.2) -> DataFrame:
    """Starts and ends moved out by ``buffer``, by ``extra`` more at a source's ends, and clamped."""
    w = _by_source()
    first, last = F.lag("idx").over(w).isNull(), F.lead("idx").over(w).isNull()
    rows = df.withColumn("__f", first).withColumn("__l", last)
    b = lambda edge: F.lit(buffer) + F.when(edge, extra).otherwise(0.0)
    return (
        rows.withColumn("start", F.greatest(F.lit(0.0), F.col("start") - b(F.col("__f"))))
        .withColumn("end", F.least(F.lit(float(audio_len)), F.col("end") + b(F.col("__l"))))
        .drop("__f", "__l")
    )


def overlapping(a: DataFrame, b: DataFrame, width: float = 1.0) -> DataFrame:
    """Pairs of a and b of the same source that overlap; b's columns are prefixed with b_.

    Time is cut into nested buckets, of ``width`` seconds and every power of two of it. An interval lies
    in the one or two buckets of its own size, and looks up the larger ones around them, of the sizes that
    occur on the other side: some rows a size, however long the longest interval is. The join is an
    equi-join on bucket and size; a pair counts in the bucket, of the longer one's size, where its
    overlap starts. An interval without a bound overlaps nothing.
    """

    def sized(df: DataFrame, s: str, e: str) -> DataFrame:
        whole = df.filter(F.col(s).isNotNull() & F.col(e).isNotNull())
        halvings = F.ceil(F.log2(F.greatest(F.abs(F.col(e) - F.col(s)) / width, F.lit(1.0))))
        return whole.withColumn("__size", F.least(halvings, F.lit(60)).cast("int"))

    def buckets(s: str, e: str, size: Column, role: int) -> Column:
        each = F.lit(width) * F.pow(F.lit(2.0), size)
        first, last = F.floor(F.col(s) / each), F.floor(F.col(e) / each)
        return F.transform(F.sequence(first, last), lambda n: F.struct(F.lit(role).alias("role"), size.alias("size"), n.alias("n")))

    def dealt(df: DataFrame, s: str, e: str, others: DataFrame, own_role: int, others_role: int, same: bool) -> DataFrame:
        """own_role: in the buckets of its own size; others_role: in those of the larger ones (and the same) of the others."""
        df = df.withColumn("__sizes", others.agg(F.collect_set("__size")).scalar())
        own, sizes = F.col("__size"), F.col("__sizes")
        up = F.flatten(F.transform(F.filter(sizes, lambda x: (x >= own) if same else (x > own)), lambda x: buckets(s, e, x, others_role)))
        at_home = F.exists(sizes, lambda x: (x < own) if same else (x <= own))
        home = F.when(at_home, buckets(s, e, own, own_role)).otherwise(F.slice(buckets(s, e, own, own_role), 1, 0))
        return df.withColumn("__at", F.explode(F.concat(home, up))).select("*", *(F.col(f"__at.{x}").alias(f"__{x}") for x in ("role", "n")), F.col("__at.size").alias("__of")).drop("__at", "__size", "__sizes")

    other = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    left, right = sized(a, "start", "end"), sized(other, "b_start", "b_end")
    # role 1: b's interval is the shorter one, looking up; role 2: a's is, or they are alike
    mine = dealt(left, "start", "end", right, 1, 2, True)
    theirs = dealt(right, "b_start", "b_end", left, 2, 1, False)
    theirs = theirs.withColumnsRenamed({x: f"__b{x}" for x in ("__role", "__of", "__n")})
    same = [F.col(x) == F.col(f"__b{x}") for x in ("__role", "__of", "__n")]
    both = mine.join(theirs, [F.col("source_id") == F.col("b_source_id"), *same])
    first = F.floor(F.greatest("start", "b_start") / (F.lit(width) * F.pow(F.lit(2.0), F.col("__of"))))
    hit = (F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end")) & (F.col("__n") == first)
    return both.filter(hit).drop("__role", "__of", "__n", *(f"__b{x}" for x in ("__role", "__of", "__n")))


def overlap(a_start="start", a_end="end", b_start="b_start", b_end="b_end") -> Column:
    return F.greatest(F.lit(0.0), F.least(F.col(a_end), F.col(b_end)) - F.greatest(F.col(a_start), F.col(b_start)))


def first_overlap_text(segments: DataFrame, cues: DataFrame, share: float = 0.5) -> DataFrame:
    """segments with the text of the first cue that covers over ``share`` of them, else null."""
    hit = overlapping(segments, cues).filter(overlap() / (F.col("end") - F.col("start")) > share)
    text = hit.groupBy("source_id", "idx").agg(F.min_by("b_text", "b_idx").alias("cue_text"))
    return segments.join(text, ["source_id", "idx"], "left")


def best_overlap(cues: DataFrame, regions: DataFrame) -> DataFrame:
    """For each cue the region of the largest overlap, the earliest of equals; cues without one go."""
    hit = overlapping(cues, regions).withColumn("overlap", overlap()).filter("overlap > 0")
    return hit.groupBy("source_id", "idx").agg(
        F.max_by("b_idx", F.struct("overlap", -F.col("b_idx"))).alias("region"), F.max("overlap").alias("overlap")
    )


def contained(words: DataFrame, segments: DataFrame, width: float = 1.0) -> DataFrame:
    """(source_id, idx of the segment, word's columns b_*) for words inside segments."""
    return overlapping(segments, words, width).filter((F.col("b_start") >= F.col("start")) & (F.col("b_end") <= F.col("end")))


def nearest(df: DataFrame, points: DataFrame, at: str, point: str, tolerance: float) -> DataFrame:
    """df with __near: the nearest point of the same source if nearer than ``tolerance``, the smaller
    of equals. Points and rows are sorted together; the last point before and the first one after
    are found by windows, so nothing is joined pairwise.
    """
    rows = df.select("source_id", "idx", F.col(at).alias("__t"), F.lit(None).cast("double").alias("__p"), F.lit(1).alias("__kind"))
    pts = points.select("source_id", F.lit(None).cast("int").alias("idx"), F.col(point).alias("__t"), F.col(point).alias("__p"), F.lit(0).alias("__kind"))
    both = rows.unionByName(pts)
    up = W.partitionBy("source_id").orderBy("__t", "__kind").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("source_id").orderBy(F.col("__t").desc(), "__kind").rowsBetween(W.unboundedPreceding, 0)
    seen = both.withColumn("__before", F.last("__p", True).over(up)).withColumn("__after", F.last("__p", True).over(down)).filter("__kind = 1")
    lo, hi = F.abs(F.col("__t") - F.col("__before")), F.abs(F.col("__after") - F.col("__t"))
    best = F.when(hi.isNull() | (lo <= hi), F.col("__before")).otherwise(F.col("__after"))
    near = seen.withColumn("__near", best).filter(F.abs(F.col("__near") - F.col("__t")) < tolerance).select("source_id", "idx", "__near")
    return df.join(near, ["source_id", "idx"], "left")


def snap_to_words(segments: DataFrame, words: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """Starts move to the nearest word start, ends to the nearest word end, within the tolerance."""
    out = nearest(segments, words, "start", "start", tolerance).withColumn("__s", F.coalesce("__near", "start")).drop("__near")
    out = nearest(out, words, "end", "end", tolerance).withColumn("end", F.coalesce("__near", "end"))
    return out.withColumn("start", F.col("__s")).drop("__s", "__near")


def split_long(segments: DataFrame, words: DataFrame, most: float) -> DataFrame:
    """Segments over ``most`` seconds are cut once: at the word end nearest to 0.8 of it, at the middle if they
    hold no word, not at all if that word is the first or last one inside."""
    long = segments.filter(F.col("end") - F.col("start") > most)
    inside = contained(words, long).select("source_id", "idx", "start", "b_idx", "b_end")
    nth = F.row_number().over(W.partitionBy("source_id", "idx").orderBy("b_idx"))
    n = F.count("*").over(W.partitionBy("source_id", "idx"))
    ranked = inside.withColumn("nth", nth).withColumn("n", n).withColumn("off", F.abs(F.col("b_end") - F.col("start") - most * 0.8))
    best = ranked.groupBy("source_id", "idx").agg(
        F.min_by(F.struct("nth", "n", "b_end"), F.struct("off", "nth")).alias("best")
    )
    rows = segments.join(best, ["source_id", "idx"], "left")
    mid = (F.col("start") + F.col("end")) / 2
    cut = F.when(F.col("end") - F.col("start") > most, F.when(F.col("best").isNull(), mid).when((F.col("best.nth") > 1) & (F.col("best.nth") < F.col("best.n")), F.col("best.b_end")))
    halves = F.when(
        cut.isNotNull(),
        F.array(F.struct(F.lit(0).alias("part"), F.col("start").alias("s"), cut.alias("e")), F.struct(F.lit(1).alias("part"), cut.alias("s"), F.col("end").alias("e"))),
    ).otherwise(F.array(F.struct(F.lit(0).alias("part"), F.col("start").alias("s"), F.col("end").alias("e"))))
    return rows.withColumn("h", F.explode(halves)).select("source_id", "idx", "h.part", F.col("h.s").alias("start"), F.col("h.e").alias("end"), "confidence")


def sentences(words: DataFrame, buffer: float = 0.2, audio_len: float | None = None, least: float = 1 / 3) -> DataFrame:
    """Words joined up to each one that ends in ! 。 . or ?; unfinished ones go.

    The start moves back by the buffer but not past the middle to the word before, the end likewise;
    clips under ``least`` seconds go, but keep their number i.
    """
    w = _by_source()
    ends = F.col("word").rlike("[!。.?]$")
    marked = (
        words.withColumn("__end", ends.cast("int"))
        .withColumn("i", F.coalesce(F.sum("__end").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("__prev", F.lag("end").over(w))
        .withColumn("__next", F.coalesce(F.lead("start").over(w), F.lit(audio_len) if audio_len is not None else F.col("end")))
    )
    start = F.when(F.col("__prev").isNull(), F.greatest(F.col("start") - buffer, F.lit(0.0))).otherwise(
        F.greatest(F.col("start") - buffer, (F.col("__prev") + F.col("start")) / 2)
    )
    end = F.least((F.col("end") + F.col("__next")) / 2, F.col("end") + buffer)
    rows = marked.withColumn("__s", start).withColumn("__e", end)
    out = rows.groupBy("source_id", "i").agg(
        F.max("__end").alias("closed"),
        F.min_by("__s", "idx").alias("start"),
        F.max_by("__e", "idx").alias("end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"]), "").alias("text"),
    )
    return (
        out.filter("closed = 1")
        .withColumn("text", F.substr("text", F.lit(2)))
        .filter(F.col("end") - F.col("start") >= least)
        .select("source_id", "i", "start", "end", "text")
    )


def quality_filter(df: DataFrame, least: float = 0.5, most: float = 15, confidence: float = 0.5, snr: float = 10) -> DataFrame:
    return df.filter((F.col("end") - F.col("start")).between(least, most) & (F.col("confidence") >= confidence) & (F.col("snr") >= snr))


def high_quality() -> Column:
    return (F.col("confidence") >= 0.7) & (F.col("snr") >= 10) & (F.col("speech_prob") >= 0.6)


def generous_padding(df: DataFrame, before: float = 0.3, after: float = 0.4, audio_len: float | None = None) -> DataFrame:
    end = F.col("end") + after
    return df.withColumn("start", F.greatest(F.lit(0.0), F.col("start") - before)).withColumn(
        "end", F.least(F.lit(float(audio_len)), end) if audio_len is not None else end
    )


def accepted_trim(trimmed_start: Column, trimmed_end: Column, share: float = 0.8) -> Column:
    """A trim counts only if it keeps ``share`` of the segment."""
    return (trimmed_end - trimmed_start) >= share * (F.col("end") - F.col("start"))


def subtitle_dataset(cues: DataFrame, least: float, most: float, max_gap: float, buffer: float, audio_len: float) -> DataFrame:
    """Cues merged, grown, filtered by length, buffered: the rows of a speech dataset."""
    merged = merge_short_cues(cues, least, most, max_gap)
    grown = expand_short(merged, least, audio_len).filter(F.col("end") - F.col("start") <= most)
    return edge_buffer(grown, buffer, audio_len).filter(F.col("end") - F.col("start") >= 0.2)
