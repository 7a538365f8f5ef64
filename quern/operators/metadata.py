"""Operators on metadata relations: audio_file, text, speaker_name and optional columns.

Every operator that depends on order takes it as a column; nothing relies on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import paths, text
from quern.session import stored

# --- filters and checks -----------------------------------------------------------------------


def duration_filter(df: DataFrame, least: float = 1, most: float = 18) -> DataFrame:
    """Rows whose duration lies in the closed range; an unknown duration goes."""
    return df.filter(F.col("duration").between(least, most))


def duration_report(df: DataFrame, least: float = 1, most: float = 18) -> DataFrame:
    ok = F.coalesce(F.col("duration").between(least, most), F.lit(False))
    return df.agg(F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("filtered"))


def index_filter(df: DataFrame, start: int, path: str = "audio_file") -> DataFrame:
    """Rows whose stem ends in _number with number >= start; other rows go."""
    last = F.element_at(F.split(paths.stem(F.col(path)), "_"), -1)
    return df.filter(last.try_cast("bigint") >= start)


def repaired_paths(df: DataFrame, files: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """audio_file as listed, else under the first prefix where its name is listed, else dropped.

    files: one column, path. Each try is an equi-join on the listing.
    """
    listed = files.select(F.col("path").alias("__path")).distinct()
    out, found = df, []
    for i, prefix in enumerate(("", *prefixes)):
        key = F.col("audio_file") if not prefix else F.concat(F.lit(prefix + "/"), paths.basename(F.col("audio_file")))
        side = listed.withColumnRenamed("__path", f"__found{i}")
        out = out.join(side, key == F.col(f"__found{i}"), "left")
        found.append(f"__found{i}")
    path = F.coalesce(*map(F.col, found))
    return out.withColumn("audio_file", path).filter(F.col("audio_file").isNotNull()).drop(*found)


SPEAKER_WORDS = ("am", "amh", "en", "speaker", "unknown", "")


def speaker_column(c: Column) -> Column:
    return F.when(F.lower(F.trim(c)).isin(*SPEAKER_WORDS), "speaker").otherwise(c)


def text_counters(df: DataFrame, *keys: str) -> DataFrame:
    """How many texts are empty, and how many have one or two characters, after stripping."""
    n = F.length(text.collapse(F.coalesce(F.col("text"), F.lit(""))))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.count_if(n == 0).alias("n_empty"), F.count_if((n > 0) & (n < 3)).alias("n_short")
    )


def size_gate(n: Column, fail: int, warn: int) -> Column:
    return F.when(n < fail, "fail").when(n < warn, "warn").otherwise("pass")


def validation_report(df: DataFrame, split: str = "split") -> DataFrame:
    """One row a split: columns present, speaker words, text counters, size verdict, overall verdict."""
    n = F.length(text.collapse(F.coalesce(F.col("text"), F.lit(""))))
    out = df.groupBy(split).agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("audio_file").isNull() | (F.col("audio_file") == "")).alias("n_no_file"),
        F.count_if(F.lower(F.trim("speaker_name")).isin(*SPEAKER_WORDS)).alias("n_speaker_fixed"),
        F.count_if(n == 0).alias("n_empty"),
        F.count_if((n > 0) & (n < 3)).alias("n_short"),
    )
    size = F.when(F.col(split) == "train", size_gate(F.col("n_rows"), 20, 50)).otherwise(size_gate(F.col("n_rows"), 3, 5))
    return out.withColumn("size_verdict", size).withColumn(
        "valid", (F.col("size_verdict") != "fail") & (F.col("n_no_file") == 0) & (F.col("n_empty") == 0)
    )


def first_issue(df: DataFrame, exists: Column, good_audio: Column) -> DataFrame:
    """Rows with the first check they fail, in order: file, text, audio."""
    why = (
        F.when(~exists, "missing file")
        .when(F.length(text.collapse(F.coalesce(F.col("text"), F.lit("")))) < 3, "short text")
        .when(~good_audio, "poor audio")
    )
    return df.withColumn("issue", why)


# --- joins ------------------------------------------------------------------------------------


def pair_by_name(subtitles: DataFrame, media: DataFrame) -> DataFrame:
    """(srt, media): by lower-case stem, else by the stem without its language mark.

    media: path, pos; of equal stems the last position wins.
    """
    last = media.groupBy(F.lower(paths.stem(F.col("path"))).alias("stem")).agg(F.max_by("path", "pos").alias("media"))
    own = F.lower(paths.stem(F.col("srt")))
    bare = paths.without_language(own)
    keyed = subtitles.select("srt", own.alias("k1"), F.when(bare != own, bare).alias("k2"))
    return (
        keyed.join(last.select(F.col("stem").alias("k1"), F.col("media").alias("m1")), "k1", "left")
        .join(last.select(F.col("stem").alias("k2"), F.col("media").alias("m2")), "k2", "left")
        .select("srt", F.coalesce("m1", "m2").alias("media"))
        .filter(F.col("media").isNotNull())
    )


def existing(df: DataFrame, files: DataFrame, key: str) -> DataFrame:
    return df.join(files.select(key).distinct(), key, "left_semi")


def missing(df: DataFrame, files: DataFrame, key: str) -> DataFrame:
    return df.join(files.select(key).distinct(), key, "left_anti")


def renamed(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """audio_file with its base name looked up in mapping (old, new), its folder kept."""
    old = paths.basename(F.col("audio_file"))
    folder = F.regexp_extract("audio_file", "^(.*/)?", 0)
    return (
        df.join(mapping.select(F.col("old").alias("__old"), F.col("new").alias("__new")), old == F.col("__old"), "left")
        .withColumn("audio_file", F.concat(folder, F.coalesce("__new", old)))
        .drop("__old", "__new")
    )


def merge_by_content(base: DataFrame, new: DataFrame, hash_col: str, order: str) -> DataFrame:
    """new with a status: added, duplicate (in base or earlier in new), or error (no hash).

    order tells rows apart; rows equal in hash and order are first together. The first row of a hash is
    aggregated before any shuffle and joined back, so a very common hash is split like any skewed key.
    """
    known = base.select(hash_col).filter(F.col(hash_col).isNotNull()).distinct().withColumn("__known", F.lit(True))
    firsts = new.filter(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.min(order).alias("__first"))
    firsts = firsts.join(known, hash_col, "left").select(hash_col, F.when(F.col("__known").isNull(), F.col("__first")).alias("__first"))
    status = F.when(F.col(hash_col).isNull(), "error").when(F.col("__first") == F.col(order), "added").otherwise("duplicate")
    return new.join(firsts, hash_col, "left").withColumn("status", status).select(*new.columns, "status")


def processed_files(queue: DataFrame, history: DataFrame) -> DataFrame:
    """queue with the position of the first history row of the same type and name or hash.

    The OR is two equi-joins, so no nested loop is needed.
    """
    h = history.select(F.col("type").alias("h_type"), "file_name", "file_hash", "pos")
    by_name = queue.join(
        h.select("h_type", F.col("file_name").alias("h_name"), "pos"),
        (F.col("type") == F.col("h_type")) & (F.col("file_name") == F.col("h_name")),
    ).select("queue_id", "pos")
    by_hash = queue.join(
        h.select("h_type", F.col("file_hash").alias("h_hash"), "pos"),
        (F.col("type") == F.col("h_type")) & (F.col("file_hash") == F.col("h_hash")),
    ).select("queue_id", "pos")
    first = by_name.unionByName(by_hash).groupBy("queue_id").agg(F.min("pos").alias("found_at"))
    return queue.join(first, "queue_id", "left")


def unprocessed_sources(sources: DataFrame, rows: DataFrame) -> DataFrame:
    """Sources whose wavs/stem_ starts no row's audio_file.

    Rows give every prefix of theirs that ends in an underscore, so the test is an equi-join.
    """
    parts = F.split("audio_file", "_")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "_"), F.lit("_"))
    )
    seen = rows.filter(F.contains("audio_file", F.lit("_"))).select(F.explode(prefixes).alias("__prefix")).distinct()
    key = F.concat(F.lit("wavs/"), paths.stem(F.col("source")), F.lit("_"))
    return sources.join(seen, key == F.col("__prefix"), "left_anti")


# --- sets, order and splits -------------------------------------------------------------------


def keep_first(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def merged(parts: list[DataFrame], key: str = "audio_file") -> DataFrame:
    """Union in the given order, first row of each key; columns pos and src order the rows."""
    every = None
    for i, p in enumerate(parts):
        own = p.withColumn("src", F.lit(i))
        every = own if every is None else every.unionByName(own, allowMissingColumns=True)
    return keep_first(every, [key], "src", "pos")


def renumbered(df: DataFrame, start: int, *order: str | Column) -> DataFrame:
    """merged_00000000.wav and so on in the given order.

    The running number is global, so it is taken from per-partition counts of a range-partitioned
    sort rather than from one unpartitioned window.
    """
    return ordinal(df, *order).withColumn("audio_file", F.concat(F.lit("wavs/"), paths.merged_name(F.col("ordinal") + start)))


def ordinal(df: DataFrame, *order: str | Column) -> DataFrame:
    """df with ordinal 0, 1, ... in the given total order, whatever the columns' types.

    The rows are sorted once into as many ranges as the size asks for and written; each is numbered as
    it streams, and shifted by the counts of the ranges before it (a row a range).
    """
    key = [F.col(o) if isinstance(o, str) else o for o in order]
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    ranges = (
        df.select(row, *[k.alias(f"key{i}") for i, k in enumerate(key)])
        .repartitionByRange(*[f"key{i}" for i in range(len(key))])
        .sortWithinPartitions(*[f"key{i}" for i in range(len(key))])
        .select("row", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("nth"))
    )
    ranges = stored(ranges, "ordinal")
    sizes = ranges.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select(
        "part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    return ranges.join(F.broadcast(before), "part").select(
        *[F.col("row").getField(c).alias(c) for c in df.columns], (F.col("before") + F.col("nth")).alias("ordinal")
    )


def next_number(names: Column) -> Column:
    """Aggregate: one more than the largest number after the last underscore or at the end; 0 if none."""
    tail = F.element_at(F.split(names, "_"), -1).try_cast("bigint")
    digits = F.nullif(F.regexp_extract(names, r"(\d+)$", 1), F.lit("")).try_cast("bigint")
    return F.coalesce(F.max(F.coalesce(tail, digits)), F.lit(-1)) + 1


def length_bin(n: Column) -> Column:
    """short, medium, long, very_long; null for an empty text."""
    return (
        F.when((n > 0) & (n <= 50), "short").when((n > 50) & (n <= 100), "medium").when((n > 100) & (n <= 150), "long").when(n > 150, "very_long")
    )


def shuffled_key(seed: int, key: str | Column) -> Column:
    """A reproducible shuffle: order by the MD5 of seed and key."""
    c = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws("|", F.lit(str(seed)), c.cast("string")))


def first_by_hash(df: DataFrame, groups: list[str], take: Callable[[Column], Column], seed: int, key: str, chosen: str) -> DataFrame:
    """df with ``chosen``: true for the first take(n) of each group's n rows in shuffled order.

    No row is moved: counts by group and the hash's first four digits (65536 a group) tell which digits
    hold the last chosen row, the few rows of those digits give its hash, and a filter does the rest.
    Rows that share a key share their side. The groups are few; their limits are broadcast.
    """
    h = shuffled_key(seed, key)
    small = df.select(*groups, h.alias("h"), F.col(key).alias("k")).withColumn("digits", F.substring("h", 1, 4))
    by = [F.col(g) for g in groups] or [F.lit(0)]
    counts = small.groupBy(*groups, "digits").agg(F.count("*").alias("n"))
    upto, total = F.sum("n").over(W.partitionBy(*by).orderBy("digits")), F.sum("n").over(W.partitionBy(*by))
    edge = (
        counts.withColumns({"upto": upto, "wanted": take(total).cast("long")})
        .filter((F.col("upto") - F.col("n") < F.col("wanted")) & (F.col("wanted") <= F.col("upto")))
        .select(*groups, "digits", (F.col("wanted") - F.col("upto") + F.col("n")).alias("need"))
    )
    nth = F.row_number().over(W.partitionBy(*by, "digits").orderBy("h", "k"))
    last = (
        small.join(F.broadcast(edge), [*groups, "digits"])
        .withColumn("nth", nth)
        .filter(F.col("nth") == F.col("need"))
        .select(*[F.col(g).alias(f"__{g}") for g in groups], F.struct("h", "k").alias("__last"))
    )
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups], F.lit(True))
    inside = F.struct(h.alias("h"), F.col(key).alias("k")) <= F.col("__last")
    return df.join(F.broadcast(last), same, "left").withColumn(chosen, F.coalesce(inside, F.lit(False))).drop("__last", *[f"__{g}" for g in groups])


def stratified_split(df: DataFrame, ratio: float = 0.1, seed: int = 42, key: str = "audio_file") -> DataFrame:
    """split = val for max(1, floor(n * ratio)) rows of each length bin; empty texts go."""
    binned = df.withColumn("bin", length_bin(F.length("text"))).filter("bin is not null")
    take = lambda n: F.greatest(F.lit(1), F.floor(n * F.lit(ratio)))
    split = first_by_hash(binned, ["bin"], take, seed, key, "split")
    return split.withColumn("split", F.when(F.col("split"), "val").otherwise("train"))


#: Size rules of the plain random splits: rows -> rows in eval.
SPLIT_RULES = {
    "train_floor": lambda n: n - F.floor(n * F.lit(0.85)),
    "eval_floor": lambda n: F.floor(n * F.lit(0.15)),
    "eval_min3": lambda n: F.when(n >= 3, F.greatest(F.lit(3), F.floor(n * F.lit(0.15)))).otherwise(n),
}


def random_split(df: DataFrame, rule: str, seed: int = 42, key: str = "audio_file") -> DataFrame:
    """split = eval for as many rows as the rule says, by shuffled order."""
    split = first_by_hash(df, [], SPLIT_RULES[rule], seed, key, "split")
    return split.withColumn("split", F.when(F.col("split"), "eval").otherwise("train"))


def split_drift(df: DataFrame) -> DataFrame:
    """One row: how far apart train and val lie by text length, with verdicts."""
    n = F.length("text")
    val = F.col("split") == "val"
    row = df.agg(
        F.count_if(~val).alias("n_train"),
        F.count_if(val).alias("n_val"),
        F.avg(F.when(~val, n)).alias("train_mean"),
        F.avg(F.when(val, n)).alias("val_mean"),
        F.stddev_pop(F.when(~val, n)).alias("train_std"),
        F.stddev_pop(F.when(val, n)).alias("val_std"),
    )
    drift = F.abs(F.col("train_mean") - F.col("val_mean")) / F.col("train_mean") * 100
    share = 100.0 * F.col("n_val") / (F.col("n_train") + F.col("n_val"))
    return (
        row.withColumn("drift_pct", drift)
        .withColumn("val_pct", share)
        .withColumn("drift_verdict", F.when(drift < 5, "excellent").when(drift < 10, "good").when(drift < 20, "acceptable").otherwise("poor"))
        .withColumn("size_verdict", F.when(share.between(8, 15), "optimal").when(share.between(5, 20), "acceptable").otherwise("off"))
    )


def repeated_rows(df: DataFrame, times: int) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))


# --- statistics -------------------------------------------------------------------------------


def dataset_statistics(df: DataFrame) -> DataFrame:
    """One row: segments and durations by split, averages, ratio and the ten-hour flag."""
    train = F.col("split") == "train"
    d = F.coalesce(F.col("duration"), F.lit(0.0))
    row = df.agg(
        F.count("*").alias("total"),
        F.count_if(train).alias("train"),
        F.count_if(~train).alias("eval"),
        F.coalesce(F.sum(d), F.lit(0.0)).alias("total_s"),
        F.coalesce(F.sum(F.when(train, d)), F.lit(0.0)).alias("train_s"),
        F.coalesce(F.sum(F.when(~train, d)), F.lit(0.0)).alias("eval_s"),
    )
    return row.select(
        "*",
        (F.col("total_s") / 60).alias("total_min"),
        (F.col("total_s") / 3600).alias("total_h"),
        F.when(F.col("total") > 0, F.col("total_s") / F.col("total")).otherwise(0.0).alias("avg_s"),
        F.when(F.col("eval") > 0, F.col("train") / F.col("eval")).otherwise(0.0).alias("ratio"),
        (F.col("total_s") / 3600 >= 10).alias("ten_hours"),
    )


def project_statistics(df: DataFrame) -> DataFrame:
    """One row over text and duration: counts, characters of the joined text, words, speakers."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"(?U)\s+"), lambda w: w != ""))
    return df.agg(
        F.count("*").alias("n"),
        F.sum("duration").alias("total_s"),
        F.avg("duration").alias("avg_s"),
        F.min("duration").alias("min_s"),
        F.max("duration").alias("max_s"),
        (F.sum(F.length("text")) + F.count("*") - 1).alias("chars"),
        F.sum(words).alias("words"),
        (F.sum(words) / F.count("*")).alias("avg_words"),
        F.count_distinct("speaker_name").alias("speakers"),
    )


def length_histogram(df: DataFrame) -> DataFrame:
    n = F.length("text")
    return (
        df.withColumn("bin", length_bin(n)).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.avg(n).alias("mean_chars"))
    )


def fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """16 hex digits over all rows in order of the columns: hashes of rows are summed, so no task
    sees them all."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", *columns), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.substring(F.sha2(F.coalesce(F.sum(h), F.lit(0)).cast("decimal(38,0)").cast("string"), 256), 1, 16).alias("fingerprint"))


def timing(df: DataFrame) -> DataFrame:
    """df with timing struct<start,end>: explicit columns, then a timestamp text, then the name."""
    num = lambda c: F.col(c).try_cast("double")

    def pair(a: Column, b: Column) -> Column:
        return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("start"), b.alias("end")))

    ts = F.col("timestamp")
    sep = F.when(F.contains(ts, F.lit("-")), "-").when(F.contains(ts, F.lit(":")), ":")
    head = F.substring_index(ts, "-", 1)
    dash = pair(head.try_cast("double"), F.expr("substring(timestamp, locate('-', timestamp) + 1)").try_cast("double"))
    colon = pair(F.substring_index(ts, ":", 1).try_cast("double"), F.expr("substring(timestamp, locate(':', timestamp) + 1)").try_cast("double"))
    found = F.regexp_extract_all("audio_file", F.lit(r"(\d+\.\d+)"), F.lit(1))
    name = F.when(
        F.size(found) >= 2,
        F.struct(F.element_at(found, -2).cast("double").alias("start"), F.element_at(found, -1).cast("double").alias("end")),
    )
    stamp = F.when(sep == "-", dash).when(sep == ":", colon)
    return df.withColumn("timing", F.coalesce(pair(num("start_time"), num("end_time")), pair(num("start"), num("end")), stamp, name))
