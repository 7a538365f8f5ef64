"""Readers: metadata files, sidecars, listings, histories, vocabularies, logs, URL and line lists."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import paths

METADATA = "audio_file string, text string, speaker_name string"
HISTORY = (
    "datasets array<struct<type:string,video_id:string,url:string,title:string,language:string,duration:double,num_segments:bigint,"
    "output_path:string,processed_at:string,timestamp:double,file_name:string,file_path:string,file_hash:string,media_file:string,media_hash:string>>"
)


def metadata(spark: SparkSession, path: str, sep: str = "|", header: bool = True, na_values: str = "spark") -> DataFrame:
    """Pipe CSV with the three columns; na_values="pandas" also reads NA, null and the like as null."""
    df = spark.read.schema(METADATA).csv(path, sep=sep, header=header)
    if na_values == "pandas":
        words = ("NA", "N/A", "NaN", "nan", "null", "NULL", "None", "n/a", "#N/A", "")
        df = df.select(*[F.when(~F.col(c).isin(*words), F.col(c)).alias(c) for c in df.columns])
    return df


def any_columns(spark: SparkSession, path: str, sep: str = "|") -> DataFrame:
    """CSV whose header names the columns; nothing is inferred, all are strings."""
    return spark.read.csv(path, sep=sep, header=True, inferSchema=False)


def ragged_rows(spark: SparkSession, path: str, sep: str = "|") -> DataFrame:
    """file, fields (array) and n_fields of every non-empty line, header or not."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").filter("value <> ''")
    return fields_of(lines, sep)


def fields_of(lines: DataFrame, sep: str = "|") -> DataFrame:
    parts = F.split("value", "[" + sep + "]")
    return lines.withColumn("fields", parts).withColumn("n_fields", F.size("fields")).drop("value")


def has_header(spark: SparkSession, path: str) -> bool:
    """Whether the first line names the audio column."""
    first = spark.read.text(path).limit(1).collect()
    return bool(first) and "audio_file" in (first[0]["value"] or "")


def metadata_with_or_without_header(spark: SparkSession, path: str) -> DataFrame:
    """Header repair on reading: a missing header costs no row and a present one is no row."""
    return metadata(spark, path, header=has_header(spark, path))


def language_of(spark: SparkSession, path: str, default: str = "unknown") -> str:
    """The stripped text of a lang.txt; the default if it is missing or empty."""
    try:
        rows = spark.read.text(path, wholetext=True).limit(1).collect()
    except Exception as e:  # only a missing path has a default
        if "PATH_NOT_FOUND" in str(e):
            return default
        raise
    return (rows[0]["value"] or "").strip() or default if rows else default


def history(spark: SparkSession, path: str) -> DataFrame:
    """One row for each dataset of a history document, with its position; none if it is malformed."""
    docs = spark.read.text(path, wholetext=True)
    return history_of(docs)


def history_of(docs: DataFrame, column: str = "value") -> DataFrame:
    rows = docs.select(F.posexplode(F.from_json(column, HISTORY)["datasets"]).alias("pos", "d"))
    return rows.select("pos", "d.*")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """token, id of a vocabulary document, as a map or a list; an empty one is an error."""
    docs = spark.read.text(path, wholetext=True)
    out = vocabulary_of(docs)
    if not out.take(1):
        raise ValueError(f"no vocabulary in {path}")
    return out


def vocabulary_of(docs: DataFrame, column: str = "value") -> DataFrame:
    body = F.get_json_object(column, "$.model.vocab")
    as_map, as_list = F.from_json(body, "map<string,int>"), F.from_json(body, "array<string>")
    mapped = docs.select(F.explode(as_map).alias("token", "id"))
    listed = docs.filter(as_list.isNotNull() & as_map.isNull()).select(F.posexplode(as_list).alias("id", "token")).select("token", "id")
    return mapped.unionByName(listed)


def files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".wav", ".mp3", ".flac"), contains: str = "") -> DataFrame:
    """path, length, modificationTime of files below a folder; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    return listing(df, suffixes, contains)


def listing(df: DataFrame, suffixes: tuple[str, ...], contains: str = "") -> DataFrame:
    ok = F.lower(paths.suffix(F.col("path"))).isin(*suffixes)
    return df.filter(ok & F.contains("path", F.lit(contains))) if contains else df.filter(ok)


def count_by_folder(df: DataFrame) -> DataFrame:
    return df.groupBy(paths.parent(F.col("path")).alias("folder")).agg(F.count("*").alias("n"))


def staged(spark: SparkSession, pattern: str) -> DataFrame:
    """Metadata of all folders that match a glob, with the folder as dataset."""
    df = spark.read.schema(METADATA).csv(pattern, sep="|", header=True)
    return df.withColumn("dataset", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1))


def url_list(text: Column, hosts: str = "youtube.com|youtu.be") -> Column:
    """URLs of a free text: cut at commas and white space, quotes stripped, known hosts kept."""
    parts = F.transform(F.split(F.trim(text), r"[,\s]+"), lambda u: F.regexp_replace(u, "^[\"']+|[\"']+$", ""))
    return F.filter(parts, lambda u: u.rlike(hosts))


def url_lines(lines: DataFrame, hosts: str = "youtube.com|youtu.be") -> DataFrame:
    """One URL a line; blank lines and comments go."""
    u = F.regexp_replace(F.trim("value"), "^[\"']+|[\"']+$", "")
    return lines.select(u.alias("url")).filter((F.col("url") != "") & ~F.col("url").startswith("#") & F.col("url").rlike(hosts))


def proxy_lines(lines: DataFrame) -> DataFrame:
    p = F.trim("value")
    return lines.select(p.alias("proxy")).filter((F.col("proxy") != "") & ~F.col("proxy").startswith("#"))


COOKIES = ("SAPISID", "HSID", "SSID", "APISID", "SID", "LOGIN_INFO")


def cookie_audit(lines: DataFrame, now: int, required: tuple[str, ...] = COOKIES) -> DataFrame:
    """One row over a Netscape cookie file: header there, cookies, required names missing, expired."""
    f = F.split("value", "\t")
    is_cookie = (F.size(f) >= 7) & ~F.col("value").startswith("#")
    expires = F.get(f, F.lit(4)).try_cast("long")
    return lines.agg(
        F.bool_or(F.contains("value", F.lit("Netscape HTTP Cookie File"))).alias("has_header"),
        F.count_if(is_cookie).alias("cookies"),
        F.sort_array(F.array_except(F.array(*map(F.lit, required)), F.coalesce(F.collect_set(F.when(is_cookie, F.get(f, F.lit(5)))), F.array().cast("array<string>")))).alias("missing"),
        F.count_if(is_cookie & (expires > 0) & (expires < now)).alias("expired"),
    )


def decoded_subtitles(df: DataFrame, column: str = "content") -> DataFrame:
    """Binary subtitle files as text: gzip is unpacked, then UTF-8, or Latin-1 where that fails. Only
    gzip files go to Python, in Arrow batches."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for b in batches:
            at = b.schema.get_field_index(column)
            own = [gzip.decompress(x) for x in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(own, b.schema.field(at).type))

    packed = F.coalesce(F.hex(F.substring(column, 1, 2)) == "1F8B", F.lit(False))
    own = df.filter(packed).mapInArrow(unpacked, df.schema).unionByName(df.filter(~packed))
    raw = F.col(column)
    text = F.coalesce(F.try_validate_utf8(raw.cast("string")), F.decode(raw, "ISO-8859-1"))
    return own.withColumn("text", F.regexp_replace(text, "^\ufeff", "")).drop(column)


def wav_duration(length: Column, rate: int, width: int = 2) -> Column:
    """Seconds of a mono PCM file by its size, 44 bytes being its header."""
    return (length - 44) / (rate * width)


def phoneme_cache(spark: SparkSession, folder: str, fingerprint: str) -> DataFrame | None:
    """A stored conversion of the same fingerprint, or None."""
    try:
        return spark.read.parquet(f"{folder}/{fingerprint}")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def checkpoints(df: DataFrame) -> DataFrame:
    """run, path, step, is_best, mb, modified from a listing (path, length, modificationTime)."""
    name = paths.basename(F.col("path"))
    return df.filter(name.endswith(".pth")).select(
        paths.parent(F.col("path")).alias("run"), "path", paths.step_of(name).alias("step"),
        F.contains(name, F.lit("best_model")).alias("is_best"), (F.col("length") / 1048576).alias("mb"), F.col("modificationTime").alias("modified"),
    )


def tokenizer_uses_phonemes(spark: SparkSession, path: str, use_phonemes: bool | None = None) -> bool:
    """The caller's word, else the stored one, else False."""
    if use_phonemes is not None:
        return use_phonemes
    try:
        rows = spark.read.schema("use_phonemes boolean").json(path).limit(1).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise
    return bool(rows and rows[0]["use_phonemes"])


def preferred_files(names: list[str], kind: str) -> list[str]:
    """The filtered files of a kind (train, eval), or any of the kind if none is filtered."""
    own = [n for n in names if kind in n and n.endswith(".csv")]
    return sorted(n for n in own if "filtered" in n[n.index(kind) :]) or sorted(own)


def chosen_backend(available: list[str], preferred: str | None = None, fallback: bool = True) -> str | None:
    """The preferred one if available, else the first by priority, or none without fallback."""
    if not available:
        return None
    want = preferred and preferred.lower().replace("-", "_").replace(" ", "_")
    if want is None or want in available:
        return want or available[0]
    return available[0] if fallback else None
