"""Paths, names, hashes and URLs: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(p: Column) -> Column:
    return F.regexp_extract(p, "([^/]*)$", 1)


def stem(p: Column) -> Column:
    return F.regexp_replace(basename(p), r"(?<=.)\.[^.]*$", "")


def suffix(p: Column) -> Column:
    return F.regexp_extract(basename(p), r".(\.[^.]*)$", 1)


def parent(p: Column) -> Column:
    return F.regexp_replace(p, "/?[^/]*$", "")


def merged_name(n: Column, digits: int = 8) -> Column:
    return F.concat(F.lit("merged_"), F.lpad(n.cast("string"), digits, "0"), F.lit(".wav"))


def youtube_id(url: Column) -> Column:
    """From watch?v=, /embed/, /v/ or youtu.be/; null otherwise."""
    host = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return (
        F.when(F.contains(host, F.lit("youtube.com")) & (path == "/watch"), F.try_parse_url(url, F.lit("QUERY"), F.lit("v")))
        .when(F.contains(host, F.lit("youtube.com")) & path.rlike("^/(embed|v)/"), F.split_part(path, F.lit("/"), F.lit(3)))
        .when(~F.contains(host, F.lit("youtube.com")) & F.contains(host, F.lit("youtu.be")), F.substr(path, F.lit(2)))
    )


def video_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(?:v=|/)([0-9A-Za-z_-]{11}).*", 1), F.lit(""))


def content_hash(content: Column, with_middle: bool = False) -> Column:
    """First 16 hex digits of the SHA-256 of the first and, if over 16 KiB, the last 8 KiB.

    with_middle: contents of 8 to 16 KiB are hashed whole. Null content gives null, which no join
    matches.
    """
    n = F.length(content)
    none = F.lit(b"")
    tail = F.when(n > 16384, F.substring(content, -8192, 8192))
    if with_middle:
        tail = tail.when(n > 8192, F.substr(content, F.lit(8193)))
    whole = F.concat(F.substring(content, 1, 8192), F.coalesce(tail, none))
    return F.substring(F.sha2(whole, 256), 1, 16)


#: Language marks that may end a subtitle's name, and names of checkpoints.
LANGUAGE_MARKS = "am|amh|en|eng|ar|es|fr|de|it|pt|ru|zh|ja|ko|hi|bn|ur|pa|sw|ha|yo|ig|zu|xh|so|om"
STEP_PATTERNS = (r"checkpoint_(\d+)\.pth", r"best_model_(\d+)\.pth", r"model_(\d+)\.pth")


def without_language(name: Column, lang: str = LANGUAGE_MARKS) -> Column:
    """A file stem without a trailing year and language mark."""
    return F.regexp_replace(name, rf"[._-]?(20\d\d)?({lang})$", "")


def step_of(name: Column) -> Column:
    """Training step in a checkpoint's name, by three patterns in order."""
    found = [F.nullif(F.regexp_extract(name, p, 1), F.lit("")) for p in STEP_PATTERNS]
    return F.coalesce(*found).try_cast("long")
