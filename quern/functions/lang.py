"""Language codes: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import tables as t


def _plain(c: Column) -> Column:
    return F.lower(F.trim(c))


def is_amharic(c: Column) -> Column:
    return F.coalesce(F.replace(_plain(c), F.lit("_"), F.lit("-")).isin(*t.AMHARIC_CODES), F.lit(False))


def canonical(c: Column, purpose: str = "dataset") -> Column:
    """Amharic names become amh, zh becomes zh-cn for datasets, regions go; null stays null."""
    s = F.replace(_plain(c), F.lit("_"), F.lit("-"))
    zh = "zh-cn" if purpose in ("coqui", "dataset") else "zh"
    return F.when(is_amharic(c), "amh").when(s == "zh", zh).otherwise(F.split_part(s, F.lit("-"), F.lit(1)))


def transcript_code(c: Column) -> Column:
    return F.when(is_amharic(c), "am").when(_plain(c) == "zh-cn", "zh").otherwise(_plain(c))


def canonical_or_same(c: Column) -> Column:
    return F.coalesce(canonical(c), c)
