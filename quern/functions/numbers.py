"""Numbers, durations and times: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import tables as t
from quern.functions.text import let, strings


def _words(pool: tuple[str, ...], i: Column) -> Column:
    return F.element_at(strings(pool), i.cast("int") + 1)


def _some(c: Column) -> Column:
    return F.when(c != "", c)


def _said(n: int) -> str:
    """Words of 1..999 by the rule of hundreds, tens and ones; '' for 0."""
    h, r = divmod(n, 100)
    hundreds = "" if h == 0 else t.HUNDRED if h == 1 else f"{t.ONES[h]} {t.HUNDRED}"
    tens = t.ONES[r] if r < 20 else " ".join(x for x in (t.TENS[r // 10], t.ONES[r % 10]) if x)
    return " ".join(x for x in (hundreds, tens) if x)


#: Looked up by number, so that a number's words cost an access for every three digits.
SAID = tuple(map(_said, range(1000)))


def _below_thousand(n: Column) -> Column:
    """Words of 1..999; null for 0."""
    return _some(_words(SAID, F.least(n, F.lit(999))))


def _below_million(n: Column) -> Column:
    k, r = F.floor(n / 1000).cast("int"), (n % 1000).cast("int")
    thousands = F.when(k == 1, t.THOUSAND).when(k > 1, F.concat(_below_thousand(k), F.lit(" " + t.THOUSAND)))
    return _some(F.concat_ws(" ", thousands, _below_thousand(r)))


def _below_billion(n: Column) -> Column:
    m, r = F.floor(n / 1_000_000).cast("int"), (n % 1_000_000).cast("int")
    millions = F.when(m > 0, F.concat(_below_thousand(m), F.lit(" " + t.MILLION)))
    return _some(F.concat_ws(" ", millions, _below_million(r)))


def amharic_words(n: Column) -> Column:
    """Words of a long of up to 18 digits, by groups of three; 0 has a word of its own."""

    def words(n: Column) -> Column:
        a = F.abs(n)
        b = ((a - a % 1_000_000_000) / 1_000_000_000).cast("long")
        said = F.concat_ws(
            " ",
            let(b, lambda x: F.when(x > 0, F.concat(_below_billion(x), F.lit(" " + t.BILLION)))),
            let((a % 1_000_000_000).cast("long"), _below_billion),
        )
        return F.when(n == 0, t.ZERO).when(n < 0, F.concat(F.lit(t.MINUS + " "), said)).when(n > 0, said)

    return let(n.cast("long"), words)


def expand_number(s: Column) -> Column:
    """Words of a number given as text, commas allowed; anything else as it is."""
    plain = F.replace(F.trim(s), F.lit(","), F.lit(""))
    n = let(plain, lambda x: F.when(x.rlike(r"^[+-]?\d{1,18}$"), x.try_cast("long")))
    return F.coalesce(amharic_words(n), s)


def replace_matches(c: Column, pattern: str, f) -> Column:
    """Each match of ``pattern`` becomes f(match)."""

    def joined(x: Column) -> Column:
        found = F.regexp_extract_all(x, F.lit(f"({pattern})"), F.lit(1))
        return F.array_join(F.zip_with(F.split(x, pattern), found, lambda a, b: F.concat(a, F.coalesce(f(b), F.lit("")))), "")

    # a text without a match is not taken apart
    return let(c, lambda x: F.when(x.rlike(pattern), joined(x)).otherwise(x))


def expand_digits(c: Column) -> Column:
    return replace_matches(c, r"\d+", expand_number)


def expand_grouped(c: Column) -> Column:
    """Numbers with comma groups first, then plain ones."""
    return expand_digits(replace_matches(c, r"\d{1,3}(?:,\d{3})+", expand_number))


def expand_decimals(c: Column) -> Column:
    """Integers and decimals; decimal digits are spoken one by one after the point's word."""

    def spoken(s: Column) -> Column:
        digits = F.filter(F.split(F.split_part(s, F.lit("."), F.lit(2)), ""), lambda d: d != "")
        parts = F.concat(F.array(F.split_part(s, F.lit("."), F.lit(1))), digits)
        point = F.contains(s, F.lit("."))
        said = lambda w: F.when(
            point, F.concat(F.get(w, F.lit(0)), F.lit(f" {t.POINT} "), F.array_join(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), " "))
        ).otherwise(F.get(w, F.lit(0)))
        return let(F.transform(parts, expand_number), said)

    return replace_matches(c, r"\d+\.?\d*", spoken)


def parse_ethiopic(c: Column) -> Column:
    """Value of an Ethiopic numeral: additive, with a unit right before 10, 100 or 10000 as factor.
    Null if empty or if any character is no numeral."""
    value = F.create_map(*[F.lit(x) for k, v in t.NUMERALS.items() for x in (k, v)])
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("unit"))

    def step(acc: Column, x: Column) -> Column:
        v = F.try_element_at(value, x).cast("long")
        factor = v.isin(10, 100, 10000) & (acc["unit"] > 0)
        return F.struct(
            F.when(factor, acc["sum"] - acc["unit"] + acc["unit"] * v).otherwise(acc["sum"] + v).alias("sum"),
            F.when(v < 10, v).otherwise(F.lit(0).cast("long")).alias("unit"),
        )

    return F.when(F.size(chars) > 0, F.aggregate(chars, start, step, lambda a: a["sum"]))


def expand_ethiopic(c: Column) -> Column:
    return replace_matches(c, "[፩-፼]+", lambda s: F.coalesce(amharic_words(parse_ethiopic(s)), s))


def srt_seconds(s: Column) -> Column:
    """HH:MM:SS,mmm (or with a full stop) as seconds."""
    p = r"(\d+):(\d+):(\d+)[,.](\d+)"
    g = [F.regexp_extract(s, p, i).try_cast("double") for i in (1, 2, 3, 4)]
    return g[0] * 3600 + g[1] * 60 + g[2] + g[3] / 1000


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm, milliseconds cut."""
    whole = F.floor(seconds).cast("long")
    ms = F.floor((seconds - whole) * 1000).cast("long")
    return F.format_string(
        "%02d:%02d:%02d,%03d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60, ms
    )


def duration_text(s: Column) -> Column:
    whole = F.floor(s).cast("long")
    return (
        F.when(s < 60, F.format_string("%.1fs", s))
        .when(s < 3600, F.format_string("%dm %ds", F.floor(whole / 60), whole % 60))
        .otherwise(F.format_string("%dh %dm", F.floor(whole / 3600), F.floor(whole % 3600 / 60)))
    )


def db_to_amplitude(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)
