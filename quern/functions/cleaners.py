"""Cleaners of several languages: Column -> Column, chosen by the language column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import numbers, numerals, text
from quern.functions import tables as t
from quern.functions.text import let, strings

#: English numerals.
EN_ONES = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
).split()
EN_TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()
EN_ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}


def _pick(pool, i: Column) -> Column:
    return F.element_at(strings(pool), i.cast("int") + 1)


def _en_said(n: int) -> str:
    h, r = divmod(n, 100)
    low = EN_ONES[r] if r < 20 else EN_TENS[r // 10] + (f"-{EN_ONES[r % 10]}" if r % 10 else "")
    return low if not h else f"{EN_ONES[h]} hundred" + (f" and {low}" if r else "")


EN_SAID = tuple(map(_en_said, range(1000)))


def _en_below_thousand(n: Column) -> Column:
    return _pick(EN_SAID, F.least(n, F.lit(999)))


def english_words(n: Column) -> Column:
    """Words of 0 .. 10^12 - 1, groups joined by ", " and a last part under a hundred by " and "."""

    def words(n: Column) -> Column:
        groups = []
        for unit, name in ((1_000_000_000, "billion"), (1_000_000, "million"), (1000, "thousand")):
            k = (F.floor(n / unit) % 1000).cast("int")
            groups.append(_group(k, name))
        large = F.nullif(F.concat_ws(", ", *groups), F.lit(""))
        small = (n % 1000).cast("int")
        last = let(small, lambda r: F.when(r > 0, _en_below_thousand(r)))
        joined = F.when(small < 100, F.concat_ws(" and ", large, last)).otherwise(F.concat_ws(", ", large, last))
        return F.when(n == 0, "zero").otherwise(joined)

    return let(n.cast("long"), lambda x: F.when(x.isNotNull(), words(x)))


def _group(k: Column, name: str) -> Column:
    return let(k, lambda x: F.when(x > 0, F.concat(_en_below_thousand(x), F.lit(f" {name}"))))


def english_ordinal(n: Column) -> Column:
    special = F.create_map(*[F.lit(x) for kv in EN_ORDINALS.items() for x in kv])

    def ordinal(words: Column) -> Column:
        head, last = F.regexp_extract(words, "^(.*?)([a-z]+)$", 1), F.regexp_extract(words, "([a-z]+)$", 1)
        regular = F.when(last.endswith("y"), F.concat(F.regexp_replace(last, "y$", ""), F.lit("ieth"))).otherwise(F.concat(last, F.lit("th")))
        return F.concat(head, F.coalesce(F.try_element_at(special, last), regular))

    return let(english_words(n), ordinal)


def english_numbers(c: Column) -> Column:
    """Commas, money, decimals, ordinals, then cardinals."""
    c = numbers.replace_matches(c, r"\b\d{1,3}(?:,\d{3})*(?:\.\d+)?\b", lambda s: F.replace(s, F.lit(","), F.lit("")))
    money = {"\\$": ("dollar", "dollars", "cent"), "£": ("pound", "pounds", "penny"), "€": ("euro", "euro", "cent")}
    plural = lambda n, one, many: F.when(n == 1, one).otherwise(many)
    for sign, (big, bigs, small) in money.items():

        def speak(s: Column, big=big, bigs=bigs, small=small) -> Column:
            d = F.regexp_replace(s, r"[^0-9.]", "")
            whole = F.split_part(d, F.lit("."), F.lit(1)).try_cast("long")
            cents = F.rpad(F.substring(F.split_part(d, F.lit("."), F.lit(2)), 1, 2), 2, "0").try_cast("long")
            many = "pence" if small == "penny" else small + "s"
            say = F.concat(english_words(whole), F.lit(" "), plural(whole, big, bigs))
            tail = F.when(cents > 0, F.concat(F.lit(", "), english_words(cents), F.lit(" "), plural(cents, small, many)))
            return F.coalesce(F.concat(say, F.coalesce(tail, F.lit(""))), s)

        c = numbers.replace_matches(c, rf"(?:{sign}\d+(?:\.\d+)?|\d+(?:\.\d+)?{sign})", speak)

    def decimal(s: Column) -> Column:
        digits = F.filter(F.split(F.split_part(s, F.lit("."), F.lit(2)), ""), lambda d: d != "")
        spoken = F.array_join(F.transform(digits, lambda d: _pick(EN_ONES, d.try_cast("int"))), " ")
        return F.coalesce(F.concat(english_words(F.split_part(s, F.lit("."), F.lit(1)).try_cast("long")), F.lit(" point "), spoken), s)

    c = numbers.replace_matches(c, r"\d+\.\d+", decimal)
    c = numbers.replace_matches(c, r"\d+(?:st|nd|rd|th)", lambda s: F.coalesce(english_ordinal(F.regexp_extract(s, r"(\d+)", 1).try_cast("long")), s))
    return numbers.replace_matches(c, r"\d+", lambda s: F.when(F.length(s) <= 12, english_words(s.try_cast("long"))).otherwise(s))


def abbreviations(c: Column, lang: Column) -> Column:
    """Languages without a list stay as they are."""
    return let(c, lambda x: _abbreviations(x, lang))


def _abbreviations(c: Column, lang: Column) -> Column:
    out = F.when(F.lit(False), c)
    for code, pairs in t.LANG_ABBREVIATIONS.items():
        own = c
        for short, long in pairs:
            if code in ("ru", "ja"):
                own = F.regexp_replace(own, rf"{'(?iu)' if code == 'ru' else ''}(?U)\b{re.escape(short)}\b", long)
            else:
                own = F.regexp_replace(own, rf"(?iuU)\b{short}\.", long)
        if pairs:  # one search tells whether there is anything to replace
            flags, end = ("(?iu)(?U)" if code == "ru" else "(?U)", r"\b") if code in ("ru", "ja") else ("(?iuU)", r"\.")
            any_ = "|".join(re.escape(short) if code in ("ru", "ja") else short for short, _ in pairs)
            out = out.when((lang == code) & c.rlike(rf"{flags}\b(?:{any_}){end}"), own)
    return out.otherwise(c)


def symbols(c: Column, lang: Column) -> Column:
    """Seven symbols as words; double spaces collapse after each."""
    return let(c, lambda x: _symbols(x, lang))


def _symbols(c: Column, lang: Column) -> Column:
    out = F.when(F.lit(False), c)
    for code, words in t.LANG_SYMBOLS.items():
        own = c
        for s, word in zip(t.SYMBOL_KEYS, words, strict=True):
            end = "" if code == "ja" and s == "°" else " "
            own = F.replace(F.replace(own, F.lit(s), F.lit(f" {word}{end}")), F.lit("  "), F.lit(" "))
        out = out.when(lang == code, F.trim(own))
    # spaces collapse even where no symbol is
    some = c.rlike("|".join(map(re.escape, (*t.SYMBOL_KEYS, "  "))))
    return F.when(some, out.otherwise(F.trim(c))).otherwise(F.trim(c))


def _by_language(c: Column, lang: Column, codes, f) -> Column:
    """F.when(...) with f(c, code) for each code."""
    out = F.when(F.lit(False), c)
    for code in codes:
        out = out.when(lang == code, f(c, code))
    return out


def clean(c: Column, lang: Column) -> Column:
    """Quotes go, lower case, numbers (of English, Amharic and the languages of numerals.py), abbreviations, symbols, white space."""
    c = F.replace(c, F.lit('"'), F.lit(""))
    tr = F.translate(c, "İÖÜ", "iöü")
    low = F.lower(F.when(lang == "tr", tr).otherwise(c))
    spoken = let(
        low,
        lambda x: _by_language(x, lang, numerals.LANGUAGES, numerals.expand).when(lang == "en", english_numbers(x)).when(lang.isin("am", "amh"), numbers.expand_grouped(text.normalize_amharic(x))).otherwise(x),
    )
    return F.regexp_replace(symbols(abbreviations(spoken, lang), lang), r"(?U)\s+", " ")


def basic(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"(?U)\s+", " ")


KNOWN = ("en", "es", "fr", "de", "pt", "it", "pl", "ar", "cs", "ru", "nl", "tr", "zh", "zh-cn", "ja", "hu", "ko", "am", "amh", "hi")


def preprocess(c: Column, lang: Column) -> Column:
    """clean() for known languages, basic() for hi; an unknown language is an error."""
    return (
        F.when(lang == "hi", basic(c))
        .when(lang.isin(*KNOWN), clean(c, lang))
        .otherwise(F.raise_error(F.concat(F.lit("no cleaner for language "), lang)))
    )
