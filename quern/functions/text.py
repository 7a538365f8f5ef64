"""Text functions: Column -> Column, all JVM-side."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import tables as t

ETHIOPIC = r"[\x{1200}-\x{137F}]"
ETHIOPIC_WIDE = r"[\x{1200}-\x{139F}]"


def let(c: Column, f) -> Column:
    """f(c) with c evaluated once and held once in the plan, however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strings(values) -> Column:
    """An array literal of strings as one node, which planning folds, instead of a node for each."""
    return F.split(F.lit("\x01".join(values)), "\x01")


def collapse(c: Column) -> Column:
    """Runs of white space, also beyond ASCII, become one space; none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def replaced(c: Column, pairs) -> Column:
    """Plain replacements one after another."""
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def guarded(c: Column, pairs) -> Column:
    """replaced(), but a text that holds none of the old strings is searched once and left alone."""
    pairs = [*pairs]
    held = "|".join(re.escape(old) for old, _ in pairs)
    return let(c, lambda x: F.when(x.rlike(held), replaced(x, pairs)).otherwise(x))


def in_one_pass(pairs: list[tuple[str, str]]) -> bool:
    """Whether replacing from left to right, whichever rule fits, equals the rules one after another.

    So it is if no old string holds another; where the end of one is the start of another, the one is the
    earlier rule; and no old string can be found across the edge of, or in, what a rule has put there.
    """
    ends = lambda a, b: any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b) + 1)))
    for i, (a, _) in enumerate(pairs):
        for j, (b, _) in enumerate(pairs):
            if i != j and (a in b or (ends(a, b) and i > j)):
                return False
    for i, (_, new) in enumerate(pairs):
        for later, _ in pairs[i + 1 :]:
            # only the last characters of a later rule may meet the first ones put there, and the other way round
            if later in new or new in later or any(later.startswith(new[-k:]) or later.endswith(new[:k]) for k in range(1, min(len(new), len(later)) + 1)):
                return False
    return True


def doubled(c: Column, halves: list[str], mark: str) -> Column:
    """Each half that follows itself becomes one half and the mark: one pass where that equals the sequence."""
    pairs = [(h + h, h + mark) for h in halves]
    if not in_one_pass(pairs):
        return replaced(c, pairs)
    return F.regexp_replace(c, f"({'|'.join(map(re.escape, halves))})\\1", f"$1{literal(mark)}")


def one_to_one(c: Column, pairs) -> Column:
    """Replacements of single characters, none of which gives one that another replaces, in one pass."""
    old, new = "".join(x for x, _ in pairs), "".join(x for _, x in pairs)
    if len(old) != len(new) or set(old) & set(new):
        return replaced(c, pairs)
    return F.translate(c, old, new)


def literal(s: str) -> str:
    """A string as the replacement of regexp_replace."""
    return s.replace("\\", "\\\\").replace("$", "\\$")


def is_ethiopic(c: Column, wide: bool = True) -> Column:
    return c.rlike(ETHIOPIC_WIDE if wide else ETHIOPIC)


def longest_first(rules: dict[str, str]) -> list[tuple[str, str]]:
    """Rules whose text is longer come before the ones that they hold; equals keep their order."""
    return sorted(rules.items(), key=lambda x: -len(x[0]))


def normalize_amharic(c: Column) -> Column:
    """Abbreviations (longest first), spelling variants, the word space, white space."""
    c = guarded(c, longest_first(t.ABBREVIATIONS))
    c = one_to_one(c, t.VARIANTS)
    return collapse(F.replace(c, F.lit(t.WORD_SPACE), F.lit(" ")))


def expand_symbols(c: Column) -> Column:
    """Temperatures, currencies, suffixes, operators, common symbols, then names of what is left."""
    number = r"(\d[\d,]*(?:\.\d+)?)"

    def sub(c: Column, pattern: str, to: str) -> Column:
        return F.regexp_replace(c, pattern, to)

    for s, word in t.TEMPERATURES.items():
        c = sub(c, rf"(\d+(?:\.\d+)?)\s*{re.escape(s)}", f"$1 {word}")
    for s, word in t.CURRENCIES.items():
        if len(s) == 1:
            c = sub(c, rf"{re.escape(s)}\s*{number}", f"$1 {word}")
            c = sub(c, rf"{number}\s*{re.escape(s)}", f"$1 {word}")
        else:
            c = sub(c, rf"(?i){number}\s+{s}\b", f"$1 {word}")
    for s, word in t.SUFFIXES.items():
        c = sub(c, rf"{number}\s*{re.escape(s)}", f"$1 {word}")
    for s, word in t.OPERATORS.items():
        side = number if s in "/xX" else r"(\S+)"
        c = sub(c, rf"{side}\s*{re.escape(s)}\s*{side}", f"$1 {word} $2")
    for s, word in t.COMMON.items():
        c = sub(c, rf"\s*{re.escape(s)}\s*", f" {word} ")
    c = collapse(c)
    return collapse(replaced(c, ((s, f" {word} ") for s, word in t.FALLBACK.items())))


def latin_punctuation(c: Column) -> Column:
    return replaced(c, t.PUNCTUATION.items())


def prosody_markers(c: Column) -> Column:
    """Pause, intonation and emphasis markers, in that order; later rules see earlier markers."""
    c = replaced(c, ((p, f"<pause:{d}>{p}") for p, d in t.PAUSES.items()))
    c = replaced(c, ((p, f"<intonation:{kind}>{p}") for p, kind in t.INTONATIONS.items()))
    for pattern, kind in t.EMPHASIS:
        c = F.regexp_replace(c, pattern, f"<emphasis:{kind}>$0</emphasis>")
    return c


def space_punctuation(c: Column) -> Column:
    return collapse(F.regexp_replace(c, r"([።፣፤፥፧፨.!?,;:])([^\s<])", "$1 $2"))


def strip_markers(c: Column) -> Column:
    for pattern in (r"<pause:\d+\.?\d*>", r"<intonation:\w+>", r"<emphasis:\w+>", "</emphasis>"):
        c = F.regexp_replace(c, pattern, "")
    return collapse(c)


def with_emotion(c: Column, emotion: str, intensity: float = 1.0) -> Column:
    if emotion == "neutral" or intensity < 0.1:
        return c
    return F.concat(F.lit(f"<emotion:{emotion}:{intensity:.1f}>"), c, F.lit("</emotion>"))


def _occurrences(c: Column, s: str) -> Column:
    return F.regexp_count(c, F.lit(re.escape(s)))


def code_switches(c: Column) -> Column:
    """array<struct<pos,script>> where the script differs from the last one seen."""
    chars = F.split(c, "")
    kind = (
        lambda x: F.when(x.rlike(ETHIOPIC), "ethiopic")
        .when(x.rlike(r"^[\p{L}&&[\x{0}-\x{11FF}]]$"), "latin")
        .when(x.rlike(r"[\x{600}-\x{6FF}]"), "arabic")
    )
    seen = F.filter(
        F.transform(chars, lambda x, i: F.struct(i.alias("pos"), kind(x).alias("script"))), lambda s: s["script"].isNotNull()
    )

    def switches(seen: Column) -> Column:
        pairs = F.zip_with(
            seen, F.concat(F.slice(seen, 1, 0), F.array(F.lit(None).cast("struct<pos:int,script:string>")), F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(0)))),
            lambda own, last: F.struct(own.alias("own"), last["script"].alias("last")),
        )
        changed = F.filter(pairs, lambda x: x["own"].isNotNull() & x["last"].isNotNull() & (x["last"] != x["own"]["script"]))
        return F.transform(changed, lambda x: x["own"])

    return let(seen, switches)


def prosody_statistics(c: Column) -> dict[str, Column]:
    """Counts of pauses by length, questions, exclamations, emphasis spans and script switches."""
    zero = F.lit(0)

    def count(keep) -> Column:
        return sum((_occurrences(c, p) for p, d in t.PAUSES.items() if keep(float(d))), zero)

    marks = {k: sum((_occurrences(c, p) for p, x in t.INTONATIONS.items() if x == k), zero) for k in ("rising", "emphatic")}
    return {
        "total_pauses": count(lambda d: True),
        "short_pauses": count(lambda d: d <= 0.2),
        "medium_pauses": count(lambda d: 0.2 < d <= 0.4),
        "long_pauses": count(lambda d: d > 0.4),
        "questions": marks["rising"],
        "exclamations": marks["emphatic"],
        "emphasis_spans": sum((F.regexp_count(c, F.lit(p)) for p, _ in t.EMPHASIS), zero),
        "code_switches": F.size(code_switches(c)),
    }


def prosody_info(c: Column) -> Column:
    """struct of pauses, intonations, emphasis spans and code switches, positions from 0.

    Positions come from the index of characters or of the pieces between marks, so all of it stays in the
    JVM; emphasis spans of overlapping patterns are listed by pattern, as found left to right.
    """
    chars = F.split(c, "")

    def at(s: str) -> Column:
        if len(s) > 1:  # marks that don't overlap, as a search from left to right finds them
            return F.transform(spans(re.escape(s)), lambda x: x["start"])
        return F.filter(F.transform(chars, lambda x, i: F.when(x == s, i)), lambda i: i.isNotNull())

    def spans(pattern: str) -> Column:
        # matches are put between two characters that no text needs; the n-th of those lies n places further on
        free = F.translate(c, "\ufdd0\ufdd1", "\ufdd2\ufdd2")
        marked = F.split(F.regexp_replace(free, f"(?s){pattern}", "\ufdd0$0\ufdd1"), "")
        return let(marked, lambda x: F.zip_with(ends(x, "\ufdd0", 0), ends(x, "\ufdd1", 1), lambda a, b: F.struct(a.alias("start"), b.alias("end"))))

    def ends(x: Column, mark: str, more: int) -> Column:
        found = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.get(x, i) == mark)
        return F.transform(found, lambda i, k: i - 2 * k - more)

    def emphasis(pattern: str, kind: str) -> Column:
        return F.transform(spans(pattern), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("emphasis")))

    def pause(p: str, d: str) -> Column:
        return F.transform(at(p), lambda i: F.struct(i.alias("pos"), F.lit(p).alias("mark"), F.lit(float(d)).alias("pause")))

    def tone(p: str, kind: str) -> Column:
        return F.transform(at(p), lambda i: F.struct(i.alias("pos"), F.lit(kind).alias("tone")))

    pauses = F.flatten(F.array(*[pause(p, d) for p, d in t.PAUSES.items()]))
    tones = F.flatten(F.array(*[tone(p, k) for p, k in t.INTONATIONS.items()]))
    stressed = F.flatten(F.array(*[emphasis(p, k) for p, k in t.EMPHASIS]))
    return F.struct(pauses.alias("pauses"), tones.alias("intonations"), stressed.alias("emphasis"), code_switches(c).alias("code_switches"))


def script_counts(c: Column) -> dict[str, Column]:
    return {
        "ethiopic": F.regexp_count(c, F.lit(ETHIOPIC)),
        "latin": F.regexp_count(c, F.lit("[A-Za-z]")),
        "arabic": F.regexp_count(c, F.lit(r"[\x{600}-\x{6FF}]")),
    }


def dominant_script(c: Column) -> Column:
    n = script_counts(c)
    kinds = sum((F.when(x > 0, 1).otherwise(0) for x in n.values()), F.lit(0))
    one = F.when(n["ethiopic"] > 0, "ethiopic").when(n["latin"] > 0, "latin").when(n["arabic"] > 0, "arabic")
    return F.when(kinds > 1, "mixed").otherwise(F.coalesce(one, F.lit("unknown")))


def script_runs(c: Column) -> Column:
    """array<struct<text,script>>: maximal runs; neutral characters join the run before them, at the
    start the one after. One pass of a regular expression, so long texts cost no more a character."""
    e, l, a = r"\x{1200}-\x{137F}", "A-Za-z", r"\x{600}-\x{6FF}"
    run = rf"((?s:[^{l}{a}]*[{e}][^{l}{a}]*|[^{e}{a}]*[{l}][^{e}{a}]*|[^{e}{l}]*[{a}][^{e}{l}]*|[^{e}{l}{a}]+))"
    script = lambda x: F.when(x.rlike(f"[{e}]"), "ethiopic").when(x.rlike(f"[{l}]"), "latin").when(x.rlike(f"[{a}]"), "arabic")
    return F.transform(F.regexp_extract_all(c, F.lit(run), F.lit(1)), lambda x: F.struct(x.alias("text"), script(x).alias("script")))


def preview(c: Column, n: int = 50) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def html_unescape(c: Column) -> Column:
    """Every character reference of HTML 5: names, also the old ones without a semicolon, and numbers."""
    from html.entities import html5

    from quern.functions.numbers import replace_matches

    old = {k: v for k, v in html5.items() if not k.endswith(";")}
    named, without = (F.map_from_arrays(strings(d.keys()), strings(d.values())) for d in (html5, old))
    windows = strings(bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0))
    utf16 = lambda n, digits: F.lpad(F.hex(n), digits, "0")

    def character(n: Column) -> Column:
        above = n - 0x10000
        high, low = F.shiftright(above, 10) + 0xD800, above.bitwiseAND(0x3FF) + 0xDC00
        units = F.when(n < 0x10000, utf16(n, 4)).otherwise(F.concat(utf16(high, 4), utf16(low, 4)))
        none = n.between(1, 8) | n.between(0xE, 0x1F) | (n == 0xB) | (n == 0x7F) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
        return (
            F.when(n.isNull() | (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd")
            .when(n.between(0x80, 0x9F), F.try_element_at(windows, (n - 0x7F).cast("int")))
            .when(none, "")
            .otherwise(F.decode(F.unhex(units), "UTF-16BE"))
        )

    def number(s: Column) -> Column:
        digits = F.regexp_extract(s, "^#[xX]?([0-9a-fA-F]+)", 1)
        hexed = F.when(F.length(F.ltrim(digits, F.lit("0"))) < 9, F.conv(digits, 16, 10).cast("long"))
        return let(F.when(s.rlike("^#[xX]"), hexed).otherwise(digits.try_cast("long")), character)

    def one(m: Column) -> Column:
        s = F.substring(m, 2, 64)
        begun = [F.concat(F.try_element_at(without, F.when(F.length(s) > k, F.left(s, F.lit(k)))), F.substring(s, k + 1, 64)) for k in range(6, 1, -1)]
        return F.when(s.startswith("#"), number(F.substring(m, 2, 1 << 20))).otherwise(F.coalesce(F.try_element_at(named, s), *begun, m))

    return replace_matches(c, r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)", one)


def char_limit(lang: Column) -> Column:
    limits = F.create_map(*[F.lit(x) for kv in t.CHAR_LIMITS.items() for x in kv])
    return F.coalesce(F.try_element_at(limits, F.split_part(lang, F.lit("-"), F.lit(1))), F.lit(t.CHAR_LIMIT))


def split_sentences(c: Column, limit: int = 250) -> Column:
    """A text under the limit as it is; a longer one as pieces of whole sentences, each packed while its
    length and the next sentence's add up to the limit. Of a longer sentence, lines are cut at white space.

    A sentence ends with a mark before white space or the end. A word over the limit begins a line and is
    cut at the limit.
    """
    mark = r"[.!?…。！？።፧፨]"
    sentence = rf"(?s)\S(?:.*?{mark}+[\"'”’)\]]*(?=\s|$)|.*$)"
    line = rf"\S(?:.{{0,{max(limit - 2, 0)}}}\S)?(?=\s|$)|\S{{{limit}}}"

    def lines(s: Column) -> Column:
        plain = F.regexp_replace(s, r"[\t\n\x0B\f\r]", " ")
        cut = F.transform(F.regexp_extract_all(plain, F.lit(line), F.lit(0)), lambda x: F.struct(x.alias("s"), F.lit(True).alias("alone")))
        return F.when(F.length(s) > limit, cut).otherwise(F.array(F.struct(s.alias("s"), F.lit(False).alias("alone"))))

    def numbered(parts: Column) -> Column:
        """The number of each part's piece, from the lengths alone."""
        start = F.struct(F.lit(-1).alias("piece"), F.lit(limit + 1).alias("size"), F.array().cast("array<int>").alias("of"))

        def step(acc: Column, x: Column) -> Column:
            n = F.length(x["s"])
            joins = ~x["alone"] & (acc["size"] + n <= limit)
            piece = acc["piece"] + F.when(joins, 0).otherwise(1)
            return F.struct(piece.alias("piece"), F.when(joins, acc["size"] + n + 1).otherwise(n).alias("size"), F.concat(acc["of"], F.array(piece)).alias("of"))

        return F.aggregate(parts, start, step, lambda acc: acc["of"])

    def pieces(parts: Column) -> Column:
        def of_numbers(of: Column) -> Column:
            firsts = F.filter(F.sequence(F.lit(0), F.size(of) - 1), lambda i: (i == 0) | (F.get(of, i) != F.get(of, i - 1)))
            ends = F.concat(F.slice(firsts, 2, F.size(firsts)), F.array(F.size(of)))
            return F.zip_with(firsts, ends, lambda a, b: F.array_join(F.transform(F.slice(parts, a + 1, b - a), lambda x: x["s"]), " "))

        return let(numbered(parts), of_numbers)

    def split(x: Column) -> Column:
        parts = F.flatten(F.transform(F.regexp_extract_all(x, F.lit(sentence), F.lit(0)), lines))
        return F.when(F.length(x) < limit, F.array(F.regexp_replace(x, r"^(?U)\s+", ""))).otherwise(
            let(parts, lambda p: F.when(F.size(p) == 0, F.array(F.lit(""))).otherwise(pieces(p)))
        )

    return let(c, split)
