"""Numbers in words for several languages: rules give words below a thousand, Columns put groups of three together.

A language is a table of words for 1..999 by rule, in the forms that its place asks for (alone, before a
thousand, before larger units, counting a thing, as an ordinal), and how groups join. The tables go into the
plan as folded literals; a number costs an access for every three digits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import numbers
from quern.functions.text import let, strings

Words = Callable[[int], str]


@dataclass(frozen=True)
class Numerals:
    """Words of one language. Each function takes 1..999 and says it in its place."""

    zero: str
    plain: Words  # at the end of a number
    thousand: Words  # with its thousand
    million: Words  # with its million
    milliard: Words | None  # with its thousand millions; None: counted in thousands of millions
    point: str
    ordinal: Words
    counted: Words  # before a thing that is counted
    after: Words | None = None  # at the end, right after another group
    glue: str = " "  # between thousands and the rest
    small_glue: str | None = None  # the same, where the rest is under a hundred or whole hundreds
    ordinal_after: Words | None = None  # the same for ordinals; None: ordinals end at 999
    millions: str = ""  # the plural of a million
    money: dict[str, tuple[str, str, str, str]] | None = None  # sign: one, several, one small, several small
    money_glue: str = " "
    ordinal_marks: str = ""


def _spanish() -> Numerals:
    ones = (
        "uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte "
        "veintiuno veintidós veintitrés veinticuatro veinticinco veintiséis veintisiete veintiocho veintinueve"
    ).split()
    tens = "treinta cuarenta cincuenta sesenta setenta ochenta noventa".split()
    hundreds = "ciento doscientos trescientos cuatrocientos quinientos seiscientos setecientos ochocientos novecientos".split()
    firsts = "primero segundo tercero cuarto quinto sexto séptimo octavo noveno".split()
    tenths = "décimo vigésimo trigésimo cuadragésimo quincuagésimo sexagésimo septuagésimo octogésimo nonagésimo".split()
    hundredths = "centésimo ducentésimo tricentésimo cuadringentésimo quingentésimo sexcentésimo septingentésimo octingentésimo noningentésimo".split()

    def plain(n: int) -> str:
        h, r = divmod(n, 100)
        low = "" if not r else ones[r - 1] if r < 30 else tens[r // 10 - 3] + (f" y {ones[r % 10 - 1]}" if r % 10 else "")
        return "cien" if n == 100 else " ".join(x for x in (hundreds[h - 1] if h else "", low) if x)

    def counted(n: int) -> str:
        own = plain(n)
        return own[:-9] + "veintiún" if own.endswith("veintiuno") else own[:-1] if own.endswith("uno") else own

    return Numerals(
        "cero", plain, lambda n: "mil" if n == 1 else f"{counted(n)} mil", lambda n: "un millón" if n == 1 else f"{counted(n)} millones", None, "punto",
        _by_place(firsts, tenths, hundredths), counted, millions="millones", money_glue=" con ",
        money={"£": ("libra", "libras", "penique", "peniques"), "$": ("dólar", "dólares", "centavo", "centavos"), "€": ("euro", "euros", "céntimo", "céntimos")},
        ordinal_marks="º|ª|er|o|a|os|as",
    )


def _by_place(firsts: list[str], tenths: list[str], hundredths: list[str]) -> Words:
    """Ordinals said digit by digit."""
    parts = (hundredths, tenths, firsts)
    return lambda n: " ".join(own[d - 1] for own, d in zip(parts, (n // 100, n // 10 % 10, n % 10), strict=True) if d)


def _portuguese() -> Numerals:
    ones = (
        "um dois três quatro cinco seis sete oito nove dez onze doze treze catorze quinze dezasseis dezassete dezoito dezanove"
    ).split()
    tens = "vinte trinta quarenta cinquenta sessenta setenta oitenta noventa".split()
    hundreds = "cento duzentos trezentos quatrocentos quinhentos seiscentos setecentos oitocentos novecentos".split()
    firsts = "primeiro segundo terceiro quarto quinto sexto sétimo oitavo nono".split()
    tenths = "décimo vigésimo trigésimo quadragésimo quinquagésimo sexagésimo septuagésimo octogésimo nonagésimo".split()
    hundredths = "centésimo ducentésimo tricentésimo quadrigentésimo quingentésimo seiscentésimo septigentésimo octigentésimo nongentésimo".split()

    def plain(n: int) -> str:
        h, r = divmod(n, 100)
        low = [ones[r - 1]] if 0 < r < 20 else [tens[r // 10 - 2], *([ones[r % 10 - 1]] if r % 10 else [])] if r else []
        return "cem" if n == 100 else " e ".join([*([hundreds[h - 1]] if h else []), *low])

    return Numerals(
        "zero", plain, lambda n: "mil" if n == 1 else f"{plain(n)} mil", lambda n: "um milhão" if n == 1 else f"{plain(n)} milhões", None, "vírgula",
        _by_place(firsts, tenths, hundredths), plain, small_glue=" e ", millions="milhões", money_glue=" e ",
        money={"£": ("libra", "libras", "péni", "pence"), "$": ("dólar", "dólares", "cêntimo", "cêntimos"), "€": ("euro", "euros", "cêntimo", "cêntimos")},
        ordinal_marks="º|ª|o|a|os|as",
    )


def _french() -> Numerals:
    ones = "un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix-sept dix-huit dix-neuf".split()
    tens = {2: "vingt", 3: "trente", 4: "quarante", 5: "cinquante", 6: "soixante", 7: "soixante", 8: "quatre-vingt", 9: "quatre-vingt"}

    def low(r: int) -> str:
        if r < 20:
            return ones[r - 1] if r else ""
        t = r // 10
        rest = r - 10 * t + (10 if t in (7, 9) else 0)
        if not rest:
            return tens[t] + ("s" if t == 8 else "")
        return tens[t] + (" et " if rest in (1, 11) and t < 8 else "-") + ones[rest - 1]

    def plain(n: int) -> str:
        h, r = divmod(n, 100)
        hundred = "" if not h else "cent" if h == 1 else f"{ones[h - 1]} cent" + ("" if r else "s")
        return " ".join(x for x in (hundred, low(r)) if x)

    def bare(n: int) -> str:
        """Without the s that cent and vingt have at the end of a number."""
        own = plain(n)
        return own[:-1] if own.endswith(("cents", "vingts")) else own

    def ordinal(n: int) -> str:
        if n == 1:
            return "premier"
        own = bare(n)
        own = own[:-1] if own.endswith("e") else own[:-1] + "v" if own.endswith("neuf") else own + "u" if own.endswith("cinq") else own
        return own + "ième"

    return Numerals(
        "zéro", plain, lambda n: "mille" if n == 1 else f"{bare(n)} mille", lambda n: f"{plain(n)} million" + "s" * (n > 1),
        lambda n: f"{plain(n)} milliard" + "s" * (n > 1), "virgule", ordinal, plain, ordinal_after=lambda n: "unième" if n == 1 else ordinal(n), money_glue=" et ",
        money={"£": ("livre", "livres", "penny", "pence"), "$": ("dollar", "dollars", "cent", "cents"), "€": ("euro", "euros", "centime", "centimes")},
        ordinal_marks="º|ª|er|re|e|ème",
    )


def _german() -> Numerals:
    ones = "ein zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn".split()
    tens = "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig".split()

    def joined(n: int) -> str:
        h, r = divmod(n, 100)
        low = "" if not r else ones[r - 1] if r < 20 else (f"{ones[r % 10 - 1]}und" if r % 10 else "") + tens[r // 10 - 2]
        return (f"{ones[h - 1]}hundert" if h else "") + low

    plain = lambda n: joined(n) + ("s" if n % 100 == 1 else "")
    large = lambda one: lambda n: f"eine {one}" if n == 1 else joined(n) + ("e" if n % 100 == 1 else "") + f" {one}" + ("n" if one[-1] == "e" else "en")

    def ordinal(n: int) -> str:
        r, own = n % 100, joined(n)
        for k, word, special in ((1, "ein", "erste"), (3, "drei", "dritte"), (7, "sieben", "siebte"), (8, "acht", "achte")):
            if r == k:
                return own[: -len(word)] + special
        return own + ("te" if 0 < r < 20 else "ste")

    return Numerals(
        "null", plain, lambda n: f"{joined(n)}tausend", large("Million"), large("Milliarde"), "Komma", ordinal, joined, glue="", ordinal_after=ordinal, money_glue=" und ",
        money={"£": ("Pfund", "Pfund", "Penny", "Pence"), "$": ("Dollar", "Dollar", "Cent", "Cent"), "€": ("Euro", "Euro", "Cent", "Cent")},
        ordinal_marks=r"st|nd|rd|th|º|ª|\.(?=\s|$)",
    )


def _italian() -> Numerals:
    ones = (
        "uno due tre quattro cinque sei sette otto nove dieci undici dodici tredici quattordici quindici sedici diciassette diciotto diciannove"
    ).split()
    tens = "venti trenta quaranta cinquanta sessanta settanta ottanta novanta".split()
    firsts = "primo secondo terzo quarto quinto sesto settimo ottavo nono decimo".split()

    def joined(n: int) -> str:
        h, r = divmod(n, 100)
        if r < 20:
            low = ones[r - 1] if r else ""
        else:
            ten, one = tens[r // 10 - 2], r % 10
            low = (ten[:-1] if one in (1, 8) else ten) + (ones[one - 1] if one else "")
        hundred = "" if not h else "cento" if h == 1 else f"{ones[h - 1]}cento"
        return (hundred[:-1] if hundred and low.startswith("o") else hundred) + low

    def after(n: int) -> str:
        own = joined(n)
        return own[:-1] + "é" if own.endswith("tre") else own

    def ordinal_after(n: int) -> str:
        own = joined(n)
        return (own if own.endswith(("tre", "sei")) else own[:-1]) + "esimo"

    large = lambda one, many: lambda n: f"un {one}" if n == 1 else f"{plain(n)} {many}"
    plain = lambda n: "tre" if n == 3 else after(n)
    return Numerals(
        "zero", plain, lambda n: "mille" if n == 1 else f"{joined(n)}mila", large("milione", "milioni"), large("miliardo", "miliardi"), "virgola",
        lambda n: firsts[n - 1] if n <= 10 else ordinal_after(n), lambda n: "un" if n == 1 else plain(n), after=after, glue="", ordinal_after=ordinal_after, money_glue=" e ",
        money={"£": ("sterlina", "sterline", "penny", "penny"), "$": ("dollaro", "dollari", "centesimo", "centesimi"), "€": ("euro", "euro", "centesimo", "centesimi")},
        ordinal_marks="º|°|ª|o|a|i|e",
    )


LANGUAGES = {"es": _spanish(), "fr": _french(), "de": _german(), "pt": _portuguese(), "it": _italian()}

#: Numbers below this are said; longer ones stay digits.
LIMIT = 10**12


def _table(f: Words) -> Column:
    return strings(["", *map(f, range(1, 1000))])


def _said(f: Words, n: Column) -> Column:
    """Words of 1..999; null for 0."""
    return F.when(n > 0, F.element_at(_table(f), F.least(n, F.lit(999)).cast("int") + 1))


def _group(n: Column, unit: int) -> Column:
    return (F.floor(n / unit) % 1000).cast("int")


def _joined(x: Numerals, n: Column, last: Column, last_after: Column) -> Column:
    """Words of 1 .. LIMIT - 1, given those of its last group of three, alone and after another."""
    k, r = _group(n, 1000), _group(n, 1)
    if x.milliard is not None:
        large = F.nullif(F.concat_ws(" ", _said(x.milliard, _group(n, 10**9)), _said(x.million, _group(n, 10**6))), F.lit(""))
    else:
        many, few = _group(n, 10**9), _group(n, 10**6)
        large = F.when(many > 0, F.concat_ws(" ", _said(x.thousand, many), _said(x.counted, few), F.lit(x.millions))).otherwise(_said(x.million, few))
    light = (r < 100) | (r % 100 == 0)

    def put(parts: Column) -> Column:
        large, thousands, last, after = (parts[c] for c in ("large", "thousands", "last", "after"))
        glue = F.lit(x.glue) if x.small_glue is None else F.when(light, x.small_glue).otherwise(x.glue)
        small = F.when(thousands.isNull(), F.when(large.isNotNull() & F.lit(x.glue != ""), after).otherwise(last)).when(r == 0, thousands).otherwise(
            F.concat(thousands, glue, after)
        )
        between = F.lit(" ") if x.small_glue is None else F.when(thousands.isNull() & (r > 0) & light, x.small_glue).otherwise(" ")
        return F.when(large.isNull(), small).when(r + k == 0, large).otherwise(F.concat(large, between, small))

    return let(F.struct(large.alias("large"), _said(x.thousand, k).alias("thousands"), last.alias("last"), last_after.alias("after")), put)


def _words(x: Numerals, v: Column, counted: Column, nth: Column) -> Column:
    """Words of 0 .. LIMIT - 1, null for others: as they stand, before a thing that is counted, or as an ordinal."""
    r = _group(v, 1)
    ordinals = nth & (r > 0) if x.ordinal_after is not None else nth & (v < 1000)
    said = lambda plain, nth_form: F.when(ordinals, _said(nth_form, r)).when(counted, _said(x.counted, r)).otherwise(_said(plain, r))
    last = said(x.plain, x.ordinal)
    after = said(x.after or x.plain, x.ordinal_after or x.ordinal)
    return F.when(v == 0, x.zero).when((v > 0) & (v < LIMIT), _joined(x, v, last, after))


def cardinal(n: Column, lang: str, counted: bool = False) -> Column:
    """Words of 0 .. LIMIT - 1, null for others; counted: in the form before a thing."""
    return let(n.cast("long"), lambda v: _words(LANGUAGES[lang], v, F.lit(counted), F.lit(False)))


def ordinal(n: Column, lang: str) -> Column:
    """The masculine ordinal; beyond those the rules give, the cardinal."""
    return let(n.cast("long"), lambda v: _words(LANGUAGES[lang], v, F.lit(False), F.lit(True)))


def _match(x: Numerals, s: Column) -> Column:
    """struct of what a matched number is: its whole part, cents or digits, and which of the four kinds."""
    sign = F.regexp_extract(s, "[£$€]", 0)
    money, decimal = sign != "", s.rlike("^[0-9]+[.,][0-9]+$")
    amount = F.round(F.regexp_replace(F.replace(s, F.lit(","), F.lit(".")), r"[^\d.]", "").try_cast("decimal(30,8)"), 2)
    whole = F.when(money, F.floor(amount).cast("long")).otherwise(F.regexp_extract(s, "^([0-9]+)", 1).try_cast("long"))
    cents = F.when(money, ((amount - F.floor(amount)) * 100).cast("int"))
    digits = F.when(~money & decimal, F.regexp_extract(s, "[.,]([0-9]*?[0-9])0*$", 1))
    return F.struct(
        whole.alias("whole"), F.array_position(F.array(*map(F.lit, x.money)), sign).cast("int").alias("sign"), cents.alias("cents"),
        digits.alias("digits"), (~money & ~decimal & ~s.rlike("^[0-9]+$")).alias("nth"),
    )


def _spoken(x: Numerals, m: Column) -> Column:
    """A match in words; null if it can't be said."""
    one, several, small_one, small = (F.element_at(strings(names), m["sign"]) for names in zip(*x.money.values(), strict=True))
    words = _words(x, m["whole"], m["sign"] > 0, m["nth"])
    cents = F.when(m["cents"] > 0, F.concat(F.lit(x.money_glue), _said(x.counted, m["cents"]), F.lit(" "), F.when(m["cents"] == 1, small_one).otherwise(small)))
    each = strings([x.zero, *map(x.plain, range(1, 10))])
    digits = F.array_join(F.transform(F.filter(F.split(m["digits"], ""), lambda d: d != ""), lambda d: F.element_at(each, d.cast("int") + 1)), " ")
    ending = F.when(m["sign"] > 0, F.concat(F.lit(" "), F.when(m["whole"] == 1, one).otherwise(several), F.coalesce(cents, F.lit("")))).when(
        m["digits"].isNotNull(), F.concat(F.lit(f" {x.point} "), digits)
    )
    return F.concat(words, F.coalesce(ending, F.lit("")))


def expand(c: Column, lang: str) -> Column:
    """A text's numbers in words: dots between thousands go, then money, decimals, ordinals and cardinals, in one pass.

    Of a decimal's digits, zeros at the end are not said, but one digit is. Numbers of LIMIT and more, and
    amounts with two decimal marks, stay as they are.
    """
    x = LANGUAGES[lang]
    number = rf"[£$€][0-9.,]*[0-9]+|[0-9.,]*[0-9]+[£$€]|[0-9]+[.,][0-9]+|[0-9]+(?:{x.ordinal_marks})?"

    def said(t: Column) -> Column:
        t = numbers.replace_matches(t, r"(?U)\b\d{1,3}(?:.\d{3})*(?:,\d+)?\b", lambda s: F.replace(s, F.lit("."), F.lit("")))
        return numbers.replace_matches(t, f"(?:{number})", lambda s: F.coalesce(let(_match(x, s), lambda m: _spoken(x, m)), s))

    return let(c, lambda t: F.when(t.rlike("[0-9]"), said(t)).otherwise(t))
