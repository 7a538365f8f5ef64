"""Numbers in words: listed pairs, and every number below a million read back by another rule."""

import re

import pytest
from pyspark.sql import functions as F

from quern.functions import cleaners, numerals

#: Sentences and what they are read as.
SENTENCES = [
    ("En 12,5 secondes.", "En douze virgule cinq secondes.", "fr"),
    ("Il y avait 50 soldats.", "Il y avait cinquante soldats.", "fr"),
    ("Ceci est un 1er test", "Ceci est un premier test", "fr"),
    ("Cela vous fera $20 monsieur.", "Cela vous fera vingt dollars monsieur.", "fr"),
    ("Cela vous fera 20€ monsieur.", "Cela vous fera vingt euros monsieur.", "fr"),
    ("Cela vous fera 20,15€ monsieur.", "Cela vous fera vingt euros et quinze centimes monsieur.", "fr"),
    ("Ce sera 100.000,5.", "Ce sera cent mille virgule cinq.", "fr"),
    ("In 12,5 Sekunden.", "In zwölf Komma fünf Sekunden.", "de"),
    ("Es gab 50 Soldaten.", "Es gab fünfzig Soldaten.", "de"),
    ("Dies ist ein 1. Test", "Dies ist ein erste Test", "de"),
    ("Das macht $20 Herr.", "Das macht zwanzig Dollar Herr.", "de"),
    ("Das macht 20€ Herr.", "Das macht zwanzig Euro Herr.", "de"),
    ("Das macht 20,15€ Herr.", "Das macht zwanzig Euro und fünfzehn Cent Herr.", "de"),
    ("En 12,5 segundos.", "En doce punto cinco segundos.", "es"),
    ("Había 50 soldados.", "Había cincuenta soldados.", "es"),
    ("Este es un 1er test", "Este es un primero test", "es"),
    ("Eso le costará $20 señor.", "Eso le costará veinte dólares señor.", "es"),
    ("Eso le costará 20€ señor.", "Eso le costará veinte euros señor.", "es"),
    ("Eso le costará 20,15€ señor.", "Eso le costará veinte euros con quince céntimos señor.", "es"),
    ("In 12,5 secondi.", "In dodici virgola cinque secondi.", "it"),
    ("C'erano 50 soldati.", "C'erano cinquanta soldati.", "it"),
    ("Questo è un 1° test", "Questo è un primo test", "it"),
    ("Ti costerà $20 signore.", "Ti costerà venti dollari signore.", "it"),
    ("Ti costerà 20€ signore.", "Ti costerà venti euro signore.", "it"),
    ("Ti costerà 20,15€ signore.", "Ti costerà venti euro e quindici centesimi signore.", "it"),
    ("Em 12,5 segundos.", "Em doze vírgula cinco segundos.", "pt"),
    ("Havia 50 soldados.", "Havia cinquenta soldados.", "pt"),
    ("Este é um 1º teste", "Este é um primeiro teste", "pt"),
    ("Isso custará $20 senhor.", "Isso custará vinte dólares senhor.", "pt"),
    ("Isso custará 20€ senhor.", "Isso custará vinte euros senhor.", "pt"),
    ("Isso custará 20,15€ senhor.", "Isso custará vinte euros e quinze cêntimos senhor.", "pt"),
    ("sans chiffres", "sans chiffres", "fr"),
    ("costa 1€ o 21€, 3,50 y 0,05$", "costa un euro o veintiún euros, tres punto cinco y cero dólares con cinco centavos", "es"),
    ("1234567890123 und 7", "1234567890123 und sieben", "de"),
    ("kostet 1€ und 1.000,00€", "kostet ein Euro und eintausend Euro", "de"),
    ("12,50 et 3,0", "douze virgule cinq et trois virgule zéro", "fr"),
]

CARDINALS = {
    "es": {0: "cero", 16: "dieciséis", 21: "veintiuno", 31: "treinta y uno", 100: "cien", 101: "ciento uno", 555: "quinientos cincuenta y cinco", 1000: "mil", 1001: "mil uno", 21000: "veintiún mil", 100000: "cien mil", 1_000_000: "un millón", 2_300_000: "dos millones trescientos mil", 1_000_000_000: "mil millones", 2_001_000_005: "dos mil un millones cinco"},
    "fr": {0: "zéro", 17: "dix-sept", 21: "vingt et un", 70: "soixante-dix", 71: "soixante et onze", 80: "quatre-vingts", 81: "quatre-vingt-un", 91: "quatre-vingt-onze", 99: "quatre-vingt-dix-neuf", 200: "deux cents", 201: "deux cent un", 1000: "mille", 2000: "deux mille", 80000: "quatre-vingt mille", 200000: "deux cent mille", 1_000_000: "un million", 80_000_000: "quatre-vingts millions", 3_000_000_100: "trois milliards cent"},
    "de": {0: "null", 1: "eins", 16: "sechzehn", 21: "einundzwanzig", 30: "dreißig", 100: "einhundert", 101: "einhunderteins", 1000: "eintausend", 1234: "eintausendzweihundertvierunddreißig", 1_000_000: "eine Million", 2_000_001: "zwei Millionen eins", 1_000_000_000: "eine Milliarde", 5_200_000_000: "fünf Milliarden zweihundert Millionen"},
    "pt": {0: "zero", 16: "dezasseis", 21: "vinte e um", 100: "cem", 101: "cento e um", 234: "duzentos e trinta e quatro", 1000: "mil", 1001: "mil e um", 1100: "mil e cem", 1234: "mil duzentos e trinta e quatro", 2000: "dois mil", 1_000_000: "um milhão", 2_000_100: "dois milhões e cem", 1_000_000_000: "mil milhões"},
    "it": {0: "zero", 3: "tre", 21: "ventuno", 23: "ventitré", 28: "ventotto", 100: "cento", 103: "centotré", 180: "centottanta", 1000: "mille", 1003: "milletré", 2000: "duemila", 2001: "duemilauno", 1_000_000: "un milione", 2_300_000: "due milioni trecentomila", 1_000_000_000: "un miliardo"},
}
ORDINALS = {
    "es": {1: "primero", 10: "décimo", 21: "vigésimo primero", 100: "centésimo", 999: "noningentésimo nonagésimo noveno"},
    "fr": {1: "premier", 2: "deuxième", 4: "quatrième", 5: "cinquième", 9: "neuvième", 21: "vingt et unième", 80: "quatre-vingtième", 200: "deux centième", 1001: "mille unième"},
    "de": {1: "erste", 3: "dritte", 7: "siebte", 8: "achte", 12: "zwölfte", 20: "zwanzigste", 21: "einundzwanzigste", 101: "einhunderterste", 1001: "eintausenderste"},
    "pt": {1: "primeiro", 12: "décimo segundo", 50: "quinquagésimo", 321: "tricentésimo vigésimo primeiro"},
    "it": {1: "primo", 10: "decimo", 11: "undicesimo", 20: "ventesimo", 23: "ventitreesimo", 26: "ventiseiesimo", 100: "centesimo", 1001: "milleunesimo"},
}


@pytest.mark.parametrize("lang", sorted(numerals.LANGUAGES))
def test_sentences(spark, lang):
    own = [(a, b) for a, b, x in SENTENCES if x == lang]
    df = spark.createDataFrame(own, "a string, b string")
    for r in df.select("a", "b", numerals.expand(F.col("a"), lang).alias("got")).collect():
        assert r.got == r.b, r.a


@pytest.mark.parametrize("lang", sorted(numerals.LANGUAGES))
def test_listed_numbers(spark, lang):
    for f, own in ((numerals.cardinal, CARDINALS), (numerals.ordinal, ORDINALS)):
        df = spark.createDataFrame(list(own[lang].items()), "n long, b string")
        for r in df.select("n", "b", f(F.col("n"), lang).alias("got")).collect():
            assert r.got == r.b, r.n
    df = spark.createDataFrame([(None,), (-1,), (numerals.LIMIT,)], "n long")
    assert [r[0] for r in df.select(numerals.cardinal(F.col("n"), lang)).collect()] == [None] * 3


@pytest.mark.parametrize("lang", sorted(numerals.LANGUAGES))
def test_no_two_numbers_are_said_alike(spark, lang):
    df = spark.range(0, 10**12, 333_333_311).union(spark.range(0, 3000)).distinct()
    said = df.select(numerals.cardinal(F.col("id"), lang).alias("w"))
    assert said.filter("w is null or w rlike '  |^ | $'").count() == 0
    assert said.distinct().count() == df.count()


def test_cleaner_says_numbers(spark):
    df = spark.createDataFrame([("Il y avait 21 chats", "fr"), ("Es waren 21", "de"), ("There were 21", "en"), ("No 21", "pl")], "a string, lang string")
    got = [r[0] for r in df.select(cleaners.clean(F.col("a"), F.col("lang"))).collect()]
    assert got == ["il y avait vingt et un chats", "es waren einundzwanzig", "there were twenty-one", "no 21"]
    assert not any(re.search("[0-9]", x) for x in got[:3])
