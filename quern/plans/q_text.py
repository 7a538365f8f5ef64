"""Registered queries on text, numbers, phonemes and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import cleaners, g2p, lang, numbers, numerals
from quern.functions import tables as t
from quern.functions import text as x
from quern.plans import views as v
from quern.plans.registry import query
from quern.session import spread, table

# --- SQL of the same rules --------------------------------------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(_q(w) for w in words) + "]"


def _replaces(c: str, pairs) -> str:
    for a, b in pairs:
        c = f"replace({c}, {_q(a)}, {_q(b)})"
    return c


def _collapse(c: str) -> str:
    ws = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
    return f"regexp_replace(regexp_replace({c}, '{ws}', ' ', 'g'), '^ | $', '', 'g')"


def _am3(n: str) -> str:
    """Words of 0 .. 999 ('' for 0)."""
    ones, tens = _list(t.ONES), _list(t.TENS)
    return (
        f"(CASE WHEN {n} >= 100 THEN CASE WHEN {n} // 100 = 1 THEN 'መቶ' ELSE {ones}[{n} // 100 + 1] || ' መቶ' END || CASE WHEN {n} % 100 > 0 THEN ' ' ELSE '' END ELSE '' END"
        f" || CASE WHEN {n} % 100 >= 20 THEN {tens}[{n} % 100 // 10 + 1] || CASE WHEN {n} % 10 > 0 THEN ' ' || {ones}[{n} % 10 + 1] ELSE '' END ELSE {ones}[{n} % 100 + 1] END)"
    )


def _am(n: str) -> str:
    """Words of 0 .. 999 999 999."""
    m, k, r = f"({n} // 1000000)", f"({n} // 1000 % 1000)", f"({n} % 1000)"
    thousands = f"CASE WHEN {k} = 0 THEN '' WHEN {k} = 1 THEN 'ሺህ ' ELSE {_am3(k)} || ' ሺህ ' END"
    millions = f"CASE WHEN {m} = 0 THEN '' ELSE {_am3(m)} || ' ሚሊዮን ' END"
    return f"CASE WHEN {n} = 0 THEN 'ዜሮ' ELSE trim({millions} || {thousands} || {_am3(r)}) END"


_MARKED = f"""marked AS (SELECT doc_id, lang, text, CAST(doc_id % 9 AS VARCHAR) || ' ' || {_q('ዓ.ም ዶ/ር ሀሎ ሥራ፡ቤት 3+4 $50 25% 7°C ')} || text AS own FROM fidel)"""


def _marked(spark, sf):
    own = F.concat((F.col("doc_id") % 9).cast("string"), F.lit(" ዓ.ም ዶ/ር ሀሎ ሥራ፡ቤት 3+4 $50 25% 7°C "), F.col("text"))
    return v.fidel(spark, sf).withColumn("own", own)


# --- language codes ---------------------------------------------------------------------------

_CODES = ["am", "AMH", "am-ET", "am_et", "Amharic", "አማርኛ", "zh", "zh-cn", "en-US", " fr ", "", "de_AT"]
_CODE_SQL = f"c AS (SELECT doc_id, CASE WHEN doc_id % 13 < 12 THEN {_list(_CODES)}[doc_id % 13 + 1] END AS code FROM documents), n AS (SELECT *, lower(trim(code)) AS s0, replace(lower(trim(code)), '_', '-') AS s FROM c)"
_AM_SQL = f"s IN ({', '.join(_q(c) for c in t.AMHARIC_CODES)})"


def _codes(spark, sf):
    i = (F.col("doc_id") % 13).cast("int")
    code = F.when(i < 12, F.element_at(F.array(*map(F.lit, _CODES)), F.least(i, F.lit(11)) + 1))
    return table(spark, sf, "documents").select("doc_id", code.alias("code"))


@query("f01_canonical_language", f"WITH {_CODE_SQL} SELECT doc_id, CASE WHEN {_AM_SQL} THEN 'amh' WHEN s = 'zh' THEN 'zh-cn' ELSE split_part(s, '-', 1) END AS code FROM n")
def f01(spark, sf):
    return _codes(spark, sf).select("doc_id", lang.canonical(F.col("code")).alias("code"))


@query("f02_is_amharic", f"WITH {_CODE_SQL} SELECT doc_id, coalesce({_AM_SQL}, false) AS amharic FROM n")
def f02(spark, sf):
    return _codes(spark, sf).select("doc_id", lang.is_amharic(F.col("code")).alias("amharic"))


@query("f03_transcript_code", f"WITH {_CODE_SQL} SELECT doc_id, CASE WHEN {_AM_SQL} THEN 'am' WHEN s0 = 'zh-cn' THEN 'zh' ELSE s0 END AS code FROM n")
def f03(spark, sf):
    return _codes(spark, sf).select("doc_id", lang.transcript_code(F.col("code")).alias("code"))


@query("f04_canonical_or_same", f"WITH {_CODE_SQL} SELECT doc_id, coalesce(CASE WHEN {_AM_SQL} THEN 'amh' WHEN s = 'zh' THEN 'zh-cn' ELSE split_part(s, '-', 1) END, code) AS code FROM n")
def f04(spark, sf):
    return _codes(spark, sf).select("doc_id", lang.canonical_or_same(F.col("code")).alias("code"))


# --- plain text -------------------------------------------------------------------------------


@query("f12_display_name", "SELECT o_orderkey, concat_ws(' | ', CASE WHEN o_orderkey % 3 = 0 THEN '🏆 BEST' END, CASE WHEN o_orderkey % 2 = 0 THEN 'Epoch ' || CAST(o_orderkey % 9 AS VARCHAR) END, 'Step ' || CAST(o_orderkey AS VARCHAR)) AS name FROM orders")
def f12(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.concat_ws(" | ", F.when(k % 3 == 0, "🏆 BEST"), F.when(k % 2 == 0, F.concat(F.lit("Epoch "), (k % 9).cast("string"))), F.concat(F.lit("Step "), k.cast("string"))).alias("name"))


@query("f14_preview", "SELECT doc_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS shown FROM documents")
def f14(spark, sf):
    return table(spark, sf, "documents").select("doc_id", x.preview(F.col("text")).alias("shown"))


@query("f15_collapse_space", f"SELECT doc_id, {_collapse('text')} AS text FROM documents")
def f15(spark, sf):
    return table(spark, sf, "documents").select("doc_id", x.collapse(F.col("text")).alias("text"))


#: The references that the pages hold; the other ones are tested on literal pairs.
_REFERENCES = (("lt;?", "<"), ("gt;?", ">"), ("quot;?", '"'), ("#39;?", "'"), ("copy;?", "©"), ("middot;?", "·"), ("amp;?", "&"))


def _unescape_sql(c: str) -> str:
    for name, to in _REFERENCES:
        c = f"regexp_replace({c}, '&{name}', {_q(to)}, 'g')"
    return c


@query("f16_html_unescape", f"SELECT page_id, {_unescape_sql('html')} AS text FROM pages")
def f16(spark, sf):
    return table(spark, sf, "pages").select("page_id", x.html_unescape(F.col("html")).alias("text"))


@query("p16_contains_ethiopic", f"WITH {v.FIDEL_SQL} SELECT doc_id, regexp_matches(text, '[\\x{{1200}}-\\x{{139F}}]') AS wide, regexp_matches(text, '[\\x{{1200}}-\\x{{137F}}]') AS narrow FROM fidel")
def p16(spark, sf):
    c = F.col("text")
    return v.fidel(spark, sf).select("doc_id", x.is_ethiopic(c).alias("wide"), x.is_ethiopic(c, False).alias("narrow"))


@query("p18_already_phonemes", f"WITH {v.FIDEL_SQL}, h AS (SELECT text FROM fidel ORDER BY doc_id LIMIT 10) SELECT avg(CASE WHEN regexp_matches(text, '[\\x{{1200}}-\\x{{139F}}]') THEN 1.0 ELSE 0.0 END) < 0.5 AS done FROM h")
def p18(spark, sf):
    head = v.fidel(spark, sf).orderBy("doc_id").limit(10)
    return head.agg((F.avg(x.is_ethiopic(F.col("text")).cast("double")) < 0.5).alias("done"))


@query("p19_preflight", f"WITH {v.FIDEL_SQL}, h AS (SELECT text FROM fidel ORDER BY doc_id LIMIT 300) SELECT count(*) FILTER (WHERE regexp_matches(text, '[\\x{{1200}}-\\x{{137F}}]')) >= greatest(1, floor(0.2::DOUBLE * count(*))) AS refuse FROM h")
def p19(spark, sf):
    head = v.fidel(spark, sf).orderBy("doc_id").limit(300)
    return head.agg((F.count_if(x.is_ethiopic(F.col("text"), False)) >= F.greatest(F.lit(1), F.floor(F.lit(0.2) * F.count("*")))).alias("refuse"))


@query("p20_mode_vote", f"""WITH {v.FIDEL_SQL}, h AS (SELECT left(text, 200) AS s FROM fidel ORDER BY doc_id LIMIT 10),
n AS (SELECT count(*) FILTER (WHERE regexp_matches(s, '[\\x{{1200}}-\\x{{137F}}]')) AS e, count(*) FILTER (WHERE regexp_matches(s, '[əɨʔʕʃʒɲ]')) AS i FROM h)
SELECT CASE WHEN e >= 7 AND i <= 2 THEN 'raw' WHEN i >= 7 THEN 'phoneme' ELSE 'raw' END AS mode FROM n""")
def p20(spark, sf):
    head = v.fidel(spark, sf).orderBy("doc_id").limit(10).select(F.substring("text", 1, 200).alias("s"))
    n = head.agg(F.count_if(x.is_ethiopic(F.col("s"), False)).alias("e"), F.count_if(F.col("s").rlike("[əɨʔʕʃʒɲ]")).alias("i"))
    return n.select(F.when((F.col("e") >= 7) & (F.col("i") <= 2), "raw").when(F.col("i") >= 7, "phoneme").otherwise("raw").alias("mode"))


@query("p21_first_row_format", f"""WITH {v.FIDEL_SQL} SELECT CASE WHEN regexp_matches(text, '[\\x{{1200}}-\\x{{137F}}]') AND NOT regexp_matches(text, '[əɨʔʕʃʒɲ]') THEN 'ethiopic' WHEN regexp_matches(text, '[əɨʔʕʃʒɲ]') THEN 'ipa' ELSE 'other' END AS format FROM fidel ORDER BY doc_id LIMIT 1""")
def p21(spark, sf):
    ipa = F.col("text").rlike("[əɨʔʕʃʒɲ]")
    kind = F.when(x.is_ethiopic(F.col("text"), False) & ~ipa, "ethiopic").when(ipa, "ipa").otherwise("other")
    return v.fidel(spark, sf).orderBy("doc_id").limit(1).select(kind.alias("format"))


@query("p24_fidel_rich", f"WITH {v.FIDEL_SQL} SELECT doc_id FROM fidel WHERE length(regexp_replace(text, '[^ጨጠፀጰቀ]', '', 'g')) >= 2")
def p24(spark, sf):
    return v.fidel(spark, sf).filter(F.regexp_count("text", F.lit("[ጨጠፀጰቀ]")) >= 2).select("doc_id")


@query("p26_length_limit", f"SELECT doc_id, length(text) > CASE lang {' '.join(f'WHEN {_q(k)} THEN {n}' for k, n in t.CHAR_LIMITS.items())} ELSE 250 END AS too_long FROM documents")
def p26(spark, sf):
    return table(spark, sf, "documents").select("doc_id", (F.length("text") > x.char_limit(F.col("lang"))).alias("too_long"))


@query("f56_split_sentences")
def f56(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(x.split_sentences(F.col("text"))).alias("piece", "text"))


# --- numbers ----------------------------------------------------------------------------------


@query("f20_number_words", f"SELECT p_partkey, n, {_am('n')} AS words FROM (SELECT p_partkey, p_partkey * 7919 % 100000007 AS n FROM part)")
def f20(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") * 7919 % 100000007).alias("n"))
    return p.withColumn("words", numbers.expand_number(F.col("n").cast("string")))


def _each_number(c: str, pattern: str, word: str) -> str:
    parts = f"string_split_regex({c}, '{pattern}')"
    found = f"regexp_extract_all({c}, '{pattern}')"
    return f"list_reduce(list_transform(range(len({parts})), lambda i: {parts}[i + 1] || CASE WHEN i < len({found}) THEN {word.format(m=f'{found}[i + 1]')} ELSE '' END), lambda a, b: a || b)"


@query("f21_expand_digits", f"WITH p AS (SELECT p_partkey, p_name || ' ' || CAST(p_partkey AS VARCHAR) || 'x' || CAST(p_size AS VARCHAR) || '.' AS s FROM part) SELECT p_partkey, {_each_number('s', '[0-9]+', _am('CAST({m} AS BIGINT)'))} AS text FROM p")
def f21(spark, sf):
    s = F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"), F.lit("x"), F.col("p_size").cast("string"), F.lit("."))
    return table(spark, sf, "part").select("p_partkey", numbers.expand_digits(s).alias("text"))


@query("f22_expand_grouped", f"SELECT p_partkey, 'ab ' || {_am('(p_partkey * 1000 + 7)')} || ' c ' || {_am('p_size')} AS text FROM part")
def f22(spark, sf):
    p = table(spark, sf, "part")
    s = F.concat(F.lit("ab "), F.format_number(F.col("p_partkey") * 1000 + 7, 0), F.lit(" c "), F.col("p_size").cast("string"))
    return p.select("p_partkey", numbers.expand_grouped(s).alias("text"))


@query("f23_expand_decimals", f"SELECT p_partkey, 'ab ' || {_am('p_size')} || ' ነጥብ ' || {_am('(p_partkey % 10)')} || ' ' || {_am('5')} || ' cd ' || {_am('p_size')} || ' ነጥብ ' AS text FROM part")
def f23(spark, sf):
    z = F.col("p_size").cast("string")
    s = F.concat(F.lit("ab "), z, F.lit("."), (F.col("p_partkey") % 10).cast("string"), F.lit("5 cd "), z, F.lit("."))
    return table(spark, sf, "part").select("p_partkey", numbers.expand_decimals(s).alias("text"))


_ETH = "CASE WHEN h > 1 THEN {u}[h] ELSE '' END || CASE WHEN h > 0 THEN '፻' ELSE '' END || CASE WHEN d > 0 THEN {t}[d] ELSE '' END || CASE WHEN o > 0 THEN {u}[o] ELSE '' END"
_ETH = _ETH.replace("{u}", _list("፩፪፫፬፭፮፯፰፱")).replace("{t}", _list("፲፳፴፵፶፷፸፹፺"))


def _eth(spark, sf):
    n = F.col("p_partkey") % 999 + 1
    h, d, o = F.floor(n / 100).cast("int"), F.floor(n % 100 / 10).cast("int"), (n % 10).cast("int")
    u = lambda i: F.element_at(F.array(*map(F.lit, "፩፪፫፬፭፮፯፰፱")), F.greatest(i, F.lit(1)))
    tens = F.element_at(F.array(*map(F.lit, "፲፳፴፵፶፷፸፹፺")), F.greatest(d, F.lit(1)))
    s = F.concat(F.when(h > 1, u(h)).otherwise(""), F.when(h > 0, "፻").otherwise(""), F.when(d > 0, tens).otherwise(""), F.when(o > 0, u(o)).otherwise(""))
    return table(spark, sf, "part").select("p_partkey", n.alias("n"), s.alias("s"))


_ETH_ROWS = f"e AS (SELECT p_partkey, n, {_ETH} AS s FROM (SELECT p_partkey, n, n // 100 AS h, n % 100 // 10 AS d, n % 10 AS o FROM (SELECT p_partkey, p_partkey % 999 + 1 AS n FROM part)))"


@query("f24_parse_ethiopic", f"WITH {_ETH_ROWS} SELECT p_partkey, s, n AS value FROM e")
def f24(spark, sf):
    return _eth(spark, sf).select("p_partkey", "s", numbers.parse_ethiopic(F.col("s")).alias("value"))


@query("f25_expand_ethiopic", f"WITH {_ETH_ROWS} SELECT p_partkey, 'ab ' || {_am('n')} || ' cd' AS text FROM e")
def f25(spark, sf):
    return _eth(spark, sf).select("p_partkey", numbers.expand_ethiopic(F.concat(F.lit("ab "), "s", F.lit(" cd"))).alias("text"))


# --- Amharic normalisation, symbols, prosody ---------------------------------------------------


@query("f40_normalize_amharic", f"WITH {v.FIDEL_SQL}, {_MARKED} SELECT doc_id, {_collapse(f'''replace({_replaces(_replaces('own', sorted(t.ABBREVIATIONS.items(), key=lambda p: -len(p[0]))), t.VARIANTS)}, '፡', ' ')''')} AS text FROM marked")
def f40(spark, sf):
    return _marked(spark, sf).select("doc_id", x.normalize_amharic(F.col("own")).alias("text"))


@query("f41_g2p_variants", f"WITH {v.FIDEL_SQL} SELECT doc_id, {_replaces('text', t.G2P_VARIANTS)} AS text FROM fidel")
def f41(spark, sf):
    return v.fidel(spark, sf).select("doc_id", x.replaced(F.col("text"), t.G2P_VARIANTS).alias("text"))


def _symbols_sql(c: str) -> str:
    import re

    num = r"([0-9][0-9,]*(?:\.[0-9]+)?)"
    sub = lambda c, p, to, f="g": f"regexp_replace({c}, {_q(p)}, {_q(to)}, '{f}')"
    for s, w in t.TEMPERATURES.items():
        c = sub(c, rf"([0-9]+(?:\.[0-9]+)?)\s*{re.escape(s)}", rf"\1 {w}")
    for s, w in t.CURRENCIES.items():
        if len(s) == 1:
            c = sub(sub(c, rf"{re.escape(s)}\s*{num}", rf"\1 {w}"), rf"{num}\s*{re.escape(s)}", rf"\1 {w}")
        else:
            c = sub(c, rf"{num}\s+{s}\b", rf"\1 {w}", "gi")
    for s, w in t.SUFFIXES.items():
        c = sub(c, rf"{num}\s*{re.escape(s)}", rf"\1 {w}")
    for s, w in t.OPERATORS.items():
        side = num if s in "/xX" else r"(\S+)"
        c = sub(c, rf"{side}\s*{re.escape(s)}\s*{side}", rf"\1 {w} \2")
    for s, w in t.COMMON.items():
        c = sub(c, rf"\s*{re.escape(s)}\s*", f" {w} ")
    return _collapse(_replaces(_collapse(c), ((s, f" {w} ") for s, w in t.FALLBACK.items())))


_SYM = "sy AS (SELECT p_partkey, 'x ' || CAST(p_size AS VARCHAR) || [' + 3 = 7', '°C it', ' USD & more', '% off!', '/2 (ok)', ' - 4, #1'][p_partkey % 6 + 1] || ' $' || CAST(p_partkey AS VARCHAR) AS s FROM part)"


def _sym(spark, sf):
    tail = F.element_at(F.array(*map(F.lit, (" + 3 = 7", "°C it", " USD & more", "% off!", "/2 (ok)", " - 4, #1"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", F.concat(F.lit("x "), F.col("p_size").cast("string"), tail, F.lit(" $"), F.col("p_partkey").cast("string")).alias("s"))


@query("f42_expand_symbols", f"WITH {_SYM} SELECT p_partkey, {_symbols_sql('s')} AS text FROM sy")
def f42(spark, sf):
    return _sym(spark, sf).select("p_partkey", x.expand_symbols(F.col("s")).alias("text"))


@query("f44_latin_punctuation", f"WITH {v.FIDEL_SQL}, f AS (SELECT doc_id, replace(replace(replace(text, '.', '።'), ',', '፣'), chr(10), '፦') AS s FROM fidel) SELECT doc_id, {_replaces('s', t.PUNCTUATION.items())} AS text FROM f")
def f44(spark, sf):
    s = F.replace(F.replace(F.replace("text", F.lit("."), F.lit("።")), F.lit(","), F.lit("፣")), F.lit("\n"), F.lit("፦"))
    return v.fidel(spark, sf).select("doc_id", x.latin_punctuation(s).alias("text"))


def _prosody_sql(c: str) -> str:
    c = _replaces(c, ((p, f"<pause:{d}>{p}") for p, d in t.PAUSES.items()))
    c = _replaces(c, ((p, f"<intonation:{k}>{p}") for p, k in t.INTONATIONS.items()))
    for p, k in t.EMPHASIS:
        c = f"regexp_replace({c}, {_q(p)}, '<emphasis:{k}>\\0</emphasis>', 'g')"
    return c


_HEAD = "h AS (SELECT doc_id, text || ' **so** _it_ OK!!' AS s FROM documents)"


def _head(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat("text", F.lit(" **so** _it_ OK!!")).alias("s"))


@query("f45_prosody_markers", f"WITH {_HEAD} SELECT doc_id, {_prosody_sql('s')} AS text FROM h")
def f45(spark, sf):
    return _head(spark, sf).select("doc_id", x.prosody_markers(F.col("s")).alias("text"))


@query("f46_prosody_info")
def f46(spark, sf):
    i = x.prosody_info(F.col("s"))
    return _head(spark, sf).select("doc_id", F.size(i["pauses"]).alias("pauses"), F.size(i["intonations"]).alias("intonations"), F.size(i["emphasis"]).alias("emphasis"), F.size(i["code_switches"]).alias("code_switches"))


@query("f47_space_punctuation", f"WITH {_HEAD} SELECT doc_id, {_collapse('''regexp_replace(s, '([።፣፤፥፧፨.!?,;:])([^\\s<])', '\\1 \\2', 'g')''')} AS text FROM h")
def f47(spark, sf):
    return _head(spark, sf).select("doc_id", x.space_punctuation(F.col("s")).alias("text"))


@query("f48_strip_markers", f"""WITH {_HEAD}, p AS (SELECT doc_id, {_prosody_sql('s')} AS s FROM h) SELECT doc_id, {_collapse("replace(regexp_replace(regexp_replace(regexp_replace(s, '<pause:[0-9]+[.]?[0-9]*>', '', 'g'), '<intonation:[0-9A-Za-z_]+>', '', 'g'), '<emphasis:[0-9A-Za-z_]+>', '', 'g'), '</emphasis>', '')")} AS text FROM p""")
def f48(spark, sf):
    return _head(spark, sf).select("doc_id", x.strip_markers(x.prosody_markers(F.col("s"))).alias("text"))


@query("f49_emotion", "SELECT doc_id, '<emotion:happy:0.5>' || lang || '</emotion>' AS marked, lang AS neutral FROM documents")
def f49(spark, sf):
    return table(spark, sf, "documents").select("doc_id", x.with_emotion(F.col("lang"), "happy", 0.5).alias("marked"), x.with_emotion(F.col("lang"), "neutral").alias("neutral"))


def _count(c: str, s: str) -> str:
    return f"(length({c}) - length(replace({c}, {_q(s)}, ''))) // {len(s)}"


@query("a11_prosody_statistics", f"""SELECT doc_id, {' + '.join(_count('text', p) for p in t.PAUSES)} AS total_pauses, {' + '.join(_count('text', p) for p, d in t.PAUSES.items() if float(d) <= 0.2)} AS short_pauses,
 {' + '.join(_count('text', p) for p, d in t.PAUSES.items() if 0.2 < float(d) <= 0.4)} AS medium_pauses, {' + '.join(_count('text', p) for p, d in t.PAUSES.items() if float(d) > 0.4)} AS long_pauses,
 {_count('text', '?')} + {_count('text', '፧')} AS questions, {_count('text', '!')} AS exclamations,
 {' + '.join(f'len(regexp_extract_all(text, {_q(p)}))' for p, _ in t.EMPHASIS)} AS emphasis_spans FROM documents""")
def a11(spark, sf):
    n = x.prosody_statistics(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", *[c.cast("long").alias(k) for k, c in n.items() if k != "code_switches"])


_SCRIPTS = "s AS (SELECT doc_id, len(regexp_extract_all(own, '[\\x{1200}-\\x{137F}]')) AS ethiopic, len(regexp_extract_all(own, '[A-Za-z]')) AS latin, len(regexp_extract_all(own, '[\\x{0600}-\\x{06FF}]')) AS arabic FROM marked)"


@query("a12_script_counts", f"""WITH {v.FIDEL_SQL}, {_MARKED}, {_SCRIPTS} SELECT *, CASE WHEN CAST(ethiopic > 0 AS INT) + CAST(latin > 0 AS INT) + CAST(arabic > 0 AS INT) > 1 THEN 'mixed' WHEN ethiopic > 0 THEN 'ethiopic' WHEN latin > 0 THEN 'latin' WHEN arabic > 0 THEN 'arabic' ELSE 'unknown' END AS script FROM s""")
def a12(spark, sf):
    c = F.col("own")
    return _marked(spark, sf).select("doc_id", *[n.cast("long").alias(k) for k, n in x.script_counts(c).items()], x.dominant_script(c).alias("script"))


_MIX = "m AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'ab ሰላም 12 cd' ELSE 'ሀለ, ሐ xy' END || CAST(doc_id % 5 AS VARCHAR) || text AS s FROM fidel)"


def _mix(spark, sf):
    head = F.when(F.col("doc_id") % 2 == 0, "ab ሰላም 12 cd").otherwise("ሀለ, ሐ xy")
    return v.fidel(spark, sf).select("doc_id", F.concat(head, (F.col("doc_id") % 5).cast("string"), "text").alias("s"))


@query("w18_code_switches", f"""WITH {v.FIDEL_SQL}, {_MIX}, c AS (SELECT doc_id, unnest(range(length(s))) AS pos, unnest(string_split(s, '')) AS ch FROM m),
k AS (SELECT doc_id, pos, CASE WHEN regexp_matches(ch, '[\\x{{1200}}-\\x{{137F}}]') THEN 'ethiopic' WHEN regexp_matches(ch, '\\p{{L}}') THEN 'latin' END AS script FROM c),
l AS (SELECT *, lag(script) OVER (PARTITION BY doc_id ORDER BY pos) AS last FROM k WHERE script IS NOT NULL) SELECT doc_id, pos, script FROM l WHERE last IS NOT NULL AND last <> script""")
def w18(spark, sf):
    e = _mix(spark, sf).select("doc_id", F.explode(x.code_switches(F.col("s"))).alias("c"))
    return e.select("doc_id", F.col("c.pos").cast("long").alias("pos"), "c.script")


@query("w19_script_runs", f"""WITH {v.FIDEL_SQL}, {_MIX}, c AS (SELECT doc_id, unnest(range(length(s))) AS pos, unnest(string_split(s, '')) AS ch FROM m),
k AS (SELECT doc_id, pos, ch, CASE WHEN regexp_matches(ch, '[\\x{{1200}}-\\x{{137F}}]') THEN 'ethiopic' WHEN regexp_matches(ch, '[A-Za-z]') THEN 'latin' END AS script FROM c),
f AS (SELECT *, last_value(script IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k),
r AS (SELECT *, sum(CASE WHEN script IS NOT NULL AND before IS NOT NULL AND script <> before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM f)
SELECT doc_id, CAST(run AS BIGINT) AS run, string_agg(ch, '' ORDER BY pos) AS text, max(script) AS script FROM r GROUP BY doc_id, run""")
def w19(spark, sf):
    e = _mix(spark, sf).select("doc_id", F.posexplode(x.script_runs(F.col("s"))).alias("run", "r"))
    return e.select("doc_id", F.col("run").cast("long").alias("run"), "r.text", "r.script")


# --- cleaners ---------------------------------------------------------------------------------


@query("f50_abbreviations", "SELECT doc_id, CASE lang WHEN 'en' THEN 'said mister x and doctor y, saint z' WHEN 'es' THEN 'said mr. x and doctor y, santo z' WHEN 'fr' THEN 'said monsieur x and docteur y, saint z' WHEN 'de' THEN 'said mr. x and doktor y, sankt z' END AS text FROM documents")
def f50(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", cleaners.abbreviations(F.lit("said mr. x and Dr. y, ST. z"), F.col("lang")).alias("text"))


def _lang_symbols(c: str, words) -> str:
    for s, w in zip(t.SYMBOL_KEYS, words, strict=True):
        c = f"replace(replace({c}, {_q(s)}, {_q(f' {w} ')}), '  ', ' ')"
    return f"trim({c})"


@query("f51_symbols", "WITH s AS (SELECT doc_id, lang, text || ' & 50% #1 @x' AS s FROM documents) SELECT doc_id, CASE lang " + " ".join(f"WHEN '{k}' THEN {_lang_symbols('s', t.LANG_SYMBOLS[k])}" for k in ("en", "es", "fr", "de")) + " END AS text FROM s")
def f51(spark, sf):
    s = F.concat("text", F.lit(" & 50% #1 @x"))
    return spread(table(spark, sf, "documents")).select("doc_id", cleaners.symbols(s, F.col("lang")).alias("text"))


@query("f52_english_numbers")
def f52(spark, sf):
    s = F.concat(F.lit("at "), F.col("p_size").cast("string"), F.lit(".5 the "), F.col("p_partkey").cast("string"), F.lit("th cost $"), F.format_number(F.col("p_partkey") * 37, 0))
    return table(spark, sf, "part").select("p_partkey", cleaners.english_numbers(s).alias("text"))


@query("f52_numbers_by_language")
def f52b(spark, sf):
    n = F.col("p_partkey")
    s = F.concat(n.cast("string"), F.lit(" "), (n * 7919).cast("string"), F.lit("º "), F.col("p_size").cast("string"), F.lit(",50 "), F.format_number(n % 1000 + F.lit(0.15), 2), F.lit("€"))
    each = F.explode(F.array(*map(F.lit, numerals.LANGUAGES)))
    rows = table(spark, sf, "part").select("p_partkey", s.alias("s"), each.alias("lang"))
    said = F.coalesce(*[F.when(F.col("lang") == x, numerals.expand(F.col("s"), x)) for x in numerals.LANGUAGES])
    return rows.select("p_partkey", "lang", said.alias("text"))


@query("f53_clean")
def f53(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", cleaners.clean(F.col("text"), F.col("lang")).alias("text"))


@query("f53_basic_clean", r"SELECT doc_id, regexp_replace(lower(text), '[\s\x{0B}\x{85}\x{A0}]+', ' ', 'g') AS text FROM documents")
def f53b(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", cleaners.basic(F.col("text")).alias("text"))


@query("f55_preprocess")
def f55(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", cleaners.preprocess(F.col("text"), F.col("lang")).alias("text"))


# --- phonemes and tokens -----------------------------------------------------------------------


def _lookup_sql(c: str) -> str:
    keys = "".join(t.phonemes())
    values = _list(t.phonemes().values())
    return f"array_to_string(list_transform(string_split({c}, ''), lambda ch: CASE WHEN instr('{keys}', ch) > 0 THEN {values}[instr('{keys}', ch)] WHEN regexp_matches(ch, '^[\\s\\x{{0B}}\\x{{85}}\\x{{A0}}]$') THEN ' ' ELSE ch END), '')"


@query("f60_phoneme_lookup", f"WITH {v.FIDEL_SQL} SELECT doc_id, {_lookup_sql('text')} AS ipa FROM fidel")
def f60(spark, sf):
    return v.fidel(spark, sf).select("doc_id", g2p.lookup(F.col("text")).alias("ipa"))


#: The generic rules with back-references, a consonant at a time: pairs of one cannot overlap another's.
_CONSONANTS = "bcdfghjklmnpqrstvwxyzʃʒʔʕ"


def _epenthesis_sql(c: str) -> str:
    for p in t.EPENTHESIS:
        c = f"regexp_replace({c}, {_q(p)}, '\\1ɨ\\2', 'g')"
    return _replaces(f"regexp_replace({c}, 'ɨ+', 'ɨ', 'g')", [(f"{x}ɨ{x}", x + x) for x in _CONSONANTS])


def _gemination_sql(c: str) -> str:
    c = _replaces(c, [(g, g[: len(g) // 2] + "ː") for g in t.GEMINATES])
    return _replaces(_replaces(c, [(x + x, x + "ː") for x in _CONSONANTS + "ɲ"]), [(f"{x}ʼ{x}ʼ", f"{x}ʼː") for x in _CONSONANTS + "ɲ"])


@query("f62_epenthesis", f"WITH {v.FIDEL_SQL} SELECT doc_id, {_epenthesis_sql(_lookup_sql('text'))} AS ipa FROM fidel")
def f62(spark, sf):
    return v.fidel(spark, sf).select("doc_id", g2p.epenthesis(g2p.lookup(F.col("text"))).alias("ipa"))


@query("f63_gemination", f"WITH {v.FIDEL_SQL} SELECT doc_id, {_gemination_sql(_lookup_sql('text'))} AS ipa FROM fidel")
def f63(spark, sf):
    return v.fidel(spark, sf).select("doc_id", g2p.gemination(g2p.lookup(F.col("text"))).alias("ipa"))


@query("f64_convert")
def f64(spark, sf):
    return v.fidel(spark, sf).select("doc_id", g2p.convert(F.col("text")).alias("ipa"))


@query("f66_hybrid_convert")
def f66(spark, sf):
    return _mix(spark, sf).select("doc_id", g2p.hybrid(F.col("s")).alias("ipa"))


@query("p27_g2p_quality")
def p27(spark, sf):
    rows = v.fidel(spark, sf).select("doc_id", "text", g2p.convert(F.col("text")).alias("ipa"))
    return rows.select("doc_id", g2p.quality(F.col("text"), F.col("ipa")).alias("q")).select("doc_id", "q.*")


@query("f67_model_text")
def f67(spark, sf):
    return _mix(spark, sf).select("doc_id", g2p.model_text(F.col("s"), F.lit("amh")).alias("text"))


@query("f68_tokens_and_ids", """SELECT doc_id, list_filter(string_split_regex(s, '\\s+'), lambda w: w <> '') AS tokens, list_transform(string_split(s, ''), lambda ch: unicode(ch)) AS ids, s AS decoded FROM (SELECT doc_id, lang || ' ሰላም ' || source AS s FROM documents)""")
def f68(spark, sf):
    s = F.concat("lang", F.lit(" ሰላም "), "source")
    ids = g2p.code_points(s)
    return table(spark, sf, "documents").select("doc_id", g2p.tokens(s).alias("tokens"), ids.alias("ids"), g2p.from_code_points(ids).alias("decoded"))


@query("f69_padded_batch", """SELECT doc_id, list_transform(range(12), lambda i: CASE WHEN i < length(s) THEN unicode(s[i + 1]) ELSE 0 END) AS ids, list_transform(range(12), lambda i: CASE WHEN i < length(s) THEN 1 ELSE 0 END) AS mask FROM (SELECT doc_id, lang || source || repeat('x', CAST(doc_id % 9 AS INTEGER)) AS s FROM documents)""")
def f69(spark, sf):
    ids = g2p.code_points(F.concat("lang", "source", F.expr("repeat('x', cast(doc_id % 9 as int))")))
    return table(spark, sf, "documents").select("doc_id", g2p.padded(ids, 12).alias("ids"), g2p.attention_mask(ids, 12).alias("mask"))


@query("f70_bpe_strings", "SELECT doc_id, replace('[' || lang || ']' || text, ' ', '[SPACE]') AS input, '[' || lang || ']' || text AS output FROM documents")
def f70(spark, sf):
    i = g2p.bpe_input(F.col("text"), F.concat("lang", F.lit("-XX")))
    return table(spark, sf, "documents").select("doc_id", i.alias("input"), g2p.bpe_output(i).alias("output"))


@query("f71_ipa_passthrough", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'tʼə lang ' || lang ELSE 'i said mister ' || lang END AS text FROM documents")
def f71(spark, sf):
    s = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("tʼə lang "), "lang")).otherwise(F.concat(F.lit("I said Mr. "), "lang"))
    return table(spark, sf, "documents").select("doc_id", F.when(s.rlike("[ʼʷəɨʔʕʃʒɲŋː]"), s).otherwise(cleaners.clean(s, F.lit("en"))).alias("text"))


@query("f72_dataset_rows")
def f72(spark, sf):
    s, code = g2p.dataset_row(F.col("s"), F.lit("am"))
    return _mix(spark, sf).select("doc_id", s.alias("text"), code.alias("language"))


@query("a28_table_coverage", "SELECT 231 AS syllables, 20 AS labiovelars, 8 AS marks, 259 AS total")
def a28(spark, sf):
    marks, labio = len(t.PUNCTUATION), len(t.LABIOVELARS) * len(t.LABIOVELAR_FORMS)
    n = len(t.phonemes())
    return spark.range(1).select(F.lit(n - marks - labio).alias("syllables"), F.lit(labio).alias("labiovelars"), F.lit(marks).alias("marks"), F.lit(n).alias("total"))
