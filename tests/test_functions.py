"""Literal fixtures and pure-Python oracles of the functions and folds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import cleaners, g2p, lang, numbers, paths, text
from quern.functions import tables as t
from quern.operators import metadata, segments, signal, training, vocab
from quern.sources import readers, subtitles, writers


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def each(spark, f, values, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}").select("i", f(F.col("v")).alias("x"))
    return [r.x for r in df.orderBy("i").collect()]


@pytest.mark.parametrize(
    ("n", "words"),
    [
        ("0", "ዜሮ"), ("1", "አንድ"), ("10", "አሥር"), ("19", "አስራ ዘጠኝ"), ("20", "ሃያ"), ("21", "ሃያ አንድ"), ("100", "መቶ"), ("101", "መቶ አንድ"),
        ("200", "ሁለት መቶ"), ("1000", "ሺህ"), ("1001", "ሺህ አንድ"), ("2024", "ሁለት ሺህ ሃያ አራት"), ("15,000", "አስራ አምስት ሺህ"),
        ("1000000", "አንድ ሚሊዮን"), ("1000000000", "አንድ ቢሊዮን"), ("-5", "መቀነስ አምስት"), ("no", "no"), ("123", "መቶ ሃያ ሶስት"),
    ],
)
def test_number_words(spark, n, words):
    assert one(spark, numbers.expand_number(F.lit(n))) == words


def reference_words(n):
    if n < 20:
        return t.ONES[n]
    if n < 100:
        return f"{t.TENS[n // 10]} {t.ONES[n % 10]}".strip()
    for unit, word, bare in ((10**9, t.BILLION, False), (10**6, t.MILLION, False), (1000, t.THOUSAND, True), (100, t.HUNDRED, True)):
        if n >= unit:
            k, r = divmod(n, unit)
            head = word if bare and k == 1 else f"{reference_words(k)} {word}"
            return f"{head} {reference_words(r)}".strip() if r else head


def test_number_words_of_all_sizes(spark):
    rng = random.Random(1)
    values = [rng.randrange(1, 10**k) for k in range(1, 19) for _ in range(8)]
    assert each(spark, numbers.amharic_words, values, "long") == [reference_words(v) for v in values]


def test_ethiopic_numerals(spark):
    pairs = [("፻፳፫", 123), ("፪፻፵፭", 245), ("፲፪", 12), ("፫፼", 30000), ("፩x", None), ("", None)]
    assert each(spark, numbers.parse_ethiopic, [a for a, _ in pairs]) == [b for _, b in pairs]
    assert one(spark, numbers.expand_ethiopic(F.lit("በ፲፪ ቀን"))) == "በአስራ ሁለት ቀን"


def test_numbers_in_text(spark):
    assert one(spark, numbers.expand_digits(F.lit("a 5 b 20."))) == "a አምስት b ሃያ."
    assert one(spark, numbers.expand_grouped(F.lit("x 15,000 y 7"))) == "x አስራ አምስት ሺህ y ሰባት"
    assert one(spark, numbers.expand_decimals(F.lit("5.5"))) == "አምስት ነጥብ አምስት"
    assert one(spark, numbers.expand_decimals(F.lit("5."))) == "አምስት ነጥብ "


def test_times(spark):
    assert one(spark, numbers.srt_seconds(F.lit("01:02:03,500"))) == 3723.5
    assert one(spark, numbers.srt_time(F.lit(3723.5))) == "01:02:03,500"
    assert each(spark, numbers.duration_text, [5.25, 65.0, 3700.0], "double") == ["5.3s", "1m 5s", "1h 1m"]


@pytest.mark.parametrize(
    ("code", "coqui", "transcript"),
    [("am", "amh", "am"), ("AMH", "amh", "am"), ("am-ET", "amh", "am"), ("am_et", "amh", "am"), ("Amharic", "amh", "am"), ("አማርኛ", "amh", "am"), ("zh", "zh-cn", "zh"), ("zh-cn", "zh", "zh"), ("en-US", "en", "en-us"), ("", "", ""), (None, None, None)],
)
def test_language_codes(spark, code, coqui, transcript):
    c = F.lit(code).cast("string")
    assert one(spark, lang.canonical(c)) == coqui and one(spark, lang.transcript_code(c)) == transcript


def test_normalize(spark):
    pairs = [("ሀሎ", "ሃሎ"), ("  ሰላም   ነው ", "ሰላም ነው"), ("2010 ዓ.ም", "2010 ዓመተ ምህረት"), ("ዶ/ር ከበደ", "ዶክተር ከበደ"), ("ሰላም፡ነው", "ሰላም ነው")]
    assert each(spark, text.normalize_amharic, [a for a, _ in pairs]) == [b for _, b in pairs]


def test_symbols(spark):
    pairs = [("5 + 3", "5 መደመር 3"), ("$50", "50 ዶላር"), ("25%", "25 ፐርሰንት"), ("5 x 3 = 15", "5 ማባዛት 3 እኩል 15"), ("ዓ/ም", "ዓ ሀዝባር ም"), ("25°C", "25 ዲግሪ ሴልሲየስ"), ("50 USD", "50 ዶላር"), ("1+2+3", "1+2 መደመር 3")]
    assert each(spark, text.expand_symbols, [a for a, _ in pairs]) == [b for _, b in pairs]


def test_prosody(spark):
    i = one(spark, text.prosody_info(F.lit("ሰላም! a, b? ሀ")))
    assert sorted((p.pos, p.mark) for p in i.pauses) == [(3, "!"), (6, ","), (9, "?")] or sorted((p.pos, p.mark) for p in i.pauses) == [(4, "!"), (7, ","), (10, "?")]
    assert [s.script for s in i.code_switches] == ["latin", "ethiopic"]
    n = text.prosody_statistics(F.lit("a, b; c. d! **x** AB??"))
    assert {k: one(spark, c) for k, c in n.items()} == {"total_pauses": 6, "short_pauses": 1, "medium_pauses": 1, "long_pauses": 4, "questions": 2, "exclamations": 1, "emphasis_spans": 4, "code_switches": 0}
    assert one(spark, text.with_emotion(F.lit("a"), "happy", 0.55)) in ("<emotion:happy:0.6>a</emotion>", "<emotion:happy:0.5>a</emotion>")


def test_prosody_spans(spark):
    s = "AB **so** _it_!! x?? :: CD"
    i = one(spark, text.prosody_info(F.lit(s)))
    want = [(m.start(), m.end(), kind) for p, kind in t.EMPHASIS for m in __import__("re").finditer(p, s)]
    assert [tuple(x) for x in i.emphasis] == want
    assert sorted((x.pos, x.mark) for x in i.pauses) == sorted((m.start(), p) for p in t.PAUSES for m in __import__("re").finditer(__import__("re").escape(p), s))
    assert one(spark, text.prosody_info(F.lit(""))).emphasis == []


def test_html_references(spark):
    import html

    own = ["&lt;b&gt; &amp;lt; &quot;x&#39;", "&#x41;&#65;&#x1F600;&#128512; &#0; &#xD800; &#1; &#128; &#x81; &#99999999999;", "&copy &copyx &notit; &notin; &ampx;",
           "&nbsp;&eacute;&NewLine;&bogus; & &; &#; &#x; &#xZ;", "no reference", "&CounterClockwiseContourIntegral;&fjlig;", ""]
    assert each(spark, text.html_unescape, own) == [html.unescape(x) for x in own]


def test_sentences_are_packed(spark):
    own = ["A short one. Another short sentence here.", "  Short.", "One two three four five six seven eight nine. Ten.", "x" * 75 + " end.", "Pi is 3.14 they say. Yes!", "a. b. c. d. e. f. g. h. i. j. k. l."]
    got = each(spark, lambda c: text.split_sentences(c, 30), own)
    assert got[0] == ["A short one.", "Another short sentence here."]
    assert got[1] == ["Short."]
    assert got[2] == ["One two three four five six", "seven eight nine. Ten."]
    assert got[3] == ["x" * 30, "x" * 30, "x" * 15 + " end."]
    assert got[4] == ["Pi is 3.14 they say. Yes!"]
    assert got[5] == ["a. b. c. d. e. f. g. h. i. j.", "k. l."]


def test_spelt_equals_a_lookup(spark):
    p = t.phonemes()
    s = "".join(p) + " ab\tሰ\u00a0ላ😀\n" + "".join(chr(i) for i in range(0x1200, 0x1380))
    want = "".join(" " if x.isspace() else p.get(x, x) for x in s)
    assert one(spark, g2p.lookup(F.lit(s))) == want


def test_scripts(spark):
    runs = one(spark, text.script_runs(F.lit("12 ab, ሰላም 3 cd")))
    assert [(r.text, r.script) for r in runs] == [("12 ab, ", "latin"), ("ሰላም 3 ", "ethiopic"), ("cd", "latin")]
    assert each(spark, text.dominant_script, ["ab", "ሰላም", "ab ሰ", "12", ""]) == ["latin", "ethiopic", "mixed", "unknown", "unknown"]


def test_phoneme_table():
    p = t.phonemes()
    assert len(p) == 259 and len(t.CONSONANTS) == 33
    assert p["ሰ"] == "sə" and p["ላ"] == "la" and p["ም"] == "mɨ" and p["ቋ"] == "qʷa" and p["ጕ"] == "gʷi" and p["።"] == "."


def test_g2p(spark):
    got = each(spark, g2p.convert, ["ሰላም", "አማርኛ", "ኢትዮጵያ", "", "  ", "hello ሰላም", None])
    assert got[0].startswith("səlam") and "ʔ" in got[1] and "pʼ" in got[2] and got[3] == got[4] == got[6] == ""
    assert not any("ɨɨ" in x for x in got)
    assert one(spark, g2p.gemination(F.lit("abba tʼtʼa"))) == "abːa tʼːa"
    assert one(spark, g2p.epenthesis(F.lit("kb"))) == "kɨbɨ"
    q = one(spark, g2p.quality(F.lit("ሰላም"), F.lit("səlamɨ")))
    assert q.valid and q.reason == "Pass"
    assert not one(spark, g2p.quality(F.lit("ሰላም"), F.lit("ሰላም"))).valid


def test_ids(spark):
    ids = one(spark, g2p.code_points(F.lit("aሰ")))
    assert ids == [97, 0x1230] and one(spark, g2p.from_code_points(F.array(*map(F.lit, ids)))) == "aሰ"
    assert one(spark, g2p.padded(F.array(F.lit(1), F.lit(2)), 3)) == [1, 2, 0] and one(spark, g2p.attention_mask(F.array(F.lit(1), F.lit(2)), 3)) == [1, 1, 0]


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("In 12.5 seconds.", "In twelve point five seconds."), ("There were 50 soldiers.", "There were fifty soldiers."),
        ("This is a 1st test", "This is a first test"), ("That will be $20 sir.", "That will be twenty dollars sir."),
        ("That will be 20€ sir.", "That will be twenty euro sir."), ("That will be 20.15€ sir.", "That will be twenty euro, fifteen cents sir."),
        ("That's 100,000.5.", "That's one hundred thousand point five."),
    ],
)
def test_english_numbers(spark, a, b):
    assert one(spark, cleaners.english_numbers(F.lit(a))) == b


def test_cleaners(spark):
    assert one(spark, cleaners.abbreviations(F.lit("Hello Mr. Smith, Dr. X"), F.lit("en"))) == "Hello mister Smith, doctor X"
    assert one(spark, cleaners.symbols(F.lit("I have 14% battery"), F.lit("en"))) == "I have 14 percent battery"
    assert one(spark, cleaners.clean(F.lit('Say "5 & 6"'), F.lit("en"))) == "say five and six"
    with pytest.raises(Exception, match="no cleaner"):
        one(spark, cleaners.preprocess(F.lit("x"), F.lit("xx")))


def test_paths(spark):
    urls = ["https://www.youtube.com/watch?v=abcdefghijk&t=1", "https://youtu.be/abc", "https://www.youtube.com/embed/xyz?x=1", "http://youtube.com/v/q1/x", "https://example.com/a", None]
    assert each(spark, paths.youtube_id, urls) == ["abcdefghijk", "abc", "xyz", "q1", None, None]
    assert each(spark, paths.stem, ["a/b.c.wav", "x", ".hid", "d.e/f"]) == ["b.c", "x", ".hid", "f"]
    assert each(spark, paths.step_of, ["checkpoint_1000.pth", "best_model_569.pth", "model_5.pth", "x.pth"]) == [1000, 569, 5, None]


def test_content_hash_branches(spark):
    import hashlib

    def want(b, middle):
        h = b[:8192] + (b[-8192:] if len(b) > 16384 else b[8192:] if middle and len(b) > 8192 else b"")
        return hashlib.sha256(h).hexdigest()[:16]

    values = [bytes(i % 251 for i in range(n)) for n in (0, 10, 8192, 8193, 16384, 16385, 30000)]
    for middle in (False, True):
        assert each(spark, lambda c: paths.content_hash(c, middle), values, "binary") == [want(v, middle) for v in values]
    assert each(spark, paths.content_hash, [None], "binary") == [None]


# --- folds against plain loops -----------------------------------------------------------------


def cues(rng):
    at, out = 0.0, []
    for i in range(rng.randint(0, 40)):
        at += rng.choice([0.0, 0.3, 0.49, 0.5, 1.4, 1.5, 1.6, 2.9, 3.0, 3.1, 6.0])
        d = rng.choice([0.4, 0.9, 1.0, 1.5, 1.9, 2.0, 5.0, 12.0])
        out.append((i + 1, round(at, 3), round(at + d, 3), f"w{i}", rng.randint(0, 10) / 10))
        at += d
    return out


def merged(rows, least, most, gap_limit):
    out, now = [], None
    for _, s, e, w, _ in rows:
        if now is None:
            now = [s, e, w]
            continue
        own, nxt, gap = now[1] - now[0], e - s, s - now[1]
        if own < least:
            ok = gap <= (gap_limit * 2 if own < 1.0 else gap_limit)
        elif nxt < least:
            ok = gap <= gap_limit
        elif own < 2.0 and nxt < 2.0:
            ok = gap <= gap_limit * 1.5
        else:
            ok = gap < 0.5
        if ok and e - now[0] <= most:
            now = [now[0], e, now[2] + " " + w]
        else:
            out.append(tuple(now))
            now = [s, e, w]
    return out + ([tuple(now)] if now else [])


def cue_frame(spark, groups):
    rows = [(g, *r) for g, own in enumerate(groups) for r in own]
    return spark.createDataFrame(rows, "source_id int, idx int, start double, end double, text string, confidence double").repartition(3)


def test_merge_cues_random(spark):
    rng = random.Random(7)
    groups = [cues(rng) for _ in range(60)]
    for least, gap in ((1.0, 1.5), (1.0, 3.0), (2.5, 0.2)):
        got = {}
        for r in segments.merge_short_cues(cue_frame(spark, groups), least, 20.0, gap).orderBy("source_id", "start", "idx").collect():
            got.setdefault(r.source_id, []).append((r.start, r.end, r.text))
        for g, own in enumerate(groups):
            assert got.get(g, []) == merged(own, least, 20.0, gap)


def test_merge_short_speech_random(spark):
    rng = random.Random(8)
    groups = [cues(rng) for _ in range(40)]
    got = {}
    for r in segments.merge_short_speech(cue_frame(spark, groups), 1.0, 0.5).orderBy("source_id", "start").collect():
        got.setdefault(r.source_id, []).append((r.start, r.end, round(r.confidence, 9)))
    for g, own in enumerate(groups):
        out, now = [], None
        for _, s, e, _, c in own:
            if now is None:
                now = (s, e, c)
            elif s - now[1] <= 0.5 or now[1] - now[0] < 1.0:
                now = (now[0], e, (now[2] + c) / 2)
            else:
                out.append(now)
                now = (s, e, c)
        out += [now] if now else []
        assert got.get(g, []) == [(s, e, round(c, 9)) for s, e, c in out if e - s >= 1.0]


def test_overlap_join_random(spark):
    rng = random.Random(9)
    a, b = [cues(rng) for _ in range(20)], [cues(rng) for _ in range(20)]
    got = {(r.source_id, r.idx, r.b_idx) for r in segments.overlapping(cue_frame(spark, a), cue_frame(spark, b), 7.0).collect()}
    want = {(g, x[0], y[0]) for g in range(20) for x in a[g] for y in b[g] if x[1] < y[2] and y[1] < x[2]}
    assert got == want


def test_silence_plan():
    with pytest.raises(ValueError):
        signal.SilencePlan(1000, least_ms=10, interval_ms=20)
    p = signal.SilencePlan(1000, -40.0, 200, 100, 10, 50)
    tone, hush = np.ones(400) * 0.5, np.zeros(300)
    ranges = p.chunks(np.concatenate([tone, hush, tone, hush]))
    assert len(ranges) == 2 and ranges[0][0] == 0 and 350 <= ranges[0][1] <= 460 and 640 <= ranges[1][0] <= 720
    assert p.chunks(np.zeros(50)) == [(0, 50)] and p.chunks(np.ones(1000)) == [(0, 1000)]


def test_early_stop_random(spark):
    rng = random.Random(3)
    runs = {r: [rng.random() for _ in range(30)] for r in range(20)}
    rows = [(r, i + 1, x) for r, own in runs.items() for i, x in enumerate(own)]
    df = spark.createDataFrame(rows, "run int, epoch int, val_loss double")
    for patience, delta in ((3, 0.01), (1, 0.0)):
        got = {r.run: (r.best, r.best_epoch, r.stop_epoch) for r in training.early_stop(df, patience, delta, True).collect()}
        for r, own in runs.items():
            best, at, bad, stop = own[0], 1, 0, None
            for i, x in enumerate(own[1:], 2):
                if x < best - delta:
                    best, at, bad = x, i, 0
                else:
                    bad += 1
                    if bad >= patience:
                        stop = i
                        break
            assert got[r] == (best, at, stop)


# --- relations and files -----------------------------------------------------------------------


def test_losses_from_zero(spark):
    runs = {1: [0.0, 1.0, 0.5], 2: [0.0, 2.0, 0.0], 3: [0.5, 0.0], 4: [1.0, 1.3]}
    rows = [(run, i, x) for run, own in runs.items() for i, x in enumerate(own)]
    found = {r.run: r for r in training.loss_summary(spark.createDataFrame(rows, "run long, epoch int, loss double")).collect()}
    assert found[1].change_pct == float("inf") and np.isnan(found[2].change_pct) and found[3].change_pct == -100
    assert [found[i].verdict for i in (1, 2, 3, 4)] == ["severe", "severe", "excellent", "overfitting"]
    assert abs(found[4].change_pct - 30) < 1e-9


def test_ordinal_is_global(spark):
    rng = random.Random(2)
    values = [rng.choice([None, *range(50)]) for _ in range(500)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "a int, b int").repartition(7)
    got = [(r.a, r.b) for r in metadata.ordinal(df, "a", "b").orderBy("ordinal").collect()]
    assert got == sorted(((v, i) for i, v in enumerate(values)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def test_ordinal_of_any_key(spark):
    values = [random.Random(4).choice([None, "a", "b10", "b9", "ä", ""]) for _ in range(300)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "a string, b int").repartition(5)
    got = [(r.a, r.b) for r in metadata.ordinal(df, "a", "b").orderBy("ordinal").collect()]
    assert got == sorted(((v, i) for i, v in enumerate(values)), key=lambda x: (x[0] is not None, (x[0] or "").encode(), x[1]))
    assert [r.ordinal for r in metadata.ordinal(df, "a", "b").orderBy("ordinal").collect()] == list(range(300))


def test_rows_of_one_key_share_a_split(spark):
    df = spark.range(200).select((F.col("id") % 20).cast("string").alias("audio_file"), F.lit("x" * 60).alias("text"))
    for out in (metadata.random_split(df, "eval_floor"), metadata.stratified_split(df)):
        assert out.groupBy("audio_file").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
        assert out.select("split").distinct().count() == 2 and out.count() == 200


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 101])
def test_split_sizes(spark, n):
    df = spark.range(n).select(F.col("id").cast("string").alias("audio_file"))
    sizes = {k: metadata.random_split(df, k).filter("split = 'eval'").count() for k in metadata.SPLIT_RULES}
    assert sizes == {"train_floor": n - int(n * 0.85), "eval_floor": int(n * 0.15), "eval_min3": max(3, int(n * 0.15)) if n >= 3 else n}


def test_unreadable_files_are_no_duplicates(spark):
    new = spark.createDataFrame([(1, None), (2, None), (3, "x"), (4, "x"), (5, "y")], "pos int, h string")
    base = spark.createDataFrame([("y",), (None,)], "h string")
    got = {r.pos: r.status for r in metadata.merge_by_content(base, new, "h", "pos").collect()}
    assert got == {1: "error", 2: "error", 3: "added", 4: "duplicate", 5: "duplicate"}


def test_metadata_files(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("audio_file|text|speaker_name\na.wav|NA|s\nb.wav|x|s\n")
    assert [r.text for r in readers.metadata(spark, str(p)).collect()] == ["NA", "x"]
    assert [r.text for r in readers.metadata(spark, str(p), na_values="pandas").collect()] == [None, "x"]
    q = tmp_path / "n.csv"
    q.write_text("a.wav|t|s\nshort|row\n")
    assert not readers.has_header(spark, str(q)) and sorted(r.n_fields for r in readers.ragged_rows(spark, str(q)).collect()) == [2, 3]
    with pytest.raises(ValueError):
        writers.exported(readers.metadata(spark, str(p)), str(tmp_path / "x"), "nope")


def test_subtitles(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,500\nhello\nthere\n\n2\n00:00:03,000 --> 00:00:03,000\n \n\n3\n00:00:05,000 --> 00:00:04,000\nback\n"
    df = spark.createDataFrame([("a", srt)], "source_id string, text string")
    assert [(r.start, r.end, r.text) for r in subtitles.parse_srt(df).collect()] == [(1.0, 2.5, "hello there"), (5.0, 4.0, "back")]
    assert subtitles.parse_srt(df, True).count() == 1


def test_vocabulary_ids_continue(spark):
    v = spark.createDataFrame([("b", 4), ("a", 7)], "token string, id int")
    c = spark.createDataFrame([("z",), ("a",), ("c",), ("z",)], "token string")
    assert {(r.token, r.id) for r in vocab.extended(v, c).collect()} == {("b", 4), ("a", 7), ("c", 8), ("z", 9)}


def test_small_profile(spark):
    assert len(t.BASIC_LABIOVELARS) == 20 and t.BASIC_LABIOVELARS["ኽ"] == "xʷɨ" and t.BASIC_LABIOVELARS["ቈ"] == "qʷi"
    assert each(spark, g2p.basic_convert, ["ሰላም ለማ", "ቋንቋ", "ሀ", ""]) == ["səlam ləma", " qʷa nə qʷa ", "ሀ", ""]
    assert one(spark, g2p.labiovelars(F.lit("ቍ ኳ"))) == "qʷɨ kʷa"


def test_speech_slices_keep_order_and_time(spark):
    rng = random.Random(4)
    groups = [cues(rng) for _ in range(20)]
    a, b = cue_frame(spark, groups).filter("idx % 2 = 0"), cue_frame(spark, groups).filter("idx % 2 = 1")
    cut = segments.split_long(a, b, 4.0)
    whole = {(r.source_id, r.idx): r.end - r.start for r in a.collect()}
    parts = {}
    for r in cut.collect():
        assert r.end > r.start
        parts[(r.source_id, r.idx)] = parts.get((r.source_id, r.idx), 0) + r.end - r.start
    assert {k: round(v, 6) for k, v in parts.items()} == {k: round(v, 6) for k, v in whole.items()}


def test_choices():
    assert readers.chosen_backend([]) is None and readers.chosen_backend(["a", "b"], "B") == "b" and readers.chosen_backend(["a"], "b", False) is None
    assert readers.preferred_files(["d_train.csv"], "train") == ["d_train.csv"]
