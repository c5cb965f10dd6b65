import random

from pyspark.sql import functions as F

from gavelworks.functions import text as T
from gavelworks.operators import cleaning, corpus


def values(spark, rows, column):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], "x string").select(column).collect()]


def test_text_functions(spark):
    x = F.col("x")
    assert values(spark, ["a &amp; b &#233;&#39;s &lt;i&gt; &nbsp;|", "plain", None, "&amp;lt;"], T.unescape(x)) == ["a & b é's <i>  |", "plain", None, "&lt;"]
    assert values(spark, ["I DON'T know, it's what's", None, ""], T.expand_contractions(x)) == ["I do not know, it is what is", None, ""]
    assert values(spark, ["[MUSIC 2] a (LAUGH-TER) b [x] (A) [UP)"], T.strip_notes(x)) == ["  a   b [x] (A) [UP)"]
    assert values(spark, ["“a” b​c…"], T.fold_punctuation(x)) == ['"a" bc...']
    assert values(spark, ["Año Nuevo: café!"], T.slug(x)) == ["año-nuevo-café"]
    assert values(spark, ["not specified", " N/A ", "unnamed", "x " * 600, None], F.length(T.null_like(x))) == [None, None, 7, 500, None]
    assert values(spark, ["see [1, 3] and [2] [3]", "none", None], T.marked_numbers(x)) == [[1, 3, 2], [], None]
    assert values(spark, ["a 0F8FAD5B-D9CB-469F-A165-70867728950E b 0f8fad5b-d9cb-469f-a165-70867728950e"], T.guids(x)) == [["0f8fad5b-d9cb-469f-a165-70867728950e"]]
    assert values(spark, ["https://u@Host.org:8080/x?y", "x", None], T.host(x)) == ["host.org:8080", None, None]
    assert [str(v) for v in values(spark, ["2024-05-01T10:20:30.123Z", "2024-05-01", "May"], T.iso_date(x))] == ["2024-05-01 10:20:30", "2024-05-01 00:00:00", "None"]
    assert values(spark, ["Special workshop", "Committee", None], T.meeting_kind(x)) == ["special", "committee", "regular"]


def test_numbers(spark):
    df = spark.createDataFrame([(1234.5, 10, 0.0), (-2.0, 600, 60.0), (0.0, 20, 60.0), (None, 30, 60.0)], "a double, w int, s double")
    got = df.select(T.dollars(F.col("a")), T.words_a_minute(F.col("w"), F.col("s")), T.minutes(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("$1,234.50", 0.85, "?"), ("-$2.00", 0.55, "01:00"), ("", 0.65, "01:00"), ("", 0.88, "01:00")]


def plain_squeeze(text, n):
    out = []
    for w in text.split():
        out.append(w)
        if len(out) >= 2 * n and out[-n:] == out[-2 * n : -n]:
            out = out[:-n]
    return " ".join(out)


def test_repeats_are_squeezed(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(30))) for _ in range(40)] + ["", "  a  b "]
    for n in (2, 3):
        assert values(spark, texts, T.squeeze_repeats(F.col("x"), n)) == [plain_squeeze(t, n) for t in texts]


def test_neighbouring_sentences(spark):
    got = values(spark, ["We voted. we  VOTED. We have voted. The vote was on. Vote on. Other. We voted."], F.array_join(T.distinct_neighbours(T.split_sentences(F.col("x"))), "|"))
    assert got == ["We voted.|We have voted.|The vote was on.|Other.|We voted."]


VTT = """WEBVTT

NOTE a comment

00:00:01.000 --> 00:00:03.000
the board will<c> now</c> come

00:00:03.000 --> 00:00:05.000
will now come to order um, [MUSIC]

00:00:05.000 --> 00:00:07.000
to order

00:00:07.000 --> 00:00:09.000
it's five o&#39;clock. >> It's five o'clock.
"""


def test_rolling_captions(spark):
    df = spark.createDataFrame([("a", VTT, 1), ("b", "no captions", 2), ("c", None, 3), ("d", "WEBVTT\n\n00:01.000 --> 00:02.000\nhi", 4)], "id string, text string, nth int")
    got = [tuple(r) for r in cleaning.caption_segments(df, "id").collect()]
    assert got == [("a", 1, 1.0, 9.0, "the board will now come to order it is five o'clock. it is five o'clock.", 0.88)]


def plain_new(said, cue):
    words, window = cue.split(), said[-60:]
    best = 0
    for i in range(len(window)):
        k = 0
        while k < len(words) and i + k < len(window) and window[i + k] == words[k].lower():
            k += 1
        best = max(best, k)
    return " ".join(words[best:]) if best else cue


def test_new_words(spark):
    rng = random.Random(1)
    for _ in range(300):
        said = [rng.choice("abc") for _ in range(rng.randrange(80))]
        cue = " ".join(rng.choice("abcD") for _ in range(rng.randrange(1, 8)))
        assert cleaning.new_words(said, cue) == plain_new(said, cue)


def test_documents_and_shares_of_time(spark):
    seg = spark.createDataFrame([("a", "one two", "x", 0.9), ("a", None, None, 0.7), ("b", "w " * 600, "y", 0.7), ("c", "", None, None)], "doc string, text string, speaker string, confidence double")
    got = {r.doc: (r.n_words, r.n_speakers, r.quality, r.rejected) for r in cleaning.document_quality(seg, "doc").collect()}
    assert got == {"a": (2, 1, 0.4016, True), "b": (600, 1, 0.7, False), "c": (0, 0, 0.0, True)}
    parts = spark.createDataFrame([("v", 1, "aaaa", 10.0, 20.0), ("v", 2, "bbbbbb", 10.0, 20.0)], "doc string, nth int, text string, seg_start double, seg_end double")
    assert [(r.start_time, r.end_time) for r in cleaning.split_times(parts, ["doc"], "nth").orderBy("nth").collect()] == [(10.0, 14.0), (14.0, 20.0)]


def plain_windows(rows, least, k, most):
    hits = [i for i, r in enumerate(rows) if r[1] >= least]
    spans = []
    for lo, hi in [(max(0, i - k), min(len(rows) - 1, i + k)) for i in hits]:
        if spans and lo <= spans[-1][1] + 1:
            spans[-1][1] = max(hi, spans[-1][1])
        else:
            spans.append([lo, hi])
    out = []

    def halve(lo, hi):
        if hi - lo <= 2 or sum(r[0] for r in rows[lo:hi]) <= most:
            if max(r[1] for r in rows[lo:hi]) >= least:
                out.append((lo, hi - 1))
        else:
            halve(lo, lo + (hi - lo) // 2)
            halve(lo + (hi - lo) // 2, hi)

    for lo, hi in spans:
        halve(lo, hi + 1)
    return out


def test_candidate_windows_match_a_plain_pass(spark):
    rng = random.Random(8)
    docs = {f"d{i}": [(rng.choice([50, 200, 400]), float(rng.choice([0, 0, 0, 1, 3, 6]))) for _ in range(rng.randrange(1, 25))] for i in range(12)}
    rows = [(d, i * 2, f"t{i}", tokens, float(i), None, rng.choice(["a", "b"]), score, 10 - score) for d, own in docs.items() for i, (tokens, score) in enumerate(own)]
    df = spark.createDataFrame(rows, "doc string, pos int, text string, tokens int, start_time double, end_time double, source string, up double, down double")
    got = corpus.candidate_windows(df, {"up": (None, 5.0, 2), "down": (None, 9.5, 1)}).collect()
    for target, least, k in (("up", 5.0, 2), ("down", 9.5, 1)):
        want = {(d, lo * 2, hi * 2) for d, own in docs.items() for lo, hi in plain_windows([(t, s if target == "up" else 10 - s) for t, s in own], least, k, corpus.MOST_TOKENS)}
        assert {(r.doc, r["first"], r["last"]) for r in got if r.target == target} == want
    assert corpus.candidate_windows(df.limit(0), {"up": (None, 5.0, 2)}).count() == 0
