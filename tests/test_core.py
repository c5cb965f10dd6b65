import json
import random
import re
from datetime import date

import pandas as pd
from pyspark.sql import functions as F

from gavelworks.functions import text as T
from gavelworks.operators import corpus, relational, retrieval, signals
from gavelworks.sources import captions, sinks
from gavelworks.streaming import incremental


def values(spark, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame([(x,) for x in rows], "x string").select(*columns).collect()]


def test_text_functions(spark):
    x = F.col("x")
    assert values(spark, ["  Hello, World__2! ", None], T.slug(x)) == [("hello-world-2",), (None,)]
    assert values(spark, ["um, so <i>well</i> [MUSIC] yes??", ""], T.clean(x)) == [("so well yes?",), ("",)]
    assert values(spark, ["$1.5M", "850K", "2B", "1,200", "abc", "-5", None], T.money(x)) == [(1.5e6,), (850e3,), (2e9,), (1200.0,), (None,), (None,), (None,)]
    assert values(spark, ["Board May 3, 2024", "x 4/5/2023", "7.9.2022", "2021-02-03 a", "none"], T.title_date(x)) == [(date(2024, 5, 3),), (date(2023, 4, 5),), (date(2022, 7, 9),), (date(2021, 2, 3),), (None,)]
    assert values(spark, ["01:02:03.5", "02:03.250", "x"], T.seconds(x)) == [(3723.5,), (123.25,), (None,)]
    assert values(spark, ["One. Two!  Three", "", None], F.size(T.split_sentences(x)), T.word_count(x)) == [(3, 3), (0, 0), (None, 0)]
    assert values(spark, ["a [1] b [2, 3] [x]"], T.marker_count(x)) == [(2,)]


def test_filters_keep_false_and_zero(spark):
    df = spark.createDataFrame([(1, True, 0.0), (2, False, 5.0), (3, None, None)], "id int, passed boolean, amount double")
    assert [r.id for r in relational.where_given(df, passed=False).collect()] == [2]
    assert [r.id for r in relational.where_given(df, amount__min=0, passed=None).orderBy("id").collect()] == [1, 2]
    totals = relational.vote_totals(df.withColumn("unanimous", F.lit(None).cast("boolean")), []).first()
    assert (totals.n_votes, totals.n_passed, totals.n_failed, totals.pass_rate) == (3, 1, 1, 0.5)
    assert relational.vote_totals(df.limit(0).withColumn("unanimous", F.lit(True)), []).first().pass_rate is None


def test_windows_merge_like_ranges(spark):
    scores = [0, 5, 0, 0, 0, 0, 0, 0, 5, 5, 0, 0, 0, 0, 5]
    df = spark.createDataFrame([("d", i, float(s)) for i, s in enumerate(scores)], "doc string, i int, s double")
    got = [(r["first"], r["last"], r.n_hits) for r in corpus.windows(df, "doc", "i", "s", 2.5, 2).orderBy("first").collect()]
    assert got == [(0, 3, 1), (6, 14, 3)]


SEGMENTS = "doc string, start double, end double, text string, speaker string, confidence double, source string"


def test_chunks_hold_every_word_once_besides_the_overlap(spark):
    rows = [("v", float(i), i + 1.0, " ".join(f"w{i}_{j}" for j in range(30 * (i % 4))), "a" if i % 3 else None, 0.5, None) for i in range(20)] + [("v", 50.0, 51.0, " ".join(f"z{j}" for j in range(2000)), "b", None, None), ("v", 60.0, 61.0, None, None, None, None)]
    got = corpus.chunk(spark.createDataFrame(rows, SEGMENTS), overlap=0).orderBy("chunk_index").collect()
    assert " ".join(r.text for r in got).split() == " ".join(r[3] for r in rows if r[3]).split()
    assert all(r.token_count <= 500 and r.total_chunks == len(got) for r in got) and got[0].chunk_id == "v_0001"
    tail = corpus.chunk(spark.createDataFrame(rows, SEGMENTS), overlap=5).orderBy("chunk_index").collect()
    assert tail[1].text.split()[:6] == ["[…]", *tail[0].text.split()[-5:]]


def plain_parts(text):
    """Parts of an oversized text: sentences (cut at 307 words) grouped up to 400 tokens."""
    if int(len(text.split()) * 1.3) <= 500:
        return [text.split()] if text.split() else []
    units = []
    for sentence in re.split(r"(?<=[.!?])\s+", text):
        words = sentence.split()
        units += [words] if int(len(words) * 1.3) <= 400 else [words[i : i + 307] for i in range(0, len(words), 307)]
    groups, held = [], 0
    for unit in units:
        if groups and held + int(len(unit) * 1.3) <= 400:
            groups[-1] = groups[-1] + unit
            held += int(len(unit) * 1.3)
        else:
            groups.append(unit)
            held = int(len(unit) * 1.3)
    return groups


def test_chunks_go_on_across_stretches_and_keep_segments_without_a_start(spark):
    rng = random.Random(5)
    sentence = lambda i, n: " ".join(f"w{i}_{j}" + rng.choice(["", "", "", "", ".", "?"]) for j in range(n))
    rows = [("v" if i % 9 else "u", float(i), i + 1.0, sentence(i, rng.choice([0, 3, 17, 60, 190, 420])), rng.choice(["a", "b", None]), rng.choice([0.2, 0.8, None]), "whisperx_asr") for i in range(300)]
    late = [("v", None, 500.0, "[00:00:50] fifty.", "c", 1.0, None), ("v", None, 120.0, "none", "c", 1.0, None), ("v", None, None, "last", None, 1.0, None)]
    df = spark.createDataFrame(rows + late, SEGMENTS)
    got = corpus.chunk(df, overlap=7).orderBy("doc", "chunk_index").collect()
    for doc in "uv":
        # packed again by hand, in one go
        said = sorted([(50.0 if "fifty" in r[3] else 120.0 if r[3] == "none" else 1e9 if r[1] is None else r[1], r[2] or 1e9, r) for r in rows + late if r[0] == doc], key=lambda r: r[:2])
        want, held = [], []
        cost = lambda parts: sum(int(len(p) * 1.3) for p, _ in parts)
        for *_, r in said:
            for part in plain_parts(r[3]):
                if held and cost([*held, (part, r)]) > 500:
                    want.append(held)
                    held = []
                held = [*held, (part, r)]
                if cost(held) >= 400 and part[-1][-1] in ".?!":
                    want.append(held)
                    held = []
        want += [held] if held else []
        mine = [r for r in got if r.doc == doc]
        assert [r.chunk_index for r in mine] == list(range(1, len(want) + 1))
        words = [[w for p, _ in c for w in p] for c in want]
        tails = [re.split(r"(?<=[.!?]) ", " ".join(w))[-1].split()[-7:] for w in words]
        assert [r.text.split() for r in mine] == [(["[…]", *tails[i - 1]] if i else []) + w for i, w in enumerate(words)]
        assert [r.token_count for r in mine] == [int(len(r.text.split()) * 1.3) for r in mine]
        for r, c in zip(mine, want, strict=True):
            sure = [s[5] for _, s in c if s[5] is not None]
            by = [s[4] for _, s in c if s[4]]
            asr = any(s[6] for _, s in c)
            assert r.speaker == (max(by, key=lambda x: (by.count(x), -by.index(x))) if by else None)
            assert abs(r.quality_score - (sum(sure) / len(sure) if sure else 0.5) * (0.85 if asr and not by else 1)) < 1e-4
    assert corpus.chunk(df.limit(0)).count() == 0


def test_quotes(spark):
    chunks = spark.createDataFrame([("A_1", "The  Board’s vote was unanimous.")], "chunk_id string, text string")
    evidence = spark.createDataFrame([(1, " a_1", "board's VOTE was"), (2, "a_1", "short"), (3, "zz", "board's vote was"), (4, "a_1", "not in there at all"), (5, None, None)], "evidence_id int, chunk_id string, exact_quote string")
    assert {r.evidence_id: (r.verdict, r.at) for r in corpus.verify_quotes(evidence, chunks).collect()} == {1: ("verified", 5), 2: ("short", None), 3: ("no chunk", None), 4: ("not found", None), 5: ("short", None)}


def test_signals_and_themes(spark):
    x = F.col("x")
    assert values(spark, ["Budget policy", "zzz", None, "student job training"], signals.theme(x)) == [("T3",), ("T7",), ("T7",), ("T2",)]
    assert values(spark, ["The ayes have it", "we will vote", None], signals.pattern_score(x, signals.VOTE_PATTERNS)) == [(7.5,), (0.0,), (0.0,)]
    df = spark.createDataFrame([("s", "T1", "a", "Aviation program launch", 0.9, [1], 1), ("s", "T1", "b", "Aviation maintenance program launch", 0.8, [2], 2), ("s", "T1", "c", "Welding", 0.7, [3], 3)], "school_slug string, theme string, slug string, label string, confidence double, meetings array<long>, first_id long")
    assert {(r.label, r.n_meetings) for r in signals.merge_alike(df).collect()} == {("Aviation program launch", 2), ("Welding", 1)}
    assert [(r.slug_a, r.slug_b) for r in signals.alike_pairs(df).collect()] == [("a", "b")]


def test_retrieval(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)] + [(9, [0.0, 0.0]), (10, None)], "vec_id long, embedding array<double>")
    got = retrieval.dense_top(v.where("vec_id = 2").withColumnRenamed("vec_id", "query_id"), v, 2).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [2, 3]
    docs = spark.createDataFrame([(1, "tax levy tax"), (2, "levy"), (3, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "tax")], "query_id int, term string")
    assert [r.doc for r in retrieval.bm25_top(retrieval.postings(docs, "doc_id", F.col("text")), 3, 1.3, q, 5).collect()] == [1]


def test_sources(spark, tmp_path):
    vtt = "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.500\nHello<br/>there\nyou\n\nNOTE x\n\n00:03.000 --> 00:04.000\n\n"
    rows = captions.vtt_cues(spark.createDataFrame([("v", vtt), ("w", "no captions"), ("n", None)], "id string, text string"), "id").collect()
    assert [(r.id, r.start, r.end, r.text) for r in rows] == [("v", 1.0, 2.5, "Hello<br/>there you")]
    asr = json.dumps({"segments": [{"start": 0.0, "end": 1.0, "text": " Hi ", "avg_logprob": -1.0}, {"start": 1.0, "end": 2.0, "text": ""}]})
    assert [(r.text, r.confidence) for r in captions.recognised_segments(spark.createDataFrame([("v", asr), ("b", "{")], "id string, text string"), "id").collect()] == [("Hi", 0.5)]
    events = json.dumps([{"Metadata": "B", "TimelineTime": 30000000, "Duration": 1.5}, {"Metadata": "A", "TimelineTime": 5000000, "Duration": 1.0}, {"Metadata": " ", "TimelineTime": 0}])
    out = captions.events_to_vtt(spark.createDataFrame([("v", events)], "id string, text string"), "id", F.lit(1.0)).first().vtt
    assert out == "WEBVTT\n\n00:00:00.000 --> 00:00:01.000\nA\n\n00:00:02.000 --> 00:00:03.500\nB"
    (tmp_path / "c.jsonl").write_text('{"chunk_id": "a", "chunk_index": 1}\n{"chunk_id": "b", "chunk_index": "x"}\n')
    assert [r.chunk_id for r in captions.chunk_lines(spark, str(tmp_path / "c.jsonl")).collect()] == ["a"]


def test_sinks_and_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, k string")
    sinks.replace_partitions(df, str(tmp_path / "t"), ["k"])
    sinks.replace_partitions(df.where("k = 'a'").withColumn("x", F.lit(7)), str(tmp_path / "t"), ["k"])
    assert {(r.x, r.k) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(7, "a"), (2, "b")}
    landing = tmp_path / "in"
    landing.mkdir()
    pd.DataFrame({"x": [1, 2]}).to_parquet(landing / "1.parquet")
    for _ in range(2):
        incremental.ingest(spark, str(landing), "x long", lambda b: b.withColumn("y", F.col("x") * 2), str(tmp_path / "out"), str(tmp_path / "state"))
    pd.DataFrame({"x": [3]}).to_parquet(landing / "2.parquet")
    incremental.ingest(spark, str(landing), "x long", lambda b: b.withColumn("y", F.col("x") * 2), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.y for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 4, 6]
