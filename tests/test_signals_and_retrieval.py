import random
from datetime import date

from pyspark.sql import functions as F

from gavelworks.operators import extraction as X
from gavelworks.operators import relational as R
from gavelworks.operators import retrieval as V
from gavelworks.operators import signals as S


def plain_merge(rows):
    kept = []
    for name, confidence, i, meetings in sorted(rows, key=lambda r: (-r[1], r[2])):
        words = set(name.split())
        for k in kept:
            both = len(words & k[0])
            if both >= 2 and both >= 0.5 * len(words | k[0]):
                k[2].update(meetings)
                break
        else:
            kept.append((words, i, set(meetings)))
    return {(i, len(m)) for _, i, m in kept}


def test_merging_alike_names_matches_a_plain_pass(spark):
    rng = random.Random(2)
    names = list({" ".join(sorted(rng.sample(["solar", "panel", "roof", "bus", "pass", "night", "lab", "nurse"], rng.randrange(2, 5)))) for _ in range(60)})
    rows = [(s, "T1", n.replace(" ", "-"), n, rng.choice([0.5, 0.7, 0.9]), [rng.randrange(9) for _ in range(2)], i * 2 + (s == "b")) for i, n in enumerate(names) for s in "ab"]
    df = spark.createDataFrame(rows, "school_slug string, theme string, slug string, label string, confidence double, meetings array<long>, first_id long")
    got = S.merge_alike(df).join(df.select("school_slug", "slug", "first_id"), ["school_slug", "slug"]).collect()
    for s in "ab":
        assert {(r.first_id, r.n_meetings) for r in got if r.school_slug == s} == plain_merge([(r[3], r[4], r[6], r[5]) for r in rows if r[0] == s])
    assert S.merge_alike(df.limit(0)).count() == 0


def test_signals(spark):
    day = lambda i: date(2024, 1, i)
    rows = [(1, "a", 1, 0.9, "m", day(1)), (2, "b", 2, 0.7, "m", day(3)), (3, "c", 3, 0.8, None, None), (4, "a", 1, 0.6, None, day(2))]
    df = spark.createDataFrame(rows, "id long, school_slug string, meeting_id long, confidence double, measured string, published_date date").withColumn("k", F.lit("k"))
    one = S.recurring(df, F.col("k"), F.col("measured"), "id").first()
    assert (one.n_schools, one.n_measured_schools, one.supporting_ids, one.signal_confidence, one.needs_review, one.first_date, one.last_date) == (3, 2, "1,2,3,4", 0.95, False, day(1), day(3))
    assert S.recurring(df.where("id <> 2"), F.col("k"), F.col("measured"), "id").first().needs_review
    assert S.trend(df.where("id < 3"), F.col("k")).first().signal_confidence == 0.733
    assert S.trend(df.where("school_slug = 'a'"), F.col("k")).count() == 0
    phrase = lambda *x: spark.createDataFrame([(list(x),)], "s array<string>").select(S.school_phrase(F.col("s"))).first()[0]
    assert [phrase("el_paso"), phrase("b", "a"), phrase("c", "b", "a", "a"), phrase(*"abcde"), phrase()] == ["El Paso", "A and B", "A, B and C", "A, B, C and 2 more", "Multiple schools"]
    parts = spark.createDataFrame([("s__T1__a__b",), ("s__T9__a",), ("s__T1",), (None,)], "x string").select(S.insight_parts(F.col("x")).alias("p")).collect()
    assert [r.p and tuple(r.p) for r in parts] == [("s", "T1", "a__b"), None, None, None]


def test_filters_and_pages(spark):
    df = spark.createDataFrame([(1, "x", None), (2, None, 5), (3, "y", 0)], "id int, s string, n int")
    ids = lambda **k: [r.id for r in R.where_given(df, **k).orderBy("id").collect()]
    assert ids(s__in=["x", "y"]) == [1, 3] and ids(s__not_in=["x"]) == [3] and ids(s__not="x") == [3] and ids(n__known=True) == [2, 3] and ids(s__in=[]) == [1, 2, 3] and ids(n=0) == [3]
    assert tuple(R.envelope(df, 2, 1).first()) == (3, 2, 1, False) and R.envelope(df, 1, 1).first().has_more
    assert {(r.id, r.s) for r in R.mark_where(df, df.where("id > 1"), "id", "s", "z").collect()} == {(1, "x"), (2, "z"), (3, "z")}
    assert {tuple(r) for r in R.counts({"a": df, "b": df.limit(0)}).collect()} == {("a", 3), ("b", 0)}
    new = spark.createDataFrame([(3, "new", 1), (4, "w", 1), (None, "n", 1)], df.schema)
    assert {r.s for r in R.upsert_absent(df, new, ["id"]).collect()} == {"x", None, "y", "w", "n"}
    assert [(r.id, r.rank) for r in R.top_n(df, [], [F.desc_nulls_last("n"), F.asc("id")], 2).collect()] == [(2, 1), (3, 2)]


def test_answers_in_json(spark):
    rows = [(1, '```json\n[{"a": 1}, 2, {"a": null, "b": "x"}]\n```'), (2, '{"items": [{"a": 5}], "n": 1}'), (3, '{"a": 7}'), (4, "no json"), (5, None), (6, '{"other": 1, "results": []}')]
    got = X.answers(spark.createDataFrame(rows, "id int, text string"), "id", ["items", "results"], "struct<a: int, b: string>").collect()
    assert sorted((r.id, r.nth, r.item.a) for r in got if r.id != 1) == [(2, 0, 5), (3, 0, 7)]
    assert sorted((r.nth, r.item.a, r.item.b) for r in got if r.id == 1) == [(0, 1, None), (2, None, "x")]
    x = F.col("x")
    numbers = spark.createDataFrame([("3",), (" -4 ",), ("3.7",), (None,), ("a",)], "x string").select(X.whole_number(x)).collect()
    assert [r[0] for r in numbers] == [3, -4, None, None, None]
    names = spark.createDataFrame([("Ann", "so ann said"), ("Bob", "none"), (None, "x"), ("Bob", None)], "n string, t string").select(X.stands_in(F.col("n"), F.col("t"))).collect()
    assert [r[0] for r in names] == [True, False, True, False]
    score = spark.createDataFrame([("to adopt the plan", "passed", True, 6.0), (None, None, None, 9.0), ("so moved", None, None, 0.0)], "m string, r string, p boolean, w double")
    got = score.select(X.vote_confidence(F.col("m"), F.col("r"), F.col("p"), F.lit(False), [F.lit("Ann")], F.lit("ann moved"), F.col("w"))).collect()
    assert [r[0] for r in got] == [0.8, 0.0, 0.05]


def brute(vectors, queries, k):
    import numpy as np

    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors if v and any(v)}
    out = set()
    for q, v in queries:
        if v and any(v):
            s = sorted((-round(float(unit[i] @ np.array(v) / np.linalg.norm(v)), 6), i) for i in unit)[:k]
            out |= {(q, i) for _, i in s}
    return out


def test_dense_search_in_blocks_and_by_lists(spark, monkeypatch):
    rng = random.Random(4)
    vectors = [(i, [rng.gauss(i % 5 * 3, 1) if j == i % 5 else rng.gauss(0, 1) for j in range(8)]) for i in range(300)] + [(900, None), (901, [0.0] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    queries = [(i, v) for i, v in vectors if i % 20 == 0]
    asked = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    monkeypatch.setattr(V, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(V, "BLOCK_VECTORS", 50)
    exact = V.dense_top(asked, df, 5)
    assert {(r.query_id, r.vec_id) for r in exact.collect()} == brute(vectors, queries, 5)
    found = V.search_index(asked, V.build_index(df, 10), 5)
    assert V.recall(found, exact).first().recall >= 0.9
    assert V.dense_top(asked.limit(0), df, 5).count() == 0 and V.search_index(asked, V.build_index(df.limit(0), 4), 5).count() == 0


def test_fusion_reranking_and_agreement(spark):
    legs = [spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(x)], "query_id int, doc string, rank int") for x in ("abc", "cad")]
    fused = V.fuse(legs, 3)
    assert [r.doc for r in fused.orderBy("rank").collect()] == ["a", "c", "b"]
    texts = spark.createDataFrame([("a", "nothing"), ("b", "pool rules"), ("c", "the pool"), ("d", None)], "doc string, text string")
    best = V.rerank(fused, spark.createDataFrame([(1, "pool rules")], "query_id int, question string"), texts, 2)
    assert [(r.doc, r.score) for r in best.orderBy("rank").collect()] == [("b", 1.0), ("c", 0.5)]
    assert tuple(V.agreement(fused, best).first()) == (1, True, 2, -1.0)
    chunks = spark.createDataFrame([(1, "s", date(2023, 2, 5)), (2, "s", date(2024, 8, 1)), (3, None, None)], "meeting_id long, school_slug string, published_date date")
    ids = lambda **k: [r.meeting_id for r in V.payload_filter(chunks, **k).collect()]
    assert ids() == [1, 2, 3] and ids(school="s", first="2023-01-01", last="2023-03-01") == [1] and ids(first="2023-12-01", last="2024-01-01") == [1, 2] and ids(meeting=3) == [3]
