from pyspark.sql import functions as F

from gavelworks.operators import evidence as E

REFS = "ref long, item string, chunk_id string, exact_quote string, supports array<string>, extra string"
TEXT = "We “approve”  the budget… of 3 million dollars, as it stands."


def run(spark, refs, chunks):
    got, reasons = E.validated(spark.createDataFrame([(*r, "x") for r in refs], REFS), spark.createDataFrame(chunks, "chunk_id string, text string"), ["amount", "vendor"])
    return {r.ref: r for r in got.collect()}, {r.item: (r.n_verified, r.reason) for r in reasons.collect()}


def test_quotes_are_found_as_they_stand(spark):
    chunks = [("a", TEXT), ("b", "Plain words in a row that say the same as before"), ("n", None), ("ﬁ", "The oﬃce of ﬁnance is open")]
    refs = [
        (1, "i", "a", '"APPROVE" the budget... of', ["amount", "bogus"]),
        (2, "i", " a ", "approve the budgets of", ["amount"]),
        (3, "j", "b", "WORDS in a row", None),
        (4, "j", "gone", "words in a row", ["vendor"]),
        (5, "k", "b", "words", ["vendor"]),
        (6, "l", "n", "words in a row", ["vendor"]),
        (7, "m", "ﬁ", "office of finance", []),
        (8, "o", None, None, None),
    ]
    got, reasons = run(spark, refs, chunks)
    assert set(got) == {1, 3, 7}
    assert got[1].quote == "“approve”  the budget… of" and TEXT[got[1].start : got[1].end] == got[1].quote and got[1].supports == ["amount"]
    assert (got[3].start, got[3].end, got[3].quote) == (6, 20, "words in a row")
    assert got[7].quote == "oﬃce of ﬁnance"
    assert reasons == {"i": (1, "quote"), "j": (1, "chunk"), "k": (0, "quote"), "l": (0, "quote"), "m": (1, None), "o": (0, "chunk")}


def test_equal_quotes_count_once_best_outside_what_was_carried_over(spark):
    chunks = [("a", "[…] it was moved and seconded. next item"), ("b", "So it was moved  and seconded. Then more")]
    refs = [(1, "i", "a", "it was moved and seconded", ["amount"]), (2, "i", "b", "It was moved and SECONDED", ["vendor"]), (3, "h", "a", "it was moved and seconded", None)]
    got, reasons = run(spark, refs, chunks)
    assert set(got) == {2, 3} and got[2].supports == ["amount", "vendor"] and not got[2].in_overlap and got[3].in_overlap
    assert reasons == {"i": (1, None), "h": (1, None)}


def test_both_ways_to_find_a_quote_agree(spark):
    text = "the board voted to table item nine until may"
    rows = [(i, text[i : i + 15], t) for i in range(20) for t in (text, text + "  ")]
    df = spark.createDataFrame([(n, q, t) for n, (_, q, t) in enumerate(rows)], "ref long, quote string, text string")
    got = {r.ref: (r.start, r.end) for r in E.located(df).collect()}
    assert got == {n: E.find_quote(q, t) or (None, None) for n, (_, q, t) in enumerate(rows)}


def test_previews_keep_the_quote_in_sight(spark):
    text = "x" * 300 + "QUOTE" + "y" * 300
    cases = [(text, 300, 305), ("QUOTE" + "y" * 50, 0, 5), ("x" * 50 + "QUOTE", 50, 55), (text, 0, 400), ("ab QUOTE", 3, 8)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, text string, s int, e int").select("i", E.preview(F.col("text"), F.col("s"), F.col("e"), 40).alias("p"))
    for r in df.collect():
        text, s, e = cases[r.i]
        assert r.p.text[r.p.start : r.p.end] == text[s:e] and len(r.p.text) <= max(42, e - s)


def test_empty_tables(spark):
    assert run(spark, [], []) == ({}, {})
