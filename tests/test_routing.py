from gavelworks.operators import routing as Q

ALIASES = {"north_college": ["north college", "nc"], "south_bay": ["south bay college", "south bay", "sb"], "east": ["east"]}


def routes(spark, *questions):
    df = spark.createDataFrame([(i, q, "x") for i, q in enumerate(questions)], "id int, q string, route string")
    return [tuple(r)[1:] for r in Q.routed(df, "id", "q", ALIASES).orderBy("id").collect()]


def test_precedence(spark):
    got = routes(
        spark,
        "What is the weather today?",
        "Compare bonds at North College",
        "What did NC and south bay approve?",
        "Summarize the last board meeting",
        "Summarize the last three board meetings",
        "Did the motion to adjourn pass?",
        "Why did they close the pool",
        "Why did the motion to buy it pass",
        "what initiatives are new",
        "tell me about pools",
        None,
        "",
    )
    assert [r[0] for r in got] == ["none", "compare", "compare", "latest_meeting", None, "sql", "rag", "hybrid", "hybrid", None, None, None]
    assert got[0][1] == "" and got[6][1] == "" and got[5][1] == "votes"
    assert got[3][1] == "votes,financial_items,personnel_actions"


def test_schools_come_by_first_mention_and_as_whole_words(spark):
    got = [r[2] for r in routes(spark, "south bay and north college", "nc then sb", "once eastern sbx", "SB beside South Bay College, and NC", None)]
    assert got == ["south_bay,north_college", "north_college,south_bay", "", "south_bay,north_college", ""]


def test_labels_of_a_model(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("Route: sql.",), ("compare",), ("no idea",), (None,)], "a string")
    assert [r[0] for r in df.select(Q.labelled_route(F.col("a"))).collect()] == ["sql", "compare", "hybrid", "hybrid"]


def test_citations_count_the_block_of_rows_first(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 1), (1, 2)], "query_id int, rank int")
    assert [r.citation for r in Q.numbered_sources(df, F.lit(True)).orderBy("rank").collect()] == [2, 3]
    assert [r.citation for r in Q.numbered_sources(df, F.lit(False)).orderBy("rank").collect()] == [1, 2]


def test_contexts_are_put_together(spark):
    routed = [(1, "sql", "votes,financial_items", "b,a"), (2, "rag", "", "a"), (3, None, "votes", ""), (4, "none", "", ""), (5, "hybrid", "votes", "zz"), (6, "compare", "", "a,b")]
    blocks = [("votes", "a", "VA"), ("votes", "b", "VB"), ("financial_items", "a", "FA"), ("personnel_actions", "b", None)]
    passages = [(q, r, f"p{q}{r}") for q in range(1, 6) for r in (2, 1)]
    got = Q.assembled(
        spark.createDataFrame(routed, "id int, route string, tables string, schools string"), spark.createDataFrame(blocks, "table string, school string, block string"), spark.createDataFrame(passages, "id int, rank int, text string"), "id"
    )
    assert {r.id: (r.route, r.context, r.n_sources) for r in got.collect()} == {
        1: ("sql", "[1] VB\nVA\nFA", 1),
        2: ("rag", "[1] p21\n\n[2] p22", 2),
        3: ("hybrid", "[1] VA\nVB\n\n[2] p31\n\n[3] p32", 3),
        4: ("none", None, 0),
        5: ("hybrid", "[1] p51\n\n[2] p52", 2),
        6: ("compare", "[1] VA\nVB\nFA", 1),
    }
