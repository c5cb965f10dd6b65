from datetime import datetime

from gavelworks.operators import orphans

EVIDENCE = "evidence_id long, chunk_id string, created_at timestamp, kind string"
VOTES = "vote_id long, chunk_ids array<string>, created_at timestamp"
CHUNKS = "chunk_id string, meeting_id long, deleted_at timestamp, loaded_at timestamp, row_id string"
MEETINGS = "meeting_id long, deleted_at timestamp"
T1, T2 = datetime(2024, 1, 5), datetime(2024, 2, 5)


def run(spark, evidence, votes, chunks, meetings, **limits):
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((evidence, EVIDENCE), (votes, VOTES), (chunks, CHUNKS), (meetings, MEETINGS))]
    return {tuple(r) for r in orphans.orphan_rows(*frames, **limits).collect()}


def test_kinds_blanks_case_repeats_and_nulls(spark):
    chunks = [("a_1", 1, None, T1, "x"), ("B_2", 1, T2, T1, "x"), ("c_3", 2, None, T1, "x"), ("d_4", None, None, T2, "x"), (None, 1, None, None, "x"), ("a_1", 1, None, T1, "x")]
    evidence = [(1, " A_1 ", T1, "k"), (2, "b_2", T1, "k"), (3, "c_3", T1, "k"), (4, "D_4", T1, "k"), (5, "e_5", None, "k"), (6, None, T1, "k"), (7, "  ", T1, "k"), (2, "b_2", T1, "k")]
    votes = [(9, ["a_1", "zz", "ZZ", "", None], T2), (10, None, T2), (11, [], T2)]
    found = run(spark, evidence, votes, chunks, [(2, T2), (1, None)])
    assert found == {
        ("extraction_evidence", 2, "b_2", "deleted", "2024-01"),
        ("extraction_evidence", 3, "c_3", "deleted", "2024-01"),
        ("extraction_evidence", 4, "d_4", "late", "2024-01"),
        ("extraction_evidence", 5, "e_5", "missing", None),
        ("votes", 9, "zz", "missing", "2024-02"),
    }


def test_empty_tables(spark):
    assert run(spark, [], [], [], []) == set()
    assert run(spark, [(1, "a", T1, "k")], [], [], []) == {("extraction_evidence", 1, "a", "missing", "2024-01")}


def test_heavy_keys_take_the_broadcast_way_with_the_same_result(spark):
    refs = spark.createDataFrame([("t", i, "hot" if i % 3 else f"k{i}", T1) for i in range(300)], "src_table string, row_id long, chunk_id string, created_at timestamp")
    target = spark.createDataFrame([("hot", False, T2), ("k0", False, T1)], "_id string, _deleted boolean, _loaded timestamp")
    heavy = {r[0] for r in orphans.heavy_keys(refs, max_heavy=10, min_heavy=5).collect()}
    assert heavy == {"hot"}
    one = {tuple(r) for r in orphans.check_references(refs, target, max_heavy=10, min_heavy=5).collect()}
    two = {tuple(r) for r in orphans.check_references(refs, target).collect()}
    assert one == two and len(one) == 299


def test_counts_of_a_skewed_key_at_the_default_limits(spark):
    day = lambda i: datetime(2024, 1 + i % 3, 1 + i % 28)
    evidence = [(i, "Hot" if i < 3000 else f"k{i % 50}", None if i % 97 == 0 else day(i), "k") for i in range(5000)]
    votes = [(i, ["hot", f"k{i}", "late_1"], day(i)) for i in range(60)]
    chunks = [("hot", 1, None, datetime(2024, 2, 10), "x"), ("late_1", 1, None, datetime(2024, 3, 9), "x"), ("k7", 1, T1, None, "x"), *[(f"k{i}", 1, None, None, "x") for i in range(20, 40)]]
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((evidence, EVIDENCE), (votes, VOTES), (chunks, CHUNKS), ([(1, None)], MEETINGS))]
    refs = orphans._all_references(*frames[:2])
    assert [r[0] for r in orphans.heavy_keys(refs).collect()] == ["hot"]
    want = {}
    for table, _, key, kind, month in (tuple(r) for r in orphans.orphan_rows(*frames).collect()):
        n, keys = want.get((table, month, kind), (0, set()))
        want[table, month, kind] = (n + 1, keys | {key})
    got = {tuple(r)[:3]: tuple(r)[3:] for r in orphans.orphan_counts(*frames).collect()}
    assert got == {k: (n, len(keys)) for k, (n, keys) in want.items()} and any(k[2] == "late" for k in got)


def test_what_is_added_up_first_is_small(spark):
    refs = spark.createDataFrame([("t", i, "hot", T1 if i % 2 else T2) for i in range(1000)], "src_table string, row_id long, chunk_id string, created_at timestamp")
    pre = refs.groupBy("src_table", "chunk_id").agg({"*": "count"})
    assert pre.count() == 1
    assert [r[0] for r in orphans.heavy_keys(pre, weight=pre["count(1)"], min_heavy=5, max_heavy=10).collect()] == ["hot"]
