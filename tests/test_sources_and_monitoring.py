import hashlib
import json
import uuid

import pytest
from pyspark.sql import functions as F

from gavelworks.functions import text as T
from gavelworks.operators import monitoring as M
from gavelworks.sources import captions, sinks
from gavelworks.streaming import incremental


def test_tracks(spark):
    track = "tracks array<struct<language: string, generated: boolean>>"
    cases = [[("fr", False), ("en", True), ("en-GB", False)], [("fr", False), ("en", True)], [("live_chat", True), ("fr", False)], [("live_chat", True), ("de", True)], [("live_chat", True)], [], None]
    got = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, {track}").select("i", captions.best_track(F.col("tracks")).alias("t")).orderBy("i").collect()
    assert [r.t and r.t.language for r in got] == ["en-GB", "en", "fr", "de", None, None, None]
    cc = [[("a", "fr", "Approved"), ("b", "EN-us", "Approved")], [("a", "fr", "Approved"), ("b", "en", "Draft")], [("b", "en", "Draft")], None]
    got = spark.createDataFrame([(i, c) for i, c in enumerate(cc)], "i int, t array<struct<src: string, srclang: string, state: string>>").select("i", captions.approved_track(F.col("t")).alias("t")).orderBy("i").collect()
    assert [r.t and r.t.src for r in got] == ["b", "a", None, None]


def test_files_and_lines(spark, tmp_path):
    (tmp_path / "a.vtt").write_bytes(b"WEBVTT")
    row = captions.file_hashes(spark, str(tmp_path / "a.vtt")).first()
    assert (row.bytes, row.sha256) == (6, hashlib.sha256(b"WEBVTT").hexdigest())
    (tmp_path / "c.jsonl").write_text("\n".join([json.dumps({"chunk_id": "b", "video_id": "v", "chunk_index": 2, "text": "one two three"}), "{bad", json.dumps({"chunk_id": "a", "video_id": "v", "chunk_index": 1, "token_count": 7})]))
    assert [(r.chunk_id, r.token_count) for r in captions.chunk_lines(spark, str(tmp_path / "c.jsonl")).collect()] == [("a", 7), ("b", 3)]
    with pytest.raises(Exception):
        captions.chunk_lines(spark, str(tmp_path / "c.jsonl"), strict=True).collect()
    texts = spark.createDataFrame([("v", "\ufeffWEBVTT\n\n00:01.000 --> 00:02.000\nhi")], "id string, text string")
    assert [r.text for r in captions.read_by_kind(texts, "id", "vtt").collect()] == ["hi"]
    with pytest.raises(ValueError, match="known are vtt"):
        captions.read_by_kind(texts, "id", "x")
    assert [str(r[0]) for r in spark.createDataFrame([(13401921239,), (0,), (None,)], "x long").select(T.filetime_date(F.col("x"))).collect()] == ["2025-09-09", "None", "None"]


def test_sinks(spark, tmp_path):
    have = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), (None, 3, "x")], "k string, n int, s string")
    assert {tuple(r) for r in sinks.upsert(have, spark.createDataFrame([("a", 9, "z"), ("c", 4, "z"), ("c", 4, "z")], have.schema), "k").collect()} == {("a", 9, "z"), ("b", 2, "y"), ("c", 4, "z"), (None, 3, "x")}
    assert {r.n for r in sinks.without(have, s="x", k=None).collect()} == {1, 2} and sinks.without(have).count() == 3
    names = ["v_0001", "é", ""]
    got = spark.createDataFrame([(n,) for n in names], "x string").select(sinks.point_id(F.col("x"))).collect()
    assert [r[0] for r in got] == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]
    path = str(tmp_path / "t")
    sinks.rebuild(have, path)
    sinks.rebuild(spark.read.parquet(path).where("n < 3"), path)
    assert spark.read.parquet(path).count() == 2
    good = sinks.split_rejected(have, F.when(F.col("k").isNull(), "no key"), str(tmp_path / "log"))
    assert good.count() == 2 and [(r.n, r.reason) for r in spark.read.json(str(tmp_path / "log")).collect()] == [(3, "no key")]
    sinks.export_csv(have, str(tmp_path / "csv"), ["k", "n"], [F.asc("n")], 2)
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()] == [("a", "1"), ("b", "2")]
    for _ in range(2):
        sinks.append_log(have.limit(1), str(tmp_path / "app"))
    assert spark.read.json(str(tmp_path / "app")).count() == 2
    chunks = spark.createDataFrame([("s", "v", 2, "b"), ("s", "v", 1, "a"), ("s", "w", 1, "c")], "school_slug string, video_id string, chunk_index int, text string")
    for _ in range(2):
        sinks.write_transcripts(chunks, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/chunks")).count() == 3
    assert {r.value for r in spark.read.text(str(tmp_path / "out/text"), wholetext=True).select("value").collect()} == {"a\n\nb\n", "c\n"}


def test_hourly_counts(spark, tmp_path):
    rows = [("2024-01-01 10:05:00", "a", 1.0), ("2024-01-01 10:50:00", "a", None), ("2024-01-01 11:00:00", "b", 2.0)]
    spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    query = incremental.hourly_counts(stream).writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.event_type, r.n, r.total) for r in spark.sql("select * from hours").collect()) == [("a", 2, 1.0), ("b", 1, 2.0)]


def test_audits(spark):
    log = spark.createDataFrame([("sql", "a [1]"), ("sql", "b"), ("sql", None), ("rag", "[2, 3]")], "route string, answer string")
    assert {tuple(r) for r in M.log_audit(log).collect()} == {("sql", 3, 2, 66), ("rag", 1, 0, 0)}
    cases = [("1", "k", ["sql"], ["Yes"], [], ["a", "b"]), ("2", "k", ["sql", "rag"], [], ["no"], []), ("3", "k", ["rag"], None, None, ["a"]), ("4", "j", ["rag"], None, None, None)]
    answers = [("1", "sql", "YES.", ["b", "c"]), ("2", "rag", "No way", None), ("3", "rag", None, ["a"])]
    got = M.evaluated(
        spark.createDataFrame(cases, "id string, kind string, routes array<string>, must_contain array<string>, must_not_contain array<string>, chunk_ids array<string>"), spark.createDataFrame(answers, "id string, route string, answer string, found array<string>")
    )
    assert {tuple(r) for r in got.collect()} == {("1", "k", True, 0.5), ("2", "k", False, None), ("3", "k", True, 1.0), ("4", "j", False, None)}
    assert {tuple(r) for r in M.evaluation(got).collect()} == {("k", 3, 2, 0.75, 1, 0), ("j", 1, 0, None, 0, 0)}
    calls = spark.createDataFrame([("m", 10, 5, 1.5, "stop", "ok"), ("m", None, 7, 0.5, "LENGTH", None), ("m", 1, None, None, None, "error")], "model string, tokens_in int, tokens_out int, seconds double, finish string, status string")
    assert tuple(M.usage(calls).first()) == ("m", 3, 11, 12, 2.0, 1, 1)


def test_calls_of_a_model_keep_their_failures(spark):
    from gavelworks.operators import models

    def client():
        seen = {}

        def ask(prompt):
            seen[prompt] = seen.get(prompt, 0) + 1
            if prompt == "never" or (prompt == "later" and seen[prompt] < 2):
                raise TimeoutError(prompt)
            return prompt.upper(), 1, 2, "stop"

        return ask

    df = spark.createDataFrame([(1, "now"), (2, "later"), (3, "never"), (4, None)], "id int, prompt string").coalesce(1)
    got = {r.id: (r.answer, r.tries, r.status) for r in models.complete(df, "id", client, tries=3, first_wait=0.01).collect()}
    assert got == {1: ("NOW", 1, "ok"), 2: ("LATER", 2, "ok"), 3: (None, 3, "TimeoutError"), 4: (None, 0, "no prompt")}

    def refusing():
        def ask(prompt):
            raise models.Refused("key")

        return ask

    with pytest.raises(Exception, match="key"):
        models.complete(df, "id", refusing).collect()


def test_positions_and_columns(spark):
    from gavelworks.operators import extraction as X
    from gavelworks.operators import relational as R

    df = spark.createDataFrame([("Vice Chancellor Alcorta",), ("Dean of Instruction",), ("Dean",), (None,), ("Director Jo",), ("Dean of",)], "p string")
    got = df.select(X.split_position(F.col("p")).alias("x"), X.is_truncated(F.col("p")).alias("cut")).collect()
    assert [(r.x.position, r.x.name) for r in got] == [("Vice Chancellor", "Alcorta"), ("Dean of Instruction", None), ("Dean", None), (None, None), ("Director Jo", None), ("Dean of", None)]
    assert [r.cut for r in got] == [False, False, False, None, False, True]
    with pytest.raises(ValueError, match="no such columns: q"):
        R.pick(df, ["p", "q"])
