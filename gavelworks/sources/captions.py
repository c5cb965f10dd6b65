"""Caption files as rows: WebVTT texts, recognition output in JSON, event lists, and chunk files with one object a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelworks.functions.text import clock, seconds, token_estimate, word_count

CHUNK = "chunk_id string, chunk_index int, video_id string, school_slug string, text string, speaker string, start_time double, end_time double, token_count int, quality_score double"
RECOGNISED = "segments array<struct<start: double, end: double, text: string, avg_logprob: double, speaker: string>>"
EVENTS = "array<struct<Metadata: string, TimelineTime: long, Duration: double>>"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def is_vtt(text: Column) -> Column:
    return F.startswith(F.ltrim(F.regexp_replace(text, "^﻿", "")), F.lit("WEBVTT"))


def vtt_cues(texts: DataFrame, id_col: str) -> DataFrame:
    """(id, nth, start, end, text) of each cue of WebVTT texts (id, text); blocks without times, and cues without text, are left out."""
    blocks = texts.where(is_vtt(F.col("text"))).select(id_col, F.posexplode(F.split(F.regexp_replace("text", "\r", ""), r"\n[ \t]*\n")).alias("nth", "block"))
    stamp = r"((?:\d+:)?\d{1,2}:\d{2}\.\d+)\s+-->\s+((?:\d+:)?\d{1,2}:\d{2}\.\d+)"
    cue = blocks.where(F.col("block").rlike(stamp))
    said = F.trim(F.regexp_replace(F.regexp_replace("block", rf"(?s)^.*?{stamp}[^\n]*\n?", ""), r"\s+", " "))
    out = cue.select(id_col, "nth", seconds(F.regexp_extract("block", stamp, 1)).alias("start"), seconds(F.regexp_extract("block", stamp, 2)).alias("end"), said.alias("text"))
    return out.where("text <> ''")


def recognised_segments(texts: DataFrame, id_col: str) -> DataFrame:
    """(id, nth, start, end, text, speaker, confidence) of recognition output in JSON; malformed texts give no row."""
    rows = texts.select(id_col, F.posexplode(F.from_json("text", RECOGNISED)["segments"]).alias("nth", "s"))
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.coalesce(F.col("s.avg_logprob"), F.lit(-0.5)) + 2) / 2))
    return rows.select(id_col, "nth", "s.start", "s.end", F.trim("s.text").alias("text"), "s.speaker", confidence.alias("confidence")).where("text <> ''")


def events_to_vtt(texts: DataFrame, id_col: str, start: Column) -> DataFrame:
    """(id, vtt): a WebVTT text of each list of events in JSON; times are ticks of 100 ns since `start` seconds, negative ones 0; blank events are left out."""
    events = F.filter(F.from_json("text", EVENTS), lambda e: F.trim(F.coalesce(e["Metadata"], F.lit(""))) != "")
    timed = F.array_sort(F.transform(events, lambda e: F.struct(F.greatest(F.lit(0.0), e["TimelineTime"] / 1e7 - start).alias("at"), F.coalesce(e["Duration"], F.lit(0.0)).alias("len"), F.trim(e["Metadata"]).alias("said"))))
    milli = lambda t: F.concat(clock(t), F.lit("."), F.lpad((F.floor(t * 1000) % 1000).cast("string"), 3, "0"))
    cues = F.transform(timed, lambda c: F.concat(milli(c["at"]), F.lit(" --> "), milli(c["at"] + c["len"]), F.lit("\n"), c["said"]))
    return texts.select(id_col, F.concat_ws("\n\n", F.array(F.lit("WEBVTT")), cues).alias("vtt"))


def best_track(tracks: Column) -> Column:
    """Of caption tracks (language, generated): the first typed English one, else generated English, else any typed, else any generated that is no live chat; null without one."""
    english = lambda t: t["language"].isin("en", "en-US", "en-GB")
    ranks = [lambda t: ~t["generated"] & english(t), lambda t: t["generated"] & english(t), lambda t: ~t["generated"], lambda t: t["generated"] & (t["language"] != "live_chat")]
    return F.coalesce(*[F.try_element_at(F.filter(tracks, test), F.lit(1)) for test in ranks])


def approved_track(tracks: Column) -> Column:
    """Of caption tracks (src, srclang, state): the first approved English one, else the first approved; null without one."""
    approved = F.filter(tracks, lambda t: t["state"] == "Approved")
    return F.coalesce(F.try_element_at(F.filter(approved, lambda t: F.lower(t["srclang"]).startswith("en")), F.lit(1)), F.try_element_at(approved, F.lit(1)))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


#: Readers by the kind of source that a school names; each takes (id, text) rows and the name of the id.
READERS = {"vtt": vtt_cues, "whisperx_asr": recognised_segments}


def read_by_kind(texts: DataFrame, id_col: str, kind: str) -> DataFrame:
    """Segments of texts by the reader of their kind; an unknown kind is an error that names the known ones."""
    if kind not in READERS:
        raise ValueError(f"unknown kind of captions {kind!r}; known are {', '.join(sorted(READERS))}")
    return READERS[kind](texts, id_col)


def chunk_lines(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Chunks from JSON lines, in order within a video; malformed lines are dropped, or with strict fail the read. A missing or zero token count is estimated."""
    own = spark.read.schema(CHUNK).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    tokens = F.coalesce(F.nullif("token_count", F.lit(0)), F.greatest(F.lit(1), token_estimate(word_count(F.col("text")))))
    return own.withColumn("token_count", tokens).sort("video_id", "chunk_index")
