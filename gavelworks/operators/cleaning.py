"""Rolling captions into segments of clean sentences.

Cues are cleaned by column functions. What a cue repeats of the words already said is cut off by a fold over the cues of one file
(one row, so a task holds no more than it read); the segments that come out are finished by column functions again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelworks.functions import text as T
from gavelworks.sources.captions import vtt_cues

#: Words that a cue is compared with, words from which a segment ends at a full stop, and the least words of a segment.
LOOK_BACK, FULL, LEAST_WORDS = 60, 50, 3


def clean_cue(c: Column) -> Column:
    """A cue without markup (which glues, as captions put tags within words), marks of change, notes and hesitation."""
    bare = F.replace(T.unescape(T.strip_tags(c, "")), F.lit(">>"), F.lit(" "))
    return T.tidy(T.strip_fillers(T.strip_notes(T.fold_punctuation(bare))))


def new_words(said: list[str], cue: str) -> str:
    """What a cue adds: without the longest beginning of it that stands anywhere among the last words said."""
    words = cue.split()
    low = [w.lower() for w in words]
    before = f" {' '.join(said[-LOOK_BACK:])} "
    known = next((k for k in range(len(low), 0, -1) if f" {' '.join(low[:k])} " in before), 0)
    return " ".join(words[known:]) if known else cue


def _fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for key, cues in zip(f["id"], f["cues"], strict=True):
            said: list[str] = []
            parts: list[str] = []
            begin = end = 0.0
            for cue in cues:
                added = new_words(said, cue["text"])
                if not added:
                    continue
                begin = begin if parts else cue["start"]
                end = cue["end"]
                parts.append(added)
                said += added.lower().split()
                if len(said) >= FULL and added.rstrip()[-1:] in (".", "!", "?"):
                    out.append((key, begin, end, " ".join(parts)))
                    said, parts = [], []
            if parts:
                out.append((key, begin, end, " ".join(parts)))
        yield pd.DataFrame(out, columns=["id", "start", "end", "stitched"])


def finish(c: Column) -> Column:
    """Stitched cues with contractions in full, without neighbouring sentences or eight words said twice."""
    sentences = T.distinct_neighbours(T.split_sentences(T.expand_contractions(c)))
    return T.tidy(T.squeeze_repeats(F.array_join(sentences, " "), 8))


def caption_segments(texts: DataFrame, id_col: str) -> DataFrame:
    """(id, nth, start, end, text, confidence) of WebVTT texts (id, text); segments of fewer than LEAST_WORDS words are left out. Texts that aren't WebVTT, and null ones, give none."""
    cues = vtt_cues(texts.select(F.col(id_col).cast("string").alias("id"), "text"), "id")
    own = cues.select("id", "nth", "start", "end", clean_cue(F.col("text")).alias("text")).where("text <> ''")
    ordered = own.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("nth", "start", "end", "text"))).alias("cues"))
    folded = ordered.mapInPandas(_fold, "id string, start double, end double, stitched string")
    done = folded.select("id", "start", "end", finish(F.col("stitched")).alias("text"))
    n = T.word_count(F.col("text"))
    from pyspark.sql import Window as W

    nth = F.row_number().over(W.partitionBy("id").orderBy("start", "end", "text"))
    return done.where(n >= LEAST_WORDS).select(F.col("id").alias(id_col), nth.alias("nth"), "start", "end", "text", T.words_a_minute(n, F.col("end") - F.col("start")).alias("confidence"))


def document_quality(segments: DataFrame, doc: str, least_words: int = 500, least_quality: float = 0.6) -> DataFrame:
    """(doc, n_words, n_speakers, quality, rejected): mean confidence of segments, less where a document has fewer than least_words; documents below least_quality are rejected."""
    per = segments.groupBy(doc).agg(
        F.sum(T.word_count(F.col("text"))).alias("n_words"), F.count_distinct("speaker").alias("n_speakers"), F.avg(F.col("confidence").cast("decimal(9,6)")).cast("double").alias("c")
    )
    short = F.when(F.col("n_words") < least_words, 0.5 + 0.5 * F.col("n_words") / least_words).otherwise(1.0)
    quality = T.half_up(F.coalesce("c", F.lit(0.0)) * short, 4)
    return per.select(doc, "n_words", "n_speakers", quality.alias("quality"), (quality < least_quality).alias("rejected"))


def split_times(pieces: DataFrame, doc: list[str], nth: str) -> DataFrame:
    """pieces (doc..., nth, text, seg_start, seg_end) of split segments with start_time and end_time by their share of the characters; the last one ends where the segment did."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*doc).orderBy(nth)
    before = F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.greatest(F.sum(F.length("text")).over(W.partitionBy(*doc)), F.lit(1))
    span = F.greatest(F.lit(0.0), F.col("seg_end") - F.col("seg_start"))
    last = F.lead(nth).over(w).isNull()
    start = T.half_up(F.col("seg_start") + span * before / total, 3)
    end = F.when(last, F.col("seg_end")).otherwise(T.half_up(F.col("seg_start") + span * (before + F.length("text")) / total, 3))
    return pieces.withColumn("start_time", start).withColumn("end_time", end)
