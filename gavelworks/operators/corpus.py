"""Chunks, quality gates, context windows and the verification of quotations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gavelworks.functions.text import half_up, split_sentences, word_count
from gavelworks.storage import cut

#: Sizes in estimated tokens, and words that a chunk carries over from the one before.
TARGET, MOST, OVERLAP_WORDS = 400, 500, 40
#: The mark before what a chunk carries over from the one before.
CARRIED = "[…]"
#: A run of chunks with more estimated tokens is halved.
MOST_TOKENS = 700


def first_reason(checks: list[tuple[Column, str]]) -> Column:
    """The reason of the first check that holds, in order; null if none does."""
    out = F.lit(None).cast("string")
    for test, reason in reversed(checks):
        out = F.when(test, reason).otherwise(out)
    return out


def gate(meetings: DataFrame, chunks: DataFrame, least_words: int = 500, least_chunks: int = 5, least_quality: float = 0.5, least_seconds: int = 120) -> DataFrame:
    """(meeting_id, n_chunks, words, mean_quality, reason, score) of each meeting: why it is rejected first (null if it isn't), and its score."""
    per = chunks.groupBy("meeting_id").agg(F.count("*").alias("n_chunks"), F.avg(F.col("quality_score").cast("decimal(9,6)")).cast("double").alias("q"), F.sum(word_count(F.col("text"))).alias("chunk_words"), F.max("end_time").alias("last"))
    own = meetings.select("meeting_id", "word_count", "duration_seconds", "published_date", "school_id").join(per, "meeting_id", "left")
    words = F.coalesce("word_count", "chunk_words", F.lit(0))
    n, q = F.coalesce("n_chunks", F.lit(0)), half_up(F.coalesce("q", F.lit(0.0)), 4)
    reason = first_reason(
        [
            (n == 0, "no chunks"),
            (words < least_words, "too few words"),
            (n < least_chunks, "too few chunks"),
            (q < least_quality, "low quality"),
            (F.col("published_date").isNull() | F.col("school_id").isNull(), "metadata missing"),
            (F.coalesce(F.col("duration_seconds").cast("double"), F.col("last"), F.lit(0.0)) < least_seconds, "too short"),
        ]
    )
    score = half_up(0.40 * q + 0.35 * F.least(F.lit(1.0), words / 3000) + 0.25 * F.least(F.lit(1.0), n / 50), 4)
    out = own.select("meeting_id", n.alias("n_chunks"), words.cast("long").alias("words"), q.alias("mean_quality"), reason.alias("reason"), score.alias("full"))
    early = F.col("reason").isin("no chunks", "too few words", "too few chunks")
    return out.select("meeting_id", "n_chunks", "words", "mean_quality", "reason", F.when(F.col("reason").isNull(), F.col("full")).when(early, 0.0).otherwise(F.col("mean_quality")).alias("score"))


def windows(scored: DataFrame, doc: str, position: str, score: str, least: float, context: int) -> DataFrame:
    """Hits (score >= least) with `context` rows around them, merged where they overlap or touch: (doc, window, first, last, n_rows, n_hits, peak, total)."""
    w = W.partitionBy(doc).orderBy(position)
    hit = (F.col(score) >= least).cast("int")
    near = scored.withColumn("nth", F.row_number().over(w)).withColumn("hit", hit).withColumn("near", F.max("hit").over(w.rowsBetween(-context, context))).where("near = 1")
    island = near.withColumn("island", F.col("nth") - F.row_number().over(w))
    spans = island.groupBy(doc, "island").agg(
        F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n_rows"), F.sum("hit").alias("n_hits"), F.max(score).alias("peak"), half_up(F.sum(score), 3).alias("total")
    )
    return spans.withColumn("window", F.row_number().over(W.partitionBy(doc).orderBy("first"))).drop("island")


def _halves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of rows (pos, tokens, score) cut at the middle until they hold MOST_TOKENS or two rows: (key..., lo, hi) positions within the run."""
    for f in frames:
        out = []
        for key, tokens in zip(f["key"], f["tokens"], strict=True):
            todo = [(0, len(tokens))]
            while todo:
                lo, hi = todo.pop()
                if hi - lo <= 2 or sum(tokens[lo:hi]) <= MOST_TOKENS:
                    out.append((key, lo, hi))
                else:
                    todo += [(lo + (hi - lo) // 2, hi), (lo, lo + (hi - lo) // 2)]
        yield pd.DataFrame(out, columns=["key", "lo", "hi"]).astype({"key": "int64", "lo": "int32", "hi": "int32"})


def candidate_windows(scored: DataFrame, targets: dict[str, tuple]) -> DataFrame:
    """(target, doc, first, last, n_rows, n_tokens, peak, total, start_time, end_time, source, text, best_text, rank) of scored (doc, pos, text, tokens, start_time, end_time, source, and a score column for each target).

    Hits (a score of at least the target's) with its context on both sides, merged where they overlap or touch; runs of more than MOST_TOKENS
    are halved, and halves without a hit dropped. source is the most frequent one, the smallest in a tie; best_text is that of the row with the peak, the first in a tie. rank is by total within doc and target. One row for each doc and pos.
    """
    from functools import reduce

    base = ["doc", "pos", "text", "tokens", "start_time", "end_time", "source"]
    parts = [scored.select(F.lit(t).alias("target"), F.lit(float(least)).alias("least"), F.lit(k).alias("k"), *base, F.col(t).alias("score")) for t, (_, least, k) in targets.items()]
    own = reduce(DataFrame.unionByName, parts)
    w = W.partitionBy("target", "doc").orderBy("pos")
    hit = (F.col("score") >= F.col("least")).cast("int")
    numbered = own.withColumn("nth", F.row_number().over(w)).withColumn("hit", hit)
    # how far the nearest hit before and after is
    back = F.col("nth") - F.last(F.when(F.col("hit") == 1, F.col("nth")), ignorenulls=True).over(w)
    ahead = F.first(F.when(F.col("hit") == 1, F.col("nth")), ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)) - F.col("nth")
    near = numbered.withColumn("gap", F.least(back, ahead)).where("gap <= k")
    island = near.withColumn("island", F.col("nth") - F.row_number().over(w)).withColumn("key", F.xxhash64("target", "doc", "island"))
    island = cut(island.withColumn("at", F.row_number().over(W.partitionBy("key").orderBy("pos")) - 1))
    runs = island.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "tokens"))), lambda x: x["tokens"]).alias("tokens"))
    halves = runs.mapInPandas(_halves, "key long, lo int, hi int")
    rows = island.join(halves, "key").where("at >= lo and at < hi")
    said = F.array_sort(F.collect_list(F.struct("pos", "text")))
    spans = rows.groupBy("target", "doc", "key", "lo", "least").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n_rows"), F.sum("tokens").alias("n_tokens"), F.max("score").alias("peak"), half_up(F.sum("score"), 3).alias("total"),
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.array_join(F.transform(said, lambda x: F.concat(F.lit("[["), x["pos"].cast("string"), F.lit("]]\n"), x["text"])), "\n\n").alias("text"),
        F.collect_list("source").alias("sources"), F.max_by("text", F.struct("score", -F.col("pos"))).alias("best_text"),
    )
    often = F.array_max(F.transform(F.array_sort(F.array_distinct("sources")), lambda x, i: F.struct(F.size(F.filter("sources", lambda y: y == x)), -i, x.alias("x"))))["x"]
    kept = spans.where("peak >= least").withColumn("source", often)
    ranked = kept.withColumn("rank", F.row_number().over(W.partitionBy("target", "doc").orderBy(F.desc("total"), "first")))
    return ranked.select("target", "doc", "first", "last", "n_rows", "n_tokens", "peak", "total", "start_time", "end_time", "source", "text", "best_text", "rank")


def dominant(rows: DataFrame, by: list[str], value: str, order: Column) -> DataFrame:
    """The most frequent non-null value of each group; of equally frequent ones the first in order."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("at"))
    return counted.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("n"), "at", value)).alias(value), F.max("n").alias("n"))


def text_start(text: Column) -> Column:
    """Seconds of the first time mark in a text (bracketed, the first of a range, or with hours or a fraction); null without one."""
    plain = F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))
    time = r"\d{1,2}:\d\d(?::\d\d)?(?:[.,]\d+)?"
    mark = rf"[\[<{{(]\s*{time}\s*(?:-+>|[\]>}})])|{time}\s*-+>|(?<![\d:.])(?:\d{{1,2}}:\d\d:\d\d(?:[.,]\d+)?|\d{{1,2}}:\d\d[.,]\d{{3}})(?![\d:])"
    parts = F.split(F.translate(F.regexp_extract(F.regexp_extract(plain, mark, 0), time, 0), ",", "."), ":")
    number = F.transform(parts, lambda x: x.try_cast("double"))
    return F.when(F.size(number) > 1, F.aggregate(number, F.lit(0.0), lambda t, x: t * 60 + x))


def _cost(words: int) -> int:
    return int(words * 1.3)


class _Packing:
    """The rule of chunk(): which parts of segments close a chunk, from the tokens that it holds."""

    def __init__(self, target: int, most: int):
        self.target, self.most, self.step = target, most, max(1, int(target / 1.3))
        #: A chunk that is still open holds 0 to `most` tokens.
        self.states = most + 1

    def parts(self, text: str | None) -> list[tuple[list[str], int, bool]]:
        """(words, tokens, whether it ends a sentence) of each part of a text: one, or if it exceeds the most, its sentences (cut, if need be) grouped up to the target."""
        words = text.split() if isinstance(text, str) else []
        groups = [words] if words else []
        if _cost(len(words)) > self.most:
            groups, held = [[]], 0
            for sentence in re.split(r"(?<=[.!?])\s+", text):
                own = sentence.split()
                whole = _cost(len(own)) <= self.target
                for unit in [own] if whole else [own[i : i + self.step] for i in range(0, len(own), self.step)]:
                    if groups[-1] and held + _cost(len(unit)) > self.target:
                        groups.append([])
                        held = 0
                    groups[-1].extend(unit)
                    held += _cost(len(unit))
        return [(g, _cost(len(g)), g[-1][-1] in ".!?") for g in groups if g]

    def add(self, held: int, tokens: int, ends: bool) -> tuple[bool, bool, int]:
        """Whether the chunk closes before a part of so many tokens, whether it closes after it, and the tokens held then."""
        before = held > 0 and held + tokens > self.most
        held = tokens if before else held + tokens
        after = held >= self.target and ends
        return before, after, 0 if after else held


def _outcomes(packing: _Packing):
    """(pid, first, last, held, closed, table) of each partition, whose rows (pid, doc, text) are in order: the tokens held and chunks closed after its last document, if that begins here; table has both for each number of tokens held before, if it is the only one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, first, doc, held, closed = None, None, None, 0, 0
        # starts that have come to hold the same go on as one path: path[i] = [held, closed, starts], a start's own lead in closed chunks beside it
        paths: dict[int, list] = {}
        for f in frames:
            for p, d, text in zip(f["pid"].tolist(), f["doc"].tolist(), f["text"].tolist(), strict=True):
                if pid is None:
                    pid, first, doc = p, d, d
                    paths = {h: [(h, 0)] for h in range(packing.states)}
                if d != doc:
                    doc, held, closed, paths = d, 0, 0, {}
                for _, tokens, ends in packing.parts(text):
                    before, after, held = packing.add(held, tokens, ends)
                    closed += before + after
                    moved: dict[int, list] = {}
                    for h, starts in paths.items():
                        b, a, now = packing.add(h, tokens, ends)
                        gained = b + a
                        moved.setdefault(now, []).extend([(s, n + gained) for s, n in starts] if gained else starts)
                    paths = moved
        if pid is not None:
            table = [0] * (2 * packing.states) if paths else []
            for h, starts in paths.items():
                for s, n in starts:
                    table[2 * s], table[2 * s + 1] = h, n
            yield pd.DataFrame({"pid": [pid], "first": [first], "last": [doc], "held": [held], "closed": [closed], "table": [table]})

    return run


def _carried(outcomes: list) -> dict[int, tuple[int, int]]:
    """Of each partition, the tokens held and the chunks closed already of its first document."""
    found, last, state = {}, None, (0, 0)
    for o in sorted(outcomes, key=lambda o: o["pid"]):
        held, closed = state if o["first"] == last else (0, 0)
        found[o["pid"]] = (held, closed)
        state = (o["table"][2 * held], closed + o["table"][2 * held + 1]) if o["table"] else (o["held"], o["closed"])
        last = o["last"]
    return found


_PIECE = "doc string, chunk_index int, pid int, own string, said array<string>, start double, end double, n int, trust double, trusted int, source string"


def _pieces(packing: _Packing, carried: dict[int, tuple[int, int]]):
    """What each partition has of a chunk (_PIECE). said: the speaker of each part; trust: the sum of confidence over its `trusted` parts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, held, index, pid = None, 0, 0, None
        words, said, times, trust, sources = [], [], [], [], []
        out: list[tuple] = []

        def close() -> None:
            if words:
                out.append((doc, index, pid, " ".join(words), said.copy(), min(times, default=None), max(times, default=None), len(words), float(sum(trust)), len(trust), min(sources, default=None)))
            for x in (words, said, times, trust, sources):
                x.clear()

        for f in frames:
            for p, d, text, by, start, end, sure, source in zip(*(f[c].tolist() for c in ("pid", "doc", "text", "speaker", "start", "end", "confidence", "source")), strict=True):
                if pid is None:
                    pid, doc = p, d
                    held, index = carried[p]
                if d != doc:
                    close()
                    doc, held, index = d, 0, 0
                for part, tokens, ends in packing.parts(text):
                    before, after, held = packing.add(held, tokens, ends)
                    if before:
                        close()
                        index += 1
                    words.extend(part)
                    times.extend(t for t in (start, end) if t == t and t is not None)
                    trust.extend([sure] if sure == sure and sure is not None else [])
                    sources.extend([source] if isinstance(source, str) else [])
                    if isinstance(by, str) and by:
                        said.append(by)
                    if after:
                        close()
                        index += 1
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _PIECE.split(", ")])
            out.clear()
        close()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _PIECE.split(", ")])

    return run


def chunk(segments: DataFrame, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """Segments (doc, start, end, text, speaker) packed in order into chunks: (doc, chunk_id, chunk_index, text, speaker, start_time, end_time, n_words, token_count, quality_score, source_type, total_chunks).

    A chunk closes at the end of a sentence once it holds `target` estimated tokens, or before a part that would take it past `most`. It begins, after a mark, with the
    last sentence of the chunk before (of at most `overlap` words; the end of the whole text where it is one sentence). A segment past `most` is split at its sentences, or else words.
    Null and blank texts are skipped. speaker is the most frequent one, the first in a tie; quality is the mean of a column `confidence`, less for recognised speech (column `source`) without a speaker.
    A segment without a start has that of the time in its text, else its end, else comes last. Segments of one time are ordered by text and speaker; by a column
    `seq` first, if there is one, and then repeated segments count once.

    Rows are spread by document and time, so that a long document has several stretches. What a stretch makes of each number of tokens that the chunk
    before it may hold is found first; with what each is handed on, all stretches are then packed at once.
    """
    packing = _Packing(target, most)
    given = lambda c, kind: (F.col(c) if c in segments.columns else F.lit(None)).cast(kind).alias(c)
    own = segments.where("doc is not null").select(
        "doc", F.coalesce("start", text_start(F.col("text")), "end").cast("double").alias("start"), F.col("end").cast("double").alias("end"), given("seq", "long"), "text", "speaker", given("confidence", "double"), given("source", "string")
    )
    order = [F.col(c).asc_nulls_last() for c in ("doc", "start", "end", "seq", "text", "speaker", "confidence", "source")]
    dealt = own.repartitionByRange(int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order)
    # equal rows lie together, so this takes no further exchange
    once = dealt.distinct() if "seq" in segments.columns else dealt
    placed = cut(once.sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id()))
    outcomes = placed.select("pid", "doc", "text").mapInPandas(_outcomes(packing), "pid int, first string, last string, held int, closed int, table array<int>").collect()
    pieces = placed.mapInPandas(_pieces(packing, _carried(outcomes)), _PIECE)
    parts = F.array_sort(F.collect_list(F.struct("pid", "own", "said")))
    whole = pieces.groupBy("doc", "chunk_index").agg(
        parts.alias("p"), F.min("start").alias("start_time"), F.max("end").alias("end_time"), F.sum("n").cast("int").alias("n_words"), F.sum("trust").alias("trust"), F.sum("trusted").alias("trusted"), F.min("source").alias("source_type")
    )
    said = F.flatten(F.col("p.said"))
    often = F.transform(F.array_distinct(said), lambda x, i: F.struct(F.size(F.filter(said, lambda y: y == x)), -i, x.alias("speaker")))
    whole = cut(whole.select("doc", "chunk_index", F.array_join("p.own", " ").alias("own"), F.array_max(often)["speaker"].alias("speaker"), "start_time", "end_time", "n_words", (F.col("trust") / F.nullif("trusted", F.lit(0))).alias("trust"), "source_type"))
    last = F.split(F.try_element_at(split_sentences(F.col("own")), F.lit(-1)), " ")
    tail = F.array_join(F.slice(last, F.greatest(F.size(last) - overlap + 1, F.lit(1)), max(overlap, 1)), " ")
    before = whole.select("doc", (F.col("chunk_index") + 1).alias("chunk_index"), tail.alias("tail")) if overlap else whole.select("doc", "chunk_index", F.lit(None).cast("string").alias("tail")).limit(0)
    total = whole.groupBy("doc").agg(F.count("*").cast("int").alias("total_chunks"))
    text = F.when(F.col("tail").isNotNull(), F.concat_ws(" ", F.lit(CARRIED), "tail", "own")).otherwise(F.col("own"))
    quality = F.coalesce("trust", F.lit(0.5)) * F.when(F.col("speaker").isNull() & (F.col("source_type") == "whisperx_asr"), 0.85).otherwise(1.0)
    full = whole.join(before, ["doc", "chunk_index"], "left").join(total, "doc").withColumn("text", text)
    number = F.col("chunk_index") + 1
    return full.select(
        "doc", F.concat("doc", F.format_string("_%04d", number)).alias("chunk_id"), number.alias("chunk_index"), "text", "speaker", half_up(F.col("start_time"), 3).alias("start_time"), half_up(F.col("end_time"), 3).alias("end_time"),
        "n_words", F.floor(word_count(F.col("text")) * 1.3).cast("int").alias("token_count"), half_up(quality, 4).alias("quality_score"), "source_type", "total_chunks",
    )


def normal(c: Column) -> Column:
    """Lower case, plain quotes and dashes, single blanks."""
    plain = F.translate(c, "‘’“”–— ", "''\"\"-- ")
    return F.trim(F.regexp_replace(F.lower(plain), r"\s+", " "))


def verify_quotes(evidence: DataFrame, chunks: DataFrame, least: int = 12) -> DataFrame:
    """(evidence_id, verdict, at): whether each quotation stands in its chunk: verified (at: its first position in the normal form, from 1), short, no chunk, or not found."""
    texts = chunks.select(F.lower(F.trim("chunk_id")).alias("_id"), normal(F.col("text")).alias("_text")).groupBy("_id").agg(F.min("_text").alias("_text"))
    own = evidence.select("evidence_id", F.lower(F.trim("chunk_id")).alias("_key"), normal(F.col("exact_quote")).alias("_quote"))
    both = own.join(texts, F.col("_key") == F.col("_id"), "left")
    at = F.expr("locate(_quote, _text)")
    verdict = first_reason([(F.length(F.coalesce("_quote", F.lit(""))) < least, "short"), (F.col("_id").isNull(), "no chunk"), (F.coalesce(at, F.lit(0)) == 0, "not found")])
    return both.select("evidence_id", F.coalesce(verdict, F.lit("verified")).alias("verdict"), F.when(verdict.isNull(), at).alias("at"))
