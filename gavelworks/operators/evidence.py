"""Quotations held against the chunks they cite, with places in the original text.

Both sides are brought to a normal form: typographic marks and compatibility characters as plain ones, lower case, single blanks.
For each character of it the place in the original is kept, so a quotation found in the normal form is returned as it stands in
the chunk. Plain ASCII texts of single blanks need no map; all others go through one Arrow batch function.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gavelworks.operators.corpus import CARRIED

#: Typographic marks and what they stand for, the least length of a quotation, and the length of a preview.
MARKS = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "–": "-", "—": "-", "‒": "-", "―": "-", " ": " ", "…": "..."}
LEAST_QUOTE, PREVIEW = 12, 500


def normal_form(text: str | None) -> tuple[str, np.ndarray]:
    """The normal form of a text, and for each of its characters the place in the text that it comes from."""
    folded = [(MARKS.get(c) or unicodedata.normalize("NFKC", c)).lower() for c in text or ""]
    chars = np.array(list("".join(folded)), dtype="<U1")
    places = np.repeat(np.arange(len(folded)), [len(x) for x in folded])
    blank = np.char.isspace(chars) if len(chars) else np.zeros(0, bool)
    keep = ~(blank & np.concatenate([[True], blank[:-1]])) if len(chars) else blank
    if keep.any() and blank[np.flatnonzero(keep)[-1]]:
        keep[np.flatnonzero(keep)[-1]] = False
    return "".join(np.where(blank, " ", chars)[keep].tolist()), places[keep]


def find_quote(quote: str | None, text: str | None) -> tuple[int, int] | None:
    """Start and end of a quotation in the original text; None if it is too short or doesn't stand there."""
    wanted = normal_form(quote)[0]
    if len(wanted) < LEAST_QUOTE or not text:
        return None
    held, places = normal_form(text)
    at = held.find(wanted)
    if at < 0:
        return None
    return int(places[at]), int(places[at + len(wanted) - 1]) + 1


def carried_length(text: Column) -> Column:
    """How many characters at the start of a chunk were carried over from the one before: up to the first full stop after the mark."""
    stop = F.locate(".", text, len(CARRIED) + 1)
    return F.when(text.startswith(CARRIED), F.when(stop > 0, stop).otherwise(F.length(text))).otherwise(0)


def preview(text: Column, start: Column, end: Column, width: int = PREVIEW) -> Column:
    """(text, start, end): an excerpt of `width` characters around the quotation from start to end, and where it stands in it."""
    n = end - start
    left = F.greatest(F.lit(0), start - F.floor((width - n) / 2).cast("int"))
    right = F.least(F.length(text), left + width)
    first = F.greatest(F.lit(0), right - width)
    lead = F.when(first > 0, 2).otherwise(0)
    cut = F.concat(F.when(first > 0, "… ").otherwise(""), F.substring(text, first + 1, right - first))
    alone = F.struct(F.substring(text, start + 1, n).alias("text"), F.lit(0).alias("start"), n.cast("int").alias("end"))
    around = F.struct(cut.alias("text"), (start - first + lead).cast("int").alias("start"), (end - first + lead).cast("int").alias("end"))
    return F.when(n >= width, alone).otherwise(around)


def shown(excerpt: Column, best_text: Column) -> Column:
    """What is shown for an item: the excerpt around its first verified quotation, else the start of the best chunk of its window."""
    return F.coalesce(excerpt, F.substring(best_text, 1, PREVIEW), F.lit(""))


def _located(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        spans = [find_quote(q, t) for q, t in zip(f["quote"], f["text"], strict=True)]
        yield f[["ref", "quote"]].assign(start=[s[0] if s else None for s in spans], end=[s[1] if s else None for s in spans], norm=[normal_form(q)[0] for q in f["quote"]]).astype({"start": "Int32", "end": "Int32"})


def located(refs: DataFrame) -> DataFrame:
    """(ref, norm, start, end) of refs (ref, quote, text): the quotation's normal form and its place in text, null if it doesn't stand there."""
    own = refs.select("ref", F.coalesce("quote", F.lit("")).alias("quote"), F.coalesce("text", F.lit("")).alias("text"))
    # on printable ASCII with single blanks the normal form is the lower case, and every place is its own
    even = r"^(?:[!-~]+(?: [!-~]+)*)?$"
    plain = F.col("quote").rlike(even) & F.col("text").rlike(even)
    at = F.when(F.length("quote") >= LEAST_QUOTE, F.expr("locate(lower(quote), lower(text))")).otherwise(0)
    fast = own.where(plain).withColumn("at", at).select("ref", F.lower("quote").alias("norm"), F.when(F.col("at") > 0, F.col("at") - 1).alias("start"), F.when(F.col("at") > 0, F.col("at") - 1 + F.length("quote")).alias("end"))
    slow = own.where(~plain).mapInPandas(_located, "ref long, quote string, start int, end int, norm string").select("ref", "norm", "start", "end")
    return fast.unionByName(slow)


def validated(refs: DataFrame, chunks: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Verified quotations, and per item the worst reason against it.

    refs (ref, item, chunk_id, exact_quote, supports), chunks (chunk_id, text), one row for each id. Verified: (ref, item, chunk_id, quote, start, end,
    in_overlap, chunk_sha, supports): the quotation stands in its chunk; equal ones of an item count once, best where the text isn't carried over, then the smallest ref; their supports,
    limited to fields, are united and sorted. Reasons: (item, n_verified, reason), reason "chunk", "quote", "none" or null, the earliest of these that occurs.
    """
    own = refs.select("ref", "item", F.trim("chunk_id").alias("chunk_id"), F.trim("exact_quote").alias("quote"), F.coalesce("supports", F.array().cast("array<string>")).alias("supports"))
    joined = own.join(chunks.select(F.col("chunk_id").alias("_id"), "text"), F.col("chunk_id") == F.col("_id"), "left")
    found = located(joined.where("_id is not null").select("ref", "quote", "text"))
    placed = joined.join(found, "ref", "left")
    good = placed.where("start is not null").withColumn("in_overlap", F.col("start") < carried_length(F.col("text")))
    same = W.partitionBy("item", "norm")
    known = F.filter("supports", lambda x: x.isin(*fields))
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_list(known).over(same))))
    nth = F.row_number().over(same.orderBy("in_overlap", "ref"))
    best = good.withColumn("supports", every).withColumn("nth", nth).where("nth = 1")
    verified = best.select(
        "ref", "item", "chunk_id", F.expr("substring(text, start + 1, end - start)").alias("quote"), "start", "end", "in_overlap", F.substring(F.sha2(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))), 256), 1, 16).alias("chunk_sha"), "supports"
    )
    reason = F.when(F.col("_id").isNull(), 1).when(F.col("start").isNull(), 2)
    judged = placed.groupBy("item").agg(F.min(reason).alias("worst"), F.count_distinct(F.when(F.col("start").isNotNull(), F.col("norm"))).alias("n_verified"))
    name = F.when(F.col("worst") == 1, "chunk").when(F.col("worst") == 2, "quote").when(F.col("n_verified") == 0, "none")
    return verified, judged.select("item", "n_verified", name.alias("reason"))
