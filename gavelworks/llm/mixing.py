"""Documents drawn so that each source has its target share of all tokens, none more often than its source allows.

Each document's number of copies is a Poisson variable, inverted at a number that a hash of its id and the seed gives, and cut at
the source's cap. The rate of a source is set so that its draw reaches the target: the tokens of its documents are summed by
that number in BINS bins, so the draw at any rate is known beforehand. The total is FULLNESS of the largest one that all
sources can reach within their caps.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelworks.storage import cut

SEED, BINS, FULLNESS = 11, 4096, 0.9


def chances(rate: float, most: int) -> list[float]:
    """P(count <= k) of a Poisson variable for k below most: a number at or above c of them means at least c copies."""
    term, total, out = math.exp(-rate), 0.0, []
    for k in range(most):
        total += term
        out.append(min(1.0, total))
        term *= rate / (k + 1)
    return out


def _drawn(bins: list[tuple[int, int]], rate: float, most: int) -> float:
    steps = chances(rate, most)
    return sum(tokens * sum((b + 0.5) / BINS >= c for c in steps) for b, tokens in bins)


def _rate(bins: list[tuple[int, int]], goal: float, most: int) -> float:
    """The rate at which the documents of bins (bin, tokens) yield goal tokens."""
    low, high = 0.0, 1.0
    while _drawn(bins, high, most) < goal and high < 600:
        high *= 2
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (middle, high) if _drawn(bins, middle, most) < goal else (low, middle)
    return high


def mix(sized: DataFrame, targets: DataFrame, seed: int = SEED, fullness: float = FULLNESS) -> DataFrame:
    """(doc_id, source, copy, n_tokens, shuffle_key), in the order of shuffle_key, of sized (doc_id, source, n_tokens).

    targets (source, target_share, max_repeats): shares are scaled to sum to 1 over the sources that have tokens; of repeated
    sources the first counts. Sources without a target, or with a share or cap of zero, and documents without tokens aren't drawn.
    The same seed draws the same documents. One small row per source and bin comes to the driver.
    """
    named = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("most"))
    goals = {r["source"]: (r["share"], r["most"]) for r in named.collect()}
    number = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / F.lit(float(2**53))
    own = cut(sized.where("n_tokens > 0").join(F.broadcast(named.select("source")), "source").select("doc_id", "source", "n_tokens", number.alias("u")))
    bins: dict[str, list[tuple[int, int]]] = {}
    for source, b, tokens in own.groupBy("source", F.floor(F.col("u") * BINS).alias("b")).agg(F.sum("n_tokens")).collect():
        bins.setdefault(source, []).append((b, tokens))
    have = {s: sum(t for _, t in rows) for s, rows in bins.items()}
    whole = sum(goals[s][0] for s in have)
    total = fullness * min((have[s] * goals[s][1] / (goals[s][0] / whole) for s in have), default=0)
    steps = {s: chances(_rate(bins[s], total * goals[s][0] / whole, goals[s][1]), goals[s][1]) for s in have}
    rows = [(s, c) for s, c in steps.items()]
    table = own.sparkSession.createDataFrame(rows, "source string, steps array<double>")
    counted = own.join(F.broadcast(table), "source").withColumn("n", F.size(F.filter("steps", lambda c: F.col("u") >= c)))
    copies = counted.where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    keyed = copies.select("doc_id", "source", "copy", "n_tokens", F.xxhash64("doc_id", "copy", F.lit(seed + 1)).alias("shuffle_key"))
    return keyed.orderBy("shuffle_key", "doc_id", "copy")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: its target share, documents, copies, tokens, most copies of one document, and the share reached (0 if nothing was drawn)."""
    per = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("t"))
    got = per.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("k").alias("n_copies"), F.sum("t").alias("n_tokens"), F.max("k").alias("most_copies"))
    total = got.agg(F.sum("n_tokens").alias("total"))
    one = targets.select("source", "target_share", "max_repeats").distinct().join(got, "source", "left").join(F.broadcast(total), F.lit(True), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return one.select("source", "target_share", "max_repeats", zero("n_docs"), zero("n_copies"), zero("n_tokens"), zero("most_copies"), F.round(F.coalesce(F.col("n_tokens") / F.col("total"), F.lit(0.0)), 6).alias("share_reached"))
