"""Items of varying length into containers of fixed capacity, with little space left over.

Only the histogram of item lengths (at most as many bins as the capacity) comes to the driver. There the configuration linear
program is solved by multiplicative weights: each length has a price, its length times a weight that falls exponentially with the
share of its items that is covered; the pattern of greatest price that fits a container is found by a knapsack over the capacity
and used for a fraction of containers, until every length is covered to COVERED. The fractions, scaled to cover each length once,
are rounded systematically (the running sum of fractions is rounded, so that none of them is lost); where a rounded pattern finds
no item of a length left, the longest ones that fit take the place. What is left then is packed by further priced patterns.
Items are then numbered within their length, and their number says which container holds them; no item visits the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gavelworks.storage import cut

#: How far each length is covered by the program, how fast weights fall, the share of a length that one step covers at most, and the most units that the knapsack divides a capacity into.
COVERED, RATE, STEP, UNITS = 0.95, 9.0, 0.25, 512
#: By how much more a unit of the longest items is worth than one of the shortest, which fit anywhere later.
LONGER = 0.2
#: Items of one length are numbered in independent parts of about so many items, and in PARTS at least, so that a length that a third of all items have isn't one task.
PART_ITEMS, PARTS = 500_000, 64


def best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size to take so that they fit the capacity and are worth most (unbounded knapsack)."""
    value, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.lexsort((-worth, sizes))
    order = order[np.concatenate([[True], sizes[order][1:] != sizes[order][:-1]])]  # of equal sizes only the one worth most
    s, w = sizes[order], worth[order]
    fitting = np.searchsorted(s, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        value[c] = value[c - 1]
        k = fitting[c]
        if k:
            total = value[c - s[:k]] + w[:k]
            i = int(total.argmax())
            if total[i] > value[c]:
                value[c], pick[c] = total[i], i
    counts, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[order[pick[c]]] += 1
            c -= s[pick[c]]
    return counts


@dataclass
class Plan:
    """patterns: (how many containers, {length: items in each}); containers are numbered in this order. The first `programmed` of them are the linear program's."""

    capacity: int
    patterns: list[tuple[int, dict[int, int]]]
    programmed: int = 0

    def slots(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By length: the first item number of each pattern that holds it, the pattern's first container, and the items in each container."""
        out: dict[int, tuple[list, list, list]] = {}
        used: dict[int, int] = {}
        base = 0
        for times, counts in self.patterns:
            for length, k in counts.items():
                rows = out.setdefault(length, ([], [], []))
                for column, x in zip(rows, (used.get(length, 0), base, k), strict=True):
                    column.append(x)
                used[length] = used.get(length, 0) + times * k
            base += times
        return {n: tuple(np.array(c, np.int64) for c in rows) for n, rows in out.items()}


def _fill(counts: np.ndarray, lengths: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """counts, with the longest items that are left put into the space that it leaves."""
    room = capacity - int(counts @ lengths)
    while True:
        fit = np.flatnonzero((lengths <= room) & (left > counts))
        if not len(fit):
            return counts
        i = fit[lengths[fit].argmax()]
        k = min(room // lengths[i], left[i] - counts[i])
        counts[i] += k
        room -= int(k * lengths[i])


def program(lengths: np.ndarray, demand: np.ndarray, sizes: np.ndarray, room: int, fit) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, how many containers of each, fractional) that cover demand: the configuration program by multiplicative weights. fit cuts a pattern to what a container holds.

    Each step covers the scarcest length of its pattern by STEP at most, so a length's price falls by a bounded factor; patterns that come again are added up.
    """
    covered, found = np.zeros(len(lengths)), {}
    base = math.log(len(lengths) + 2)
    while covered.min() < COVERED:
        weights = np.exp(-RATE * base * np.minimum(covered, 4.0) / 4) * (covered < 1.0 + STEP)
        counts = fit(best_pattern(sizes, weights * lengths * (1 + LONGER * lengths / lengths.max()), room))
        if not counts.any():
            break
        some = counts > 0
        most = float((demand[some] / counts[some]).min())
        times = max(STEP * most, min(1.0, most))  # whole containers of rare lengths
        key = counts.tobytes()
        found[key] = found.get(key, 0.0) + times
        covered += times * counts / demand
    patterns = np.array([np.frombuffer(k, np.int64) for k in found]).reshape(-1, len(lengths))
    fractions = np.array(list(found.values()))
    need = float(demand @ lengths)
    have = float(fractions @ (patterns @ lengths)) if len(fractions) else 1.0
    return patterns, fractions * min(1.0, need / have)


def plan(histogram: dict[int, int], capacity: int, with_program: bool = True) -> Plan:
    """A plan for histogram (items by length, 1 to capacity). Items of the full capacity have containers of their own."""
    patterns = [(histogram[capacity], {capacity: 1})] if histogram.get(capacity) else []
    lengths = np.array(sorted(n for n, k in histogram.items() if k and 0 < n < capacity), np.int64)
    if not len(lengths):
        return Plan(capacity, patterns, len(patterns))
    left = np.array([histogram[n] for n in lengths], np.int64)
    unit = max(1, -(-capacity // UNITS))
    # rounded to units, a pattern may be too long by less than a unit for each item; it is then cut to what fits
    sizes, room = np.maximum(1, np.round(lengths / unit).astype(np.int64)), capacity // unit

    def trimmed(counts: np.ndarray, have: np.ndarray) -> np.ndarray:
        counts = np.minimum(counts, have)
        while counts @ lengths > capacity:
            over = counts @ lengths - capacity
            some = np.flatnonzero(counts)
            enough = some[lengths[some] >= over]
            counts[enough[0] if len(enough) else some[-1]] -= 1
        return _fill(counts, lengths, have, capacity)

    def use(times: int, counts: np.ndarray) -> None:
        nonlocal left
        patterns.append((times, {int(n): int(k) for n, k in zip(lengths, counts, strict=True) if k}))
        left = left - times * counts

    demand = left.astype(float)
    if with_program:
        start = left.copy()
        found, fractions = program(lengths, demand, sizes, room, lambda c: trimmed(c, start))
        order = np.argsort(-(found @ lengths) / capacity, kind="stable")  # the fullest first, while every length is there
        sums = np.floor(np.cumsum(fractions[order]) + 0.5).astype(np.int64)
        for i, times in zip(order, np.diff(sums, prepend=0).tolist(), strict=True):
            while times > 0:
                some = found[i] > 0
                whole = min(times, int((left[some] // found[i][some]).min()))
                if whole:
                    use(whole, found[i])
                else:
                    counts = trimmed(found[i].copy(), left)
                    # a container that would stay emptier than the others is left to the further patterns
                    if counts @ lengths < 0.98 * capacity:
                        break
                    whole = 1
                    use(whole, counts)
                times -= whole
    programmed = len(patterns)
    while (left > 0).any():
        alive = np.flatnonzero(left > 0)
        share = left[alive] / demand[alive]
        few = np.zeros(len(lengths), np.int64)
        few[alive] = best_pattern(sizes[alive], lengths[alive] * (1 + 0.05 * share + 0.02 * lengths[alive] / capacity), room)
        counts = trimmed(few, left)
        if not counts.any():
            counts[alive[-1]] = 1
        use(int((left[counts > 0] // counts[counts > 0]).min()), counts)
    return Plan(capacity, patterns, programmed)


def pieces(sized: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, capacity, doc_id, piece, start_token, length) of sized (doc_id, tokenizer, n_tokens) under specs (spec_id, tokenizer, capacity).

    A document is one piece unless it exceeds the capacity; then it is cut into full pieces and a remainder. Empty documents have no piece.
    """
    own = sized.where("n_tokens > 0").join(F.broadcast(specs.where("capacity > 0").distinct()), "tokenizer")
    many = own.withColumn("piece", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n_tokens") / F.col("capacity")) - 1).cast("int"))))
    start = F.col("piece").cast("long") * F.col("capacity")
    return many.select("spec_id", "capacity", "doc_id", "piece", start.alias("start_token"), F.least(F.col("capacity").cast("long"), F.col("n_tokens") - start).alias("length"))


def pack(items: DataFrame) -> DataFrame:
    """(spec_id, container_id, doc_id, piece, start_token, n_tokens): the container of each of items, as from pieces().

    Container ids count from 0 within a spec. Equal lengths are told apart by document and piece; the sum of a container never exceeds its capacity.
    """
    parts = max(PARTS, items.count() // PART_ITEMS)
    items = items.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    bins = cut(items.groupBy("spec_id", "capacity", "length", "part").agg(F.count("*").alias("n")))
    histograms: dict[tuple[int, int], dict[int, int]] = {}
    for spec, capacity, length, n in bins.groupBy("spec_id", "capacity", "length").agg(F.sum("n")).collect():
        histograms.setdefault((spec, capacity), {})[length] = n
    slots = {spec: plan(h, capacity).slots() for (spec, capacity), h in histograms.items()}
    before = W.partitionBy("spec_id", "length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = bins.select("spec_id", "length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(W.partitionBy("spec_id", "length", "part").orderBy("doc_id", "piece"))
    numbered = items.join(offsets, ["spec_id", "length", "part"]).withColumn("nth", inside - 1 + F.col("offset"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = np.zeros(len(f), np.int64)
            for (spec, length), rows in f.groupby(["spec_id", "length"]).indices.items():
                first, base, k = slots[spec][length]
                nth = f["nth"].to_numpy()[rows]
                at = np.searchsorted(first, nth, "right") - 1
                out[rows] = base[at] + (nth - first[at]) // k[at]
            yield pd.DataFrame({"spec_id": f["spec_id"], "container_id": out, "doc_id": f["doc_id"], "piece": f["piece"], "start_token": f["start_token"], "n_tokens": f["length"]})

    return numbered.select("spec_id", "doc_id", "piece", "start_token", "length", "nth").mapInPandas(
        place, "spec_id int, container_id long, doc_id long, piece int, start_token long, n_tokens long"
    )


def report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per spec: containers used, tokens, the least number of containers that could hold them, and the share of space filled."""
    used = packed.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"))
    total = used.groupBy("spec_id").agg(F.count("*").alias("n_containers"), F.sum("t").alias("n_tokens"), F.sum("k").alias("n_pieces"), F.max("t").alias("fullest"))
    one = total.join(specs.select("spec_id", "capacity").distinct(), "spec_id")
    return one.select(
        "spec_id", "capacity", "n_pieces", "n_tokens", "n_containers", "fullest", F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least_containers"), F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 6).alias("filled")
    )
