"""References to records that do not exist: missing, deleted or loaded only after the row that refers to them.

Skew-aware: references are counted per key first. Keys that hold more than 1/MAX_HEAVY of all references (so at most
MAX_HEAVY keys, whatever the input) are checked against a broadcast of their own target rows; all other keys are checked
by a shuffled join, in which no key can be hot. Both parts are united.

For counts, references are first added up per key and month. A key that is missing or deleted, or that was loaded after the
last or before the first reference of the month, settles its whole month at once; only of months during which it was loaded
are single references looked at again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_HEAVY = 1000
#: Below so many references a key is never treated as heavy. This and MAX_HEAVY choose the way a key takes, not its result.
MIN_HEAVY = 2000


def norm_key(c: Column) -> Column:
    """A key without blanks around it, in lower case; null if nothing is left."""
    bare = F.lower(F.regexp_replace(c, r"^[\s\u00a0]+|[\s\u00a0]+$", ""))
    return F.when(bare != "", bare)


def references(rows: DataFrame, table: str, id_col: str, key: Column, created: Column) -> DataFrame:
    """src_table, row_id, chunk_id, created_at of each reference; key may be an array, whose elements count singly.

    Null and blank keys, null and empty arrays give no reference. Repeated rows and elements give one.
    """
    kind = rows.select(key.alias("k")).schema["k"].dataType.typeName()
    picked = rows.select(F.lit(table).alias("src_table"), F.col(id_col).cast("long").alias("row_id"), key.alias("_key"), created.alias("created_at"))
    if kind == "array":
        picked = picked.withColumn("_key", F.explode("_key"))
    return picked.select("src_table", "row_id", norm_key(F.col("_key")).alias("chunk_id"), "created_at").where("chunk_id is not null").distinct()


def targets(chunks: DataFrame, meetings: DataFrame) -> DataFrame:
    """One row per key of chunks: whether it or its meeting is deleted, and when it was first loaded."""
    gone = meetings.where("deleted_at is not null and meeting_id is not null").select(F.col("meeting_id").alias("_gone")).distinct()
    own = chunks.select(norm_key(F.col("chunk_id")).alias("_id"), "meeting_id", F.col("deleted_at").isNotNull().alias("_del"), "loaded_at").where("_id is not null")
    marked = own.join(gone, own["meeting_id"] == gone["_gone"], "left")
    return marked.groupBy("_id").agg(F.max(F.col("_del") | F.col("_gone").isNotNull()).alias("_deleted"), F.min("loaded_at").alias("_loaded"))


def heavy_keys(refs: DataFrame, key: str = "chunk_id", max_heavy: int = MAX_HEAVY, min_heavy: int = MIN_HEAVY, weight: Column | None = None) -> DataFrame:
    """The keys with more than 1/max_heavy of all references, and at least min_heavy: fewer than max_heavy rows. A row counts for weight references."""
    weight = F.lit(1) if weight is None else weight
    total = refs.agg(F.sum(weight)).first()[0] or 0
    return refs.groupBy(key).agg(F.sum(weight).alias("_n")).where(F.col("_n") > max(min_heavy, total / max_heavy)).select(F.col(key).alias("_heavy"))


def matched(refs: DataFrame, target: DataFrame, heavy: DataFrame) -> DataFrame:
    """refs with their target's columns (null where there is none): those of heavy keys by broadcast, all others by a shuffled join; _hot tells them apart."""
    heavy = F.broadcast(heavy)
    is_heavy = refs["chunk_id"] == heavy["_heavy"]
    few = F.broadcast(target.join(heavy, target["_id"] == heavy["_heavy"], "left_semi"))
    by_broadcast = refs.join(heavy, is_heavy, "left_semi").join(few, F.col("chunk_id") == F.col("_id"), "left").withColumn("_hot", F.lit(True))
    by_shuffle = refs.join(heavy, is_heavy, "left_anti").join(target, F.col("chunk_id") == F.col("_id"), "left").withColumn("_hot", F.lit(False))
    return by_broadcast.unionByName(by_shuffle)


def check_references(refs: DataFrame, target: DataFrame, max_heavy: int = MAX_HEAVY, min_heavy: int = MIN_HEAVY) -> DataFrame:
    """refs plus kind: missing, deleted or late; references that are in order are left out.

    missing: no target has the key. deleted: the target or its meeting is. late: the target was loaded after created_at;
    a null created_at or load time is never late. Empty tables give an empty result, or only missing ones.
    """
    both = matched(refs, target, heavy_keys(refs, max_heavy=max_heavy, min_heavy=min_heavy))
    kind = F.when(F.col("_id").isNull(), "missing").when(F.col("_deleted"), "deleted").when(F.col("_loaded") > F.col("created_at"), "late")
    return both.withColumn("kind", kind).where("kind is not null").drop("_id", "_deleted", "_loaded", "_hot")


def _all_references(evidence: DataFrame, votes: DataFrame) -> DataFrame:
    return references(evidence, "extraction_evidence", "evidence_id", F.col("chunk_id"), F.col("created_at")).unionByName(
        references(votes, "votes", "vote_id", F.col("chunk_ids"), F.col("created_at"))
    )


def orphan_rows(evidence: DataFrame, votes: DataFrame, chunks: DataFrame, meetings: DataFrame) -> DataFrame:
    """src_table, row_id, chunk_id, kind, ref_month (null where created_at is) of each orphan reference, each once."""
    found = check_references(_all_references(evidence, votes), targets(chunks, meetings))
    return found.select("src_table", "row_id", "chunk_id", "kind", F.date_format("created_at", "yyyy-MM").alias("ref_month")).distinct()


def orphan_counts(evidence: DataFrame, votes: DataFrame, chunks: DataFrame, meetings: DataFrame, max_heavy: int = MAX_HEAVY, min_heavy: int = MIN_HEAVY) -> DataFrame:
    """Orphan references per table, month (null where created_at is) and kind: n_refs, and n_keys, the distinct keys they name.

    References are added up per table, key and month before they are checked, so a hot key moves one row for each month.
    """
    refs = _all_references(evidence, votes).withColumn("ref_month", F.date_format("created_at", "yyyy-MM"))
    pre = refs.groupBy("src_table", "chunk_id", "ref_month").agg(F.count("*").alias("n"), F.min("created_at").alias("lo"), F.max("created_at").alias("hi"))
    heavy = heavy_keys(pre, max_heavy=max_heavy, min_heavy=min_heavy, weight=F.col("n"))
    judged = matched(pre, targets(chunks, meetings), heavy)
    kind = F.when(F.col("_id").isNull(), "missing").when(F.col("_deleted"), "deleted").when(F.col("_loaded") > F.col("hi"), "late").when(F.col("_loaded") > F.col("lo"), "split")
    judged = judged.withColumn("kind", kind).where("kind is not null").select("src_table", "chunk_id", "ref_month", "n", "kind", "_loaded", "_hot")
    split = judged.where("kind = 'split'").select("src_table", "chunk_id", "ref_month", "_loaded", "_hot")
    keys = ["src_table", "chunk_id", "ref_month"]
    hot, rest = (split.where(F.col("_hot") == h).drop("_hot") for h in (True, False))
    again = refs.join(F.broadcast(hot), keys).unionByName(refs.join(rest, keys))  # hot: a heavy key has at most one such month in each table
    late = again.where(F.col("_loaded") > F.col("created_at")).groupBy(*keys).agg(F.count("*").alias("n")).withColumn("kind", F.lit("late"))
    found = judged.where("kind <> 'split'").select(*keys, "n", "kind").unionByName(late.select(*keys, "n", "kind"))
    return found.groupBy("src_table", "ref_month", "kind").agg(F.sum("n").alias("n_refs"), F.count("*").alias("n_keys"))
