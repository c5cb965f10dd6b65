"""Idempotent writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelworks.storage import keep


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Write df, replacing just the partitions that it has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def rebuild(df: DataFrame, path: str) -> None:
    """Write a derived table anew. df may be made from the table at path: it is kept aside before that is overwritten."""
    keep(df).write.mode("overwrite").parquet(path)


def export_csv(df: DataFrame, path: str, columns: list[str], order: list[Column], most: int = 5000) -> None:
    """One CSV file with a header: the first `most` rows of a report in a total order."""
    df.select(*columns).orderBy(*order).limit(most).coalesce(1).write.mode("overwrite").csv(path, header=True)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_transcripts(chunks: DataFrame, path: str) -> None:
    """Per school and video, under path/chunks the chunks as JSON lines, under path/text the whole text, replacing those of the same videos. chunks as from chunk(), with school_slug and video_id."""
    by = ["school_slug", "video_id"]
    chunks.repartition(*by).sortWithinPartitions(*by, "chunk_index").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).json(f"{path}/chunks")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "\n\n")
    chunks.groupBy(*by).agg(said.alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).text(f"{path}/text")


def point_id(c: Column) -> Column:
    """A name-based id (UUID version 5 in the DNS name space) of a text."""
    space = "6ba7b8109dad11d180b400c04fd430c8"
    digest = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(c, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def upsert(have: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new, and the rows of have whose key it lacks. A repeated key of new counts once; null keys are all kept."""
    fresh = new.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(new.where(F.col(key).isNull()))
    return fresh.unionByName(have.join(new.select(key).distinct(), key, "left_anti"))


def without(have: DataFrame, **payload: object) -> DataFrame:
    """have without the rows whose columns all have the given values."""
    hit = F.lit(bool(payload))
    for column, value in payload.items():
        hit = hit & F.col(column).eqNullSafe(F.lit(value))
    return have.where(~hit)


def split_rejected(df: DataFrame, reason: Column, path: str) -> DataFrame:
    """The rows of df without a reason against them; those with one are appended to the log at path, with it."""
    judged = keep(df.withColumn("_reason", reason))
    judged.where("_reason is not null").withColumnRenamed("_reason", "reason").write.mode("append").json(path)
    return judged.where("_reason is null").drop("_reason")
