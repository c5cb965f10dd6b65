"""Tables by name under a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The id of each table of the domain.
KEYS = {
    "meetings": "meeting_id",
    "chunks": "chunk_id",
    "cleaned_segments": "segment_id",
    "votes": "vote_id",
    "personnel_actions": "action_id",
    "financial_items": "item_id",
    "initiatives": "initiative_id",
    "extraction_evidence": "evidence_id",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rows(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The id and the named columns of a table; re-delivered rows, which repeat every column, count once. No other column is read or moved."""
    key = KEYS[name]
    return table(spark, folder, name).select(key, *[c for c in columns if c != key]).distinct()
