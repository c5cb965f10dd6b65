"""Queries on references between tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gavelworks.operators import orphans
from gavelworks.tables import table


def _tables(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [table(spark, folder, t) for t in ("extraction_evidence", "votes", "chunks", "meetings")]


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_rows(*_tables(spark, folder))


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_counts(*_tables(spark, folder))


_FOUND = r"""
with bare as (
  select 'extraction_evidence' as src_table, evidence_id as row_id, chunk_id as k, created_at from extraction_evidence
  union all
  select 'votes', vote_id, unnest(chunk_ids), created_at from votes
), refs as (
  select distinct src_table, row_id, lower(regexp_replace(k, '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g')) as chunk_id, created_at from bare
), goal as (
  select lower(regexp_replace(c.chunk_id, '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g')) as id,
         bool_or(c.deleted_at is not null or c.meeting_id in (select meeting_id from meetings where deleted_at is not null and meeting_id is not null)) as gone,
         min(c.loaded_at) as loaded
  from chunks c group by 1
), judged as (
  select r.*, case when g.id is null then 'missing' when g.gone then 'deleted' when g.loaded > r.created_at then 'late' end as kind
  from refs r left join goal g on r.chunk_id = g.id where r.chunk_id <> ''
)
"""

QUERIES = {"p4_found": p4_found, "p4_counts": p4_counts}
SQL = {
    "p4_found": _FOUND + "select distinct src_table, row_id, chunk_id, kind, strftime(created_at, '%Y-%m') as ref_month from judged where kind is not null",
    "p4_counts": _FOUND
    + "select src_table, strftime(created_at, '%Y-%m') as ref_month, kind, count(*) as n_refs, count(distinct chunk_id) as n_keys from judged where kind is not null group by all",
}
