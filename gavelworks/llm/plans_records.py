"""Queries on typed records (problems 2, 3 and 5), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelworks.llm import canonical, names, near_duplicates
from gavelworks.tables import table

#: Share of words that two records have in common at least.
SAME_INITIATIVE = 0.7


def _typed_names(spark: SparkSession, folder: str) -> DataFrame:
    movers = table(spark, folder, "votes").select(F.col("school_slug").alias("scope"), F.col("moved_by").alias("name"))
    people = table(spark, folder, "personnel_actions").select(F.col("school_slug").alias("scope"), F.col("person_name").alias("name"))
    return movers.unionByName(people)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.variant_pairs(_typed_names(spark, folder)).withColumnRenamed("scope", "school_slug")


def p2_entities(spark: SparkSession, folder: str) -> DataFrame:
    return names.link_names(_typed_names(spark, folder)).withColumnRenamed("scope", "school_slug")


#: Tables with a typed category, and their ids.
CATEGORISED = {"initiatives": "initiative_id", "financial_items": "item_id"}


def _typed_categories(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(list, row_id, value) of rows whose category isn't already a code, and the reference list."""
    reference = table(spark, folder, "category_list").select(F.col("list_name").alias("list"), "code", "label", F.col("scope_note").alias("note"))
    parts = [
        table(spark, folder, t).select(F.lit(t).alias("list"), F.col(k).alias("row_id"), F.col("category").alias("value")) for t, k in CATEGORISED.items()
    ]
    rows = parts[0].unionByName(parts[1]).where("value is not null").distinct()
    codes = reference.select("list", F.col("code").alias("value")).distinct()
    return rows.join(codes, ["list", "value"], "left_anti"), reference


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    rows, reference = _typed_categories(spark, folder)
    mapped = canonical.map_values(rows, reference)
    return rows.join(mapped, ["list", "value"]).select(F.col("list").alias("src_table"), "row_id", "code").distinct()


def p3_values(spark: SparkSession, folder: str) -> DataFrame:
    """Every typed value with its rows, the code it was mapped to, the score and the way there; the unmatched ones are the report."""
    rows, reference = _typed_categories(spark, folder)
    counted = rows.groupBy("list", "value").agg(F.count("*").alias("n_rows"))
    return canonical.map_values(rows, reference).join(counted, ["list", "value"]).select(F.col("list").alias("src_table"), "value", "code", "score", "way", "n_rows")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    words = near_duplicates.word_set(F.col("initiative_name"), F.col("description"))
    pairs = near_duplicates.near_pairs(table(spark, folder, "initiatives"), "initiative_id", words, SAME_INITIATIVE)
    return pairs.select(F.col("id_a").alias("initiative_id_a"), F.col("id_b").alias("initiative_id_b"))


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    words = near_duplicates.word_set(F.col("initiative_name"), F.col("description"))
    return near_duplicates.near_classes(table(spark, folder, "initiatives"), "initiative_id", words, SAME_INITIATIVE)


QUERIES = {"p2_found": p2_found, "p2_entities": p2_entities, "p3_found": p3_found, "p3_values": p3_values, "p5_found": p5_found, "p5_classes": p5_classes}
SQL = {
    "p5_found": """
with w as (
  select distinct initiative_id as id, list_distinct(regexp_extract_all(lower(coalesce(initiative_name, '') || ' ' || coalesce(description, '')), '[a-z0-9]+')) as words
  from initiatives
)
select distinct a.id as initiative_id_a, b.id as initiative_id_b
from w a join w b on a.id < b.id and len(a.words) >= 0.7 * len(b.words) and len(b.words) >= 0.7 * len(a.words) and len(a.words) > 0
where len(list_intersect(a.words, b.words)) >= 0.7 * (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words)))
"""
}
