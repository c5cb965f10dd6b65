"""Filters, star joins, summaries and ranked lists over the extracted tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gavelworks.functions.text import half_up


def where_given(df: DataFrame, **wanted: object) -> DataFrame:
    """df where each named column equals its value; None, "" and empty lists are no filter, False and 0 are.

    Suffixes: __min, __max (inclusive), __like (any case, with wildcards), __in, __not_in (a null is in neither), __not (a null is not kept), __known (not null).
    """

    def test(name: str, value: object) -> Column:
        column, _, kind = name.partition("__")
        c = F.col(column)
        tests = {
            "min": lambda: c >= F.lit(value),
            "max": lambda: c <= F.lit(value),
            "like": lambda: F.lower(c).like(f"%{str(value).lower()}%"),
            "in": lambda: c.isin(list(value)),
            "not_in": lambda: ~c.isin(list(value)),
            "not": lambda: c != F.lit(value),
            "known": lambda: c.isNotNull() if value else c.isNull(),
        }
        return tests[kind]() if kind else c == F.lit(value)

    return reduce(lambda d, kv: d.where(test(*kv)), ((k, v) for k, v in wanted.items() if v is not None and v not in ("", [])), df)


def envelope(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """(total, limit, offset, has_more) of a page of df."""
    total = df.agg(F.count("*").alias("total"))
    return total.select("total", F.lit(limit).alias("limit"), F.lit(offset).alias("offset"), (F.lit(offset + limit) < F.col("total")).alias("has_more"))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): the rows of each table."""
    return reduce(DataFrame.unionByName, (d.agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t, d in tables.items()))


def review_rates(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table and school: rows, rows to review, and the mean confidence to three places."""
    every = reduce(DataFrame.unionByName, (d.select(F.lit(t).alias("name"), "school_slug", "needs_review", "confidence") for t, d in tables.items()))
    mean = half_up(F.avg(F.col("confidence").cast("decimal(9,6)")).cast("double"), 3)
    return every.groupBy("name", "school_slug").agg(F.count("*").alias("n"), F.count_if("needs_review").alias("n_review"), mean.alias("mean_confidence"))


def mark_where(df: DataFrame, hits: DataFrame, key: str, column: str, value: str) -> DataFrame:
    """df with column set to value in the rows whose key is among hits; null keys aren't."""
    marked = df.join(hits.select(F.col(key).alias("_hit")).where("_hit is not null").distinct(), df[key] == F.col("_hit"), "left")
    return marked.withColumn(column, F.when(F.col("_hit").isNotNull(), value).otherwise(F.col(column))).drop("_hit")


def pick(df: DataFrame, fields: list[str]) -> DataFrame:
    """The named columns; an unknown one is an error that names what is missing."""
    missing = [f for f in fields if f not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    return df.select(*fields)


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows offset to offset + limit in the given (total) order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def rate(part: Column, whole: Column) -> Column:
    """part / whole to three places; null if whole is 0."""
    return half_up(F.try_divide(part, whole), 3)


def vote_totals(votes: DataFrame, by: list[str]) -> DataFrame:
    """Votes, passed, failed, unanimous and rates; an undecided vote (null) is in neither bucket and out of the pass rate."""
    passed, failed = F.count_if(F.col("passed")), F.count_if(~F.col("passed"))
    return votes.groupBy(*by).agg(
        F.count("*").alias("n_votes"),
        passed.alias("n_passed"),
        failed.alias("n_failed"),
        F.count_if("unanimous").alias("n_unanimous"),
        rate(passed, passed + failed).alias("pass_rate"),
        rate(F.count_if("unanimous"), F.count("*")).alias("unanimous_rate"),
    )


def group_totals(df: DataFrame, by: str, value: str) -> DataFrame:
    """Rows and sum of value per group; null is a group of its own."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.sum(value).cast("double").alias("total"))


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in a total order, numbered by rank."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def upsert_absent(have: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """have, and the rows of new whose key it lacks (a null key is always new)."""
    return have.unionByName(new.join(have.select(*key).distinct(), key, "left_anti"))
