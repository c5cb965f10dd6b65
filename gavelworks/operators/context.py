"""Records as lines of text for a model's context, newest meeting first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelworks.functions.text import dollars

#: Fixed value: characters of a meeting's title that are shown.
TITLE = 60


def _text(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name)), F.lit(""))


def _lines(*parts: Column) -> Column:
    """Parts that aren't null, a line each, and an empty line."""
    return F.concat(F.concat_ws("\n", *parts), F.lit("\n"))


def _where() -> Column:
    date = F.coalesce(F.date_format("published_date", "yyyy-MM-dd"), F.lit("?"))
    return F.concat(F.lit("• "), date, F.lit(" ["), F.coalesce(F.substring(F.nullif("title", F.lit("")), 1, TITLE), F.lit("Untitled")), F.lit("]"))


def _tagged(name: str, default: str) -> Column:
    return F.concat(F.lit("  ["), F.upper(F.coalesce(F.nullif(name, F.lit("")), F.lit(default))), F.lit("]"))


def vote_text() -> Column:
    """Of columns published_date, title, motion_text, yes_count, no_count, passed and unanimous."""
    tally = F.when(F.col("yes_count").isNotNull(), F.concat(F.lit("  ("), F.col("yes_count").cast("string"), F.lit(" yes / "), F.coalesce(F.col("no_count").cast("string"), F.lit("?")), F.lit(" no)"))).otherwise("")
    result = F.when(F.col("unanimous"), "  [UNANIMOUS]").when(F.col("passed"), "  [PASSED]").when(~F.col("passed"), "  [FAILED]").otherwise("")
    said = F.concat(tally, result)
    return _lines(_where(), F.concat(F.lit("  Motion : "), _text("motion_text")), F.when(said != "", F.concat(F.lit("  Result :"), said)))


def money_text() -> Column:
    """Of columns published_date, title, action_type, amount, category, vendor and description."""
    amount = dollars(F.col("amount"))
    detail = F.array_join(F.filter(F.array(F.col("category"), F.col("vendor")), lambda x: x != ""), " / ")
    line = F.concat(_tagged("action_type", "approved"), F.when(amount != "", F.concat(F.lit("  "), F.coalesce(amount, F.lit("")))).otherwise(""), F.lit("  "), detail)
    return _lines(_where(), line, F.when(_text("description") != "", F.concat(F.lit("  "), _text("description"))))


def people_text() -> Column:
    """Of columns published_date, title, action_type, person_name, position_title, department, effective_date and is_interim."""
    detail = F.array_join(F.filter(F.array(F.col("position_title"), F.col("department")), lambda x: x != ""), ", ")
    since = F.when(_text("effective_date") != "", F.concat(F.lit("  (effective "), F.col("effective_date"), F.lit(")"))).otherwise("")
    line = F.concat(_tagged("action_type", ""), F.when(F.col("is_interim"), "  [INTERIM]").otherwise(""), F.lit(" "), F.coalesce(F.nullif("person_name", F.lit("")), F.lit("Unknown")), F.lit(" — "), detail, since)
    return _lines(_where(), line)


def initiative_text() -> Column:
    """Of columns published_date, title, action_type, initiative_name, category, description and measured_outcome."""
    line = F.concat(_tagged("action_type", "discussed"), F.lit(" "), F.coalesce(F.nullif("initiative_name", F.lit("")), F.lit("Unnamed initiative")), F.lit("  ("), F.coalesce("category", F.lit("")), F.lit(")"))
    more = [F.when(_text(c) != "", F.concat(F.lit(head), _text(c))) for c, head in (("description", "  "), ("measured_outcome", "  Outcome  : "))]
    return _lines(_where(), line, *more)


def blocks(rows: DataFrame, by: str, text: Column, heading: str, id_col: str, most: int = 100) -> DataFrame:
    """(by, block): the texts of the first `most` rows of each group, newest meeting first (those without a date at the top), under a heading. The limit is that of a context."""
    from pyspark.sql import Window as W

    nth = F.row_number().over(W.partitionBy(by).orderBy(F.desc_nulls_first("published_date"), id_col))
    kept = rows.withColumn("_nth", nth).where(F.col("_nth") <= most).select(by, "_nth", text.alias("_text"))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_nth", "_text"))), lambda x: x["_text"]), "\n")
    return kept.groupBy(by).agg(F.concat(F.lit(f"### {heading}\n\n"), told).alias("block"))
