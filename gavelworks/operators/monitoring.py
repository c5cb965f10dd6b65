"""Audits of logged questions, of evaluation runs and of model use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelworks.functions.text import half_up, marker_count


def log_audit(log: DataFrame) -> DataFrame:
    """Per route of log (route, answer): answers, those without a citation mark, and their share in whole per cent."""
    unmarked = F.count_if(F.coalesce(marker_count(F.col("answer")), F.lit(0)) == 0)
    return log.groupBy("route").agg(F.count("*").alias("n"), unmarked.alias("n_unmarked"), F.floor(100 * unmarked / F.count("*")).cast("int").alias("per_cent"))


def evaluated(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Each case (id, kind, routes, must_contain, must_not_contain, chunk_ids) with its answer (id, route, answer, found): (id, kind, passed, recall).

    Passed: the route is one of the expected, the answer has one of the wanted texts (if any is wanted) and none of the unwanted, in any case.
    recall: the share of expected chunks found; null where none are expected. A case without an answer fails.
    """
    both = cases.join(answers, "id", "left").withColumn("a", F.lower(F.coalesce("answer", F.lit(""))))
    has = lambda c, default: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.exists(c, lambda x: F.contains(F.col("a"), F.lower(x)))).otherwise(default)
    passed = F.coalesce(F.array_contains("routes", F.col("route")), F.lit(False)) & has("must_contain", True) & ~has("must_not_contain", False)
    wanted = F.array_distinct("chunk_ids")
    share = F.try_divide(F.size(F.array_intersect(wanted, F.coalesce("found", F.array().cast("array<string>")))), F.size(wanted))
    return both.select("id", "kind", passed.alias("passed"), F.when(F.size(wanted) > 0, share).alias("recall"))


def evaluation(results: DataFrame) -> DataFrame:
    """Per kind of evaluated cases: cases, passed, and of those with expected chunks the mean recall, and how many found all or none."""
    return results.groupBy("kind").agg(
        F.count("*").alias("n"), F.count_if("passed").alias("n_passed"), half_up(F.avg("recall"), 4).alias("recall"), F.count_if(F.col("recall") == 1).alias("n_all"), F.count_if(F.col("recall") == 0).alias("n_none")
    )


def usage(calls: DataFrame) -> DataFrame:
    """Per model of calls (model, tokens_in, tokens_out, seconds, finish, status): calls, tokens, seconds, answers cut off at their limit, and failures; null counts are 0."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return calls.groupBy("model").agg(
        F.count("*").alias("calls"), total("tokens_in"), total("tokens_out"), total("seconds"), F.count_if(F.lower("finish").isin("length", "max_tokens")).alias("cut_off"), F.count_if(F.coalesce("status", F.lit("ok")) != "ok").alias("failed")
    )
