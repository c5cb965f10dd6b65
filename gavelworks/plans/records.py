"""Queries on votes, financial items, personnel actions, initiatives and meetings, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelworks.functions import text as T
from gavelworks.operators import context as K
from gavelworks.operators import extraction as X
from gavelworks.operators import relational as R
from gavelworks.operators import signals as S
from gavelworks.tables import KEYS, rows, table


def _money(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return rows(spark, folder, "financial_items", *columns, "needs_review").where("not needs_review")


def _star(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Facts with the title, date and school of their meeting."""
    meetings = rows(spark, folder, "meetings", "title", "published_date", "school_id").withColumnRenamed("school_id", "meeting_school")
    schools = table(spark, folder, "meetings").select(F.col("school_id").alias("meeting_school"), F.col("school_slug").alias("school_name")).distinct()
    return rows(spark, folder, name, "meeting_id", *columns).join(meetings, "meeting_id").join(schools, "meeting_school")


def _dated(facts: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    return facts.join(rows(spark, folder, "meetings", "published_date"), "meeting_id")


def _recurring(spark: SparkSession, folder: str) -> DataFrame:
    proven = table(spark, folder, "extraction_evidence").where("initiative_id is not null").select("initiative_id").distinct()
    own = rows(spark, folder, "initiatives", "category", "measured_outcome", "meeting_id", "school_slug", "confidence", "needs_review").where("not needs_review and confidence >= 0.5")
    return S.recurring(_dated(own.join(proven, "initiative_id", "left_semi"), spark, folder), F.lower(F.trim("category")), F.col("measured_outcome"), "initiative_id")


def _budget(spark: SparkSession, folder: str) -> DataFrame:
    own = rows(spark, folder, "financial_items", "category", "action_type", "meeting_id", "school_slug", "confidence", "needs_review")
    return S.trend(_dated(own.where("not needs_review and confidence >= 0.5 and category is not null and action_type = 'approved'"), spark, folder), F.lower(F.trim("category")))


def _personnel(spark: SparkSession, folder: str) -> DataFrame:
    own = rows(spark, folder, "personnel_actions", "action_type", "meeting_id", "school_slug", "confidence", "needs_review")
    return S.trend(_dated(own.where("not needs_review and confidence >= 0.5"), spark, folder), F.coalesce("action_type", F.lit("other")))


def _signals(spark: SparkSession, folder: str) -> DataFrame:
    """Every signal: (signal_type, category, school_count, meeting_count, confidence, needs_review, first_date, last_date, schools, n_rows, n_measured, n_measured_schools)."""
    columns = [F.col("signal").alias("category"), F.col("n_schools").alias("school_count"), F.col("n_meetings").alias("meeting_count"), F.col("signal_confidence").alias("confidence"), "needs_review", "first_date", "last_date", "schools", "n_rows"]
    none = [F.lit(0).cast("long").alias("n_measured"), F.lit(0).cast("long").alias("n_measured_schools")]
    parts = [_recurring(spark, folder).select(F.lit("recurring_initiative").alias("signal_type"), *columns, "n_measured", "n_measured_schools")]
    parts += [f(spark, folder).select(F.lit(t).alias("signal_type"), *columns, *none) for f, t in ((_budget, "budget_trend"), (_personnel, "personnel_trend"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _initiatives(spark: SparkSession, folder: str) -> DataFrame:
    return rows(spark, folder, "initiatives", "school_slug", "category", "initiative_name", "confidence", "meeting_id")


def _matrix(spark: SparkSession, folder: str) -> DataFrame:
    """The three first of each school and theme, after alike names are merged."""
    merged = S.merge_alike(S.matrix_candidates(_initiatives(spark, folder)))
    return R.top_n(merged, ["school_slug", "theme"], [F.desc("confidence"), F.desc("n_meetings"), F.asc("slug")], 3).select("school_slug", "theme", "slug", "label", "confidence", "n_meetings", "rank")


def _grid(spark: SparkSession, folder: str) -> DataFrame:
    """Each theme as a row and each school as a column: the number of entries of the matrix, 0 for empty cells; schools with more entries come first."""
    cells = _matrix(spark, folder).groupBy("theme", "school_slug").agg(F.count("*").alias("n"))
    order = [r[0] for r in cells.groupBy("school_slug").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "school_slug").collect()]  # a column each
    themes = spark.createDataFrame([(t,) for t in S.THEMES], "theme string")
    return themes.join(cells.groupBy("theme").pivot("school_slug", order).agg(F.sum("n")), "theme", "left").na.fill(0)


def _ordered():
    from pyspark.sql import Window

    return Window.partitionBy("meeting_id").orderBy(F.asc_nulls_last("chunk_index"), F.asc_nulls_last("start_time"), "chunk_id")


def _overview(spark: SparkSession, folder: str) -> DataFrame:
    """Votes, items, actions, initiatives and chunks of each meeting."""
    out = rows(spark, folder, "meetings", "school_slug")
    for name, alias in (("votes", "n_votes"), ("financial_items", "n_items"), ("personnel_actions", "n_actions"), ("initiatives", "n_initiatives"), ("chunks", "n_chunks")):
        out = out.join(rows(spark, folder, name, "meeting_id").groupBy("meeting_id").agg(F.count("*").alias(alias)), "meeting_id", "left")
    return out.na.fill(0)


def _evidence_counts(spark: SparkSession, folder: str) -> DataFrame:
    n = rows(spark, folder, "extraction_evidence", "initiative_id").where("initiative_id is not null").groupBy("initiative_id").agg(F.count("*").alias("n_evidence"))
    return rows(spark, folder, "initiatives").join(n, "initiative_id", "left").na.fill(0)


def _overview_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Per meeting its reviewed votes, items and actions and its five best chunks, as lists of ids in order."""
    out = rows(spark, folder, "meetings", "title")
    for name in ("votes", "financial_items", "personnel_actions"):
        ids = rows(spark, folder, name, "meeting_id", "needs_review").where("not needs_review").groupBy("meeting_id").agg(F.array_join(F.sort_array(F.collect_list(KEYS[name])), ",").alias(name))
        out = out.join(ids, "meeting_id", "left")
    best = QUERIES["key_chunks_top5"](spark, folder).groupBy("meeting_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]), ",").alias("key_chunks"))
    return out.join(best, "meeting_id", "left").select("meeting_id", "title", *[F.coalesce(c, F.lit("")).alias(c) for c in ("votes", "financial_items", "personnel_actions", "key_chunks")])


def _supporting(spark: SparkSession, folder: str) -> DataFrame:
    """The initiatives behind each recurring signal."""
    ids = _recurring(spark, folder).select("signal", F.explode(F.split("supporting_ids", ",").cast("array<long>")).alias("initiative_id"))
    return ids.join(rows(spark, folder, "initiatives", "school_slug", "meeting_id", "measured_outcome"), "initiative_id")


def _pattern_evidence(spark: SparkSession, folder: str, most: int = 20) -> DataFrame:
    """The quotations behind each recurring signal, newest meeting first: the first `most` of each, as its report shows them."""
    quotes = rows(spark, folder, "extraction_evidence", "initiative_id", "meeting_id", "exact_quote").where("initiative_id is not null")
    own = _supporting(spark, folder).drop("meeting_id").join(quotes, "initiative_id").join(rows(spark, folder, "meetings", "title", "published_date"), "meeting_id")
    return R.top_n(own, ["signal"], [F.desc_nulls_last("published_date"), F.asc("evidence_id")], most).select("signal", "evidence_id", "initiative_id", "title", "exact_quote", "rank")


def _insight_detail(spark: SparkSession, folder: str) -> DataFrame:
    """Per insight (school, theme and slug): its most confident initiative, the meetings of its school and theme, its quotations, and its text."""
    own = rows(spark, folder, "initiatives", "school_slug", "category", "initiative_name", "description", "measured_outcome", "action_type", "confidence", "meeting_id", "needs_review").where("not needs_review and initiative_name is not null")
    own = own.withColumn("theme", S.theme(F.col("category"))).withColumn("insight_id", S.insight_id(F.col("school_slug"), F.col("theme"), F.col("initiative_name")))
    first = R.top_n(own, ["insight_id"], [F.desc("confidence"), F.asc("initiative_id")], 1)
    meetings = own.groupBy("school_slug", "theme").agg(F.count_distinct("meeting_id").alias("n_meetings"))
    quotes = _evidence_counts(spark, folder)
    summary = F.coalesce(F.concat(F.lit("Measured outcome: "), "measured_outcome"), F.col("description"), F.col("initiative_name"))
    return first.join(meetings, ["school_slug", "theme"]).join(quotes, "initiative_id").select(
        "insight_id", "initiative_id", F.col("initiative_name").alias("label"), F.coalesce("action_type", F.lit("discussed")).alias("action_type"), "n_meetings", F.col("n_evidence").alias("n_quotes"), summary.alias("summary"), T.half_up(F.col("confidence"), 3).alias("confidence")
    )


def _insight_related(spark: SparkSession, folder: str, most: int = 10) -> DataFrame:
    """The reviewed votes of the meetings of each school and theme: the first `most` by id, as its report shows them."""
    own = rows(spark, folder, "initiatives", "school_slug", "category", "meeting_id", "needs_review").where("not needs_review").select("school_slug", S.theme(F.col("category")).alias("theme"), "meeting_id").distinct()
    votes = rows(spark, folder, "votes", "meeting_id", "needs_review").where("not needs_review").select("vote_id", "meeting_id")
    return R.top_n(own.join(votes, "meeting_id"), ["school_slug", "theme"], [F.asc("vote_id")], most).select("school_slug", "theme", "vote_id", "rank")


QUERIES = {
    "votes_by_school": lambda s, d: R.vote_totals(rows(s, d, "votes", "school_slug", "passed", "unanimous"), ["school_slug"]),
    "votes_totals": lambda s, d: R.vote_totals(rows(s, d, "votes", "passed", "unanimous"), []),
    "votes_top_movers": lambda s, d: R.top_n(
        rows(s, d, "votes", "school_slug", "moved_by").where("moved_by is not null").groupBy("school_slug", "moved_by").agg(F.count("*").alias("n")), ["school_slug"], [F.desc("n"), F.asc("moved_by")], 5
    ).select("school_slug", "moved_by", "n", "rank"),
    "votes_list_page": lambda s, d: R.page(
        R.where_given(_star(s, d, "votes", "school_slug", "passed", "moved_by"), school_slug="harlow_creek", passed=True, published_date__min=None), [F.desc_nulls_last("published_date"), F.asc("vote_id")], 50, 10
    ).select("vote_id", "title", "moved_by", "published_date"),
    "votes_between_dates": lambda s, d: R.where_given(_star(s, d, "votes", "passed", "motion_text"), published_date__min="2023-01-01", published_date__max="2024-12-31", passed=False).select("vote_id", "title", "school_name", "motion_text", "published_date"),
    "votes_envelope": lambda s, d: R.envelope(R.where_given(rows(s, d, "votes", "passed"), passed=True), limit=50, offset=100),
    "fin_summary_by_action": lambda s, d: R.group_totals(_money(s, d, "action_type", "amount"), "action_type", "amount"),
    "fin_top_vendors": lambda s, d: R.group_totals(_money(s, d, "vendor", "amount").where("vendor is not null"), "vendor", "amount").orderBy(F.desc_nulls_last("total"), "vendor").limit(10),
    "fin_largest_item": lambda s, d: R.top_n(_money(s, d, "school_slug", "amount").where("amount is not null"), ["school_slug"], [F.desc("amount"), F.asc("item_id")], 1).select("school_slug", "item_id", F.col("amount").cast("double").alias("amount")),
    "fin_list_page": lambda s, d: R.page(
        R.where_given(_star(s, d, "financial_items", "category", "amount"), category__like="contract", amount__min=1000), [F.desc_nulls_last("published_date"), F.asc("item_id")], 100
    ).select("item_id", "title", F.col("amount").cast("double").alias("amount"), "category"),
    "fin_by_year_cube": lambda s, d: _money(s, d, "fiscal_year", "action_type", "amount").cube("fiscal_year", "action_type").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"), F.grouping_id().alias("level")),
    "fin_context_rows": lambda s, d: R.page(
        _star(s, d, "financial_items", "action_type", "amount", "needs_review").where("not needs_review and action_type <> 'discussed'"), [F.desc_nulls_first("published_date"), F.asc("item_id")], 100
    ).select("item_id", "title", "action_type", T.dollars(F.col("amount")).alias("amount"), "published_date"),
    "meetings_list_page": lambda s, d: R.page(rows(s, d, "meetings", "title", "published_date", "is_active", "deleted_at").where("is_active and deleted_at is null"), [F.desc_nulls_last("published_date"), F.asc("meeting_id")], 20, 20).select("meeting_id", "title", "published_date"),
    "meetings_in_states": lambda s, d: R.where_given(rows(s, d, "meetings", "status", "school_slug", "published_date"), status__not_in=["failed", "rejected", "discovered"], published_date__known=True).select("meeting_id", "status", "school_slug"),
    "meetings_of_types": lambda s, d: R.where_given(rows(s, d, "meetings", "meeting_type", "title"), meeting_type__in=["special", "workshop"]).select("meeting_id", "meeting_type", T.meeting_kind(F.col("title")).alias("kind"), T.any_word(F.col("title"), ["board", "trustee", "regular meeting"]).alias("named_so")),
    "meeting_latest_per_school": lambda s, d: R.top_n(rows(s, d, "meetings", "school_slug", "published_date").where("published_date is not null"), ["school_slug"], [F.desc("published_date"), F.desc("meeting_id")], 1).select("school_slug", "meeting_id", "published_date"),
    "meeting_status_audit": lambda s, d: rows(s, d, "meetings", "school_slug", "status", "source_type").groupBy("school_slug", "status", F.coalesce("source_type", F.lit("none")).alias("source_type")).agg(F.count("*").alias("n")),
    "table_counts": lambda s, d: R.counts({t: table(s, d, t).select(k).where(F.col(k).isNotNull()).distinct() for t, k in KEYS.items()}),
    "meeting_overview_counts": lambda s, d: _overview(s, d),
    "meeting_overview": lambda s, d: _overview_sets(s, d),
    "transcript_ordered": lambda s, d: rows(s, d, "chunks", "meeting_id", "chunk_index", "start_time", "deleted_at").where("deleted_at is null").withColumn("nth", F.row_number().over(_ordered())).select("chunk_id", "meeting_id", "chunk_index", "nth"),
    "key_chunks_top5": lambda s, d: R.top_n(rows(s, d, "chunks", "meeting_id", "chunk_index", "quality_score", "deleted_at").where("deleted_at is null"), ["meeting_id"], [F.desc_nulls_last("quality_score"), F.asc("chunk_index"), F.asc("chunk_id")], 5).select("meeting_id", "chunk_id", "rank"),
    "semi_with_evidence": lambda s, d: rows(s, d, "votes", "school_slug").join(table(s, d, "extraction_evidence").select("vote_id"), "vote_id", "left_semi").select("vote_id", "school_slug"),
    "anti_without_evidence": lambda s, d: rows(s, d, "votes", "school_slug").join(table(s, d, "extraction_evidence").select("vote_id"), "vote_id", "left_anti").select("vote_id", "school_slug"),
    "marked_by_evidence": lambda s, d: R.mark_where(rows(s, d, "meetings", "status"), table(s, d, "extraction_evidence").select("meeting_id"), "meeting_id", "status", "cited"),
    "initiative_evidence_counts": lambda s, d: _evidence_counts(s, d),
    "patterns_recurring": _recurring,
    "patterns_budget": _budget,
    "patterns_personnel": _personnel,
    "patterns_all": lambda s, d: _signals(s, d).select("signal_type", "category", "school_count", "meeting_count", "confidence", "needs_review", "first_date", "last_date"),
    "patterns_described": lambda s, d: _signals(s, d).select("signal_type", "category", S.described().alias("description")),
    "patterns_summary": lambda s, d: _signals(s, d).agg(
        F.count("*").alias("total"), F.count_if(~F.col("needs_review")).alias("trustee_ready"), F.count_if("needs_review").alias("to_review"), F.count_distinct("category").alias("categories"), F.coalesce(F.max("school_count"), F.lit(0)).alias("max_school_count")
    ),
    "patterns_by_type": lambda s, d: _signals(s, d).groupBy("signal_type").agg(F.count("*").alias("total"), F.count_if(~F.col("needs_review")).alias("trustee_ready"), F.count_if(F.col("n_measured_schools") >= 2).alias("corroborated")),
    "patterns_page": lambda s, d: R.page(_signals(s, d), [F.asc("needs_review"), F.desc("confidence"), F.desc("school_count"), F.asc("signal_type"), F.asc("category")], 50).select("signal_type", "category", "confidence", "needs_review", "school_count"),
    "pattern_schools": lambda s, d: _supporting(s, d).groupBy("signal", "school_slug").agg(F.count("*").alias("initiative_count"), F.count("measured_outcome").alias("measured_count")),
    "pattern_rows": lambda s, d: _supporting(s, d).join(_evidence_counts(s, d), "initiative_id").join(rows(s, d, "meetings", "title", "published_date"), "meeting_id").select("signal", "initiative_id", "school_slug", "title", "published_date", "n_evidence"),
    "pattern_evidence": lambda s, d: _pattern_evidence(s, d),
    "theme_assignment": lambda s, d: rows(s, d, "initiatives", "category").select("initiative_id", S.theme(F.col("category")).alias("theme")),
    "matrix_candidates_top3": lambda s, d: R.top_n(
        S.matrix_candidates(_initiatives(s, d)).withColumn("n_meetings", F.size("meetings")), ["school_slug", "theme"], [F.desc("confidence"), F.desc("n_meetings"), F.asc("slug")], 3
    ).select("school_slug", "theme", "label", "confidence", "n_meetings", "rank"),
    "matrix_alike_pairs": lambda s, d: S.alike_pairs(S.matrix_candidates(_initiatives(s, d)), 0.15, 2),
    "matrix_top3": _matrix,
    "matrix_grid": _grid,
    "insight_ids": lambda s, d: rows(s, d, "initiatives", "school_slug", "category", "initiative_name").select("initiative_id", S.insight_id(F.col("school_slug"), S.theme(F.col("category")), F.col("initiative_name")).alias("insight_id")),
    "insight_detail": lambda s, d: _insight_detail(s, d),
    "insight_related": lambda s, d: _insight_related(s, d),
    "peer_top1": lambda s, d: R.top_n(_initiatives(s, d).where("initiative_name is not null").withColumn("theme", S.theme(F.col("category"))), ["theme", "school_slug"], [F.desc("confidence"), F.asc("initiative_id")], 1).select(
        "theme", "school_slug", "initiative_id", "confidence"
    ),
    "personnel_by_month": lambda s, d: rows(s, d, "personnel_actions", "created_at", "action_type", "is_interim").groupBy(F.date_format("created_at", "yyyy-MM").alias("month"), "action_type").agg(F.count("*").alias("n"), F.count_if("is_interim").alias("n_interim")),
    "review_rates": lambda s, d: R.review_rates({t: rows(s, d, t, "school_slug", "needs_review", "confidence") for t in ("votes", "financial_items", "personnel_actions", "initiatives")}),
    "category_lookup": lambda s, d: rows(s, d, "initiatives", "category").select("initiative_id", X.clamp(F.col("category"), X.INITIATIVE_CATEGORIES, "other", X.CATEGORY_SYNONYMS).alias("category")),
    "money_confidence": lambda s, d: rows(s, d, "financial_items", "amount", "description", "action_type", "vendor", "category", "confidence").select("item_id", X.money_confidence(F.col("amount"), *[F.col(c) for c in ("description", "action_type", "vendor", "category")], F.col("confidence") * 20).alias("score")),
    "initiative_confidence": lambda s, d: rows(s, d, "initiatives", "initiative_name", "action_type", "description", "outcome_timeframe", "measured_outcome", "confidence").select(
        "initiative_id", X.initiative_confidence(*[F.col(c) for c in ("initiative_name", "action_type", "description", "outcome_timeframe", "measured_outcome")], F.col("confidence") * 10).alias("score")
    ),
    "vote_confidence": lambda s, d: rows(s, d, "votes", "motion_text", "agenda_item", "passed", "yes_count", "no_count", "moved_by", "seconded_by", "confidence").select(
        "vote_id",
        X.vote_confidence(
            F.col("motion_text"), F.col("agenda_item"), F.col("passed"), F.col("yes_count").isNotNull() | F.col("no_count").isNotNull(), [F.col("moved_by"), F.col("seconded_by")], F.concat_ws(" ", "motion_text", "moved_by"), F.col("confidence") * 12
        ).alias("score"),
    ),
    "people_confidence": lambda s, d: rows(s, d, "personnel_actions", "action_type", "position_title", "person_name", "effective_date", "department", "confidence")
    .withColumn("score", X.people_confidence(F.col("action_type"), F.col("position_title"), F.col("person_name"), F.col("effective_date"), F.concat_ws(" ", "department", "position_title"), F.col("confidence") * 8))
    .withColumn("p", X.without_name(F.col("person_name"), F.col("score")))
    .select("action_id", "p.score", "p.review", "p.reason"),
    "initiatives_first_seen": lambda s, d: X.first_seen(rows(s, d, "initiatives", "meeting_id", "initiative_name", "confidence").where("initiative_name is not null"), ["meeting_id"], F.lower(F.trim("initiative_name")), [F.desc_nulls_last("confidence"), F.asc("initiative_id")]).select("initiative_id", "meeting_id"),
    "positions_split": lambda s, d: rows(s, d, "personnel_actions", "position_title").select("action_id", X.split_position(F.col("position_title")).alias("p")).select("action_id", F.col("p.position").alias("position"), F.col("p.name").alias("name")),
    "context_votes": lambda s, d: K.blocks(_star(s, d, "votes", "school_slug", "motion_text", "yes_count", "no_count", "passed", "unanimous", "needs_review").where("not needs_review"), "school_slug", K.vote_text(), "Board Votes", "vote_id"),
    "context_money": lambda s, d: K.blocks(
        _star(s, d, "financial_items", "school_slug", "action_type", "amount", "category", "vendor", "description", "needs_review").where("not needs_review and action_type <> 'discussed'"), "school_slug", K.money_text(), "Financial Actions", "item_id"
    ),
    "context_people": lambda s, d: K.blocks(
        _star(s, d, "personnel_actions", "school_slug", "action_type", "person_name", "position_title", "department", "effective_date", "is_interim", "needs_review").where("not needs_review"), "school_slug", K.people_text(), "Personnel Actions", "action_id"
    ),
    "context_initiatives": lambda s, d: K.blocks(
        _star(s, d, "initiatives", "school_slug", "action_type", "initiative_name", "category", "description", "measured_outcome", "needs_review").where("not needs_review"), "school_slug", K.initiative_text(), "Initiatives & Strategic Programs", "initiative_id"
    ),
    "position_parts": lambda s, d: rows(s, d, "personnel_actions", "position_title", "person_name").select(
        "action_id", X.bare_position(F.col("position_title")).alias("position"), X.is_bare_title(F.col("position_title")).alias("is_bare"), X.is_truncated(F.col("position_title")).alias("is_cut"), X.is_governance(F.col("position_title")).alias("is_governance"), X.is_no_name(F.col("person_name")).alias("is_no_name")
    ),
}


def _r(x: str, places: int = 3) -> str:
    return f"floor(({x}) * {10**places}.0::double + 0.5) / {10**places}.0::double"


_VOTES = f"""count(*) as n_votes, count(*) filter (where passed) as n_passed, count(*) filter (where not passed) as n_failed, count(*) filter (where unanimous) as n_unanimous,
 {_r("count(*) filter (where passed)::double / nullif(count(passed), 0)")} as pass_rate, {_r("count(*) filter (where unanimous)::double / nullif(count(*), 0)")} as unanimous_rate
 from (select distinct * from votes)"""
_THEME_ROWS = " union all ".join(f"select {i} as nth, '{t}' as theme, unnest({words!r}) as word" for i, (t, words) in enumerate(S.THEMES.items()))
_THEME = f"""with themes as ({_THEME_ROWS}), own as (select distinct * from initiatives),
 hits as (select o.initiative_id, t.nth, t.theme, count(*) filter (where contains(lower(coalesce(o.category, '')), t.word)) as n from (select distinct initiative_id, category from own) o cross join themes t group by all),
 themed as (select initiative_id, case when max(n) = 0 then 'T7' else arg_min(theme, nth) filter (where n = m) end as theme from (select *, max(n) over (partition by initiative_id) as m from hits) group by initiative_id)"""
_SLUG = "left(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s-]', '', 'g'), '[\\s_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 60)"
_CANDIDATES = (
    _THEME
    + f""", cand as (select o.school_slug, t.theme, {_SLUG.format("o.initiative_name")} as slug, arg_min(o.initiative_name, (-o.confidence, o.initiative_id)) as label, max(o.confidence) as confidence, count(distinct o.meeting_id) as n_meetings
 from own o join themed t using (initiative_id) where o.initiative_name is not null group by 1, 2, 3)"""
)
_WORDS = "list_sort(list_distinct(list_filter(regexp_extract_all(lower(label), '[a-z0-9]{2,}'), lambda x: x not in (" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "))))"


_DATED = "join (select distinct meeting_id, published_date from meetings) using (meeting_id)"


def _signal(source: str, by: str, measured: str | None = None, key: str = "") -> str:
    extra = f", count({measured}) as n_measured, count(distinct case when {measured} is not null then school_slug end) as n_measured_schools, array_to_string(list_sort(list(distinct {key})), ',') as supporting_ids" if measured else ""
    strength = "least(1.0, greatest(0.0, 0.4 * least(1.0::double, n_schools / 3) + 0.4 * least(1.0::double, n_measured_schools / 2) + 0.2 * mean_confidence))" if measured else "0.5 * least(1.0::double, n_schools / 3) + 0.5 * mean_confidence"
    review = "not (n_schools >= 2 and n_measured_schools >= 2)" if measured else "n_schools < 2"
    return f"""select *, {_r(strength)} as signal_confidence, {review} as needs_review from (
 select {by} as signal, count(distinct school_slug) as n_schools, count(distinct meeting_id) as n_meetings, count(*) as n_rows, {_r("avg(confidence::decimal(9,6))", 6)} as mean_confidence,
 min(published_date) as first_date, max(published_date) as last_date, array_to_string(list_sort(list(distinct school_slug)), ',') as schools{extra}
 from ({source}) {_DATED} group by 1) where n_schools >= 2"""


_RECURRING = _signal(
    "select distinct * from initiatives where not needs_review and confidence >= 0.5 and initiative_id in (select initiative_id from extraction_evidence where initiative_id is not null)", "lower(trim(category))", "measured_outcome", "initiative_id"
)
_BUDGET = _signal("select distinct * from financial_items where not needs_review and confidence >= 0.5 and category is not null and action_type = 'approved'", "lower(trim(category))")
_PERSONNEL = _signal("select distinct * from personnel_actions where not needs_review and confidence >= 0.5", "coalesce(action_type, 'other')")
_ALL = " union all ".join(
    f"select '{t}' as signal_type, signal as category, n_schools as school_count, n_meetings as meeting_count, signal_confidence as confidence, needs_review, first_date, last_date, schools, n_rows, {m} from ({q})"
    for t, q, m in (("recurring_initiative", _RECURRING, "n_measured, n_measured_schools"), ("budget_trend", _BUDGET, "0 as n_measured, 0 as n_measured_schools"), ("personnel_trend", _PERSONNEL, "0 as n_measured, 0 as n_measured_schools"))
)
_SUPPORTING = f"(select signal, initiative_id, i.school_slug, i.meeting_id, i.measured_outcome from (select signal, unnest(string_split(supporting_ids, ','))::bigint as initiative_id from ({_RECURRING})) join (select distinct * from initiatives) i using (initiative_id))"
_NAMES = "list_transform(list_sort(list_distinct(string_split(schools, ','))), lambda x: array_to_string(list_transform(string_split(replace(x, '_', ' '), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' '))"
_PHRASE = f"case when len({_NAMES}) = 1 then {_NAMES}[1] when len({_NAMES}) <= 3 then array_to_string(({_NAMES})[1:len({_NAMES}) - 1], ', ') || ' and ' || ({_NAMES})[len({_NAMES})] else array_to_string(({_NAMES})[1:3], ', ') || ' and ' || (len({_NAMES}) - 3) || ' more' end"


def _n(x: str, word: str) -> str:
    return f"{x} || ' {word}' || case when {x} = 1 then '' else 's' end"


def _block(source: str, key: str, where: str, heading: str, text: str) -> str:
    return f"""select school_slug, '### {heading}' || chr(10) || chr(10) || string_agg(told, chr(10) order by nth) as block from (select school_slug, nth, '• ' || coalesce(strftime(published_date, '%Y-%m-%d'), '?') || ' [' || coalesce(left(nullif(title, ''), 60), 'Untitled') || ']' || chr(10) || {text} || chr(10) as told from
 (select f.*, m.title, m.published_date, row_number() over (partition by f.school_slug order by m.published_date desc nulls first, f.{key}) as nth from (select distinct * from {source}) f join (select distinct meeting_id, title, published_date from meetings) m using (meeting_id) where {where.replace("needs_review", "f.needs_review").replace("action_type", "f.action_type")}) where nth <= 100) group by school_slug"""


_CLAMP = "case when {1} in ({0}) then {1} else '{2}' end"
_NULLS = "('', 'null', 'none', 'n/a', 'na', 'unknown', 'not mentioned', 'not specified', 'not stated', 'not provided', 'not available', 'not applicable', 'unspecified', 'unclear')"


def _there(c: str) -> str:
    return f"({c} is not null and lower(trim({c})) not in {_NULLS})"


_RANK = "row_number() over (partition by {0} order by {1})"
SQL = {
    "votes_by_school": f"select school_slug, {_VOTES} group by 1",
    "votes_totals": f"select {_VOTES}",
    "votes_top_movers": "select * from (select *, row_number() over (partition by school_slug order by n desc, moved_by) as rank from (select school_slug, moved_by, count(*) as n from (select distinct * from votes) where moved_by is not null group by 1, 2)) where rank <= 5",
    "votes_list_page": "select vote_id, title, moved_by, published_date from (select distinct * from votes) v join (select distinct meeting_id, title, published_date from meetings) m using (meeting_id) where school_slug = 'harlow_creek' and passed = true order by published_date desc nulls last, vote_id limit 50 offset 10",
    "fin_summary_by_action": "select action_type, count(*) as n, sum(amount)::double as total from (select distinct * from financial_items) where not needs_review group by 1",
    "fin_top_vendors": "select vendor, count(*) as n, sum(amount)::double as total from (select distinct * from financial_items) where not needs_review and vendor is not null group by 1 order by total desc nulls last, vendor limit 10",
    "fin_largest_item": "select school_slug, item_id, amount::double as amount from (select distinct * from financial_items) where not needs_review and amount is not null qualify row_number() over (partition by school_slug order by amount desc, item_id) = 1",
    "fin_list_page": "select item_id, title, amount::double as amount, category from (select distinct * from financial_items) f join (select distinct meeting_id, title, published_date from meetings) m using (meeting_id) where lower(category) like '%contract%' and amount >= 1000 order by published_date desc nulls last, item_id limit 100",
    "fin_by_year_cube": "select fiscal_year, action_type, count(*) as n, sum(amount)::double as total, grouping_id(fiscal_year, action_type) as level from (select distinct * from financial_items) where not needs_review group by cube (fiscal_year, action_type)",
    "meetings_list_page": "select meeting_id, title, published_date from (select distinct * from meetings) where is_active and deleted_at is null order by published_date desc nulls last, meeting_id limit 20 offset 20",
    "meeting_latest_per_school": "select school_slug, meeting_id, published_date from (select distinct * from meetings) where published_date is not null qualify row_number() over (partition by school_slug order by published_date desc, meeting_id desc) = 1",
    "meeting_status_audit": "select school_slug, status, coalesce(source_type, 'none') as source_type, count(*) as n from (select distinct * from meetings) group by 1, 2, 3",
    "meeting_overview_counts": "select m.meeting_id, m.school_slug, "
    + ", ".join(
        f"(select count(*) from (select distinct * from {t}) x where x.meeting_id = m.meeting_id) as {a}"
        for t, a in (("votes", "n_votes"), ("financial_items", "n_items"), ("personnel_actions", "n_actions"), ("initiatives", "n_initiatives"), ("chunks", "n_chunks"))
    )
    + " from (select distinct * from meetings) m",
    "transcript_ordered": "select chunk_id, meeting_id, chunk_index, row_number() over (partition by meeting_id order by chunk_index nulls last, start_time nulls last, chunk_id) as nth from (select distinct * from chunks) where deleted_at is null",
    "key_chunks_top5": "select * from (select meeting_id, chunk_id, row_number() over (partition by meeting_id order by quality_score desc nulls last, chunk_index, chunk_id) as rank from (select distinct * from chunks) where deleted_at is null) where rank <= 5",
    "semi_with_evidence": "select vote_id, school_slug from (select distinct * from votes) v where exists (select 1 from extraction_evidence e where e.vote_id = v.vote_id)",
    "anti_without_evidence": "select vote_id, school_slug from (select distinct * from votes) v where not exists (select 1 from extraction_evidence e where e.vote_id = v.vote_id)",
    "initiative_evidence_counts": "select initiative_id, (select count(*) from (select distinct * from extraction_evidence) e where e.initiative_id = i.initiative_id) as n_evidence from (select distinct * from initiatives) i",
    "votes_between_dates": "select vote_id, title, m.school_slug as school_name, motion_text, published_date from (select distinct * from votes) v join (select distinct * from meetings) m using (meeting_id) where published_date between '2023-01-01' and '2024-12-31' and passed = false",
    "votes_envelope": "select count(*) as total, 50 as \"limit\", 100 as \"offset\", 150 < count(*) as has_more from (select distinct * from votes) where passed = true",
    "fin_context_rows": "select item_id, title, action_type, case when amount <> 0 then (case when amount < 0 then '-' else '' end) || '$' || format('{:,.2f}', abs(amount)::double) else '' end as amount, published_date from (select distinct * from financial_items where not needs_review and action_type <> 'discussed') f join (select distinct meeting_id, title, published_date from meetings) m using (meeting_id) order by published_date desc nulls first, item_id limit 100",
    "meetings_in_states": "select meeting_id, status, school_slug from (select distinct * from meetings) where status not in ('failed', 'rejected', 'discovered') and published_date is not null",
    "meetings_of_types": "select meeting_id, meeting_type, case when lower(title) like '%special%' then 'special' when lower(title) like '%workshop%' then 'workshop' when lower(title) like '%committee%' then 'committee' else 'regular' end as kind, coalesce(lower(title) like '%board%' or lower(title) like '%trustee%' or lower(title) like '%regular meeting%', false) as named_so from (select distinct * from meetings) where meeting_type in ('special', 'workshop')",
    "table_counts": " union all ".join(f"select '{t}' as name, count(distinct {k}) as n from {t}" for t, k in KEYS.items()),
    "meeting_overview": "select m.meeting_id, m.title, "
    + ", ".join(f"coalesce((select array_to_string(list_sort(list({k})), ',') from (select distinct {k}, meeting_id, needs_review from {t}) x where x.meeting_id = m.meeting_id and not needs_review), '') as {t}" for t, k in (("votes", "vote_id"), ("financial_items", "item_id"), ("personnel_actions", "action_id")))
    + ", coalesce((select string_agg(chunk_id, ',' order by rank) from (select meeting_id, chunk_id, row_number() over (partition by meeting_id order by quality_score desc nulls last, chunk_index, chunk_id) as rank from (select distinct * from chunks) where deleted_at is null) k where k.meeting_id = m.meeting_id and rank <= 5), '') as key_chunks from (select distinct * from meetings) m",
    "marked_by_evidence": "select meeting_id, case when meeting_id in (select meeting_id from extraction_evidence where meeting_id is not null) then 'cited' else status end as status from (select distinct meeting_id, status from meetings)",
    "patterns_recurring": _RECURRING,
    "patterns_budget": _BUDGET,
    "patterns_personnel": _PERSONNEL,
    "patterns_all": f"select signal_type, category, school_count, meeting_count, confidence, needs_review, first_date, last_date from ({_ALL})",
    "patterns_described": f"""select signal_type, category, {_PHRASE} || ' (' || {_n("school_count", "school")} || '): ' || {_n("n_rows", "record")} || ' of ' || replace(category, '_', ' ') || ' across ' || {_n("meeting_count", "meeting")} || '.'
 || case when signal_type <> 'recurring_initiative' then '' when n_measured_schools >= 2 then ' ' || {_n("n_measured", "record")} || ' of ' || {_n("n_measured_schools", "school")} || ' with measured outcomes.'
 when n_measured_schools = 1 then ' ' || {_n("n_measured", "record")} || ' with measured outcomes, all of one school.' else ' No measured outcomes.' end as description from ({_ALL})""",
    "patterns_summary": f"select count(*) as total, count(*) filter (where not needs_review) as trustee_ready, count(*) filter (where needs_review) as to_review, count(distinct category) as categories, coalesce(max(school_count), 0) as max_school_count from ({_ALL})",
    "patterns_by_type": f"select signal_type, count(*) as total, count(*) filter (where not needs_review) as trustee_ready, count(*) filter (where n_measured_schools >= 2) as corroborated from ({_ALL}) group by 1",
    "patterns_page": f"select signal_type, category, confidence, needs_review, school_count from ({_ALL}) order by needs_review, confidence desc, school_count desc, signal_type, category limit 50",
    "pattern_schools": f"select signal, school_slug, count(*) as initiative_count, count(measured_outcome) as measured_count from {_SUPPORTING} group by 1, 2",
    "pattern_rows": f"select signal, initiative_id, school_slug, title, published_date, (select count(*) from (select distinct * from extraction_evidence) e where e.initiative_id = x.initiative_id) as n_evidence from {_SUPPORTING} x join (select distinct meeting_id, title, published_date from meetings) m using (meeting_id)",
    "pattern_evidence": f"select signal, evidence_id, initiative_id, title, exact_quote, rank from (select signal, evidence_id, initiative_id, title, exact_quote, row_number() over (partition by signal order by published_date desc nulls last, evidence_id) as rank from (select signal, initiative_id from {_SUPPORTING}) join (select distinct * from extraction_evidence) e using (initiative_id) join (select distinct meeting_id as mid, title, published_date from meetings) m on e.meeting_id = m.mid) where rank <= 20",
    "insight_ids": _THEME + f" select o.initiative_id, o.school_slug || '__' || t.theme || case when o.initiative_name is null then '' else '__' || {_SLUG.format('o.initiative_name')} end as insight_id from own o join themed t using (initiative_id)",
    "insight_detail": _THEME
    + f""", named as (select o.*, t.theme, o.school_slug || '__' || t.theme || '__' || {_SLUG.format("o.initiative_name")} as insight_id from own o join themed t using (initiative_id) where not o.needs_review and o.initiative_name is not null),
 met as (select school_slug, theme, count(distinct meeting_id) as n_meetings from named group by 1, 2)
 select insight_id, initiative_id, initiative_name as label, coalesce(action_type, 'discussed') as action_type, n_meetings, (select count(*) from (select distinct * from extraction_evidence) e where e.initiative_id = n.initiative_id) as n_quotes,
 coalesce('Measured outcome: ' || measured_outcome, description, initiative_name) as summary, {_r("confidence")} as confidence
 from (select * from named qualify row_number() over (partition by insight_id order by confidence desc, initiative_id) = 1) n join met using (school_slug, theme)""",
    "insight_related": _THEME
    + """, cells as (select distinct o.school_slug, t.theme, o.meeting_id from own o join themed t using (initiative_id) where not o.needs_review)
 select school_slug, theme, vote_id, row_number() over (partition by school_slug, theme order by vote_id) as rank from cells join (select distinct vote_id, meeting_id from votes where not needs_review) using (meeting_id) qualify rank <= 10""",
    "review_rates": " union all ".join(f"select '{t}' as name, school_slug, count(*) as n, count(*) filter (where needs_review) as n_review, {_r('avg(confidence::decimal(9,6))')} as mean_confidence from (select distinct * from {t}) group by 2" for t in ("votes", "financial_items", "personnel_actions", "initiatives")),
    "category_lookup": "with syn as (select * from (values " + ", ".join(f"('{a}', '{b}')" for a, b in X.CATEGORY_SYNONYMS.items()) + ") s(a, b)), own as (select distinct initiative_id, lower(trim(coalesce(category, ''))) as c from initiatives) select initiative_id, "
    + _CLAMP.format("'workforce_development', 'career_technical_education', 'student_success', 'equity_and_inclusion', 'facilities', 'technology', 'curriculum', 'accreditation', 'financial_sustainability', 'governance', 'community_partnership', 'dual_enrollment', 'transfer_pathway', 'other'", "coalesce(b, c)", "other")
    + " as category from own left join syn on a = c",
    "money_confidence": f"""with own as (select distinct * from financial_items), f as (select item_id, case when amount > 0 then 0.40::double else 0.0::double end + case when {_there("description")} then 0.35::double else 0.0::double end + case when {_there("action_type")} then 0.15::double else 0.0::double end + case when {_there("vendor")} then 0.10::double else 0.0::double end as fields,
 least(1.0::double, confidence * 20 / 14) as pat, lower(trim(coalesce(category, ''))) in ('contract', 'grant', 'budget_amendment', 'salary_schedule', 'bond', 'capital_project', 'technology', 'student_services') as known, lower(trim(coalesce(action_type, ''))) as act from own),
 g as (select *, {_r("fields * 0.65::double + pat * 0.35::double")} as s1 from f), h as (select *, case when known then s1 else {_r("s1 * 0.85::double")} end as s from g)
 select item_id, case when act in ('approved', 'amended') then s when act in ('proposed', 'tabled') then least(s, 0.68::double) else least(s, 0.50::double) end as score from h""",
    "initiative_confidence": f"""select initiative_id, least(1.0::double, greatest(0.0::double, {_r(f"(case when {_there('initiative_name')} then 1.0::double else 0.0::double end + case when {_there('action_type')} then 1.0::double else 0.0::double end + case when {_there('description')} then 1.0::double else 0.0::double end) / 3 * 0.6::double + least(1.0::double, confidence * 10 / 8) * 0.4::double - case when {_there('outcome_timeframe')} and coalesce(lower(trim(outcome_timeframe)) = lower(trim(measured_outcome)), false) then 0.25::double else 0.0::double end")})) as score from (select distinct * from initiatives)""",
    "vote_confidence": f"""with own as (select distinct * from votes), f as (select *, len(list_filter(regexp_split_to_array(case when {_there("motion_text")} then trim(motion_text) else '' end, '\\s+'), lambda w: w <> '')) as n, lower(concat_ws(' ', motion_text, moved_by)) as t from own)
 select vote_id, case when {_there("motion_text")} or {_there("agenda_item")} then least(1.0::double, greatest(0.0::double, {_r(f"(case when {_there('motion_text')} then 1.0::double else 0.0::double end + case when {_there('agenda_item')} then 1.0::double else 0.0::double end + case when passed is not null then 1.0::double else 0.0::double end) / 3 * 0.6::double + least(1.0::double, confidence) * 0.4::double + case when n >= 8 then 0.1::double else 0.0::double end + case when yes_count is not null or no_count is not null then 0.1::double else 0.0::double end - case when {_there('motion_text')} and n < 4 then 0.15::double else 0.0::double end - case when {_there('moved_by')} and not contains(t, lower(trim(moved_by))) then 0.2::double else 0.0::double end - case when {_there('seconded_by')} and not contains(t, lower(trim(seconded_by))) then 0.2::double else 0.0::double end")})) else 0.0::double end as score from f""",
    "people_confidence": f"""with own as (select distinct * from personnel_actions), f as (select *, lower(concat_ws(' ', department, position_title)) as t from own),
 s as (select *, least(1.0::double, greatest(0.0::double, {_r(f"(case when {_there('action_type')} then 1.0::double else 0.0::double end + case when {_there('position_title')} then 1.0::double else 0.0::double end) / 2 * 0.6::double + least(1.0::double, confidence) * 0.4::double + case when not {_there('person_name')} then 0.0::double when contains(t, lower(trim(person_name))) then 0.2::double else -0.3::double end + case when {_there('effective_date')} then 0.15::double else 0.0::double end - case when coalesce(lower(trim(position_title)) in ('vice chancellor', 'vice president', 'dean', 'chancellor', 'president', 'director', 'associate vice', 'assistant vice', 'executive vice'), false) then 0.15::double else 0.0::double end")})) as raw from f)
 select action_id, case when {_there("person_name")} then raw else least(raw, 0.6::double) end as score, not {_there("person_name")} as review, case when not {_there("person_name")} then 'missing_person_name' end as reason from s""",
    "initiatives_first_seen": "select initiative_id, meeting_id from (select distinct * from initiatives) where initiative_name is not null qualify row_number() over (partition by meeting_id, lower(trim(initiative_name)) order by confidence desc nulls last, initiative_id) = 1",
    "positions_split": r"""with own as (select action_id, position_title as p, regexp_extract(trim(position_title), '\s(\S+)$', 1) as last from (select distinct action_id, position_title from personnel_actions)),
 j as (select *, regexp_matches(last, '^\p{Lu}') and length(last) > 2 and not ends_with(last, '.') and lower(last) not in (""" + ", ".join(f"'{q}'" for q in X.QUALIFIERS) + r""") as found from own)
 select action_id, case when found then trim(regexp_replace(trim(p), '\s\S+$', '')) else p end as position, case when found then last end as name from j""",
    "context_votes": _block("votes", "vote_id", "not needs_review", "Board Votes", """'  Motion : ' || coalesce(trim(motion_text), '') || case when yes_count is null and passed is null and not coalesce(unanimous, false) then '' else chr(10) || '  Result :' || case when yes_count is null then '' else '  (' || yes_count || ' yes / ' || coalesce(no_count::varchar, '?') || ' no)' end
 || case when unanimous then '  [UNANIMOUS]' when passed then '  [PASSED]' when not passed then '  [FAILED]' else '' end end"""),
    "context_money": _block("financial_items", "item_id", "not needs_review and action_type <> 'discussed'", "Financial Actions", """'  [' || upper(coalesce(nullif(action_type, ''), 'approved')) || ']' || case when amount <> 0 then '  ' || case when amount < 0 then '-' else '' end || '$' || format('{:,.2f}', abs(amount)::double) else '' end || '  ' || concat_ws(' / ', nullif(category, ''), nullif(vendor, ''))
 || case when coalesce(trim(description), '') <> '' then chr(10) || '  ' || trim(description) else '' end"""),
    "context_people": _block("personnel_actions", "action_id", "not needs_review", "Personnel Actions", """'  [' || upper(coalesce(nullif(action_type, ''), '')) || ']' || case when is_interim then '  [INTERIM]' else '' end || ' ' || coalesce(nullif(person_name, ''), 'Unknown') || ' — ' || concat_ws(', ', nullif(position_title, ''), nullif(department, ''))
 || case when coalesce(trim(effective_date), '') <> '' then '  (effective ' || effective_date || ')' else '' end"""),
    "context_initiatives": _block("initiatives", "initiative_id", "not needs_review", "Initiatives & Strategic Programs", """'  [' || upper(coalesce(nullif(action_type, ''), 'discussed')) || '] ' || coalesce(nullif(initiative_name, ''), 'Unnamed initiative') || '  (' || coalesce(category, '') || ')'
 || case when coalesce(trim(description), '') <> '' then chr(10) || '  ' || trim(description) else '' end || case when coalesce(trim(measured_outcome), '') <> '' then chr(10) || '  Outcome  : ' || trim(measured_outcome) else '' end"""),
    "position_parts": r"""select action_id, regexp_replace(trim(regexp_replace(position_title, '\s*\([^)]*\)', '', 'g')), '[.,;: ]+$', '') as position, lower(trim(position_title)) in ('vice chancellor', 'vice president', 'dean', 'chancellor', 'president', 'director', 'associate vice', 'assistant vice', 'executive vice') as is_bare,
 lower(regexp_extract(position_title, '([A-Za-z]+)\s*$', 1)) in ('of', 'the', 'and', 'in', 'for', 'with', 'at', 'to', 'by', 'on', 'from', 'a', 'an') as is_cut, regexp_matches(lower(position_title), '\b(trustee|board\s+(member|chair(man|woman|person)?|president|officer|secretary|treasurer)|committee\s+chair(man|woman|person)?|higher\s+education|coordinating\s+board|advisory\s+board\s+member|state\s+(senator|representative|legislator|official)|regent)\b') as is_governance,
 lower(trim(person_name)) in ('counseling', 'union', 'committee', 'board', 'division', 'department', 'faculty', 'staff', 'administration', 'services', 'education', 'instruction', 'enrollment', 'affairs', 'operations', 'resources', 'technology', 'finance', 'marketing', 'communications', 'research', 'planning', 'development', 'workforce', 'continuing', 'center', 'program', 'office', 'institute', 'college', 'university', 'district', 'foundation', 'council', 'commission', 'association', 'organization', 'coalition', 'alliance', 'network', 'society', 'academy') as is_no_name
 from (select distinct * from personnel_actions)""",
    "theme_assignment": _THEME + " select o.initiative_id, t.theme from own o join themed t using (initiative_id)",
    "matrix_candidates_top3": _CANDIDATES + " select school_slug, theme, label, confidence, n_meetings, row_number() over (partition by school_slug, theme order by confidence desc, n_meetings desc, slug) as rank from cand qualify rank <= 3",
    "matrix_alike_pairs": _CANDIDATES
    + f""", w as (select school_slug, theme, slug, {_WORDS} as words from cand) select a.school_slug, a.theme, a.slug as slug_a, b.slug as slug_b from w a join w b on a.school_slug = b.school_slug and a.theme = b.theme and a.slug < b.slug
 where len(list_intersect(a.words, b.words)) >= 2 and len(list_intersect(a.words, b.words)) >= 0.15 * (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words)))""",
    "peer_top1": _THEME + " select t.theme, o.school_slug, o.initiative_id, o.confidence from own o join themed t using (initiative_id) where o.initiative_name is not null qualify row_number() over (partition by t.theme, o.school_slug order by o.confidence desc, o.initiative_id) = 1",
    "personnel_by_month": "select strftime(created_at, '%Y-%m') as month, action_type, count(*) as n, count(*) filter (where is_interim) as n_interim from (select distinct * from personnel_actions) group by 1, 2",
}
