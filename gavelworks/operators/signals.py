"""Signals that recur across schools, the theme matrix, and scores by weighted patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelworks.functions.text import content_tokens, half_up, jaccard, slug
from gavelworks.storage import cut

#: Keywords of the themes, matched as substrings.
THEMES = {
    "T1": ["academic", "student", "curriculum", "course", "instruction", "enrollment", "graduation", "transfer", "tutoring", "advising", "faculty", "degree", "program", "accreditation", "learning"],
    "T2": ["career", "workforce", "job", "employer", "industry", "training", "apprentice", "internship", "placement", "cte", "technical education", "workforce development"],
    "T3": ["budget", "finance", "financial", "fiscal", "grant", "contract", "bond", "expenditure", "revenue", "tax", "audit", "procurement", "vendor", "policy", "fee", "tuition"],
    "T4": ["technology", "tech", "ai", "artificial intelligence", "digital", "software", "infrastructure", "data", "cybersecurity", "system", "platform", "tool", "innovation", "automation", "it ", "information technology"],
    "T5": ["community", "recognition", "partnership", "donation", "award", "ceremony", "event", "outreach", "diversity", "equity", "inclusion", "dei", "engagement", "alumni"],
    "T6": ["personnel", "staff", "hire", "appointment", "resignation", "facilities", "construction", "renovation", "building", "campus", "maintenance", "interim", "position", "employee", "human resources", "hr"],
    "T7": ["procedural", "minutes", "agenda", "quorum", "adjournment", "committee", "board meeting", "resolution", "consent", "approval", "motion", "compliance", "bylaw", "legal"],
}
#: Patterns with weights. They are held against lower-case text, so alternatives with capitals ("I move", "FY 24", month names, "MOU") can never match and are left out.
VOTE_PATTERNS = [
    (r"\bthe ayes have it\b", 4.0),
    (r"\bmotion (carries|passes|passed|failed|is denied)\b", 4.0),
    (r"\bvoting has concluded\b", 4.0),
    (r"\bmotion is approved\b", 4.0),
    (r"\bayes?\b|\bnays?\b", 3.5),
    (r"\bfavor say aye\b|\ball in favor\b", 3.5),
    (r"\bvote of \d", 3.5),
    (r"\bvoting is open\b|\bcast your vote\b", 3.0),
    (r"\bso moved\b|\bmove that\b", 3.0),
    (r"\bmotion to\b", 2.5),
    (r"\bseconded?\b", 2.0),
    (r"\bunanimous(ly)?\b", 2.5),
    (r"\bany opposed\b|\bno objection\b", 2.5),
    (r"\broll call\b", 2.0),
    (r"\bmotion\b", 1.5),
    (r"\bwill (be )?vot(e|ing)\b", -3.0),
    (r"\bplan(ning)? to vote\b", -3.0),
    (r"\bwill (be )?brought (back )?to a vote\b", -3.0),
    (r"\bnext meeting\b|\bnext (month|session|time)\b", -2.0),
    (r"\bscheduled for (a )?(vote|approval)\b", -2.0),
    (r"\bplease welcome\b|\bthank you for joining\b", -3.0),
    (r"\bwill (now )?present\b|\bwill (now )?provide\b", -2.0),
    (r"\bhow (we|the board) (should |will )?vote\b", -2.0),
    (r"\bvoting (procedure|process|guideline)\b", -2.0),
]
FINANCIAL_PATTERNS = [
    (r"\$[\d,]+", 3.0),
    (r"\b\d[\d,.]*\s*(million|thousand|billion)\b", 2.5),
    (r"\bapprove.*contract\b|\bcontract.*approv\w+\b", 3.0),
    (r"\baward(ed)? (the |a )?contract\b", 3.0),
    (r"\bbudget amendment\b", 2.5),
    (r"\bapprove.*fund\b|\bfund.*approv\w+\b", 2.5),
    (r"\bbond (measure|issuance|sale)\b", 2.5),
    (r"\bcontract\b", 1.5),
    (r"\bgrant (of|from|award|funding)\b", 2.0),
    (r"\bpurchase order\b|\bprocurement\b", 2.0),
    (r"\bappropriat\w+\b", 1.5),
    (r"\bcapital (project|outlay|expenditure)\b", 2.0),
    (r"\bsalary schedule\b", 2.0),
    (r"\bprofessional services\b", 1.5),
    (r"\bfiscal year\b", 1.0),
    (r"\blast year (it was|the amount|we had|we received)\b", -2.5),
    (r"\bcompared to (last|prior|previous)\b", -2.0),
    (r"\bhistorical(ly)?\b", -1.5),
    (r"\bstate (gave|allocated|provided|awarded) .*to\b", -2.5),
    (r"\bfederal (gave|provided|awarded)\b", -2.5),
    (r"\bfor example\b|\bsuch as\b|\bfor instance\b", -1.0),
]
PERSONNEL_PATTERNS = [
    (r"\bapprove the (employment|appointment|hiring)\b", 4.0),
    (r"\bmotion to (approve|accept).*(employ|appoint|hire)\b", 4.0),
    (r"\bterminat\w+\b", 3.5),
    (r"\bresign\w*\b", 3.5),
    (r"\bretir\w+\b", 3.0),
    (r"\beffective (date|immediately)\b", 3.0),
    (r"\bappoint(ment|ed|ing)?\b", 2.5),
    (r"\bhir(e|ed|ing)\b", 2.5),
    (r"\bemployment of\b", 2.5),
    (r"\bnew (hire|position|appointment)\b", 2.5),
    (r"\bfaculty appointment\b|\bstaff appointment\b", 2.5),
    (r"\bpersonnel (action|report|item)\b", 2.5),
    (r"\binterim (appointment|hire|position)\b", 2.5),
    (r"\bdirector of\b|\bdean of\b", 1.5),
    (r"\bvice (chancellor|president) of\b", 1.5),
    (r"\bposition of\b", 1.5),
    (r"\binterim\b", 1.0),
    (r"\bplease welcome\b", -4.0),
    (r"\bthank you for joining\b|\bjoining us (today|this evening|tonight)\b", -3.5),
    (r"\bwill (now )?present\b|\bwill (now )?provide (an )?overview\b", -3.0),
    (r"\bhere to (answer|present|provide|share)\b", -2.5),
    (r"\bhas been (serving|working|with us) (for|since)\b", -2.5),
    (r"\bworking (with|alongside) (our|the)\b", -2.0),
    (r"\bled by (our|the)\b|\bsupported by\b", -1.5),
    (r"\bresponded? to (board |trustee )?questions\b", -1.5),
]
INITIATIVE_PATTERNS = [
    (r"\blaunch(ed|ing)?\b|\bpilot (program|project)\b", 2.5),
    (r"\bprogram (approval|launch|expansion)\b", 2.5),
    (r"\bstrategic (plan|initiative|goal|priority)\b", 2.5),
    (r"\bworkforce (development|training|pipeline)\b", 2.5),
    (r"\bpartnership (with|agreement)\b", 2.0),
    (r"\bmemorandum of understanding\b", 2.5),
    (r"\bnew (program|initiative|course|certificate)\b", 2.0),
    (r"\baccreditation\b|\bcurriculum (approval|change)\b", 2.0),
    (r"\bgrant (funded|award|program)\b", 2.0),
    (r"\bequity (initiative|plan|program)\b", 2.0),
    (r"\btechnology (upgrade|project|initiative)\b", 2.0),
    (r"\bdual credit\b|\bdual enrollment\b", 2.0),
    (r"\bstudent success (initiative|plan|program)\b", 2.5),
    (r"\bexpand\w+\b|\bgrow\w+\b", 1.0),
    (r"\bconstruction\b|\brenovation\b|\bfacility\b", 1.5),
]
#: The least score of a hit, and the chunks of context on each side, by target.
TARGETS = {"votes": (VOTE_PATTERNS, 5.0, 2), "financial": (FINANCIAL_PATTERNS, 2.5, 1), "personnel": (PERSONNEL_PATTERNS, 3.5, 2), "initiative": (INITIATIVE_PATTERNS, 2.5, 4)}


def pattern_score(text: Column, patterns: list[tuple[str, float]]) -> Column:
    """Sum of the weights of the patterns that the lower-cased text has, each once; at least 0, and 0 for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0.0)
    for pattern, weight in patterns:
        total = total + F.when(low.rlike(pattern), weight).otherwise(0.0)
    return F.greatest(F.lit(0.0), total)


def theme(category: Column, themes: dict[str, list[str]] = THEMES, default: str = "T7") -> Column:
    """The theme with the most keywords in the category, the earlier one in a tie; default without any."""
    low = F.lower(F.coalesce(category, F.lit("")))
    hits = [F.struct(F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))).alias("n"), F.lit(-i).alias("nth"), F.lit(name).alias("name")) for i, (name, words) in enumerate(themes.items())]
    best = F.array_max(F.array(*hits))
    return F.when(best["n"] == 0, default).otherwise(best["name"])


def _groups(rows: DataFrame, by: Column, extra: list[Column], least_schools: int) -> DataFrame:
    """Per group that at least so many schools have: counts, mean confidence, first and last date (published_date), and the sorted schools."""
    out = rows.groupBy(by.alias("signal")).agg(
        F.count_distinct("school_slug").alias("n_schools"),
        F.count_distinct("meeting_id").alias("n_meetings"),
        F.count("*").alias("n_rows"),
        half_up(F.avg(F.col("confidence").cast("decimal(9,6)")).cast("double"), 6).alias("mean_confidence"),
        F.min("published_date").alias("first_date"),
        F.max("published_date").alias("last_date"),
        F.array_join(F.sort_array(F.collect_set("school_slug")), ",").alias("schools"),
        *extra,
    )
    return out.where(F.col("n_schools") >= least_schools)


def recurring(rows: DataFrame, by: Column, measured: Column, id_col: str, least_schools: int = 2) -> DataFrame:
    """Signals of groups with measured outcomes: as _groups, with the measured rows, the schools that measured, and the sorted ids.

    Confidence is 0.4 for schools (full at 3), 0.4 for schools that measured (full at 2) and 0.2 for the mean; a signal is to be reviewed unless two schools have it and two measured it.
    """
    extra = [
        F.count(measured).alias("n_measured"),
        F.count_distinct(F.when(measured.isNotNull(), F.col("school_slug"))).alias("n_measured_schools"),
        F.array_join(F.sort_array(F.collect_set(id_col)), ",").alias("supporting_ids"),
    ]
    strength = 0.4 * F.least(F.lit(1.0), F.col("n_schools") / 3) + 0.4 * F.least(F.lit(1.0), F.col("n_measured_schools") / 2) + 0.2 * F.col("mean_confidence")
    out = _groups(rows, by, extra, least_schools).withColumn("signal_confidence", half_up(F.least(F.lit(1.0), F.greatest(F.lit(0.0), strength)), 3))
    return out.withColumn("needs_review", ~((F.col("n_schools") >= 2) & (F.col("n_measured_schools") >= 2)))


def trend(rows: DataFrame, by: Column, least_schools: int = 2) -> DataFrame:
    """Signals of groups without outcomes: as _groups; confidence is half for schools (full at 3) and half the mean, and below two schools a signal is to be reviewed."""
    strength = 0.5 * F.least(F.lit(1.0), F.col("n_schools") / 3) + 0.5 * F.col("mean_confidence")
    return _groups(rows, by, [], least_schools).withColumn("signal_confidence", half_up(strength, 3)).withColumn("needs_review", F.col("n_schools") < 2)


def school_phrase(schools: Column, most: int = 3) -> Column:
    """Sorted distinct slugs as prose: "A", "A, B and C", "A, B, C and 2 more"; "Multiple schools" without any."""
    names = F.transform(F.sort_array(F.array_distinct(schools)), lambda s: F.initcap(F.translate(s, "_", " ")))
    n = F.size(names)
    head = F.array_join(F.slice(names, 1, F.greatest(F.least(n - 1, F.lit(most)), F.lit(0))), ", ")
    few = F.when(n == 1, names[0]).otherwise(F.concat(head, F.lit(" and "), F.try_element_at(names, F.lit(-1))))
    return F.when(F.coalesce(n, F.lit(0)) < 1, "Multiple schools").when(n <= most, few).otherwise(F.concat(head, F.lit(" and "), (n - most).cast("string"), F.lit(" more")))


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def described() -> Column:
    """A sentence on a signal of columns schools (joined by commas), school_count, meeting_count, n_rows, n_measured and n_measured_schools."""
    who = F.concat(school_phrase(F.split("schools", ",")), F.lit(" ("), plural(F.col("school_count"), "school"), F.lit("): "), plural(F.col("n_rows"), "record"), F.lit(" of "), F.translate("category", "_", " "), F.lit(" across "), plural(F.col("meeting_count"), "meeting"), F.lit("."))
    outcome = (
        F.when(F.col("n_measured_schools") >= 2, F.concat(F.lit(" "), plural(F.col("n_measured"), "record"), F.lit(" of "), plural(F.col("n_measured_schools"), "school"), F.lit(" with measured outcomes.")))
        .when(F.col("n_measured_schools") == 1, F.concat(F.lit(" "), plural(F.col("n_measured"), "record"), F.lit(" with measured outcomes, all of one school.")))
        .otherwise(" No measured outcomes.")
    )
    return F.concat(who, F.when(F.col("signal_type") == "recurring_initiative", outcome).otherwise(""))


def insight_id(school: Column, theme_name: Column, name: Column) -> Column:
    return F.concat_ws("__", school, theme_name, slug(name))


def insight_parts(c: Column) -> Column:
    """(school, theme, slug) of an insight id; null unless it has three parts and a known theme."""
    parts = F.split(c, "__", 3)
    return F.when((F.size(parts) == 3) & F.try_element_at(parts, F.lit(2)).isin(*THEMES), F.struct(*[F.try_element_at(parts, F.lit(i)).alias(n) for i, n in ((1, "school"), (2, "theme"), (3, "slug"))]))


def matrix_candidates(initiatives: DataFrame) -> DataFrame:
    """Initiatives by school and theme, one row for each slug of their names: its most confident label (then the smallest id) and its meetings."""
    own = initiatives.where("initiative_name is not null").select(
        "school_slug", theme(F.col("category")).alias("theme"), slug(F.col("initiative_name")).alias("slug"), "initiative_name", "confidence", "meeting_id", "initiative_id"
    )
    return own.groupBy("school_slug", "theme", "slug").agg(
        F.min_by("initiative_name", F.struct(-F.col("confidence"), "initiative_id")).alias("label"), F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("meeting_id")).alias("meetings"), F.min("initiative_id").alias("first_id")
    )


def merge_alike(bucket: DataFrame, least: float = 0.5, shared: int = 2) -> DataFrame:
    """Candidates of a school and theme merged, most confident first, into the first kept one whose words they share: (school_slug, theme, slug, label, confidence, n_meetings).

    A candidate is kept unless an earlier kept one is alike (alike_pairs). This is decided in rounds: whoever has a kept earlier
    neighbour is merged, whoever has only merged ones is kept, until all are decided; no task holds a whole school and theme.
    """
    place = lambda s: F.struct((-F.col(f"confidence{s}")).alias("c"), F.col(f"first_id{s}").alias("i"))
    nodes = cut(bucket.select("school_slug", "theme", "slug", "label", "confidence", "meetings", "first_id"))
    ends = nodes.select("school_slug", "theme", "slug", "confidence", "first_id")
    pairs = alike_pairs(nodes, least, shared)
    for side in ("a", "b"):
        pairs = pairs.join(ends.select("school_slug", "theme", F.col("slug").alias(f"slug_{side}"), F.col("confidence").alias(f"confidence_{side}"), F.col("first_id").alias(f"first_id_{side}")), ["school_slug", "theme", f"slug_{side}"])
    first, last = F.least(place("_a"), place("_b")), F.greatest(place("_a"), place("_b"))
    edges = cut(pairs.select(last["i"].alias("node"), first.alias("earlier")))
    state = cut(nodes.select(F.col("first_id").alias("node")).join(edges.select("node").distinct(), "node", "left_anti").withColumn("kept", F.lit(True)))
    while True:
        open_edges = edges.join(state.select("node"), "node", "left_anti").join(state.select(F.col("node").alias("n2"), "kept"), F.col("earlier.i") == F.col("n2"), "left")
        judged = open_edges.groupBy("node").agg(F.max(F.coalesce("kept", F.lit(False))).alias("any_kept"), F.count_if(F.col("kept").isNull()).alias("n_open"))
        new = cut(judged.where("any_kept or n_open = 0").select("node", (~F.col("any_kept")).alias("kept")))
        if not new.head(1):
            break
        state = cut(state.unionByName(new))
    into = edges.join(state.where("kept").select(F.col("node").alias("n2")), F.col("earlier.i") == F.col("n2")).join(state.where("not kept").select("node"), "node")
    into = into.groupBy("node").agg(F.min("earlier")["i"].alias("to"))
    held = nodes.join(into, nodes["first_id"] == into["node"], "left").select(F.coalesce("to", "first_id").alias("first_id"), F.explode("meetings").alias("m"))
    n = held.groupBy("first_id").agg(F.count_distinct("m").alias("n_meetings"))
    return nodes.join(n, "first_id").select("school_slug", "theme", "slug", "label", "confidence", "n_meetings")


def alike_pairs(bucket: DataFrame, least: float = 0.5, shared: int = 2) -> DataFrame:
    """Pairs of slugs of a school and theme whose labels share `shared` words and have a similarity of `least`.

    Joined on the rarest words only: two labels that share so many words share one of their rarest n - needed + 1.
    """
    own = bucket.select("school_slug", "theme", "slug", content_tokens(F.col("label")).alias("words"))
    flat = own.select("school_slug", "theme", "slug", F.explode("words").alias("word"))
    ranked = flat.join(flat.groupBy("word").agg(F.count("*").alias("df")), "word").groupBy("school_slug", "theme", "slug").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("w"))
    needed = F.greatest(F.ceil(F.size("w") * least).cast("int"), F.lit(shared))
    rare = ranked.where(F.size("w") >= needed).select("school_slug", "theme", "slug", F.explode(F.slice("w", 1, F.greatest(F.size("w") - needed + 1, F.lit(1)))).alias("p")).select("school_slug", "theme", "slug", "p.word")
    met = rare.withColumnRenamed("slug", "slug_a").join(rare.withColumnRenamed("slug", "slug_b"), ["school_slug", "theme", "word"]).where("slug_a < slug_b").select("school_slug", "theme", "slug_a", "slug_b").distinct()
    for side in ("a", "b"):
        met = met.join(own.select("school_slug", "theme", F.col("slug").alias(f"slug_{side}"), F.col("words").alias(f"words_{side}")), ["school_slug", "theme", f"slug_{side}"])
    both = F.size(F.array_intersect("words_a", "words_b"))
    return met.where((both >= shared) & (jaccard(F.col("words_a"), F.col("words_b")) >= least)).select("school_slug", "theme", "slug_a", "slug_b")
