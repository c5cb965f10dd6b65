"""Extracted items: JSON answers as rows, vocabularies, parts of positions, confidence, and first-seen rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gavelworks.functions.text import half_up, null_like

#: The categories of initiatives, and what else is typed for them.
INITIATIVE_CATEGORIES = (
    "workforce_development career_technical_education student_success equity_and_inclusion facilities technology curriculum accreditation financial_sustainability governance community_partnership dual_enrollment transfer_pathway other"
).split()
CATEGORY_SYNONYMS = {
    "workforce": "workforce_development",
    "workforce development": "workforce_development",
    "cte": "career_technical_education",
    "career technical": "career_technical_education",
    "career and technical": "career_technical_education",
    "student success": "student_success",
    "equity": "equity_and_inclusion",
    "dei": "equity_and_inclusion",
    "diversity": "equity_and_inclusion",
    "facility": "facilities",
    "construction": "facilities",
    "it": "technology",
    "information technology": "technology",
    "dual credit": "dual_enrollment",
    "dual enrollment": "dual_enrollment",
    "transfer": "transfer_pathway",
    "articulation": "transfer_pathway",
    "financial": "financial_sustainability",
    "budget": "financial_sustainability",
    "partnership": "community_partnership",
    "community": "community_partnership",
}
#: The categories and actions of financial items.
MONEY_CATEGORIES = "contract grant budget_amendment salary_schedule bond capital_project technology student_services other".split()
MONEY_ACTIONS = "approved proposed discussed tabled amended".split()
#: Titles without a department, words that end a title that was cut off, roles of governance, and single words that are no names.
BARE_TITLES = ["vice chancellor", "vice president", "dean", "chancellor", "president", "director", "associate vice", "assistant vice", "executive vice"]
DANGLING = "of the and in for with at to by on from a an".split()
GOVERNANCE = ["trustee", "board member", "board chair", "board chairman", "board chairwoman", "board chairperson", "committee chair", "committee chairman", "committee chairwoman", "committee chairperson", "board president", "board officer", "board secretary", "board treasurer", "higher education", "coordinating board", "advisory board member", "state senator", "state representative", "state legislator", "state official", "regent"]
NO_NAMES = (
    "counseling union committee board division department faculty staff administration services education instruction enrollment affairs operations resources technology finance marketing communications research "
    "planning development workforce continuing center program office institute college university district foundation council commission association organization coalition alliance network society academy"
).split()

#: Words that end a position and are no surname.
QUALIFIERS = (
    "finance financial instruction instructional student affairs services development relations operations technology resources communication marketing research planning equity diversity "
    "inclusion academic workforce continuing education enrollment information human facilities legal general external institutional advancement chancellor president dean director officer vice assistant "
    "associate senior executive interim acting northwest northeast southwest southeast north south east west central online i ii iii major colonel lieutenant sergeant captain commander admiral corporal "
    "private specialist warrant brigadier marshal commodore"
).split()


def answers(texts: DataFrame, id_col: str, keys: list[str], item: str) -> DataFrame:
    """(id, nth, item) of answers in JSON (id, text): a list, an object that wraps one under the first of keys that holds a list, or one object.

    Code fences around an answer are taken off. item is the schema of an item (a struct); elements that aren't objects, and answers that are no JSON, give no row.
    """
    bare = F.regexp_replace(F.trim("text"), r"^```[a-zA-Z]*\s*|\s*```$", "")
    own = texts.select(id_col, bare.alias("t"))
    wrapped = F.coalesce(*[F.when(F.get_json_object("t", f"$.{k}").startswith("["), F.get_json_object("t", f"$.{k}")) for k in keys])
    whole = F.when(F.col("t").startswith("["), F.col("t")).otherwise(F.coalesce(wrapped, F.concat(F.lit("["), F.col("t"), F.lit("]"))))
    elements = own.select(id_col, F.posexplode(F.from_json(whole, "array<string>")).alias("nth", "e"))
    return elements.where("e like '{%'").select(id_col, "nth", F.from_json("e", item).alias("item"))


def whole_number(c: Column) -> Column:
    """The integer that a text or number is, a fraction cut off numbers alone; null for anything else."""
    return F.when(c.cast("string").rlike(r"^\s*[+-]?\d+\s*$"), F.trim(c.cast("string")).try_cast("long"))


def clamp(c: Column, allowed: list[str], fallback: str, synonyms: dict[str, str] | None = None) -> Column:
    """The entry of a vocabulary that a value is, in any case, or stands for; else fallback."""
    low = F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    if synonyms:
        known = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
        low = F.coalesce(F.try_element_at(known, low), low)
    return F.when(low.isin(*allowed), low).otherwise(fallback)


def stands_in(name: Column, text: Column) -> Column:
    """Whether a name stands in a text, in any case; a null or empty name always does."""
    return F.coalesce(name, F.lit("")).eqNullSafe("") | F.coalesce(F.contains(F.lower(text), F.lower(name)), F.lit(False))


def bare_position(c: Column) -> Column:
    """A position without parentheses and marks at its end."""
    return F.regexp_replace(F.trim(F.regexp_replace(c, r"\s*\([^)]*\)", "")), "[.,;: ]+$", "")


def split_position(c: Column) -> Column:
    """(position, name): a surname at the end of a position (a capital word of three letters or more that no position ends with) taken off it; name is null without one."""
    bare = F.trim(c)
    last = F.regexp_extract(bare, r"\s(\S+)$", 1)
    found = last.rlike(r"^\p{Lu}") & (F.length(last) > 2) & ~last.endswith(".") & ~F.lower(last).isin(*QUALIFIERS)
    return F.struct(F.when(found, F.trim(F.regexp_replace(bare, r"\s\S+$", ""))).otherwise(c).alias("position"), F.when(found, last).alias("name"))


def is_bare_title(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c), r"\s+", " ")).isin(*BARE_TITLES)


def is_truncated(c: Column) -> Column:
    """Whether a position ends with a word that can't end one."""
    return F.lower(F.regexp_extract(c, r"([A-Za-z]+)\s*$", 1)).isin(*DANGLING)


def is_governance(c: Column) -> Column:
    return F.lower(c).rlike(r"\b(" + "|".join(g.replace(" ", r"\s+") for g in GOVERNANCE) + r")\b")


def is_no_name(c: Column) -> Column:
    """Whether a name is one word that names no person."""
    return F.lower(F.trim(c)).isin(*NO_NAMES)


def _has(c: Column) -> Column:
    return null_like(c.cast("string")).isNotNull()


def money_confidence(amount: Column, description: Column, action: Column, vendor: Column, category: Column, window_score: Column) -> Column:
    """What fields are there (0.40, 0.35, 0.15, 0.10) for 0.65, the window's score (full at 14) for 0.35; less for the category "other", capped where nothing was decided."""
    fields = sum((F.when(test, w).otherwise(0.0) for test, w in ((F.coalesce(amount > 0, F.lit(False)), 0.40), (_has(description), 0.35), (_has(action), 0.15), (_has(vendor), 0.10))), F.lit(0.0))
    score = half_up(fields * 0.65 + F.least(F.lit(1.0), window_score / 14) * 0.35, 3)
    score = F.when(clamp(category, MONEY_CATEGORIES, "other") == "other", half_up(score * 0.85, 3)).otherwise(score)
    done = clamp(action, MONEY_ACTIONS, "discussed")
    return F.when(done == "discussed", F.least(score, F.lit(0.50))).when(done.isin("proposed", "tabled"), F.least(score, F.lit(0.68))).otherwise(score)


def initiative_confidence(name: Column, action: Column, description: Column, claimed: Column, measured: Column, window_score: Column) -> Column:
    """What fields are there for 0.6, the window's score (full at 8) for 0.4; 0.25 less where the claimed outcome is the measured one."""
    there = sum((F.when(_has(c), 1.0).otherwise(0.0) for c in (name, action, description)), F.lit(0.0))
    same = F.coalesce(_has(claimed) & (F.lower(null_like(claimed)) == F.lower(null_like(measured))), F.lit(False))
    score = there / 3 * 0.6 + F.least(F.lit(1.0), window_score / 8) * 0.4 - F.when(same, 0.25).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), half_up(score, 3)))


def vote_confidence(motion: Column, result: Column, passed: Column, counts: Column, names: list[Column], text: Column, window_score: Column) -> Column:
    """What fields are there for 0.6, the window's score (full at 12) for 0.4; more for a long motion and counts, less for a fragment and for each name that the text lacks; 0 without motion and result."""
    n = F.size(F.filter(F.split(F.coalesce(null_like(motion), F.lit("")), r"\s+"), lambda w: w != ""))
    there = sum((F.when(t, 1.0).otherwise(0.0) for t in (_has(motion), _has(result), passed.isNotNull())), F.lit(0.0))
    score = there / 3 * 0.6 + F.least(F.lit(1.0), window_score / 12) * 0.4 + F.when(n >= 8, 0.1).otherwise(0.0) + F.when(counts, 0.1).otherwise(0.0) - F.when(_has(motion) & (n < 4), 0.15).otherwise(0.0)
    for name in names:
        score = score - F.when(stands_in(null_like(name), text), 0.0).otherwise(0.2)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), half_up(score, 3)))
    return F.when(_has(motion) | _has(result), score).otherwise(0.0)


def people_confidence(action: Column, position: Column, name: Column, since: Column, text: Column, window_score: Column) -> Column:
    """What fields are there for 0.6, the window's score (full at 8) for 0.4; more for a name that the text has and for a date, less for a name that it lacks and for a bare title."""
    there = sum((F.when(_has(c), 1.0).otherwise(0.0) for c in (action, position)), F.lit(0.0))
    known = null_like(name)
    named = F.when(known.isNull(), 0.0).when(stands_in(known, text), 0.2).otherwise(-0.3)
    bare = F.coalesce(is_bare_title(null_like(position)), F.lit(False))
    score = there / 2 * 0.6 + F.least(F.lit(1.0), window_score / 8) * 0.4 + named + F.when(_has(since), 0.15).otherwise(0.0) - F.when(bare, 0.15).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), half_up(score, 3)))


def without_name(name: Column, score: Column, most: float = 0.60) -> Column:
    """(score, review, reason): a row that names nobody is kept, its score capped, and to be reviewed for that."""
    nobody = null_like(name).isNull()
    return F.struct(F.when(nobody, F.least(score, F.lit(most))).otherwise(score).alias("score"), nobody.alias("review"), F.when(nobody, "missing_person_name").alias("reason"))


def first_seen(rows: DataFrame, by: list[str], key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key within by, in a total order."""
    nth = F.row_number().over(W.partitionBy(*by, key).orderBy(*order))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")
