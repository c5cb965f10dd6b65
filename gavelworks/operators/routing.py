"""Questions sorted by what answers them: nothing, a comparison, the latest meeting, tables, texts, or both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of questions, in any case.
OFF_TOPIC = (
    r"\b(weather forecast|today('s)? weather|temperature outside|what('s| is) the weather|weather (in|for) [a-z ]{2,20}(today|tomorrow|right now)|"
    r"recipe for|how to cook|cooking (tip|hack)|tell me a joke|write me a (poem|story|song)|generate (code|an? essay)|"
    r"(nfl|nba|mlb|nhl|fifa) (score|game|match|player|team)|(football|baseball|basketball|soccer) (score|game|player|team|match)|"
    r"stock (price|ticker|market)|crypto(currency)?|bitcoin|ethereum|celebrity (news|gossip)|who is (dating|married to)|"
    r"president of (the us|america|united states)|who (is|was) (trump|biden|obama|harris|elon|musk)|"
    r"(hello|hi there|hey there|good morning|good evening|how are you|what('s| is) up|thank(s| you)|bye|goodbye|see you))\b"
)
COMPARES = (
    r"\b(compare[ds]?|comparison|better than|worse than|vs\.?|versus|difference between|which (college|school|institution)s? (is|are|has|have|does|do|did|was|were)|"
    r"(more|less|higher|lower|greater|fewer) than .{1,20} (college|school)|across (schools|colleges|institutions|campuses))\b"
)
LATEST = r"\b(last|latest|most recent|most-recent|newest|recent)(\s+\w+){0,4}\s+(board\s+)?meetings?\b"
SEVERAL = r"\b(\d+|two|three|four|five|six|seven|eight|nine|ten|several|multiple|few|couple)\b"
ON_VOTES = r"\b(how did the board vote|what did (they|the board) vote|vote result|motion (to|that)|was (it|the motion) approved|pass(ed)?|unanimously|who voted|roll.?call|board action)\b"
ON_MONEY = (
    r"\b(budget (item|amendment|adjustment|approved|modified|cut)|financial (action|adjustment|approval)|appropriat|expenditure|how much (was|did)|dollar|fund(ing|ed)?|allocat|contract (value|amount)|"
    r"what (was|were) approved? (budget|financ)|tuition (increase|decrease|chang|set))\b"
)
ON_PEOPLE = (
    r"\b(who was (hired|appointed|promoted|terminated|reassigned|named|selected)|new (chancellor|president|cfo|coo|vp|dean|director|provost|superintendent)|personnel (action|change|decision)|"
    r"executive (hire|appointment)|who (got|received) the (position|role|job)|employment (action|decision))\b"
)
NARRATIVE = (
    r"\b(what (concern|reason|rationale|argument|sentiment|opinion|view|position|theme|issue|problem|challenge)|why did|why (was|were|is|are)|"
    r"how did (trustees|board members|the board) (feel|react|respond|discuss|describe)|what (was|were) (said|discussed|raised|mentioned|brought up) about|"
    r"trustee (comment|remark|question|concern)|background|context|general (discussion|sentiment|feeling))\b"
)
MIXED = (
    r"\b(what (action|step|decision)s? (were|was) taken (regarding|about|on|for)|(construction|capital|bond|facility|facilities|building) (project|improvement|work|discussed|approved)|"
    r"(contract|vendor|contractor) (discussion|approval|vote|award)|(outside|external) (vendor|contractor)|contracts? with (outside|external|vendor)|tuition (and|or) fee|financial aid|student fee|"
    r"what (is|are|was|were) (the college|the board|they) (implement|launch|deploy|roll.?out|pilot|introduc|invest|pursu|develop|plan)|"
    r"what (initiative|program|project|effort|plan|strategy|pilot|rollout)s? (is|are|was|were)|"
    r"(ai|artificial intelligence|technology|tech|innovation|workforce|equity|strategic) (initiative|program|plan|investment|effort|project|pilot)|what (new|recent) (program|initiative|effort|investment|technolog)|"
    r"what (are|is|were|was) (colleges?|schools?|institutions?|they) (doing|working on|talking about|discussing|implementing|planning|saying) (about|with|on|regarding)?|"
    r"(colleges?|schools?) (doing|working on|talking|discussing) (with|about|on) (ai|technology|tech|workforce|equity|innovation)|"
    r"(ai|artificial intelligence|robotics|technology) (program|degree|course|bachelor|certif|initiative|investment))\b"
)
#: What points to a table, beside the patterns above. A word boundary binds the first and last alternative only.
TABLE_HINTS = {
    "votes": (ON_VOTES, r"\bvote|motion|approv|pass|second|aye|nay\b"),
    "financial_items": (ON_MONEY, r"\bbudget|financ|fund|dollar|contract|vendor|expenditure|allocat|construction|capital|bond|facilit|building\b"),
    "personnel_actions": (ON_PEOPLE, r"\bhired?|appoint|promot|terminat|reassign|personnel|staff|executive\b"),
    "initiatives": (r"\b(implement|launch|deploy|roll.?out|pilot|introduc|invest|pursu|develop|initiative|program|effort|strategy|plan|ai|artificial intelligence|technology|innovation|workforce|strategic|equity)\b",),
}
ROUTES = ["none", "compare", "latest_meeting", "hybrid", "sql", "rag"]


def asks(c: Column, pattern: str) -> Column:
    return c.rlike(f"(?i){pattern}")


def tables_of(question: Column) -> Column:
    """The tables that a question points to, in order; without any hint all but initiatives."""
    hits = F.array_compact(F.array(*[F.when(F.greatest(*[asks(question, p) for p in (*ps, ps[0])]), name) for name, ps in TABLE_HINTS.items()]))
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(*[F.lit(t) for t in TABLE_HINTS if t != "initiatives"]))


def schools_of(question: Column, aliases: dict[str, list[str]]) -> Column:
    """The slugs that a question names by one of their aliases, as whole words in any case, by where the longest alias that occurs stands; a small table of aliases is given."""
    found = []
    for slug, names in aliases.items():
        at = F.lit(0)
        for name in sorted(names, key=len):  # the longest alias is asked first, so it comes outermost
            pattern = r"(?i)\b" + "".join(f"\\{c}" if c in ".()+*?[]{}|^$" else c for c in name) + r"\b"
            here = F.regexp_instr(question, F.lit(pattern))
            at = F.when(here > 0, here).otherwise(at)
        found.append(F.when(at > 0, F.struct(at.alias("at"), F.lit(slug).alias("slug"))))
    return F.transform(F.array_sort(F.array_compact(F.array(*found))), lambda x: x["slug"])


def route(question: Column, n_schools: Column) -> Column:
    """none, compare, latest_meeting, hybrid, sql or rag, the first that holds; null if nothing does and a model has to tell."""
    tabular = F.greatest(*[asks(question, p) for p in (ON_VOTES, ON_MONEY, ON_PEOPLE)])
    told = asks(question, NARRATIVE)
    span = F.regexp_extract(question, f"(?i){LATEST}", 0)
    return (
        F.when(asks(question, OFF_TOPIC), "none")
        .when(asks(question, COMPARES) | (n_schools >= 2), "compare")
        .when((span != "") & ~asks(span, SEVERAL), "latest_meeting")
        .when(asks(question, MIXED) | (tabular & told), "hybrid")
        .when(tabular, "sql")
        .when(told, "rag")
    )


def labelled_route(answer: Column) -> Column:
    """The route that a model's answer names; hybrid if it names none."""
    name = F.lower(F.regexp_extract(F.upper(answer), r"\b(SQL|RAG|HYBRID|COMPARE|NONE)\b", 1))
    return F.when(name != "", name).otherwise("hybrid")


def routed(questions: DataFrame, id_col: str, text_col: str, aliases: dict[str, list[str]]) -> DataFrame:
    """(id, route, tables, schools) of questions; tables and schools are joined by commas. Null questions have no route. Texts answered by no table have no tables."""
    q = F.trim(F.col(text_col))
    schools = schools_of(q, aliases)
    own = questions.select(id_col, q.alias("_q"), schools.alias("_s")).withColumn("route", route(F.col("_q"), F.coalesce(F.size("_s"), F.lit(0))))
    tables = F.when(F.col("route").isin("none", "rag") | F.col("_q").isNull(), "").otherwise(F.array_join(tables_of(F.col("_q")), ","))
    return own.select(id_col, "route", tables.alias("tables"), F.coalesce(F.array_join("_s", ","), F.lit("")).alias("schools"))


def numbered_sources(chunks: DataFrame, with_tables: Column) -> DataFrame:
    """chunks (query_id, rank, ...) with the number of their citation: the block of table rows is 1 where there is one, chunks follow by rank."""
    return chunks.withColumn("citation", F.col("rank") + with_tables.cast("int"))


def assembled(routed_questions: DataFrame, blocks: DataFrame, passages: DataFrame, id_col: str) -> DataFrame:
    """(id, route, context, n_sources): what a model is given to answer each question of routed().

    blocks (table, school, block) are the records' texts, passages (id, rank, text) what retrieval found. A question without a route is taken as hybrid, one
    of route none gets no context. Records are those of the question's tables and of the schools that it names (of all schools if it names none), tables in their order and
    schools in the order of mention; together they are source 1. Passages follow by rank. rag and none take no records; sql takes no passages.
    """
    own = routed_questions.select(F.col(id_col).alias("_id"), F.coalesce("route", F.lit("hybrid")).alias("route"), "tables", "schools")
    asked = own.where(~F.col("route").isin("none", "rag")).select("_id", F.posexplode(F.split(F.when(F.col("tables") != "", F.col("tables")).otherwise(",".join(t for t in TABLE_HINTS if t != "initiatives")), ",")).alias("t", "table"), "schools")
    named = asked.where("schools <> ''").select("_id", "t", "table", F.posexplode(F.split("schools", ",")).alias("s", "school"))
    held = blocks.where("block is not null").select("table", "school", "block")
    # blocks of all schools are put together once, and not for each question
    every = held.groupBy("table").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("school", "block"))), lambda x: x["block"]), "\n").alias("block"))
    found = named.join(held, ["table", "school"]).select("_id", "t", "s", "block").unionByName(asked.where("schools = ''").join(every, "table").select("_id", "t", F.lit(0).alias("s"), "block"))
    rows = found.groupBy("_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "s", "block"))), lambda x: x["block"]), "\n").alias("rows"))
    wanted = passages.select(F.col(id_col).alias("_id"), "rank", "text").join(own.where(~F.col("route").isin("none", "sql")).select("_id"), "_id", "left_semi")
    texts = wanted.groupBy("_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("texts"))
    both = own.join(rows, "_id", "left").join(texts, "_id", "left")
    sources = F.concat(F.when(F.col("rows").isNotNull(), F.array("rows")).otherwise(F.array().cast("array<string>")), F.coalesce("texts", F.array().cast("array<string>")))
    numbered = F.transform(sources, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x))
    context = F.when(F.col("route") != "none", F.array_join(numbered, "\n\n"))
    return both.select(F.col("_id").alias(id_col), "route", context.alias("context"), F.size(sources).alias("n_sources"))
