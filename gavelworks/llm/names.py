"""Variant spellings of the names of people and bodies, linked within a scope (a school).

1. Every distinct spelling is parsed: a person into surname, given name and middle initial, a body (committee, council ...)
   into its words. Which words are given names, and which nickname stands for which name, is learned from the spellings
   that show it ("Surname, Given"; Given "Nick" Surname), beside a fixed list of common nicknames. What is learned is kept as
   tables and joined to the names; none of it comes to the driver, and what counts as evidence doesn't change with the volume.
2. The rare tokens (surnames; of a body the words that few bodies share) are joined within a scope to the surnames, or to all
   words of bodies, that step 3 could take for the same word: by what is left of both without a few letters, or by beginnings.
3. Names that share similar rare tokens are compared token by token: equal, abbreviated, nickname or misspelt tokens count
   by their similarity, weighted by rarity; tokens that contradict each other (Ann and Robert, B. and C.) rule a pair out.
4. Full names that agree are one entity, through any number of steps. A spelling with only an initial, or only a surname,
   joins the one entity that it fits; where it fits several, it is linked to none of them.

Spellings that name nobody in particular ("unknown", "the chair", a title alone) and nulls are left out.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gavelworks.storage import cut

#: Words that are titles or roles and no part of a name.
TITLES = set(
    "mr mrs ms miss mx dr prof professor hon honorable sir madam rev trustee trustees president pres chair chairman chairwoman "
    "chairperson vice vp member members dean provost chancellor director secretary treasurer clerk superintendent supt commissioner "
    "councilmember regent jr sr ii iii iv phd edd md esq".split()
)
#: Words that name nobody.
NOBODY = set(
    "unknown unnamed none na n a inaudible not stated the an of to by who someone somebody anyone nobody employee employees staff person "
    "board name names tbd tba null nil unidentified unclear speaker various several others other anonymous candidate applicant faculty "
    "instructor audience public motion another one no listed available recorded given specified provided applicable x".split()
)
#: Kinds of bodies with their usual abbreviations.
BODY_WORDS = {
    "committee": "cmte comm cttee cte com",
    "subcommittee": "subcmte subcomm",
    "council": "cncl coun cnl",
    "association": "assn assoc asn",
    "foundation": "fdn found fndn",
    "force": "",
    "board": "bd",
    "senate": "sen",
    "commission": "commn",
    "department": "dept",
    "office": "ofc",
    "union": "",
    "league": "",
    "society": "soc",
    "panel": "",
    "team": "",
    "group": "grp",
    "authority": "auth",
    "federation": "fed",
    "caucus": "",
    "club": "",
    "coalition": "",
    "institute": "inst",
}
BODY_OF = {a: k for k, v in BODY_WORDS.items() for a in [k, *v.split()]} | {"tf": "task force"}
#: Common English and Spanish nicknames (after the colon) of given names: the default of a parameter, to be replaced by a fuller table where there is one.
NICKNAMES = """
abigail: abby abbie gail; alexander: alex al sandy xander; alexandra: alex sandy; andrew: andy drew; anthony: tony; barbara: barb babs;
barnaby: barney; benjamin: ben benny benji; catherine: cathy cate kitty; charles: charlie chuck chas; charlotte: charlie lottie char; christine: chris tina;
christopher: chris kit topher; daniel: dan danny; david: dave davy; deborah: deb debbie debby; dolores: lola lolly; donald: don; dorothy: dot dottie;
edward: ed eddie ned ted teddy; eleanor: ellie nell nora; elizabeth: liz lizzie beth betty betsy eliza libby; eugene: gene; frances: fran; francis: frank;
francisco: paco pancho frank cisco; frederick: fred freddie freddy fritz; gabriela: gabi gabby; gabriel: gabe; gerald: jerry; gregory: greg; guadalupe: lupe lupita;
harold: hal harry; henry: hank harry; hildegard: hilda hildy; ignacio: nacho iggy; isabella: bella izzy isa; jacob: jake; james: jim jimmy jamie; jennifer: jen jenny jenn;
jonathan: jon jonny nathan; john: jack johnny; jose: pepe; joseph: joe joey; joshua: josh; katherine: kate kathy katie kat kit kitty; kenneth: ken kenny;
lawrence: larry laurie; leonard: len lenny leo; margaret: maggie meg peggy marge greta; matilda: tilly tilda mattie; matthew: matt; michael: mike mick mickey;
nathaniel: nate nathan; nicholas: nick nicky nico; octavia: tavi tavia; patricia: pat patty trish tricia; patrick: pat paddy; peter: pete; philip: phil; rebecca: becky;
richard: rich rick dick ricky; robert: bob bobby rob robbie bert; ronald: ron; rosalind: roz rosie ros; samuel: sam sammy; samantha: sam; stephen: steve; steven: steve;
susannah: sue susie suzy susan; susan: sue susie; theodore: ted teddy theo; thomas: tom tommy; timothy: tim; victoria: vicky vickie tori; vincent: vince vinny vin;
walter: walt wally; william: will bill billy liam willy; yolanda: yoli yola; zachary: zach zack zac
"""
#: q-gram length, letters from which a word is joined by its q-grams, and least weighted similarity of two names.
Q, LONG, NAME_SIMILARITY = 2, 16, 0.72
#: A given name or nickname is known if so many spellings show it; a given name, too, if it isn't shown as a surname more often.
SHOWN = 2
#: A word of bodies is a common one from this share of them; so there are at most 100.
COMMON = 0.01


@lru_cache
def nickname_pairs(nicknames: str = NICKNAMES) -> frozenset[tuple[str, str]]:
    """(formal, nickname) of entries "formal: nickname nickname", separated by semicolons."""
    found = set()
    for entry in nicknames.replace("\n", " ").split(";"):
        formal, _, nicks = entry.partition(":")
        found |= {(formal.strip(), n) for n in nicks.split()}
    return frozenset(found)


def fold(text: str) -> str:
    """Without accents, digits typed for letters, glued words ("AnnaLee" is two) and repeated blanks; lower case."""
    text = unicodedata.normalize("NFKD", text)
    text = "".join(c for c in text if not unicodedata.combining(c))
    text = re.sub(r"(?<=[a-z])(?<!\bMc)(?<!\bMac)(?<!\bDe)(?<!\bLa)(?=[A-Z])", " ", text)
    text = re.sub(r"(?<=[A-Za-z])[015](?=[A-Za-z]|\b)|\b[015](?=[A-Za-z]{2})", lambda m: {"0": "o", "1": "l", "5": "s"}[m[0]], text)
    return re.sub(r"\s+", " ", text.lower()).strip()


def _tokens(text: str) -> list[str]:
    return re.findall(r"[a-z]+(?:['’-][a-z]+)*\.?", text)


def parse(name: str | None, turned: bool = False) -> dict:
    """kind (person, body or none), surname, given, nick, middle and words of a spelling; shown: the given name is certain.

    ends: the first and last word of a person's name without a comma; turned: its last word is the given name.
    """
    out = {"kind": "none", "surname": "", "given": "", "nick": "", "middle": "", "words": [], "shown": False, "ends": []}
    text = fold(name or "")
    quoted = re.search(r"[\"“'‘]([a-z]+)[\"”'’](?=\s|$)", text)
    nick = quoted[1] if quoted else ""
    text = re.sub(r"[\"“'‘][a-z]+[\"”'’](?=\s|$)", " ", text)
    bare = re.sub(r"[()\[\]]", " ", text)
    words = [t.rstrip(".") for t in _tokens(bare)]
    if any(w in BODY_OF for w in words) and len(words) > 1 and not set(words) <= TITLES | NOBODY | {"board"}:
        kept = [w for w in words if w not in {"the", "of", "on", "for", "and", "in", "college", "s"}]
        kept = [x for w in kept for x in BODY_OF.get(w, w).split()]
        if [w for w in kept if w not in BODY_OF and w not in TITLES and w != "task"]:
            return out | {"kind": "body", "words": sorted(set(kept))}
    text = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", text)
    parts = [[t.rstrip(".") for t in _tokens(p)] for p in text.split(",")]
    parts = [[t for t in p if t not in TITLES] for p in parts]
    parts = [[x for t in p for x in t.split(".") if x] for p in parts if p]
    every = [t for p in parts for t in p]
    if not every or all(t in NOBODY for t in every):
        return out
    shown, ends = False, []
    if len(parts) > 1 and parts[1]:
        surname, rest, shown = " ".join(parts[0]), parts[1], len(parts[1][0]) > 1
    elif len(every) == 1:
        surname, rest = every[0], []
    else:
        long = [t for t in every if len(t) > 1]
        if not long:
            return out
        if len(long) == 1:
            surname, rest = long[0], [t for t in every if len(t) == 1]
        else:
            ends = [long[0], long[-1]]
            if turned and len(every[-1]) > 1:
                surname, rest = every[0], [every[-1], *every[1:-1]]
            elif turned:
                surname, rest = every[0], every[1:]
            else:
                at = max(i for i, t in enumerate(every) if len(t) > 1)
                surname, rest = every[at], every[:at]
    dotted = re.findall(r"\b([a-z])\.?\s?([a-z])\.(?=\s|$)", text) if rest and len(rest[0]) == 1 else []
    middle = next((t[0] for t in rest[1:] if t), "") or (dotted[0][1] if dotted and not rest[1:] else "")
    return out | {"kind": "person", "surname": surname, "given": rest[0] if rest else "", "nick": nick, "middle": middle, "shown": shown or bool(nick), "ends": ends}


def distance(a: str, b: str, most: int = 3) -> int:
    """Edits (insert, delete, replace, swap neighbours) between two words; most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def allowed(a: str, b: str) -> int:
    """Edits that two spellings of one word may be apart."""
    n = min(len(a), len(b))
    return 0 if n < 4 else 1 if n < 6 else 2 if n < 10 else 3


def reach(a: str, b: str, kind: str) -> int:
    """The most edits between two words at which some names with them are still one: a surname gets two edits where the given names agree."""
    most = allowed(a, b)
    return 2 if most == 1 and kind == "person" else most


def _abbreviates(a: str, b: str) -> bool:
    """Whether the shorter is a beginning of the longer, or has its first letter and its consonants in order."""
    a, b = sorted((a, b), key=len)
    if len(a) < 2 or a[0] != b[0] or len(b) - len(a) < 2:
        return False
    return b.startswith(a)


def given_similarity(a: dict, b: dict) -> float:
    """1 for equal given names, less for initial, nickname, abbreviation or misspelling; 0 for names that contradict each other.

    a and b have given, formals (what it may be a nickname of) and known (whether it is a known given name).
    """
    x, y = a["given"], b["given"]
    if x == y:
        return 1.0
    fa, fb = {x, *a["formals"]}, {y, *b["formals"]}
    if len(x) == 1 or len(y) == 1:
        short, formals = (x, fb) if len(x) <= len(y) else (y, fa)
        return 0.8 if any(f[0] == short for f in formals) else 0.0
    if fa & fb:
        return 0.95
    if _abbreviates(x, y) and len(min(x, y, key=len)) >= 3:
        return 0.9
    if a["known"] and b["known"]:
        return 0.0
    best = 0.0
    for f in fa:
        for g in fb:
            d = distance(f, g)
            if d <= (1 if min(len(f), len(g)) < 7 else 2) and min(len(f), len(g)) >= 4:
                best = max(best, 1 - d / max(len(f), len(g)))
    return best


def body_similarity(a: list[str], b: list[str], weight) -> float:
    """Soft weighted similarity of two bodies' words, each word aligned with its best; 0 if a rare word has no counterpart."""
    used, total, got = set(), 0.0, 0.0
    for x in sorted(a, key=lambda w: -weight(w)):
        best, at = 0.0, None
        for y in b:
            if y in used:
                continue
            d = distance(x, y)
            s = 1.0 if d == 0 else 0.9 if _abbreviates(x, y) else 1 - d / max(len(x), len(y)) if d <= allowed(x, y) else 0.0
            if s > best:
                best, at = s, y
        if at is None:
            return 0.0
        used.add(at)
        total += weight(x)
        got += weight(x) * best
    return 0.0 if len(used) < len(set(b)) else got / total if total else 0.0


def person_similarity(a: dict, b: dict, weight) -> float:
    """Soft weighted similarity of two persons' names; what one of them lacks doesn't count, what contradicts gives 0."""
    d = distance(a["surname"], b["surname"])
    most = allowed(a["surname"], b["surname"])
    if most == 1 and a["given"] and b["given"] and given_similarity(a, b) >= 0.95:
        most = 2
    if d > most or (d > 1 and a["surname"][0] != b["surname"][0]):
        return 0.0
    ws = max(weight(a["surname"]), weight(b["surname"]))
    total, got = ws, ws * (1 - d / max(len(a["surname"]), len(b["surname"])))
    if a["given"] and b["given"]:
        s = given_similarity(a, b)
        if not s:
            return 0.0
        w = max(weight(a["given"]), weight(b["given"])) if min(len(a["given"]), len(b["given"])) > 1 else 1.0
        total, got = total + w, got + w * s
    if a["middle"] and b["middle"]:
        if a["middle"] != b["middle"]:
            return 0.0
        total, got = total + 1, got + 1
    if d and (not a["given"] or not b["given"]) and d > 1:
        return 0.0
    return got / total


_FORM = "surname string, given string, nick string, middle string, words array<string>, kind string, shown boolean, ends array<string>"


def _parsed(names: DataFrame) -> DataFrame:
    """names (scope, name) or (scope, name, turned) in parts, without those that name nobody."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            turned = f["turned"] if "turned" in f else [False] * len(f)
            rows = [parse(n, bool(t)) for n, t in zip(f["name"], turned, strict=True)]
            yield pd.concat([f[["scope", "name"]].reset_index(drop=True), pd.DataFrame(rows, columns=["surname", "given", "nick", "middle", "words", "kind", "shown", "ends"])], axis=1)

    return names.mapInPandas(run, f"scope string, name string, {_FORM}").where("kind <> 'none'")


def _frequent(words: DataFrame, share: float) -> list[tuple]:
    """The values (their count last) that make up at least share of the rows, and come twice: at most 1/share of them."""
    total = words.count()
    return [tuple(r) for r in words.groupBy(*words.columns).count().where(F.col("count") >= max(2, share * total)).collect()]


def spared(words: Column) -> Column:
    """The distinct words that are left when one letter of one of the words is taken out."""
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(w.substr(F.lit(1), i - 1), w.substr(i + 1, F.length(w)))))))


def _near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield f[[distance(a, b, reach(a, b, k)) <= reach(a, b, k) for a, b, k in zip(f["ta"], f["tb"], f["kind"])]]


def similar_tokens(tokens: DataFrame) -> DataFrame:
    """(scope, kind, ta, tb) of every two tokens (scope, kind, token) that may be one word: reach() edits apart or less or, of bodies, abbreviated; both ways, equal ones included.

    Words k edits apart (swaps too) have a word in common that each gives with k letters or fewer taken out; these are joined. Long words have too many of them:
    they are joined by their rarest q-grams, of which an edit spoils q + 1 at most, so that of more than (q + 1) k the words share one. An abbreviation is joined to the beginnings of words.
    """
    key = ["scope", "kind"]
    n = F.length("token")
    k = F.when(n < 6, F.when(F.col("kind") == "person", 2).otherwise(1)).when(n < 10, 2).otherwise(3)
    one = spared(F.array("token"))
    two = spared(one)
    left_over = F.concat(F.array("token"), one, F.when(k > 1, two).otherwise(F.array().cast("array<string>")), F.when(k > 2, spared(two)).otherwise(F.array().cast("array<string>")))
    short = tokens.where((n >= 4) & (n < LONG)).select(*key, "token", F.explode(left_over).alias("part"))
    padded = F.concat(F.lit("^" * (Q - 1)), F.col("token"), F.lit("$" * (Q - 1)))
    # a pair with one word below LONG and one not below is among these too
    grams = tokens.where(n >= LONG - 3).select(*key, "token", F.posexplode(F.transform(F.sequence(F.lit(1), F.length(padded) - Q + 1), lambda i: padded.substr(i, F.lit(Q)))).alias("at", "gram"))
    counted = grams.withColumn("part", F.concat("gram", F.row_number().over(W.partitionBy(*key, "token", "gram").orderBy("at")).cast("string")))
    frequency = counted.groupBy("part").agg(F.count("*").alias("df"))
    nth = F.row_number().over(W.partitionBy(*key, "token").orderBy("df", "part"))
    long = counted.join(frequency.hint("merge"), "part").withColumn("nth", nth).where(F.col("nth") <= (Q + 1) * 3 + 1).select(*key, "token", "part")
    near = (F.col("ta") < F.col("tb")) & (F.abs(F.length("ta") - F.length("tb")) <= 3)
    met = None
    for keys in (short, long):
        left, right = (keys.select(*key, "part", F.col("token").alias(t)) for t in ("ta", "tb"))
        own = left.join(right.hint("merge"), [*key, "part"]).where(near).select(*key, "ta", "tb")
        met = own if met is None else met.unionByName(own)
    pairs = met.distinct().mapInPandas(_near, "scope string, kind string, ta string, tb string")
    words = tokens.where("kind = 'body'")
    begun = words.where(n >= 4).select(*key, F.col("token").alias("tb"), F.explode(F.transform(F.sequence(F.lit(2), F.greatest(n - 2, F.lit(2))), lambda i: F.col("token").substr(F.lit(1), i))).alias("ta"))
    abbreviated = begun.join(words.select(*key, F.col("token").alias("ta")).hint("merge"), [*key, "ta"]).select(*key, "ta", "tb")
    pairs = pairs.unionByName(abbreviated)
    both = pairs.unionByName(pairs.select(*key, F.col("tb").alias("ta"), F.col("ta").alias("tb")))
    return both.unionByName(tokens.select(*key, F.col("token").alias("ta"), F.col("token").alias("tb"))).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node of each node's connected component. edges (a, b) go both ways.

    Each round takes the smallest label among neighbours, then the label of that label; rounds end when nothing changes.
    """
    labels = cut(nodes.select("node", F.col("node").alias("comp")))
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("m"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", F.least("comp", F.coalesce("m", "comp")).alias("comp"), F.col("comp").alias("old"))
        jump = step.select(F.col("node").alias("n2"), F.col("comp").alias("c2"))
        new = cut(step.join(jump, step["comp"] == jump["n2"], "left").select("node", F.least("comp", F.coalesce("c2", "comp")).alias("comp"), "old"))
        if not new.where("comp <> old").head(1):
            return new.select("node", "comp")
        labels = new.select("node", "comp")


def link_names(names: DataFrame, nicknames: str = NICKNAMES) -> DataFrame:
    """(scope, name, entity) of each distinct spelling of names (scope, name) that names a person or a body.

    nicknames: a list of common nicknames, as nickname_pairs() reads it; those that spellings show are learned beside it.

    entity is the same for the spellings that mean the same one. A null scope is a scope of its own; null names are left out.
    """
    spelled = cut(names.select("scope", "name").where("name is not null").distinct())
    first = cut(_parsed(spelled))
    fixed = names.sparkSession.createDataFrame(sorted(nickname_pairs(nicknames)), "formal string, nick string")
    learned = first.where("nick <> '' and length(given) > 1").groupBy(F.col("given").alias("formal"), "nick").count().where(F.col("count") >= SHOWN).select("formal", "nick")
    pairs = cut(fixed.unionByName(learned).distinct())
    shown = first.where("shown and kind = 'person' and length(given) > 1")
    as_given, as_surname = (shown.groupBy(F.col(c).alias("word")).agg(F.count("*").alias(c)) for c in ("given", "surname"))
    sure = as_given.where(F.col("given") >= SHOWN).join(as_surname, "word", "left").where(F.col("given") >= F.coalesce("surname", F.lit(0))).select("word")
    known = cut(sure.union(pairs.select("formal")).union(pairs.select("nick")).distinct().withColumn("known", F.lit(True)))
    common = {w: n for w, n in _frequent(first.where("kind = 'body'").select(F.explode("words").alias("w")), COMMON)} | dict.fromkeys(BODY_OF.values(), 1000)
    commons = list(common)
    # "Surname Given" is told from "Given Surname" by which of the two words is a known given name
    ends = first.where("size(ends) = 2").select("scope", "name", F.col("ends")[0].alias("head"), F.col("ends")[1].alias("tail"))
    tails = ends.join(known.select(F.col("word").alias("tail")), "tail", "left_semi").join(known.select(F.col("word").alias("head")), "head", "left_anti").select("scope", "name", F.lit(True).alias("turned"))
    same = spelled["scope"].eqNullSafe(tails["scope"]) & (spelled["name"] == tails["name"])
    parsed = _parsed(spelled.join(tails, same, "left").select(spelled["scope"], spelled["name"], F.coalesce("turned", F.lit(False)).alias("turned")))
    key = F.xxhash64("scope", "kind", "surname", "given", "middle", F.concat_ws(" ", "words"))
    parsed = cut(parsed.withColumn("form", key).withColumn("scope", F.coalesce("scope", F.lit(""))))
    forms = parsed.dropDuplicates(["form"]).select("form", "scope", "kind", "surname", "given", "middle", "words")
    # what is known of each given name: whether it is one, what it may stand for, and how many have it
    of_nick = pairs.groupBy(F.col("nick").alias("given")).agg(F.sort_array(F.collect_set("formal")).alias("formals"))
    givens = parsed.where("length(given) > 1").groupBy("given").agg(F.count("*").alias("given_df"))
    forms = forms.join(of_nick, "given", "left").join(known.withColumnRenamed("word", "given"), "given", "left").join(givens, "given", "left")
    forms = cut(forms.withColumn("formals", F.coalesce("formals", F.array().cast("array<string>"))).withColumn("known", F.coalesce("known", F.lit(False))).withColumn("given_df", F.coalesce("given_df", F.lit(1))))
    rare = F.array_except("words", F.lit(commons)) if commons else F.col("words")
    rare = F.when(F.size(rare) > 0, rare).otherwise(F.col("words"))
    keyed = forms.withColumn("token", F.explode(F.when(F.col("kind") == "person", F.array("surname")).otherwise(rare)))
    frequency = keyed.groupBy("kind", "token").agg(F.count("*").alias("df"))
    keyed = cut(keyed.join(frequency, ["kind", "token"]))
    n_forms = max(2, keyed.count())
    # the rare words of one are met with every word of the other, which may have the word as a common one
    whole = forms.withColumn("token", F.explode(F.when(F.col("kind") == "person", F.array("surname")).otherwise(F.col("words"))))
    whole = cut(whole.join(frequency, ["kind", "token"], "left").withColumn("df", F.coalesce("df", F.lit(1))))
    near = similar_tokens(whole.select("scope", "kind", "token").distinct())
    a = keyed.select(*[F.col(c).alias(f"{c}_a") for c in keyed.columns])
    b = whole.select(*[F.col(c).alias(f"{c}_b") for c in whole.columns])
    cand = near.join(a.hint("merge"), (F.col("scope") == F.col("scope_a")) & (F.col("kind") == F.col("kind_a")) & (F.col("ta") == F.col("token_a"))).join(
        b.hint("merge"), (F.col("scope") == F.col("scope_b")) & (F.col("kind") == F.col("kind_b")) & (F.col("tb") == F.col("token_b"))
    )
    full = lambda s: (F.col(f"kind_{s}") == "body") | (F.length(f"given_{s}") > 1)
    # full names are compared once; partial ones are compared with every other name, as the first of the two
    cand = cand.where((full("a") & full("b") & (F.col("form_a") < F.col("form_b"))) | (~full("a") & (F.col("form_a") != F.col("form_b"))))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import math

        parts = ("surname", "given", "middle", "formals", "known")
        for f in frames:
            got = []
            for r in f.to_dict("records"):
                df = max(r["df_a"], r["df_b"])
                counts = {r["given_b"]: r["given_df_b"], r["given_a"]: r["given_df_a"], r["token_a"]: df, r["token_b"]: df} | ({} if r["kind"] == "person" else common)
                weight = lambda w: math.log(1 + n_forms / counts.get(w, 1))  # noqa: E731, B023
                if r["kind"] == "body":
                    got.append((body_similarity(list(r["words_a"]), list(r["words_b"]), weight), 0))
                else:
                    x, y = ({p: r[f"{p}_{s}"] for p in parts} for s in "ab")
                    got.append((person_similarity(x, y, weight), distance(x["surname"], y["surname"])))
            out = f[["form_a", "form_b", "rank_a", "rank_b"]].copy()
            out["score"], out["apart"] = [s for s, _ in got], [d for _, d in got]
            yield out[out["score"] >= NAME_SIMILARITY]

    rank = lambda s: F.when(full(s), 2).when(F.length(f"given_{s}") == 1, 1).otherwise(0)
    wanted = ["kind", *[f"{c}_{s}" for c in ("form", "surname", "given", "middle", "words", "token", "df", "formals", "known", "given_df") for s in "ab"]]
    links = cut(
        cand.select(*wanted, rank("a").alias("rank_a"), rank("b").alias("rank_b")).mapInPandas(compare, "form_a long, form_b long, rank_a int, rank_b int, score double, apart int").distinct()
    )
    nodes = forms.select(F.col("form").alias("node"))
    edges = links.where("rank_a = 2 and rank_b = 2").select(F.col("form_a").alias("a"), F.col("form_b").alias("b"))
    edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    entity = components(nodes, edges)
    for rank_now in (1, 0):
        # the entities of fuller names that fit, of those with the nearest surname; one of them takes the name in
        fits = links.where((F.col("rank_a") == rank_now) & (F.col("rank_b") > rank_now)).join(entity, F.col("form_b") == F.col("node"))
        best = fits.groupBy("form_a", "comp").agg(F.min("apart").alias("apart"))
        nearest = best.groupBy("form_a").agg(F.min("apart").alias("least"))
        only = best.join(nearest, "form_a").where("apart = least").groupBy("form_a").agg(F.count("*").alias("n"), F.min("comp").alias("to"))
        entity = cut(entity.join(only.where("n = 1"), entity["node"] == only["form_a"], "left").select("node", F.coalesce("to", "comp").alias("comp")))
    return parsed.join(entity, parsed["form"] == entity["node"]).select("scope", "name", F.col("comp").alias("entity"))


def variant_pairs(names: DataFrame, nicknames: str = NICKNAMES) -> DataFrame:
    """(scope, name_a, name_b), name_a < name_b: the different spellings of names (scope, name) that mean the same one."""
    linked = cut(link_names(names, nicknames))
    a = linked.select("scope", "entity", F.col("name").alias("name_a"))
    b = linked.select("scope", "entity", F.col("name").alias("name_b"))
    return a.join(b.hint("merge"), ["scope", "entity"]).where("name_a < name_b").select("scope", "name_a", "name_b").distinct()
