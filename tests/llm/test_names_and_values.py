from gavelworks.llm import canonical, names

PEOPLE = [
    "Susannah B. Naulifold", "Naulifold, Sue", "SUSANNAH NAULIFOLD", "SusannahNaulifold", "S. Naulifold", "Susanah Naulifold", "Trustee Susannah Naulifold",
    "Robert Tasko", "Tasko, Bob", "James Tasko", "Tasko (trustee)", "Policy Committee (Pamine)", "Pamine Pol. Cmte", "the Pamine Policy Committee", "Pamine Audit Committee",
    "unknown", "the chair", "", " ", "N/A", "x" * 3000,
]


def entities(spark, rows):
    df = spark.createDataFrame([(*r, "z") for r in rows], "scope string, name string, entity string")
    groups = {}
    for r in names.link_names(df).collect():
        groups.setdefault((r.scope, r.entity), set()).add(r.name)
    return groups


def test_spellings_of_one_entity_are_linked(spark):
    rows = [("a", n) for n in PEOPLE] + [("a", None), ("a", "Robert Tasko"), ("b", "Robert Tasko"), (None, "Bob Tasko")]
    groups = entities(spark, rows)
    of = {(s, n): e for (s, e), ns in groups.items() for n in ns}
    assert len({of[("a", n)] for n in PEOPLE[:7]}) == 1
    assert of[("a", "Robert Tasko")] == of[("a", "Tasko, Bob")] != of[("a", "James Tasko")]
    assert of[("a", "Tasko (trustee)")] not in {of[("a", "Robert Tasko")], of[("a", "James Tasko")]}
    assert of[("a", "Pamine Pol. Cmte")] == of[("a", "Policy Committee (Pamine)")] == of[("a", "the Pamine Policy Committee")] != of[("a", "Pamine Audit Committee")]
    assert not {("a", n) for n in ("unknown", "the chair", "", " ", "N/A")} & set(of)
    assert ("b", "Robert Tasko") in of and ("", "Bob Tasko") in of


def test_pairs_and_empty(spark):
    df = spark.createDataFrame([("a", "Ann Bolworth"), ("a", "ann bolworth"), ("b", "Ann  Bolworth")], "scope string, name string")
    assert [tuple(r) for r in names.variant_pairs(df).collect()] == [("a", "Ann Bolworth", "ann bolworth")]
    assert names.variant_pairs(df.limit(0)).count() == 0


def test_similar_tokens_match_brute_force(spark):
    words = ["naulifold", "nauliflod", "naulifod", "tasko", "taskow", "togeda", "toged", "trogeda", "zz"]
    df = spark.createDataFrame([("s", "person", w) for w in words], "scope string, kind string, token string")
    grams = {w: {f"^{w}$"[i : i + 2] for i in range(len(w) + 1)} for w in words}
    want = {(a, b) for a in words for b in words if a == b or len(grams[a] & grams[b]) >= 0.3 * len(grams[a] | grams[b]) and names.distance(a, b, 3) <= 3}
    got = {(r.ta, r.tb) for r in names.similar_tokens(df).collect()}
    assert want <= got and len(got) < len(words) ** 2


def test_every_pair_that_verification_takes_is_met(spark):
    words = ["tharkey", "thaokye", "cruz", "curz", "crzu", "naulifold", "nualiflod", "fin", "finance", "finances", "ad", "administration", "adminsitratoin", "aaaaaaaaaaaa", "aaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaa", "abracadabraabracadabra", "abarcadabraabarcadabraa", "zz", "zzz"]
    df = spark.createDataFrame([("s", k, w) for k in ("person", "body") for w in words], "scope string, kind string, token string")
    fits = lambda k, a, b: names.distance(a, b, 3) <= names.reach(a, b, k) or (k == "body" and names._abbreviates(a, b))
    want = {(k, a, b) for k in ("person", "body") for a in words for b in words if fits(k, a, b)}
    assert {(r.kind, r.ta, r.tb) for r in names.similar_tokens(df).collect()} == want
    pairs = [("Rob Thaokye", "Tharkey, Robert"), ("Ann Cruz", "Ann Curz"), ("Fin Committee", "Finances Committee")]
    linked = names.variant_pairs(spark.createDataFrame([(str(i), n) for i, p in enumerate(pairs) for n in p], "scope string, name string"))
    assert {(r.name_a, r.name_b) for r in linked.collect()} == {tuple(sorted(p)) for p in pairs}


def test_distance():
    assert [names.distance(*x) for x in (("abc", "abc"), ("abc", "acb"), ("abc", "abd"), ("abcdef", "badcfe"), ("a", "xxxxx"))] == [0, 1, 1, 3, 4]


def test_values_are_mapped_or_reported(spark):
    reference = spark.createDataFrame(
        [("l", "food_services", "Food services", "cafeteria, catering"), ("l", "legal_fees", "Legal fees", None), ("l", "career_technical", "Career and technical education", "CTE"), ("m", "grants", "Grants", "")],
        "list string, code string, label string, note string",
    )
    typed = {
        "Food srvices": "food_services", "services, food": "food_services", "CATERING - FY25": "food_services", "foodservices": "food_services", "honorarios legales": "legal_fees",
        "C.T.E.": "career_technical", "lgeal fees": "legal_fees", "weather": "unmatched", "": "unmatched", "???": "unmatched", "word " * 3000: "unmatched",
    }
    values = spark.createDataFrame([("l", v, 1) for v in typed] + [("l", None, 1), ("l", "weather", 2), ("nolist", "Food services", 1)], "list string, value string, code int")
    got = {(r.list, r.value): r.code for r in canonical.map_values(values, reference).collect()}
    assert got == {("l", v): c for v, c in typed.items()} | {("nolist", "Food services"): "unmatched"}
    assert canonical.map_values(values.limit(0), reference).count() == 0
    assert {r.code for r in canonical.map_values(values, reference.limit(0)).collect()} == {"unmatched"}
