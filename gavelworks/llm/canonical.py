"""Freely typed values, mapped to the entries of a reference list, or reported as unmatched.

1. Values are cut into tokens; distinct tokens are repaired against the list's vocabulary (the words of its codes, labels and
   notes): by edits (joined on the strings that remain when up to two letters are deleted), as abbreviations (beginnings,
   or letters in order), by a common stem, and through a thesaurus of synonyms and translations.
2. Each value's repaired tokens are scored against each entry by soft TF-IDF: the weight of the tokens that the entry has,
   by similarity, over the weight of all; rare words of the list count more. The best entry wins if it reaches MIN_SCORE.
3. Values that no entry reaches (glued words, many typos) are compared as a whole with the labels by their letter pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelworks.llm.names import distance, spared
from gavelworks.storage import cut

UNMATCHED = "unmatched"
#: Least share of a value's weight that an entry must have, and least similarity of letter pairs of whole values.
MIN_SCORE, MIN_WHOLE = 0.52, 0.5
#: Words without meaning of their own in a category.
FILLER = set("a al an and by de del el en etc for fund in item la las los of on or paid prog program rate rates the to w with y district cat fy bill bills no".split())
#: Abbreviations, synonyms and Spanish words (before the colon) with words of the reference lists that they may stand for: the default of a parameter.
THESAURUS = """
acreditacion: accreditation; adultos: adult; alfabetizacion: literacy; arrendamiento: lease; auditoria: audit; becas: scholarships; biblioteca: library;
bienestar: wellness; bonos: bond; bgt: budget; cap: capital; capacitacion: training; colaboracion: partnerships; compra: purchase; comunidad: community; comunitarias: community;
computing: computers; construccion: construction; contrato: contract; cuotas: fees; curriculo: curriculum; deportes: athletics sports; deuda: debt;
dev: training; distancia: distance; doble: dual; educacion: education; electric: power; electricity: power; emision: issue; energia: energy; enmienda: amendment;
equidad: equity; equipo: equipment; escala: schedule; estabilidad: stability; estudiantil: student; estudiantes: student students; exito: success; externa: outside; financiera: financial fiscal;
fiscal: fiscal; gastos: expense; go: bond; gobierno: governance; gobernanza: governance; honorarios: fees; hs: high school; hr: personnel; informatica: information; ingresos: revenue;
instalaciones: facilities; internacionales: international; junta: board; laboral: workforce; lawyer: attorneys; lawyers: attorneys; legales: legal; licencia: license; linea: online;
mantenimiento: maintenance; matricula: enrollment tuition; partners: partnerships; prima: premium; presupuesto: budget; profesional: professional; profesionales: professional; programas: programs;
proyecto: project; publicos: utilities; salarial: salary; salario: salary; salud: health; saas: software; sale: selling; seguridad: safety; seguro: insurance; seguros: insurance;
servicio: service; servicios: services utilities; soldier: soldiers; subvencion: grant; subvenciones: grant; sw: software; tecnica: technical; tecnologia: technology; trabajo: job;
transferencia: transfer; uni: university; veteranos: veterans; viaje: travel; viajes: travel; vocational: technical; vets: veterans; wf: workforce; xfer: transfer; svc: service services; svcs: services
"""


def fold(c: Column) -> Column:
    """Lower case without accents and apostrophes; dotted capitals ("C.T.E.") are one word."""
    text = F.translate(F.lower(c), "áàâäãéèêëíìîïóòôöõúùûüñç'’", "aaaaaeeeeiiiiooooouuuunc")
    return F.regexp_replace(text, r"\b([a-z])\.([a-z])\.(?:([a-z])\b\.?)?", "$1$2$3 ")


def tokens_of(c: Column) -> Column:
    """The distinct runs of letters (digits inside a word are read as the letters they look like) that aren't filler."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(fold(c), r"\(new\)", " "), r"(?<=[a-z])0|0(?=[a-z]{2})", "o"), r"(?<=[a-z])1|1(?=[a-z]{2})", "l"), r"(?<=[a-z])5", "s")
    words = F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z]+"), 0))
    return F.filter(words, lambda w: ~w.isin(*sorted(FILLER)) & ((F.length(w) > 1)))


def letter_pairs(c: Column) -> Column:
    """The distinct pairs of neighbouring letters, other characters left out."""
    text = F.regexp_replace(F.regexp_replace(fold(c), r"\b(cat|item|prog|etc|new|district|fy)\b", ""), "[^a-z]+", "")
    return F.when(F.length(text) > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: text.substr(i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def deletions(word: Column) -> Column:
    """A word, and what is left of it without one (from 4 letters) or two (from 6) of its letters."""
    one = spared(F.array(word))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.array(word), F.when(F.length(word) > 3, one).otherwise(none), F.when(F.length(word) > 5, spared(one)).otherwise(none)))


def _similarity(token: str, term: str) -> float:
    """1 for the same word, less for misspellings, plurals, stems and abbreviations; 0 for other words."""
    if token == term:
        return 1.0
    n = min(len(token), len(term))
    d = distance(token, term, 2)
    best = 1 - d / (max(len(token), len(term)) + 4) if n > 3 and d <= (1 if n < 6 else 2) else 0.0
    same = next((i for i, (x, y) in enumerate(zip(token, term, strict=False)) if x != y), n)
    if same == n and len(token) < len(term) and n > 1:
        best = max(best, 0.9)  # a beginning
    elif same >= 4 and same >= 0.6 * n:
        best = max(best, 0.8)  # a common stem
    elif 2 <= len(token) <= 6 and len(token) < len(term) and token[0] == term[0]:
        rest = iter(term)
        if all(c in rest for c in token) and not any(c in "aeiou" for c in token[1:]):
            best = max(best, 0.85)  # letters in order
    return best


def _scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        f = f.assign(s=[_similarity(a, b) for a, b in zip(f["token"], f["term"], strict=True)])
        yield f[f["s"] > 0]


def thesaurus_rows(thesaurus: str) -> list[tuple[str, str]]:
    """(word, term) of each entry "word: term term"; entries are separated by semicolons."""
    entries = [e.split(":") for e in thesaurus.replace("\n", " ").split(";") if ":" in e]
    return [(word.strip(), t) for word, terms in entries for t in terms.split()]


def repair(tokens: DataFrame, terms: DataFrame, thesaurus: str = THESAURUS) -> DataFrame:
    """(list, token, term, s, synonym): the terms of the list that each distinct token may stand for, their similarity, and whether only the thesaurus says so.

    Candidates share what is left without a letter or two, the first four letters, or are a beginning (the whole token is the key), or letters
    in order (keyed by the first letter and one later consonant): no key is held by more terms than have these letters.
    """
    spark = tokens.sparkSession
    own = tokens.withColumn("k", F.explode(deletions(F.col("token"))))
    goal = terms.withColumn("k", F.explode(deletions(F.col("term"))))
    by_edit = own.join(goal, ["list", "k"]).select("list", "token", "term")
    stem = tokens.where("length(token) > 3").withColumn("k", F.substring("token", 1, 4))
    by_stem = stem.join(terms.where("length(term) > 3").withColumn("k", F.substring("term", 1, 4)), ["list", "k"]).select("list", "token", "term")
    begun = terms.where("length(term) > 2").select("list", "term", F.explode(F.expr("transform(sequence(2, length(term) - 1), i -> substring(term, 1, i))")).alias("token"))
    by_beginning = tokens.join(begun, ["list", "token"]).select("list", "token", "term")
    later = F.array_distinct(F.filter(F.split(F.substring("term", 2, 99), ""), lambda x: ~x.isin("a", "e", "i", "o", "u", "")))
    skeletons = terms.select("list", "term", F.explode(F.transform(later, lambda x: F.concat(F.substring("term", 1, 1), x))).alias("k"))
    bare = tokens.where("length(token) between 2 and 6 and not substring(token, 2) rlike '[aeiou]'").withColumn("k", F.substring("token", 1, 2))
    by_letters = bare.join(skeletons, ["list", "k"]).where("length(term) > length(token) and term rlike array_join(split(token, ''), '.*')").select("list", "token", "term")
    met = by_edit.unionByName(by_stem).unionByName(by_beginning).unionByName(by_letters).distinct()
    scored = met.mapInPandas(_scored, "list string, token string, term string, s double").withColumn("synonym", F.lit(False))
    known = F.broadcast(spark.createDataFrame(thesaurus_rows(thesaurus), "word string, term string")).join(terms, "term").select("list", "word", "term")
    exact = tokens.join(known.withColumnRenamed("word", "token"), ["list", "token"]).select("list", "token", "term", F.lit(0.95).alias("s"))
    # a word of the thesaurus may be misspelt, too
    words = known.where("length(word) > 5").select("list", "word").distinct().withColumn("k", F.explode(deletions(F.col("word"))))
    near = own.where("length(token) > 5").join(words, ["list", "k"]).where("word <> token").select("list", "token", F.col("word").alias("term")).distinct()
    near = near.mapInPandas(_scored, "list string, token string, term string, s double").where("s > 0.85").withColumnRenamed("term", "word")
    near = near.join(known, ["list", "word"]).select("list", "token", "term", (F.col("s") * 0.95).alias("s"))
    both = scored.unionByName(exact.unionByName(near).withColumn("synonym", F.lit(True)))
    return both.groupBy("list", "token", "term").agg(F.max("s").alias("s"), F.min("synonym").alias("synonym"))


def map_values(values: DataFrame, reference: DataFrame, thesaurus: str = THESAURUS, min_score: float = MIN_SCORE) -> DataFrame:
    """(list, value, code, score, way) of each distinct value (list, value), null values left out.

    reference (list, code, label, note). code is the entry meant, or "unmatched" (score 0, way null) if none is reached. way says what led to it: "tokens"
    (repaired by their letters), "thesaurus" (a token of the code is known by the thesaurus alone) or "letters" (letter pairs of the whole value). Values without
    letters are unmatched; so are all values of a list without entries. Of entries that fit equally, the one whose label
    is covered best wins, then the smaller code.
    """
    values = cut(values.select("list", "value").where("value is not null").distinct().withColumn("vid", F.xxhash64("list", "value")))
    entries = reference.select("list", "code", "label", F.coalesce("note", F.lit("")).alias("note")).where("code is not null").distinct()
    label_terms = entries.select("list", "code", F.explode(tokens_of(F.concat_ws(" ", "label", F.translate("code", "_", " ")))).alias("term")).distinct()
    note_terms = entries.select("list", "code", F.explode(tokens_of(F.col("note"))).alias("term")).distinct()
    words = cut(label_terms.withColumn("main", F.lit(1)).unionByName(note_terms.withColumn("main", F.lit(0))).groupBy("list", "code", "term").agg(F.max("main").alias("main")))
    n = entries.groupBy("list").agg(F.count("*").alias("n"))
    weight = cut(words.groupBy("list", "term").agg(F.count("*").alias("df")).join(n, "list").select("list", "term", F.log1p(F.col("n") / F.col("df")).alias("w")))
    flat = cut(values.select("vid", "list", F.explode(tokens_of(F.col("value"))).alias("token")))
    tokens = cut(flat.select("list", "token").distinct())
    repaired = cut(repair(tokens, weight.select("list", "term"), thesaurus).join(weight, ["list", "term"]))
    token_weight = repaired.groupBy("list", "token").agg(F.max_by("w", "s").alias("tw"))
    top = n.select("list", F.log1p("n").alias("most"))
    unknown = F.when(F.length("token") < 4, 0.5).otherwise(1.0) * F.col("most")
    weights = tokens.join(token_weight, ["list", "token"], "left").join(top, "list").select("list", "token", F.coalesce("tw", unknown).alias("tw"))
    weighed = cut(flat.join(weights, ["list", "token"]))
    total = weighed.groupBy("vid").agg(F.sum("tw").alias("total"))
    hits = repaired.join(words, ["list", "term"]).groupBy("list", "token", "code").agg(F.max("s").alias("s"), F.max(F.col("main") * F.col("s")).alias("main"), F.min("synonym").alias("synonym"))
    score = weighed.join(hits, ["list", "token"]).groupBy("vid", "code").agg(F.sum(F.col("tw") * F.col("s")).alias("got"), F.sum(F.col("main") * F.col("tw")).alias("main"), F.max("synonym").alias("synonym"))
    ranked = score.join(total, "vid").withColumn("score", F.round(F.col("got") / F.col("total"), 6)).withColumn("main", F.round("main", 6))
    way = F.when(F.col("synonym"), "thesaurus").otherwise("tokens").alias("way")
    best = cut(ranked.where(F.col("score") >= min_score).groupBy("vid").agg(F.min_by(F.struct("code", "score", way), F.struct(-F.col("score"), -F.col("main"), F.col("code"))).alias("best")))
    open_values = values.join(best, "vid", "left_anti")
    pairs = open_values.select("vid", "list", F.explode(letter_pairs(F.col("value"))).alias("p"), F.size(letter_pairs(F.col("value"))).alias("size"))
    forms = entries.select("list", "code", F.explode(F.array("label", F.translate("code", "_", " "))).alias("form")).withColumn("form_size", F.size(letter_pairs(F.col("form"))))
    form_pairs = cut(forms.withColumn("p", F.explode(letter_pairs(F.col("form")))))
    whole = pairs.join(form_pairs, ["list", "p"]).groupBy("vid", "code", "form", "size", "form_size").agg(F.count("*").alias("same"))
    whole = whole.withColumn("score", F.round(2 * F.col("same") / (F.col("size") + F.col("form_size")), 6)).where(F.col("score") >= MIN_WHOLE)
    by_pairs = whole.groupBy("vid").agg(F.min_by(F.struct("code", "score", F.lit("letters").alias("way")), F.struct(-F.col("score"), F.col("code"))).alias("best"))
    found = best.unionByName(by_pairs)
    return values.join(found, "vid", "left").select("list", "value", F.coalesce("best.code", F.lit(UNMATCHED)).alias("code"), F.coalesce("best.score", F.lit(0.0)).alias("score"), "best.way")
