"""Subjects of documents, by label propagation over the graph of sentences and the terms that they share.

Nodes are documents (distinct texts), sentence forms (without numbers, months and markup) and terms (words and neighbouring
pairs of words). Two sentences are near if they share a term that is verified to be about a subject, that is, most of its labelled mentions
have that subject; the graph is kept as sentence-term and document-sentence edges, so it grows with the text and not with its
square. Labels spread by rounds of joins:

1. Seeds are the readers' labels, clamped: a labelled document's sentences can only take its own subjects, several at once;
   and the subjects' scope notes. Rounds of sentence -> term -> sentence sort out which sentence has which of the subjects.
2. Terms then label the sentences of all documents; sentences whose terms aren't known yet take the subjects of the document they
   stand in, which labels their terms in the next round (so words and languages without a seed are reached).
3. A sentence in passing names a subject that the rest of its document isn't about. It is known by its frame, the words around the
   subject's terms: a frame whose subject mostly stands alone in its document is no evidence, nor is a figure of speech or
   procedure, whose terms occur with all subjects alike.

A document has each subject that at least MIN_SENTENCES of its sentences are about, and each that a reader gave it and one of its sentences confirms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gavelworks.storage import cut, drop, keep

SEED_ROUNDS, MIN_SENTENCES = 2, 2
#: Rounds over all documents end when no more than this share of the labelled sentence forms changes; MOST_ROUNDS only guards against labels that swing for ever.
SETTLED, MOST_ROUNDS = 0.01, 12
#: A term is about a subject if so large a share of its mentions is, of so many at least; or a lesser share of more mentions.
PURE, MENTIONS, FAIRLY_PURE, MANY_MENTIONS = 0.7, 3, 0.5, 12
#: Least logarithm of how much likelier a subject is with a term of its own than without.
SETS_APART = 0.26
#: A term with so many mentions of which no subject has this share is about none, and is left out of later rounds.
FLAT, FLAT_MENTIONS = 0.35, 20
#: Weight of a label that a sentence takes from its document, and of the prior in a term's share.
BORROWED, PRIOR = 0.4, 2.0
#: Mentions that each term of a scope note counts for.
NOTE_MENTIONS = 6.0
#: A frame (or form) is in passing if, of so many documents or more that have it, less than this share has others of the subject.
FRAME_MENTIONS, COHERENT = 8, 0.55

MONTHS = "january february march april may june july august september october november december enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre"
STOP = (
    "a about above after again all also an and any are as at be because been before being but by can could did do does for from had has have he her here his how i if in into is it its "
    "just like more most no nor not now of off on only or other our out over own s same she should so some such t than that the their them then there these they this those through to too "
    "under until up was we were what when where which while who will with would you your um uh "
    "al como con cuando de del donde el en entre era es esta este fue ha hay la las lo los mas no o para pero por que se sea ser sera si sin sobre su sus un una y"
)


def sentences(text: Column) -> Column:
    """The sentences of a text in normal form: lower case, without accents, markup, speaker and time marks, numbering and hesitation; digits and months are "#"."""

    def where_any(c: Column, marks: str, then) -> Column:
        """then(c) of texts that have one of the marks; the others, which it would leave as they are, aren't searched by patterns."""
        some = (*marks.split(), marks.split()[0])
        # bound by transform(), so that c is made once and not for each of its uses
        return F.transform(F.array(c), lambda x: F.when(F.greatest(*[F.contains(x, F.lit(m)) for m in some]), then(x)).otherwise(x))[0]

    t = where_any(text, "<", lambda c: F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>|</?p>|</?div>", "\n"), r"<[^<>]{0,200}>", " "))
    t = where_any(t, "&", lambda c: F.replace(F.replace(F.replace(c, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit(" and ")), F.lit("&"), F.lit(" and ")))
    t = where_any(t, "-", lambda c: F.regexp_replace(c, r"([A-Za-z])-[ \t]*\r?\n[ \t]*([a-z])", "$1$2"))
    t = F.regexp_replace(t, r"(?m)^\s*(?:\d{1,3}[.)]|Sec\.?\s*[\d.]+|SEC\.?\s*[\d.]+|[*•#-]+)\s+", "")
    t = where_any(t, "[ >> :", lambda c: F.regexp_replace(c, r"\[[\d:.]+\]|>>+|\b(?:SPEAKER_\d+|CHAIR|Chair|Speaker \d+):", " "))
    t = F.regexp_replace(t, r"(?i)\b(?:um+|uh+|erm?|hmm+)\b[,.]*", " ")
    t = F.translate(F.lower(t), "áàâäéèêëíìîïóòôöúùûüñç’", "aaaaeeeeiiiioooouuuunc'")
    t = F.regexp_replace(t, rf"\b(?:{MONTHS.replace(' ', '|')})\b|\d[\d,.:]*", "#")
    t = F.regexp_replace(F.regexp_replace(t, r"\r?\n\s*\r?\n", " ¶ "), r"\s+", " ")
    parts = F.split(t, r"(?<=[a-z#%)\"']{2}[.!?])\s+|(?<=#[.!?])\s+(?=[a-z])|\s*¶\s*")
    return F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"[^a-z#']+", " "))), lambda s: F.length(s) > 2)


def words_of(sentence: Column) -> Column:
    stop = sorted(set(STOP.split()))
    kept = F.filter(F.split(sentence, " "), lambda w: (F.length(w) > 1) & ~w.isin(*stop))
    return F.transform(kept, lambda w: F.when(w.endswith("s"), F.regexp_replace(w, r"(?<=[a-z]{3}[a-rt-z])s$", "")).otherwise(w))  # plurals


def terms_of(sentence: Column) -> Column:
    """Hashes of the distinct words and neighbouring pairs of words of a sentence, function words left out."""
    w = words_of(sentence)
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(1))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b)))
    return F.transform(F.array_distinct(F.concat(w, F.coalesce(pairs, F.array().cast("array<string>")))), lambda x: F.xxhash64(x))


def _term_table(mentions: DataFrame, base: DataFrame) -> DataFrame:
    """(term, subject, lift, share, n) from mentions (term, subject or null, p): the share of a term's mentions that a subject has, against its share of all."""
    total = cut(mentions.groupBy("term", "subject").agg(F.sum("p").alias("c")))  # read twice, and planned once
    n = total.groupBy("term").agg(F.sum("c").alias("n"))
    each = total.where("subject is not null").join(n, "term").join(F.broadcast(base), "subject")
    share = (F.col("c") + PRIOR * F.col("pi")) / (F.col("n") + PRIOR)
    return each.select("term", "subject", F.log(share / F.col("pi")).alias("lift"), share.alias("share"), "n")


def _base(labelled: DataFrame) -> DataFrame:
    """(subject, pi): the subjects' shares of labelled (subject, p); one row for each subject."""
    per = labelled.groupBy("subject").agg(F.sum("p").alias("c"))
    return per.select("subject", (F.col("c") / F.sum("c").over(W.partitionBy(F.lit(0)))).alias("pi"))


def _best(form_terms: DataFrame, table: DataFrame) -> DataFrame:
    """(fid, subject, score) of each form that has a pure term: the subject with the most lift among its pure terms."""
    pure = table.where(F.col("lift") >= SETS_APART).where(((F.col("share") >= PURE) & (F.col("n") >= MENTIONS)) | ((F.col("share") >= FAIRLY_PURE) & (F.col("n") >= MANY_MENTIONS)))
    scored = form_terms.join(pure, "term").groupBy("fid", "subject").agg(F.sum(F.col("lift") * F.col("share")).alias("score"))
    return scored.groupBy("fid").agg(F.max_by("subject", F.struct("score", "subject")).alias("subject"), F.max("score").alias("score"))


def _in_passing(placed: DataFrame, key: str) -> DataFrame:
    """The keys (forms or frames) of placed (tid, subject, n, key) whose subject mostly stands alone in the document."""
    inside = placed.groupBy("tid", "subject").agg(F.sum("n").alias("all"))
    own = placed.groupBy("tid", "subject", key).agg(F.sum("n").alias("own"), F.count("*").alias("forms"))
    others = ((F.col("all") > F.col("own")) | (F.col("forms") > 1)).cast("int")
    stands = own.join(inside, ["tid", "subject"]).groupBy(key).agg(F.count("*").alias("m"), F.avg(others).alias("coherence"))
    return stands.where((F.col("m") >= FRAME_MENTIONS) & (F.col("coherence") < COHERENT)).select(key)


def _changed(before: DataFrame, now: DataFrame) -> float:
    """The share of forms (fid, subject) that have another subject now, or have one only before or only now."""
    both = before.select("fid", F.col("subject").alias("old")).join(now.select("fid", "subject"), "fid", "full_outer")
    changed, every = both.agg(F.count_if(~F.col("old").eqNullSafe(F.col("subject"))), F.count("*")).first()
    return changed / every if every else 0.0


def prepare(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, tid) of each document with a text, (tid, fid, n) of each sentence form of a distinct text, and (fid, sentence, docs) of each form."""
    own = documents.select("doc_id", "text").where("doc_id is not null and trim(text) <> ''").withColumn("tid", F.xxhash64("text"))
    texts = own.groupBy("tid").agg(F.first("text").alias("text"))
    flat = texts.select("tid", F.explode(sentences(F.col("text"))).alias("sentence")).withColumn("fid", F.xxhash64("sentence"))
    occurrences = cut(flat.groupBy("tid", "fid", "sentence").agg(F.count("*").alias("n")))
    forms = occurrences.groupBy("fid").agg(F.first("sentence").alias("sentence"), F.count("*").alias("docs"))
    return own.select("doc_id", "tid").distinct(), occurrences.select("tid", "fid", "n"), forms


def spread(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The propagated graph: documents (doc_id, tid), occurrences (tid, fid, n), form terms (fid, term) and the terms' table (term, subject, lift, share, n)."""
    docs, occurrences, forms = prepare(documents)
    listed = keep(forms.select("fid", "docs", terms_of(F.col("sentence")).alias("terms")))  # read twice, and dear to make
    every = listed.select("fid", "docs", F.explode("terms").alias("term"))
    notes = areas.where("subject is not null").select("subject", F.explode(sentences(F.concat_ws(" ", F.translate("subject", "_", " "), "scope_note"))).alias("s"))
    note_mentions = cut(notes.select(F.explode(terms_of(F.col("s"))).alias("term"), "subject", F.lit(NOTE_MENTIONS).alias("p")))
    # a term with fewer mentions, those of the notes included, can never be about anything
    counted = every.select("term", "docs").unionByName(note_mentions.select("term", F.col("p").cast("long").alias("docs")))
    often = counted.groupBy("term").agg(F.sum("docs").alias("m")).where(F.col("m") >= MENTIONS).select("term")
    form_terms = all_terms = cut(every.join(often, "term").select("fid", "term"))
    drop(listed)
    known = areas.select("subject").where("subject is not null").distinct()
    clamp = labels.select("doc_id", "subject").distinct().join(F.broadcast(known), "subject").join(docs, "doc_id").select("tid", "subject").distinct()
    # 1. within labelled documents: each sentence may take each of its document's subjects
    allowed = cut(occurrences.join(clamp, "tid").select("tid", "fid", "subject"))
    among = allowed.groupBy("tid", "fid").agg(F.count("*").alias("k"))
    state = allowed.join(among, ["tid", "fid"]).select("tid", "fid", "subject", (1 / F.col("k")).alias("p"))
    seed_terms = cut(form_terms.join(allowed.select("fid").distinct(), "fid", "left_semi"))
    table = None
    for _ in range(SEED_ROUNDS):
        mentions = state.join(seed_terms, "fid").select("term", "subject", "p").unionByName(note_mentions)
        table = cut(_term_table(mentions, _base(state.unionByName(known.select(F.lit(0).cast("long").alias("tid"), F.lit(0).cast("long").alias("fid"), "subject", F.lit(0.5).alias("p"))))))
        lifted = seed_terms.join(table, "term").groupBy("fid", "subject").agg(F.sum(F.col("lift")).alias("score"))
        weighed = allowed.join(lifted, ["fid", "subject"], "left").withColumn("e", F.exp(F.least(F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(-20.0)), F.lit(20.0))))
        total = weighed.groupBy("tid", "fid").agg(F.sum("e").alias("z"))
        state = weighed.join(total, ["tid", "fid"]).select("tid", "fid", "subject", (F.col("e") / F.col("z")).alias("p"))
    # 2. over all documents
    readers = clamp.groupBy("tid").agg(F.collect_set("subject").alias("readers"))
    settled = None
    for turn in range(MOST_ROUNDS):
        if turn == 1:
            flat = table.groupBy("term").agg(F.max("share").alias("share"), F.max("n").alias("n")).where((F.col("share") < FLAT) & (F.col("n") >= FLAT_MENTIONS))
            form_terms = cut(form_terms.join(flat.select("term"), "term", "left_anti"))
        best = cut(_best(form_terms, table))
        if settled is not None and _changed(settled, best) <= SETTLED:
            break
        if settled is not None:
            drop(settled)
        settled = best
        placed = cut(occurrences.join(best, "fid").select("tid", "fid", "subject", "n"))
        own = placed.join(_in_passing(placed, "fid"), "fid", "left_anti").select("tid", "fid", "subject")
        # a label against the reader's counts half
        agreed = F.when(F.col("readers").isNull() | F.array_contains("readers", F.col("subject")), 1.0).otherwise(0.5)
        own = cut(own.join(readers, "tid", "left").select("tid", "fid", "subject", agreed.alias("p")))
        per = own.groupBy("tid", "subject").agg(F.sum("p").alias("c"))
        mixture = cut(per.join(per.groupBy("tid").agg(F.sum("c").alias("all")), "tid").select("tid", "subject", (F.col("c") / F.col("all")).alias("p")))
        rest = occurrences.join(placed.select("fid").distinct(), "fid", "left_anti").select("tid", "fid")
        # a sentence without a known term takes its document's subjects, each as likely as its terms are elsewhere
        hints = form_terms.join(placed.select("fid").distinct(), "fid", "left_anti").join(table, "term").groupBy("fid", "subject").agg(F.sum(F.col("lift") * F.col("share")).alias("hint"))
        taken = cut(rest.join(mixture, "tid").join(hints, ["fid", "subject"], "left").withColumn("p", F.col("p") * F.exp(F.greatest(F.lit(-5.0), F.least(F.lit(5.0), F.coalesce("hint", F.lit(0.0)))))))
        whole = taken.groupBy("tid", "fid").agg(F.sum("p").alias("z"))
        lent = taken.join(whole, ["tid", "fid"]).groupBy("fid", "subject").agg(F.sum(F.lit(BORROWED) * F.col("p") / F.col("z")).alias("p"))
        given = own.groupBy("fid", "subject").agg(F.sum("p").alias("p"))
        said = cut(given.unionByName(lent))
        before, table = table, cut(_term_table(form_terms.join(said, "fid").select("term", "subject", "p").unionByName(note_mentions), _base(own)))
        drop(before, placed, own, mixture, taken, said)  # nothing reads the round's tables any more
    return docs, occurrences, all_terms, table


def document_subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, subject, n_sentences) of each document and each subject that at least MIN_SENTENCES of its sentences are about, or one if a reader gave the subject.

    Subjects are those of areas (subject, scope_note); labels (doc_id, subject) of other subjects or of unknown documents are ignored. Copies of a text
    have the same subjects. Null and blank texts have none. Without any label or area the result is empty.
    """
    docs, occurrences, form_terms, table = spread(documents, labels, areas)
    best = cut(_best(form_terms, table))
    # 3. frames: what is left of a form's terms without those that are about its subject
    about = table.where((F.col("share") >= 0.4) & (F.col("lift") >= SETS_APART)).select("term", F.col("subject").alias("s2"))
    marked = form_terms.join(best, "fid").join(about, ["term"], "left")
    frame = marked.groupBy("fid", "subject").agg(F.sort_array(F.collect_set(F.when(F.col("s2").isNull(), F.col("term")))).alias("left"))
    framed = cut(frame.select("fid", "subject", F.xxhash64("left").alias("frame")))
    placed = cut(occurrences.join(framed, "fid"))
    firm = placed.join(_in_passing(placed, "fid"), "fid", "left_anti").join(_in_passing(placed, "frame"), "frame", "left_anti")
    # a reader's label is clamped where a sentence confirms it: readers are at times wrong, and a subject without any sentence is none
    trusted = labels.select("doc_id", "subject").distinct().join(docs, "doc_id").select("tid", "subject", F.lit(True).alias("trusted")).distinct()
    counted = firm.groupBy("tid", "subject").agg(F.sum("n").alias("n_sentences")).join(trusted, ["tid", "subject"], "left")
    counted = counted.where((F.col("n_sentences") >= MIN_SENTENCES) | F.col("trusted")).drop("trusted")
    return docs.join(counted, "tid").select("doc_id", "subject", "n_sentences")


def make_up(assigned: DataFrame, documents: DataFrame) -> DataFrame:
    """Per subject and source: documents and characters that have it; a document with several subjects counts in each."""
    sizes = documents.select("doc_id", "source", F.length("text").alias("n_chars")).distinct()
    return assigned.join(sizes, "doc_id").groupBy("subject", "source").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))
