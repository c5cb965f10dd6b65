"""Column functions on text, times and numbers. Nulls give null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STOPWORDS = "a an and the of for in on to with at by from is are be new proposed".split()  # fixed values
#: Texts that stand for "nothing".
NULL_LIKE = ["", "null", "none", "n/a", "na", "unknown", "not mentioned", "not specified", "not stated", "not provided", "not available", "not applicable", "unspecified", "unclear"]


def half_up(c: Column, places: int) -> Column:
    """Rounded to so many places by floor(x + 1/2), the same in every engine."""
    scale = float(10**places)
    return F.floor(c * scale + 0.5) / scale


def slug(c: Column) -> Column:
    """Lower case, only letters (of any script), digits and single hyphens; at most 60 characters."""
    kept = F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}_\s-]", "")
    return F.substring(F.regexp_replace(F.regexp_replace(kept, r"[\s_-]+", "-"), "^-+|-+$", ""), 1, 60)


def content_tokens(c: Column) -> Column:
    """Sorted distinct runs of a-z and 0-9 of two characters or more without stop words; null gives an empty array."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]{2,}"), 0)
    return F.array_sort(F.array_distinct(F.filter(found, lambda t: ~t.isin(*STOPWORDS))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; null if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.try_divide(both, F.size(a) + F.size(b) - both)


def fold_punctuation(c: Column) -> Column:
    """Typographic quotes, dashes, ellipses and blanks as plain ones; blanks of no width are dropped."""
    return F.replace(F.translate(c, "‘’“”–—\u00a0\u200b", "''\"\"-- "), F.lit("…"), F.lit("..."))


def strip_tags(c: Column, gap: str = " ") -> Column:
    """Without markup. By default a tag leaves a blank, so that "of<br/>the" stays two words; gap "" glues them."""
    return F.regexp_replace(c, "<[^>]+>", gap)


def strip_notes(c: Column) -> Column:
    """Without bracketed notes in capitals and digits, such as [MUSIC] or (CROSS-TALK 2)."""
    return F.regexp_replace(c, r"\[[A-Z0-9 _/-]{2,}\]|\([A-Z0-9 _/-]{2,}\)", " ")


def strip_fillers(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?i)\b(?:um|uh|er|erm)\b[,\s]*", " "))


def tidy(c: Column) -> Column:
    """Single blanks, none before marks, and no repeated marks."""
    c = F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"\s+([,?!:;])", "$1")
    c = F.regexp_replace(F.regexp_replace(c, r"\.{4,}", "..."), "!{2,}", "!")
    return F.trim(F.regexp_replace(c, r"\?{2,}", "?"))


def clean(c: Column) -> Column:
    return tidy(strip_fillers(strip_notes(strip_tags(fold_punctuation(c)))))


def split_sentences(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"(?<=[.!?])\s+"), lambda s: s != "")


def word_count(c: Column) -> Column:
    """Runs of characters other than white space; null counts 0."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))


def token_estimate(words: Column) -> Column:
    return F.floor(words * 1.3).cast("int")


def null_like(c: Column, limit: int = 500) -> Column:
    """Null for texts that say nothing, else trimmed and cut."""
    bare = F.trim(c)
    return F.when(~F.lower(bare).isin(*NULL_LIKE), F.substring(bare, 1, limit))


def fingerprint(c: Column) -> Column:
    """16 hexadecimal digits of the SHA-256 of the text in lower case with single blanks."""
    return F.substring(F.sha2(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), 256), 1, 16)


def marker_count(c: Column) -> Column:
    """Citation marks like [3] or [1, 4]."""
    return F.regexp_count(c, F.lit(r"\[\d+(?:\s*,\s*\d+)*\]"))


def clock(seconds: Column) -> Column:
    """HH:MM:SS of a number of seconds, rounded down."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def seconds(stamp: Column) -> Column:
    """Seconds of [HH:]MM:SS.mmm; null for anything else."""
    parts = [F.try_element_at(F.split(stamp, "[:]"), F.lit(i)).try_cast("double") for i in (-1, -2, -3)]
    value = parts[0] + 60 * parts[1] + 3600 * F.coalesce(parts[2], F.lit(0.0))
    return F.when(stamp.rlike(r"^(\d+:)?\d{1,2}:\d{2}(\.\d+)?$"), value)


def money(c: Column) -> Column:
    """The value of "$1.5M", "850K" or "1,200"; null where it isn't one or isn't positive."""
    bare = F.upper(F.regexp_replace(c, r"[$,\s]", ""))
    unit = F.when(bare.endswith("B"), 1e9).when(bare.endswith("M"), 1e6).when(bare.endswith("K"), 1e3).otherwise(1.0)
    value = F.regexp_replace(bare, "[BMK]$", "").try_cast("double") * unit
    return F.when(value > 0, value)


def title_date(c: Column) -> Column:
    """The first date in a title: month name day, year; m/d/yyyy; m.d.yyyy; yyyy-mm-dd."""
    named = F.regexp_extract(c, r"([A-Z][a-z]+ \d{1,2}, \d{4})", 1)
    numeric = F.regexp_replace(F.regexp_extract(c, r"(\d{1,2}[/.]\d{1,2}[/.]\d{4})", 1), r"\.", "/")
    iso = F.regexp_extract(c, r"(\d{4}-\d{2}-\d{2})", 1)
    return F.coalesce(F.try_to_date(named, "MMMM d, yyyy"), F.try_to_date(numeric, "M/d/yyyy"), F.try_to_date(iso, "yyyy-MM-dd"))


def title_year(title: Column, published: Column) -> Column:
    """A year 2000 to 2029 named in the title, else that of the date."""
    named = F.regexp_extract(title, r"\b(20[0-2]\d)\b", 1)
    return F.coalesce(F.when(named != "", named.cast("int")), F.year(published))


def filetime_date(ticks: Column) -> Column:
    """The UTC date of seconds since 1601; null if not positive."""
    return F.when(ticks > 0, F.to_date(F.timestamp_seconds(ticks - F.lit(11644473600))))


#: Contractions in full; the longest comes first where one is part of another.
CONTRACTIONS = {
    "don't": "do not", "doesn't": "does not", "didn't": "did not", "won't": "will not", "wouldn't": "would not", "can't": "cannot",
    "couldn't": "could not", "shouldn't": "should not", "isn't": "is not", "aren't": "are not", "wasn't": "was not", "weren't": "were not",
    "i'm": "I am", "we're": "we are", "you're": "you are", "they're": "they are", "i've": "I have", "we've": "we have", "i'll": "I will",
    "we'll": "we will", "it's": "it is", "that's": "that is", "there's": "there is", "what's": "what is", "let's": "let us", "who's": "who is",
    "i'd": "I would", "we'd": "we would", "he's": "he is", "she's": "she is", "could've": "could have", "would've": "would have", "should've": "should have",
}
#: Named characters that unescape() knows, beside every numbered one up to 65535.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": "\u00a0", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&rsquo;": "’", "&lsquo;": "‘", "&rdquo;": "”", "&ldquo;": "“", "&ntilde;": "ñ", "&aacute;": "á", "&eacute;": "é", "&iacute;": "í", "&oacute;": "ó", "&uacute;": "ú", "&amp;": "&"}


def expand_contractions(c: Column) -> Column:
    for short in sorted(CONTRACTIONS, key=lambda x: (-len(x), x)):
        c = F.regexp_replace(c, f"(?i){short}", CONTRACTIONS[short])
    return c


def unescape(c: Column) -> Column:
    """HTML's character references as characters, "&amp;" last; texts without "&" are left alone."""
    marks = F.array_distinct(F.regexp_extract_all(c, F.lit(r"&#(\d{1,5});"), 1))
    numbered = F.aggregate(marks, c, lambda t, n: F.replace(t, F.concat(F.lit("&#"), n, F.lit(";")), F.decode(F.unhex(F.lpad(F.hex(n.cast("int")), 4, "0")), "UTF-16BE")))
    for name, char in ENTITIES.items():
        numbered = F.replace(numbered, F.lit(name), F.lit(char))
    return F.when(F.contains(c, F.lit("&")), numbered).otherwise(c)


def squeeze_repeats(c: Column, n: int = 8) -> Column:
    """The words of a text without immediate repeats of n words: whenever the last n words equal the n before them, they are dropped."""
    out = F.aggregate(
        F.filter(F.split(c, r"\s+"), lambda w: w != ""),
        F.array().cast("array<string>"),
        lambda kept, w: _without_repeat(F.array_append(kept, w), n),
    )
    return F.when(F.size(F.split(c, r"\s+")) < 2 * n, F.array_join(F.filter(F.split(c, r"\s+"), lambda w: w != ""), " ")).otherwise(F.array_join(out, " "))


def _without_repeat(words: Column, n: int) -> Column:
    size = F.size(words)
    twice = (size >= 2 * n) & (F.slice(words, F.greatest(size - n + 1, F.lit(1)), n) == F.slice(words, F.greatest(size - 2 * n + 1, F.lit(1)), n))
    return F.when(twice, F.slice(words, 1, F.greatest(size - n, F.lit(0)))).otherwise(words)


#: Words that don't count when neighbouring sentences are compared.
FUNCTION_WORDS = "the a an and or but of to in on for with at by is are was were be been being this that it as from we you they he she i our your their".split()


def distinct_neighbours(sentences: Column) -> Column:
    """Sentences without those that repeat the last kept one, in any case and spacing, or in all but function words."""
    keyed = F.transform(
        sentences,
        lambda s: F.struct(
            s.alias("s"),
            F.trim(F.regexp_replace(F.lower(s), r"\s+", " ")).alias("norm"),
            F.array_join(F.filter(F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9']+"), 0), lambda w: ~w.isin(*FUNCTION_WORDS)), " ").alias("bare"),
        ),
    )
    empty = F.filter(keyed, lambda x: F.lit(False))

    def add(kept: Column, x: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        again = F.coalesce((last["norm"] == x["norm"]) | ((last["bare"] == x["bare"]) & (x["bare"] != "")), F.lit(False))
        return F.when(again, kept).otherwise(F.array_append(kept, x))

    return F.transform(F.aggregate(keyed, empty, add), lambda x: x["s"])


def words_a_minute(words: Column, length: Column) -> Column:
    """Confidence in captions of so many words in so many seconds: 0.85 without a length, 0.55 over 400 words a minute, 0.88 from 30, else 0.65."""
    pace = F.try_divide(words * 60.0, length)
    return F.when(F.coalesce(length, F.lit(0.0)) <= 0, 0.85).when(pace > 400, 0.55).when(pace >= 30, 0.88).otherwise(0.65)


def dollars(c: Column) -> Column:
    """$1,234.00; null and 0 give an empty text."""
    return F.when(c != 0, F.concat(F.when(c < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(c), 2))).otherwise("")


def minutes(c: Column) -> Column:
    """mm:ss of a number of seconds, rounded down; "?" for null and 0."""
    s = F.floor(c).cast("long")
    return F.when(c != 0, F.format_string("%02d:%02d", F.floor(s / 60), s % 60)).otherwise("?")


def marked_numbers(c: Column) -> Column:
    """The distinct numbers of citation marks like [3] or [1, 4], in order of appearance."""
    marks = F.regexp_extract_all(c, F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), 1)
    return F.array_distinct(F.transform(F.flatten(F.transform(marks, lambda m: F.split(m, r"\s*,\s*"))), lambda x: x.try_cast("int")))


def guids(c: Column) -> Column:
    """The distinct GUIDs of a text in lower case, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit("[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"), 0), lambda x: F.lower(x)))


def host(c: Column) -> Column:
    """Host and port of a URL in lower case; null where there is none."""
    found = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1)
    return F.when(found != "", F.lower(found))


def iso_date(c: Column) -> Column:
    """The time of an ISO text, with a blank or T, with or without a fraction and zone; null for anything else."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), "T", " "), r"(\.\d+)?(Z|[+-]\d\d:?\d\d)?$", "")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(bare, F.lit("yyyy-MM-dd")))


def meeting_kind(title: Column) -> Column:
    """special, workshop or committee if the title says so, in this order; else regular."""
    low = F.lower(title)
    return F.when(F.contains(low, F.lit("special")), "special").when(F.contains(low, F.lit("workshop")), "workshop").when(F.contains(low, F.lit("committee")), "committee").otherwise("regular")


def any_word(c: Column, words: list[str]) -> Column:
    """Whether the lower-cased text has one of the words; null has none."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
