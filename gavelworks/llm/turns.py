"""Captions into speaker turns: tokens are tagged by a hidden Markov model, decoded by Viterbi, and assembled from the tags.

The lexer cuts a text into words and marked spans (bracketed notes, times, tags). A token's symbol is its form alone: an ordinary
word, a capital word that no text has in lower case, a title, one of these before a colon, a dash and so on. Most forms leave it
open what a token is: "Smith:" may open a turn or stand in a sentence, "Chair" may belong to a label or to speech, a dash may
close a label or not. The states of the model say it (speech, speech that closes a sentence, filler, time, note, first, inner and
last token of a label), and their order decides: a label follows the start, a mark or a closed sentence and ends with its mark.
Start, transitions and emissions are fitted by expectation-maximisation on a bounded sample (SAMPLE_SEGMENTS) from a prior that
only says which states may follow each other and which forms a state may have. Which words are ordinary is counted over all texts.

Decoding is vectorised: distinct tokens are classified once per batch, and one Viterbi runs over all texts of like length.
Turns are assembled within stretches of BUCKET_S seconds of a video; only the first and last turn of a stretch can go on in
another one, so that only these are moved again, and no task holds a whole video.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gavelworks import storage

#: The sample that the model is fitted on has at most so many segments.
SAMPLE_SEGMENTS = 20_000
#: A word is an ordinary one if texts have it in lower case so many times, and so often for each time that it has a capital or a colon.
ORDINARY, ORDINARY_SHARE = 3, 0.02
BUCKET_S = 600

TITLES = "mr|mrs|ms|miss|dr|prof|professor|chair|chairman|chairwoman|chairperson|vice|trustee|president|dean|provost|chancellor|secretary|treasurer|member|director|hon|superintendent|clerk"
SOUNDS = (
    "laugh\\w*|chuckl\\w*|applau\\w*|clap\\w*|cheer\\w*|cough\\w*|sneez\\w*|sigh\\w*|music|singing|inaudible|unintelligible|indistinct|crosstalk|cross-talk|silence|pause|noise\\w*|static|"
    "feedback|audio|chatter\\w*|conversation\\w*|gavel|bang\\w*|knock\\w*|door|phone|ring\\w*|beep\\w*|background|microphone|no sound|blank_audio|foreign|overlapping|whisper\\w*|murmur\\w*"
)
TIME = r"\d{1,2}:\d\d(?::\d\d)?(?:[.,]\d+)?"
#: Tokens, in order of precedence: time ranges, tags and brackets, times and notes and names in parentheses, sung or starred notes, marks, words.
LEXER = "|".join(
    [
        rf"{TIME}\s*-+>\s*{TIME}",
        r"<[^<>]*>",
        r"\[[^\[\]]*\]",
        r"\{[^{}]*\}",
        r"\(\([^()]*\)\)",
        rf"\(\s*{TIME}\s*\)",
        rf"\((?i:[\w -]{{0,24}}\b(?:{SOUNDS})\b[\w -]{{0,24}})\)",
        rf"\((?i:(?:{TITLES})\b\.?(?:\s+[a-z'.-]+){{0,3}}|speaker\s*#?\d+)\):?",
        r"♪[^♪]*♪",
        r"\*[^*\s][^*]*\*",
        r">>+",
        r"[^\s<\[{♪*>]+",
        r"\S",
    ]
)
#: States: speech, speech that closes a sentence, filler, time, note; of labels the first, an inner and the last token; one token that is a label and ends with its mark; a label in brackets.
SPEECH, CLOSING, FILLER, CLOCK, NOTE, FIRST, INNER, LAST, ONLY, CALL = range(10)
STATES = 10
#: Symbols: ordinary word, word that ends a sentence, ordinary word with a colon; capital word, title, numbered speaker, each without and with a colon; the word "speaker";
#: digits without and with a colon; dash; bracketed name; hesitation; hesitation written as an abbreviation, and the same in a text in capitals; time; note or tag; other mark without and with a full stop.
WORD, END, HEAD, NAME, NAME_C, TITLE, TITLE_C, NUMBER, NUMBER_C, SPEAKER, DIGITS, DIGITS_C, DASH, NAMED, HUM, SHORT, SHORT_CAPS, STAMP, MARKED, MARK, MARK_END = range(21)
SYMBOLS = 21
#: The prior: which symbols a state may have, and its weight against the others'. What isn't named can't be.
MAY_HAVE = {
    SPEECH: {WORD: 20, NAME: 2, TITLE: 1, NUMBER: 0.02, SPEAKER: 0.2, DIGITS: 1, DASH: 0.2, SHORT: 0.1, SHORT_CAPS: 0.02},
    CLOSING: {END: 10, HEAD: 1, MARK_END: 1, NAME_C: 0.1, TITLE_C: 0.05, NUMBER_C: 0.01, DIGITS_C: 0.2},
    FILLER: {HUM: 20, SHORT: 0.02, SHORT_CAPS: 1},
    CLOCK: {STAMP: 1},
    NOTE: {MARKED: 4, MARK: 2, DASH: 1},
    FIRST: {NAME: 2, TITLE: 4, NUMBER: 1, SPEAKER: 1},
    INNER: {NAME: 4, TITLE: 1, DIGITS: 1},
    LAST: {NAME_C: 8, TITLE_C: 1, DIGITS_C: 2, DASH: 1},
    ONLY: {NAME_C: 4, TITLE_C: 1, NUMBER_C: 4},
    CALL: {NAMED: 1},
}
#: Which state may follow: a label's tokens follow each other; a label opens rarely within a sentence.
OPEN = {SPEECH: 8, CLOSING: 2, FILLER: 0.5, CLOCK: 0.5, NOTE: 0.5, FIRST: 0.5, ONLY: 0.3, CALL: 0.3}
MAY_FOLLOW = {
    **dict.fromkeys((CLOSING, FILLER, CLOCK, NOTE, LAST, ONLY, CALL), OPEN),
    SPEECH: OPEN | {FIRST: 0.0005, ONLY: 0.0005},
    FIRST: {INNER: 1, LAST: 3},
    INNER: {INNER: 0.3, LAST: 3},
}
#: How many tokens of the sample the prior counts for, and rounds of fitting.
PRIOR, FIT_ROUNDS = 200.0, 4
NEVER = -1e4

_HUM = re.compile(r"(?:u+h+m*|u+m+|e+r+m*|e+h+m*|h+m+|m+h*m+|a+h+m+|uh-?huh|mm+-?hm+)[.,…!?-]*", re.I)
_STAMP = re.compile(rf"[\[<{{(]?\s*(?:{TIME}\s*-+>\s*{TIME}|\d{{1,2}}:\d\d:\d\d(?:[.,]\d+)?|\d{{1,2}}:\d\d[.,]\d{{3}})\s*[\]>}})]?")
_BRACKETED = re.compile(rf"[\[<{{(]\s*{TIME}\s*[\]>}})]")
_NUMBERED = re.compile(r"(?:speaker|spkr?|s)[\s_#-]*0*(\d+)", re.I)
_TITLE = re.compile(rf"(?:{TITLES})\.?", re.I)
_TITLED = re.compile(rf"(?:{TITLES})\b\.?\s+.*", re.I)
_SOUND = re.compile(rf"\b(?:{SOUNDS})\b", re.I)
_NAME = re.compile(r"[A-Z][A-Za-z'’.-]*")
NOBODY = {"", "unknown", "none", "null", "n/a", "na", "?", "unidentified", "unknown speaker", "speaker", "nan"}


def unescape(c: Column) -> Column:
    plain = c
    for a, b in (("&gt;", ">"), ("&lt;", "<"), ("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.when(F.contains(plain, F.lit("&")), c).otherwise(plain)


def lexed(c: Column) -> Column:
    """The tokens of a text. A text without any mark that the lexer knows is cut at blanks, which gives the same and costs less."""
    text = unescape(c)
    return F.when(text.rlike(r"[<>\[{♪*(\v\x1c-\x1f\x85\u2028\u2029]"), F.regexp_extract_all(text, F.lit(f"({LEXER})"), 1)).otherwise(F.filter(F.split(text, r"\s+"), lambda t: t != ""))


def who(label: str | None) -> str | None:
    """A numbered speaker's number, a named one's surname in lower case; None for nobody."""
    text = re.sub(r"\s+", " ", (label or "").strip().strip("[](){}<>:-–— ").removeprefix("v ").strip(" :"))
    if text.lower() in NOBODY:
        return None
    if m := _NUMBERED.fullmatch(text):
        return m[1]
    text = re.sub(r"\([^)]*\)?", " ", text).split(",")[0]
    words = [w.strip(".") for w in text.split() if not _TITLE.fullmatch(w)]
    words = [w for w in words if w] or text.split()
    return words[-1].strip(".,:").lower() if words else None


def _prior() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, SYMBOLS))
    for s, w in OPEN.items():
        start[s] = w
    for a, b in MAY_FOLLOW.items():
        move[a, list(b)] = list(b.values())
    for s, x in MAY_HAVE.items():
        emit[s, list(x)] = list(x.values())
    return start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True)


def _log(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.log(np.maximum(p, 1e-300)), NEVER).astype(np.float32)


#: Symbols without which a text is speech throughout: no label can end, and nothing else is there.
_ODD = np.ones(SYMBOLS, bool)
_ODD[[WORD, END, HEAD, NAME, TITLE, NUMBER, SPEAKER, DIGITS, SHORT, MARK, MARK_END]] = False


def _groups(symbol: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """Texts that need decoding, in groups of like length."""
    odd = np.concatenate([[0], np.cumsum(_ODD[symbol])])
    todo = np.flatnonzero(odd[ends] > odd[begins])
    todo = todo[np.argsort((ends - begins)[todo], kind="stable")]
    at = 0
    while at < len(todo):
        longest = (ends - begins)[todo[at]]
        stop = at + 1
        while stop < len(todo) and (ends - begins)[todo[stop]] <= longest * 1.25 + 4 and (stop - at) * longest < 200_000:
            stop += 1
        yield todo[at:stop]
        at = stop


@dataclass
class Model:
    """Probabilities of start, transitions and emissions, the words that texts have in lower case, and those that follow the abbreviation ER."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    ordinary: frozenset[str]
    after_short: frozenset[str]
    cache: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def kind(self, token: str) -> tuple[int, bool, str]:
        """(symbol, whether it is in capitals, words) of a token, by its form alone."""
        got = self.cache.get(token)
        if got is None:
            if len(self.cache) > 500_000:
                self.cache.clear()
            got = self.cache[token] = self._kind(token)
        return got

    def _kind(self, token: str) -> tuple[int, bool, str]:
        words = re.sub(r"[^a-z0-9]+", " ", token.lower()).strip()
        first, inner = token[0], token.strip("[](){}<>:♪* ")
        if _STAMP.fullmatch(token) or (first in "[<{(" and _BRACKETED.fullmatch(token)):
            return STAMP, False, ""
        if first == "<":
            return (NAMED if token[1:3].lower() == "v " and who(token[3:-1]) else MARKED), False, ""
        if first in "[{" and len(token) > 1 or token[:2] == "((":
            single = _NAME.fullmatch(inner) and not _SOUND.search(inner) and inner.lower() not in self.ordinary
            if _NUMBERED.fullmatch(inner) or (_TITLED.fullmatch(inner) and not _SOUND.search(inner)) or (single and inner.lower() not in NOBODY):
                return NAMED, False, ""
            return MARKED, False, ""
        if first == "(" and token.rstrip(":")[-1] == ")":
            if _NUMBERED.fullmatch(inner) or _TITLED.fullmatch(inner):
                return NAMED, False, ""
            if _TITLE.fullmatch(inner):
                return (TITLE_C if token.endswith(":") else TITLE), False, words
            if _SOUND.search(inner):
                return MARKED, False, ""
        if first in "♪*" and len(token) > 1 or token[:2] == ">>":
            return MARKED, False, ""
        if not words:
            return (DASH if token in ("-", "–", "—") else MARK_END if token[-1] in ".?!" else MARK), False, ""
        capital = token.upper() == token and any(c.isalpha() for c in token)
        if _HUM.fullmatch(token):
            return (SHORT if token == "ER" else HUM), capital, words
        bare = token.rstrip(":")
        colon = int(bare != token)
        if _TITLE.fullmatch(bare):
            return TITLE + colon, capital, words
        if not colon and bare.lower() in ("speaker", "spk"):
            return SPEAKER, capital, words
        if re.fullmatch(r"#?\d+", bare):
            return DIGITS + colon, capital, words
        if _NUMBERED.fullmatch(bare):
            return NUMBER + colon, capital, words
        if token[-1] in ".?!":
            return END, capital, words
        if _NAME.fullmatch(bare) and bare.strip(".'’-").lower() not in self.ordinary:
            return NAME + colon, capital, words
        if colon and re.fullmatch(r"[a-z'’-]{3,}", bare) and bare not in self.ordinary:
            return NAME_C, capital, words
        return (HEAD if colon else WORD), capital, words

    def symbols(self, tokens: list[str], begins: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The symbol of each token; codes are indexes into the distinct tokens, texts are codes[begins[i]:ends[i]]."""
        known = [self.kind(t) for t in tokens]
        symbol = np.fromiter((k[0] for k in known), np.int8, len(known))[codes]
        short = np.flatnonzero(symbol == SHORT)
        for i, text in zip(short.tolist(), (np.searchsorted(begins, short, "right") - 1).tolist(), strict=True):
            after = tokens[codes[i + 1]].lower().strip(".,;:") if i + 1 < ends[text] else ""
            lettered = [known[c][1] for c in codes[begins[text] : ends[text]] if known[c][0] <= TITLE_C]
            if lettered and all(lettered) and after not in self.after_short:
                symbol[i] = SHORT_CAPS
        return symbol

    def decode(self, symbol: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The likeliest states of each text (tokens begins[i]:ends[i])."""
        start, move, emit = _log(self.start), _log(self.move), _log(self.emit)
        tags = np.where(np.isin(symbol, (END, HEAD, MARK_END)), CLOSING, SPEECH).astype(np.int8)
        for group in _groups(symbol, begins, ends):
            n, b = (ends - begins)[group], begins[group]
            steps = int(n.max())
            score = start + emit[:, symbol[b]].T
            back = np.zeros((steps, len(group), STATES), np.int8)
            for t in range(1, steps):
                live = t < n
                step = score[:, :, None] + move[None]
                back[t] = step.argmax(1)
                here = symbol[np.minimum(b + t, len(symbol) - 1)]
                score = np.where(live[:, None], step.max(1) + emit[:, here].T, score)
            score[:, [FIRST, INNER]] = NEVER * 100  # a label that is begun is ended
            state = score.argmax(1)
            for t in range(steps - 1, -1, -1):
                live = t < n
                tags[(b + t)[live]] = state[live]
                if t:
                    state = np.where(live, back[t][np.arange(len(group)), state], state)
        return tags

    def expected(self, symbol: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, transitions and emissions in the texts, by the forward-backward algorithm."""
        start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, SYMBOLS))
        for group in _groups(symbol, begins, ends):
            n, b = (ends - begins)[group], begins[group]
            steps, every = int(n.max()), np.arange(len(group))
            forward, chance = np.zeros((steps, len(group), STATES)), np.zeros((steps, len(group), STATES))
            for t in range(steps):
                chance[t] = self.emit[:, symbol[np.minimum(b + t, len(symbol) - 1)]].T
                now = (self.start if t == 0 else forward[t - 1] @ self.move) * chance[t]
                total = now.sum(1, keepdims=True)
                forward[t] = np.where((t < n)[:, None] & (total > 0), now / np.maximum(total, 1e-300), 0)
            back = np.zeros((len(group), STATES))
            for t in range(steps - 1, -1, -1):
                final = np.ones(STATES)
                final[[FIRST, INNER]] = 0
                back = np.where((t == n - 1)[:, None], final, back)
                post = forward[t] * back
                total = post.sum(1, keepdims=True)
                post = np.where(total > 0, post / np.maximum(total, 1e-300), 0)
                live = every[t < n]
                np.add.at(emit.T, symbol[b[live] + t], post[live])
                if t == 0:
                    start += post.sum(0)
                else:
                    ahead = chance[t] * back
                    pair = forward[t - 1][:, :, None] * self.move[None] * ahead[:, None, :]
                    whole = pair.sum((1, 2), keepdims=True)
                    move += np.where((t < n)[:, None, None] & (whole > 0), pair / np.maximum(whole, 1e-300), 0).sum(0)
                    prior = ahead @ self.move.T
                    back = np.where((t < n)[:, None], prior / np.maximum(prior.sum(1, keepdims=True), 1e-300), back)
        return start, move, emit


def fit(texts: list[list[str]], ordinary: frozenset[str] | None = None, after_short: frozenset[str] | None = None, rounds: int = FIT_ROUNDS) -> Model:
    """A model fitted on lexed texts by expectation-maximisation, from the prior. Without lexicons they are counted on the texts."""
    if ordinary is None:
        lower = Counter(t.strip(".,;:?!'\"()’") for tokens in texts for t in tokens if t[:1].islower())
        ordinary = frozenset(w for w, n in lower.items() if n >= ORDINARY)
    if after_short is None:
        after_short = frozenset(b.strip(".,;:?!").lower() for tokens in texts for a, b in zip(tokens, tokens[1:], strict=False) if a == "ER" and b[:1].islower())
    prior = _prior()
    model = Model(*prior, ordinary, after_short)
    texts = [t for t in texts if t]
    if not texts:
        return model
    index: dict[str, int] = {}
    codes = np.array([index.setdefault(t, len(index)) for tokens in texts for t in tokens])
    ends = np.cumsum([len(t) for t in texts])
    begins = np.concatenate([[0], ends[:-1]])
    symbol = model.symbols(list(index), begins, ends, codes)
    for _ in range(rounds):
        counts = model.expected(symbol, begins, ends)
        start, move, emit = (c + PRIOR * p / (1 if p.ndim == 1 else len(p)) for c, p in zip(counts, prior, strict=True))
        model.start, model.move, model.emit = start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True)
    return model


def _seconds(stamp: str) -> float | None:
    m = re.search(r"(\d{1,2}):(\d\d)(?::(\d\d))?(?:[.,](\d+))?", stamp)
    if not m:
        return None
    a, b, c = int(m[1]), int(m[2]), m[3]
    whole = a * 3600 + b * 60 + int(c) if c else a * 60 + b
    return whole + float(f"0.{m[4]}") if m[4] else float(whole)


def _tagger(model: Model):
    """Segments with lexed texts into pieces: what one speaker says within a segment, or a label alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speakers: dict[str | None, str | None] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("tokens").fill_null([]) if batch.column("tokens").null_count else batch.column("tokens")
            offsets = np.asarray(lists.offsets, np.int64)
            flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
            offsets = offsets - offsets[0]
            codes, tokens = np.asarray(flat.indices), flat.dictionary.to_pylist()
            begins, ends = offsets[:-1], offsets[1:]
            of = np.repeat(np.arange(batch.num_rows), ends - begins)
            full = np.flatnonzero(ends > begins)
            symbol = model.symbols(tokens, begins[full], ends[full], codes)
            tags = model.decode(symbol, begins, ends)
            # where a label begins, a piece begins; each segment begins with a piece, too
            fresh = (tags == FIRST) | (tags == ONLY) | (tags == CALL)
            label = np.where(tags >= FIRST, np.cumsum(fresh), -1)
            piece_starts = np.concatenate([begins, np.flatnonzero(fresh)])
            owner = np.concatenate([np.arange(batch.num_rows), of[fresh]])
            labelled = np.concatenate([np.zeros(batch.num_rows, bool), np.ones(int(fresh.sum()), bool)])
            order = np.lexsort((labelled, piece_starts, owner))
            piece_starts, owner, labelled = piece_starts[order], owner[order], labelled[order]
            # words of each piece
            clean = pa.array([model.kind(t)[2] for t in tokens], pa.string())
            has = np.fromiter((bool(model.kind(t)[2]) for t in tokens), bool, len(tokens))
            keep = np.flatnonzero((tags <= CLOSING) & has[codes]) if len(codes) else np.zeros(0, np.int64)
            word_at = np.searchsorted(keep, piece_starts)
            bounds = np.append(word_at, len(keep))
            words = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), clean.take(pa.array(codes[keep]))), " ")
            # speakers
            column = batch.column("speaker").dictionary_encode()
            named = [who(x) for x in column.dictionary.to_pylist()]
            index = column.indices.to_pylist()
            names: list[str | None] = []
            for o, s, by_text in zip(owner.tolist(), piece_starts.tolist(), labelled.tolist(), strict=True):
                if by_text:
                    e = s + 1
                    while e < len(label) and label[e] == label[s]:
                        e += 1
                    text = " ".join(tokens[c] for c in codes[s:e])
                    if text not in speakers:
                        if len(speakers) > 200_000:
                            speakers.clear()
                        speakers[text] = who(text)
                    names.append(speakers[text])
                else:
                    names.append(None if index[o] is None else named[index[o]])
            # a missing start is the first time in the text, or else the end
            start = batch.column("start_time").to_numpy(zero_copy_only=False).astype(float).copy()
            end = batch.column("end_time").to_numpy(zero_copy_only=False).astype(float)
            for r in np.flatnonzero(np.isnan(start)):
                stamp = next((tokens[codes[i]] for i in range(begins[r], ends[r]) if tags[i] == CLOCK), None)
                at = _seconds(stamp) if stamp else None
                start[r] = at if at is not None else end[r]
            start = np.where(np.isnan(start), 1e12, start)
            number = np.arange(len(owner)) - np.searchsorted(owner, owner)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("video_id").take(pa.array(owner)),
                    pa.array(start[owner]),
                    batch.column("segment_id").take(pa.array(owner)),
                    pa.array(number.astype(np.int32)),
                    pa.array(names, pa.string()),
                    pa.array(labelled),
                    words,
                ],
                ["video_id", "start", "segment_id", "piece", "speaker", "labelled", "words"],
            )

    return run


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, lower, capital, after) per batch: how often a word stands in lower case, with a capital or before a colon, and after the abbreviation ER."""
    for batch in batches:
        text = batch.column(0)
        found: dict[str, list[int]] = {}
        counted = pc.utf8_split_whitespace(text).flatten().value_counts()
        for w, n in zip(counted.field("values").to_pylist(), counted.field("counts").to_pylist(), strict=True):
            bare = w.strip(",;.?!:'\"()[]{}<>’-")
            if bare[:1].isalpha():
                found.setdefault(bare.lower(), [0, 0, 0])[not bare[0].islower() or w[-1] == ":"] += n
        for t in text.filter(pc.match_substring(text, "ER ")).to_pylist():
            for w in re.findall(r"\bER ([a-z'’-]+)", t):
                found.setdefault(w, [0, 0, 0])[2] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *[pa.array([c[i] for c in found.values()], pa.int64()) for i in range(3)]], ["w", "lower", "capital", "after"])


def lexicons(segments: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """(ordinary words, words after the abbreviation ER), counted over all texts.

    Ordinary are the words that texts have in lower case and also with a capital or before a colon. Names hardly ever stand in
    lower case, so what comes to the driver grows with the vocabulary and not with the speakers.
    """
    own = segments.select("text").where("text is not null")
    words = own.mapInArrow(_count_words, "w string, lower long, capital long, after long").groupBy("w").agg(*[F.sum(c).alias(c) for c in ("lower", "capital", "after")])
    ordinary = (F.col("lower") >= ORDINARY) & (F.col("capital") > 0) & (F.col("lower") >= ORDINARY_SHARE * F.col("capital"))
    got = words.where(ordinary | (F.col("after") > 0)).select("w", ordinary, F.col("after") > 0).collect()
    return frozenset(w for w, o, _ in got if o), frozenset(w for w, _, a in got if a and w.strip("-") and not _HUM.fullmatch(w))


def sample_texts(segments: DataFrame, most: int = SAMPLE_SEGMENTS) -> list[list[str]]:
    """The lexed texts of at most `most` segments, chosen by a hash of their ids."""
    share = min(1.0, 0.98 * most / max(1, segments.count()))
    chosen = segments.where(F.pmod(F.xxhash64("segment_id"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else segments
    return [r[0] or [] for r in chosen.select(lexed(F.col("text"))).limit(most).collect()]


def pieces(segments: DataFrame, model: Model) -> DataFrame:
    own = segments.select("video_id", "segment_id", "start_time", "end_time", "speaker", lexed(F.coalesce("text", F.lit(""))).alias("tokens"))
    return own.mapInArrow(_tagger(model), "video_id string, start double, segment_id long, piece int, speaker string, labelled boolean, words string")


def _in_order(*position: str) -> Column:
    """The spoken words of a group, in the order of position."""
    said = F.collect_list(F.when(F.col("words") != "", F.struct(*position, "words")))
    return F.array_join(F.transform(F.array_sort(said), lambda x: x["words"]), " ")


def turns(segments: DataFrame, model: Model | None = None) -> DataFrame:
    """(video_id, start_sec, speaker, turn_words) of the distinct turns of segments (video_id, segment_id, start_time, end_time, speaker, text).

    Repeated segments count once; segments that start together are ordered by id. A null start is the first time in the text,
    else the end; without either the segment comes last. Null, blank and wordless texts give no turn and end none. Speech
    before any speaker is known has the speaker "". Segments without a video id are one video.
    """
    if model is None:
        model = fit(sample_texts(segments), *lexicons(segments))
    parts = pieces(segments, model).withColumn("bucket", F.floor(F.col("start") / BUCKET_S))
    stretch = W.partitionBy("video_id", "bucket")
    local = stretch.orderBy("start", "segment_id", "piece")
    same = (F.lag("segment_id").over(local) == F.col("segment_id")) & (F.lag("piece").over(local) == F.col("piece"))
    once = parts.withColumn("again", F.coalesce(same, F.lit(False))).where("not again")
    spoken = F.col("words") != ""
    heard = F.when(F.col("labelled") | spoken, F.col("speaker"))
    filled = once.withColumn("by", F.last(heard, ignorenulls=True).over(local)).withColumn("place", F.row_number().over(local))
    said_by = F.last(F.when(spoken, F.struct("by")), ignorenulls=True).over(local.rowsBetween(W.unboundedPreceding, -1))
    filled = filled.withColumn("before", said_by).withColumn("ending", F.last("by", ignorenulls=True).over(local.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    opens = (spoken & (F.col("before").isNull() | ~F.col("before.by").eqNullSafe(F.col("by")))).cast("int")
    numbered = filled.withColumn("nth", F.sum(opens).over(local)).where(spoken | (F.col("place") == 1))  # the first piece says how the stretch ends, even if nobody speaks
    islands = numbered.groupBy("video_id", "bucket", "nth").agg(
        F.max(F.when(spoken, F.col("by"))).alias("by"), F.max("ending").alias("ending"), F.min(F.when(spoken, F.col("start"))).alias("start"), _in_order("start", "segment_id", "piece").alias("words")
    )
    # the first and last turn of a stretch may go on in others; those that begin in one second may be equal
    turn = stretch.orderBy("nth")
    last = F.max("nth").over(stretch)
    sec = F.floor("start").cast("long")
    edge = (F.col("nth") <= 1) | (F.col("nth") == F.col("n")) | ((F.col("nth") == 2) & F.col("after_nobody"))
    twin = F.coalesce(F.col("sec") == F.lag("sec").over(turn), F.lit(False)) | F.coalesce(F.col("sec") == F.lead("sec").over(turn), F.lit(False))
    marked = islands.withColumn("n", last).withColumn("sec", sec).withColumn("after_nobody", F.coalesce(F.lag("by").over(turn).isNull() & (F.col("nth") == 2), F.lit(False)))
    marked = marked.withColumn("twin", twin).withColumn("edge", edge)
    kept = storage.keep(marked.drop("after_nobody"))  # read by several branches below, which would tag every text again
    plain = kept.where("not edge and not twin").select("video_id", F.col("sec").alias("start_sec"), F.col("by").alias("speaker"), F.col("words").alias("turn_words"))
    twins = kept.where("not edge and twin").select("video_id", F.col("sec").alias("start_sec"), F.col("by").alias("speaker"), F.col("words").alias("turn_words"))
    edges = kept.where("edge")
    # one row per stretch: its first, second and last speaker, and whom it hands on
    ends = edges.groupBy("video_id", "bucket").agg(
        F.max("ending").alias("ending"), F.max("n").alias("n"), F.max(F.when(F.col("nth") == 1, F.col("by"))).alias("one"), F.max(F.when(F.col("nth") == 2, F.col("by"))).alias("two"), F.max_by("by", "nth").alias("final")
    )
    across = W.partitionBy("video_id").orderBy("bucket")
    earlier = across.rowsBetween(W.unboundedPreceding, -1)
    carried = ends.withColumn("carry", F.coalesce(F.last("ending", ignorenulls=True).over(earlier), F.lit(""))).where("n > 0")
    carried = carried.withColumn("merged", F.coalesce(F.col("one").isNull() & (F.col("two") == F.col("carry")), F.lit(False)).cast("int"))
    carried = carried.withColumn("opening", F.coalesce("one", "carry")).withColumn("closing", F.when(F.col("n") == 1, F.coalesce("one", "carry")).otherwise(F.col("final")))
    carried = carried.withColumn("joined", F.when(F.col("opening") == F.lag("closing").over(across), 1).otherwise(0))
    offset = carried.select(
        F.col("video_id").alias("v2"), F.col("bucket").alias("b2"), "opening", "merged", (F.coalesce(F.sum(F.col("n") - F.col("merged") - F.col("joined")).over(earlier), F.lit(0)) - F.col("joined")).alias("offset")
    )
    placed = edges.where("nth > 0").join(offset, F.col("video_id").eqNullSafe(F.col("v2")) & (F.col("bucket") == F.col("b2"))).select(
        "video_id", "bucket", "nth", "start", "words", F.coalesce("by", "opening").alias("speaker"), (F.col("nth") + F.col("offset") - F.when(F.col("nth") > 1, F.col("merged")).otherwise(0)).alias("turn")
    )
    whole = placed.groupBy("video_id", "turn", "speaker").agg(F.min("start").alias("start"), _in_order("bucket", "nth").alias("turn_words"))
    crossing = whole.select("video_id", F.floor("start").cast("long").alias("start_sec"), "speaker", "turn_words")
    return plain.unionByName(crossing.unionByName(twins).distinct())
