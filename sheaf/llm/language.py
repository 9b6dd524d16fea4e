"""Problem 5: the language of each document and of each paragraph of a mixed one, with a confidence.

A model is fitted on labelled sample texts (at most `FIT_ROWS` rows and `FIT_CHARS` characters of each, a documented
bound on the fit alone).  Per language a word is either one of the samples, with its frequency, or new, with the
likelihood of its letter sequences; both are taken against a background of single letters that knows no language.
What a word of the language gains over that background is measured on held-out samples, and a share of it
(`REJECT`) is what a stretch of text must gain on average to count as the language at all: texts of other languages
fall short of it, whatever they are.  Script ranges of the text as written narrow candidates first: a word of another
alphabet is of neither language, unless all its letters are look-alikes and the paragraph is mostly Latin.  A Viterbi
pass over the words, with a penalty for each switch, labels spans; the share of the lesser language decides between
one language and `mixed`.  The confidence is the chance that the gain and the share lie on their sides of the limits.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from .textform import _CONTROLS, _INVISIBLE, LOOKALIKES, canonical

FIT_ROWS, FIT_CHARS = 5000, 20_000
LESSER = 0.2
SWITCH = 1.0
#: Below this share of en and fil words among all words with letters a text is of neither language.
LEAST_SHARE = 0.4
#: Share of the gain over the background that words must have on average; chance that a word is new; folds of the fit.
REJECT, NEW, FOLDS = 0.4, 0.1, 5
#: Bounds of one word's gain, and of the difference of its states; words that count as one independent observation.
LOW, HIGH, CLIP, BLUR = -4.0, 6.0, 5.0, 2.0
LETTERS = 60
PARAGRAPH_WORDS = 6
CACHED, CACHED_LENGTH = 300_000, 40

_TOKEN = regex.compile(r"[\p{L}\p{N}]+")
_LETTER = regex.compile(r"\p{L}")
_LATIN = regex.compile(r"\p{Script=Latin}")
_OTHER_LETTER = regex.compile(r"[\p{L}--[\p{Script=Latin}\p{Script=Common}\p{Script=Inherited}]]", regex.V1)
_RAW_WORD = regex.compile(r"[\p{L}\p{M}\p{Cf}]*\p{L}[\p{L}\p{M}\p{Cf}]*")
_BLANK = regex.compile(r"(?:\r\n|\n|\r)[^\S\r\n]*(?:\r\n|\n|\r)(?:[^\S\r\n]*(?:\r\n|\n|\r))*")
#: Stands for a letter of a word in another alphabet; no look-alike, so it stays what it is in the consistent form.
_STRANGE = "\u0436"


def _scripts(text: str) -> str:
    """The text with the letters of words in other alphabets replaced by one that is plainly not Latin."""
    if text.isascii() or not _OTHER_LETTER.search(text):
        return text
    latin = other = 0
    for m in _RAW_WORD.finditer(text):
        if _LATIN.search(m[0]):
            latin += 1
        elif _OTHER_LETTER.search(m[0]):
            other += 1

    def put(m) -> str:
        if _LATIN.search(m[0]) or not _OTHER_LETTER.search(m[0]) or (latin > other and all(c in LOOKALIKES for c in m[0])):
            return m[0]
        return _STRANGE * len(m[0])

    return _RAW_WORD.sub(put, text)


def words(text: str) -> list[str]:
    return _TOKEN.findall(canonical(_scripts(text)).lower())


def paragraphs(text: str) -> list[str]:
    """The parts between blank lines, blank ones left out; a line of invisible characters is blank."""
    if _CONTROLS.search(text):
        text = _CONTROLS.sub("", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    return [p for p in _BLANK.split(text) if p.strip()]


class Letters:
    """Likelihood of a word's letters given the two before each, mixed with shorter contexts where those are rare."""

    def __init__(self, known: set[str] | Counter):
        self.three, self.two, self.one, self.after, self.begun = Counter(), Counter(), Counter(), Counter(), Counter()
        for word in known:
            p = f"^^{word}$"
            for i in range(2, len(p)):
                self.three[p[i - 2 : i + 1]] += 1
                self.after[p[i - 2 : i]] += 1
                self.two[p[i - 1 : i + 1]] += 1
                self.begun[p[i - 1]] += 1
                self.one[p[i]] += 1
        self.total = sum(self.one.values())

    def _single(self, c: str) -> float:
        return (self.one[c] + 0.5) / (self.total + 0.5 * LETTERS)

    def sequence(self, word: str) -> float:
        p, out = f"^^{word}$", 0.0
        for i in range(2, len(p)):
            pair = (self.two[p[i - 1 : i + 1]] + 5 * self._single(p[i])) / (self.begun[p[i - 1]] + 5)
            out += math.log((self.three[p[i - 2 : i + 1]] + 3 * pair) / (self.after[p[i - 2 : i]] + 3))
        return out

    def background(self, word: str) -> float:
        return sum(math.log(0.75 * self._single(c) + 0.25 / LETTERS) for c in f"{word}$")


@dataclass
class Model:
    """Word counts and letters of (en, fil), the letters of both, and the gain a word must have over the background."""

    counts: tuple[Counter, Counter]
    letters: tuple[Letters, Letters]
    pool: Letters
    limit: float = 0.0
    spread: float = 1.0
    cache: dict = field(default_factory=dict)

    def gains(self, word: str) -> tuple[float, float]:
        """Logarithm of the likelihood of the word in (en, fil) over the background, within bounds."""
        if _STRANGE in word:
            return LOW, LOW
        if any(c.isdigit() for c in word) or len(word) > CACHED_LENGTH:  # figures with units, hex, encoded data
            return 0.0, 0.0
        base, out = self.pool.background(word), []
        for n, l in zip(self.counts, self.letters):
            p = (1 - NEW) * n[word] / max(1, n.total()) + NEW * math.exp(max(-700.0, l.sequence(word)))
            out.append(max(LOW, min(HIGH, math.log(p) - base)))
        return out[0], out[1]

    def scores(self, word: str) -> tuple[float, float, float, float] | None:
        """Scores of (en, fil, neither) below the best of them, and the larger gain; None for a word without letters."""
        got = self.cache.get(word, 0)
        if got != 0:
            return got
        if not _LETTER.search(word):
            got = None
        else:
            en, fil = self.gains(word)
            top = max(en, fil, self.limit)
            got = (max(en - top, -CLIP), max(fil - top, -CLIP), max(self.limit - top, -CLIP), max(en, fil))
        if len(self.cache) < CACHED and len(word) <= CACHED_LENGTH:
            self.cache[word] = got
        return got


def _model(texts: tuple[list[list[str]], list[list[str]]]) -> Model:
    counts = tuple(Counter(w for t in x for w in t) for x in texts)
    return Model(counts, tuple(Letters(c) for c in counts), Letters(set(counts[0]) | set(counts[1])))


def fit(samples: list[tuple[str, str]]) -> Model:
    """The model of (language, text) samples; languages other than en and fil are not needed and not used."""
    texts: tuple[list, list] = ([], [])
    for language, text in samples[:FIT_ROWS]:
        side = {"en": 0, "fil": 1}.get(language)
        if side is not None and text:
            texts[side].append([w for w in words(text[:FIT_CHARS]) if _LETTER.search(w)])
    model = _model(texts)
    told = []
    for k in range(FOLDS):  # what words of samples gain that the model has not seen
        part = _model(tuple([t for n, t in enumerate(x) if n % FOLDS != k] for x in texts))
        told += [part.gains(w)[side] for side, x in enumerate(texts) for n, t in enumerate(x) if n % FOLDS == k for w in t]
    if told:
        mean = sum(told) / len(told)
        model.limit = REJECT * mean
        model.spread = max(0.1, math.sqrt(sum((x - mean) ** 2 for x in told) / len(told)))
    return model


def viterbi(model: Model, found: list[str]) -> tuple[list[int], float]:
    """(states, gain): the state (0 en, 1 fil, 2 neither) of each word with letters on the best path, and the sum of the words' gains."""
    told = [s for s in map(model.scores, found) if s is not None]
    if not told:
        return [], 0.0
    sums = [sum(x) for x in zip(*told)]
    top = max(sums[:3])
    if top > -SWITCH:  # leaving the best state pays less than a switch costs
        return [sums.index(top)] * len(told), sums[3]
    path, best = [], (0.0, 0.0, 0.0)
    for s in told:
        lead = max(best)
        jump, first = lead - SWITCH, best.index(lead)
        back = tuple(k if best[k] >= jump else first for k in (0, 1, 2))
        best = tuple((b if b >= jump else jump) + x for b, x in zip(best, s))
        path.append(back)
    states, k = [], best.index(max(best))
    for back in reversed(path):
        states.append(k)
        k = back[k]
    return states[::-1], sums[3]


def _below(limit: float, value: float, spread: float) -> float:
    """The chance that a quantity measured as `value` lies below the limit."""
    return 0.5 * (1 + math.erf((limit - value) / (spread * math.sqrt(2))))


def decide(model: Model, states: list[int], gain: float) -> tuple[str, float]:
    """(language, confidence) of a labelled stretch with that sum of gains."""
    en, fil, n = states.count(0), states.count(1), len(states)
    if not n:
        return "unknown", 1.0
    free = max(1.0, n / BLUR)
    foreign = _below(model.limit, gain / n, model.spread / math.sqrt(free))
    if en + fil < LEAST_SHARE * n:
        return "unknown", round(max(0.5, foreign), 4)
    lesser = min(en, fil) / (en + fil)
    single = _below(LESSER, lesser, math.sqrt((lesser * (1 - lesser) + 0.5 / free) / free))
    name = "mixed" if lesser >= LESSER else "en" if en > fil else "fil"
    return name, round(max(0.0, 1 - foreign) * (1 - single if name == "mixed" else single), 4)


def label(model: Model, text: str) -> list[tuple[int, str, float, int]]:
    """(seg_no, language, confidence, words): 0 the whole text; from 1 its paragraphs, if it is mixed."""
    parts = [words(p) for p in paragraphs(text)]
    told = [viterbi(model, p) for p in parts]
    whole = decide(model, [k for s, _ in told for k in s], sum(g for _, g in told))
    out = [(0, *whole, sum(map(len, parts)))]
    if whole[0] == "mixed":
        out += [(n, *decide(model, *s), len(p)) for n, (p, s) in enumerate(zip(parts, told), 1)]
    return out


def detect_languages(texts: DataFrame, samples: DataFrame, key: str = "file_id", text: str = "content") -> DataFrame:
    """(key, seg_no, language, confidence, n_words): seg_no 0 for each row, from 1 its paragraphs if it is mixed.

    A null or empty text is `unknown` with confidence 1.  Null keys are left out and repeated rows count once (equal
    rows give equal labels, which are made distinct); other columns are ignored.  `samples` has language and text; it
    is read to the driver within the bound FIT_ROWS, smallest sample_id first, and the fitted model of a few thousand
    numbers goes with the function.
    """
    rows = samples.filter("language IN ('en', 'fil') AND text IS NOT NULL").orderBy("sample_id").select("language", "text").limit(FIT_ROWS).collect()
    model = fit([(r[0], r[1]) for r in rows])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, *row) for i, t in zip(pdf["id"], pdf["text"]) for row in label(model, t if isinstance(t, str) else "")]
            yield pd.DataFrame(out, columns=["id", "seg_no", "language", "confidence", "n_words"])

    once = texts.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("id IS NOT NULL")
    return once.mapInPandas(run, "id bigint, seg_no int, language string, confidence double, n_words int").distinct().withColumnRenamed("id", key)
