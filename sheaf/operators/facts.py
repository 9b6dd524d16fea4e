"""Typed facts of a clause - a date or a counted quantity, its role and its subject - and texts that share one.

A clause gives a fact only if nothing in its sentence negates or reschedules it, it has exactly one anchor and one
role, and a subject can be named: its own run of capitalised words, or else the text's heading.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.text import MONTHS

# Words after which a sentence says nothing certain - negation, contrast, moved or past dates.
NEGATION = (
    "not", "no", "never", "without", "different", "other", "another", "unrelated", "instead", "except", "isn't", "wasn't", "aren't", "weren't", "don't", "doesn't", "didn't",
    "won't", "hindi", "di", "wala", "walang", "huwag", "hwag", "wag", "iba", "ibang",
)
CONTRAST = (
    "but", "however", "pero", "ngunit", "samantalang", "habang",
)
RESCHEDULE = (
    "move", "moved", "moves", "moving", "reschedule", "rescheduled", "resched", "postpone", "postponed", "delayed", "pushed", "shifted", "cancel", "cancelled", "canceled",
    "cancellation", "change", "changed", "previously", "previous", "originally", "original", "formerly", "former", "initially", "old", "was", "were", "dati", "dating", "orihinal",
    "inilipat", "nilipat", "ilipat", "ililipat", "lumipat", "na-move", "ni-move", "i-move", "na-resched", "ni-resched", "i-resched", "na-reschedule", "ni-reschedule",
    "i-reschedule", "na-postpone", "i-postpone", "ipinagpaliban", "pinagpaliban", "ipagpaliban", "ipagpapaliban", "naantala", "kinansela", "kanselado", "kanselahin", "na-cancel",
    "kina-cancel", "i-cancel", "binago", "nabago", "babaguhin", "pinalitan", "napalitan", "papalitan",
)
# Role words, counted nouns, words before a number that only marks a place.
DEADLINE = (
    "deadline", "due", "submission", "submit", "submitted", "pasahan", "pagpasa", "ipasa", "magpasa", "isumite", "pagsumite",
)
EVENT = (
    "session", "sesyon", "meeting", "pulong", "pagpupulong", "presentation", "presentasyon", "class", "klase", "exam", "pagsusulit", "practice", "magpraktis", "pagsasanay",
    "workshop", "kumperensya", "conference", "interview", "panayam", "schedule", "scheduled", "iskedyul",
)
PEOPLE = (
    "student", "students", "estudyante", "mag-aaral", "participant", "participants", "kalahok", "volunteer", "volunteers", "boluntaryo", "boluntaryong", "people", "tao", "member",
    "members", "miyembro", "respondent", "respondents", "respondente", "interviewee", "interviewees",
)
ITEMS = (
    "file", "files", "document", "documents", "dokumento", "item", "items", "copies", "kopya", "report", "reports", "ulat",
)
MARKERS = (
    "page", "pages", "p", "pp", "pahina", "section", "seksyon", "no", "number", "bilang", "v", "version", "chapter", "kabanata", "step", "hakbang", "line", "linya", "ika",
    "ikalawa", "item", "#",
)
ARTICLES = (
    "the", "a", "an", "this", "that", "these", "those", "ang", "ng", "sa", "si", "ni", "kay", "para", "mga", "of", "and", "at",
)

# Further spellings of months.
MORE_MONTHS = {"sept": 9, "octubre": 10}
#: Least cosine of two passages that state one fact.
FACT_COSINE = 0.88

_MONTH = {name: n for n, names in enumerate(MONTHS, 1) for name in names} | MORE_MONTHS
_SENTENCE = re.compile(r"[^.!?\n]*(?:\.(?!\s|$)[^.!?\n]*)*(?:[.!?]|\n|$)")
_CLAUSE = re.compile(r"[^;,]+")
_APOSTROPHE = re.compile(r"^[^\w']+")
_TRIM = re.compile(r"^[^\w#]+|[^\w]+$")


def _bare(raw: str) -> str:
    return _TRIM.sub("", raw)


def _dates(words: list[str]) -> list[tuple[int, int, int | None]]:
    found = []
    for i, w in enumerate(words):
        month = _MONTH.get(w.rstrip(".").lower())
        if not month or w == "may":
            continue
        day = re.fullmatch(r"(\d{1,2})(?:st|nd|rd|th)?", words[i + 1].lower()) if i + 1 < len(words) else None
        if day and 1 <= int(day[1]) <= 31:
            year = words[i + 2] if i + 2 < len(words) else ""
            found.append((month, int(day[1]), int(year) if re.fullmatch(r"(?:19\d\d|20\d\d|2100)", year) else None))
    return found


def _quantities(words: list[str]) -> list[tuple[int, str]]:
    found = []
    for i, w in enumerate(words):
        if not w.isdigit() or (i and words[i - 1].lower() in MARKERS):
            continue
        for noun in words[i + 1 : i + 4]:
            kind = "person" if noun.lower() in PEOPLE else "item" if noun.lower() in ITEMS else None
            if kind:
                found.append((int(w), kind))
                break
    return found


def _subjects(words: list[str]) -> list[str]:
    spans, run = [], []
    for w in [*words, ""]:
        if w and w[0].isupper() and w.lower() not in ARTICLES and w.lower().rstrip(".") not in _MONTH:
            run.append(w.lower())
            continue
        if len(run) > 1 and " ".join(run) not in spans:
            spans.append(" ".join(run))
        run = []
    return spans


def text_facts(text: str) -> list[tuple]:
    """(kind, role, subject, from_heading, month, day, year, value, start, end) of every clause with one fact; offsets in UTF-8 bytes."""
    heading = next((h.strip("# \r") for h in text.split("\n") if h.startswith("# ")), "").lower()
    out = []
    for s in _SENTENCE.finditer(text):
        if not s[0].strip() or s[0].lstrip().startswith("# "):
            continue
        words = [_bare(w) for w in s[0].split()]
        low = {w.lower() for w in words}
        if not low.isdisjoint(NEGATION + CONTRAST + RESCHEDULE) or any(w.endswith("n't") for w in low) or any(_APOSTROPHE.sub("", w).lower().startswith("'di") for w in s[0].split()):
            continue
        whole = _subjects([w for w in words if w])
        for c in _CLAUSE.finditer(s[0]):
            part = [w for w in map(_bare, c[0].split()) if w]
            dates, counted = _dates(part), _quantities(part)
            roles = {r for w in part for r, names in (("deadline", DEADLINE), ("event", EVENT)) if w.lower() in names}
            if any(a.lower() == "huling" and b.lower() == "araw" for a, b in zip(part, part[1:])):
                roles.add("deadline")
            subjects = _subjects(part) or whole
            subject, titled = (subjects[0], False) if len(subjects) == 1 else (heading, True) if not subjects else ("", False)
            if not subject or len(dates) + len(counted) != 1:
                continue
            start = len(text[: s.start() + c.start()].encode())
            end = start + len(c[0].encode())
            if dates and len(roles) == 1:
                out.append(("date", roles.pop(), subject, titled, *dates[0], None, start, end))
            elif counted:
                out.append(("quantity", counted[0][1], subject, titled, None, None, None, counted[0][0], start, end))
    return out


def clause_facts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, role, subject, from_heading, month, day, year, value, start, end) of every text; null texts have none."""
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [key, "kind", "role", "subject", "from_heading", "month", "day", "year", "value", "start", "end"]
        for pdf in batches:
            yield pd.DataFrame([(k, *f) for k, t in zip(pdf[key], pdf["__text"]) for f in text_facts(t)], columns=columns, dtype=object)

    rows = texts.select(F.col(key), F.col(text).alias("__text")).filter(f"{key} IS NOT NULL AND __text IS NOT NULL")
    # a text delivered twice gives equal facts: these are made distinct, not the texts
    return rows.mapInPandas(run, f"{key} {kind}, kind string, role string, subject string, from_heading boolean, month int, day int, year int, value bigint, start bigint, end bigint").distinct()


def shared_facts(facts: DataFrame, key: str) -> DataFrame:
    """(key, class_id, kind, role, subject, month, day, value, n_texts): texts that say the same of the same subject, one row
    per text and fact, class_id being the smallest text that says it and n_texts how many do.

    A subject that is only a text's heading counts where some text of the class names it in a sentence: two headings
    alone are no match.  Texts with different years are of different classes; a text without a year is in the class of
    each year, and in one of its own where no year is named.  No pairs are formed.
    """
    same = ["kind", "role", "subject", "month", "day", "value"]
    one = facts.select(key, *same, "from_heading", "year").distinct().fillna(-1, ["month", "day", "value"])
    years = one.groupBy(*same).agg(F.collect_set("year").alias("__years"))
    each = one.join(years, same).withColumn("__year", F.explode_outer(F.when(F.col("year").isNotNull(), F.array("year")).otherwise(F.col("__years"))))
    classes = each.groupBy(*same, "__year").agg(F.min(key).alias("class_id"), F.count_distinct(key).alias("n_texts"), F.bool_or(~F.col("from_heading")).alias("__told"))
    sound = classes.filter("n_texts > 1 AND __told")
    met = each.join(sound.withColumnRenamed("__year", "__y"), [*same]).filter(F.col("__year").eqNullSafe(F.col("__y")))
    return met.select(key, "class_id", *same, "n_texts").distinct()


def fact_links(facts: DataFrame, similar: DataFrame, key: str, least: float = FACT_COSINE) -> DataFrame:
    """(a, b, kind, role, subject): pairs of texts that share a fact and whose best passages have cosine `least` or more.

    `similar` (a, b, cosine; a < b) are pairs that similarity has found: it bounds the pairs, facts are only looked up.
    """
    same = ["kind", "role", "subject", "month", "day", "value"]
    one = facts.select(key, *same, "from_heading", "year").distinct().fillna(-1, ["month", "day", "value"])
    near = similar.filter(F.col("cosine") >= least).select("a", "b").distinct()
    left = near.join(one.select(F.col(key).alias("a"), *same, F.col("from_heading").alias("ha"), F.col("year").alias("ya")), "a")
    met = left.join(one.select(F.col(key).alias("b"), *same, F.col("from_heading").alias("hb"), F.col("year").alias("yb")), ["b", *same])
    return met.filter("NOT (ha AND hb) AND (ya IS NULL OR yb IS NULL OR ya = yb)").select("a", "b", "kind", "role", "subject").distinct()
