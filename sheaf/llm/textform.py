"""Problem 2: one consistent form for text that looks the same.

The form is: compatibility width and presentation forms folded, accents composed (NFC), invisible characters
removed, every kind of space character as U+0020, letters of other alphabets that look like Latin ones as the
Latin letter.  Case, accents, punctuation, the number of spaces and line breaks are kept.

Only unstable segments are touched.  A character is stable if the normalization quick check says yes for it whatever
stands before it (it is a starter, composed, and no second half of a composition) and the form maps nothing in it.  A
segment is a run of unstable characters together with the one stable character before it, which a mark may join
with; the next stable character begins anew, so a segment's canonical text can be spliced into what is unchanged without
looking further.  Which characters are unstable is asked once for each distinct character of a text.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..plans.staging import stage

# Letters of other alphabets that have the look of a Latin letter.
LOOKALIKES = {
    # Cyrillic, small
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    # Cyrillic, capital
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ӏ": "I", "Ј": "J", "К": "K", "М": "M", "О": "O",
    "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y",
    # Greek
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Ϳ": "J", "Κ": "K",
    "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "γ": "y", "ι": "i", "ρ": "p", "σ": "o", "υ": "u",
    # Latin letters with the look of a plain one
    "ı": "i", "ɑ": "a", "ɡ": "g",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "Y", "Ꮐ": "G", "Ꮓ": "Z",
    "Ꮢ": "R", "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ꮷ": "d", "Ᏼ": "B",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L",
    "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Armenian
    "օ": "o", "ս": "u", "Օ": "O", "Տ": "S", "Լ": "L",
}

#: Kinds of compatibility decomposition that keep the look: widths, Arabic shapes, fonts, non-breaking twins.
SAME_LOOK_TAGS = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>", "<font>", "<vertical>")

_CONTROLS = regex.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
_INVISIBLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}\x80-\x84\x86-\x9f]")
_LETTERS = regex.compile(r"\p{L}+")
#: What makes the JVM hand a text to Python at all.
UNSTABLE_PATTERN = r"[^\t\n\x0B\f\r -~]"


@lru_cache(maxsize=65536)
def _char(c: str) -> str:
    """The replacement of one character before composition."""
    if _INVISIBLE.match(c):
        return ""
    if unicodedata.category(c) == "Zs":
        return " "
    kind = unicodedata.decomposition(c)
    if kind.startswith("<"):
        whole = unicodedata.normalize("NFKC", c)
        same = kind.startswith(SAME_LOOK_TAGS) or (kind.startswith("<compat>") and len(whole) > 1 and _LETTERS.fullmatch(whole))
        if same and whole != c:
            return "".join(map(_char, whole))
    return LOOKALIKES.get(c, c)


def _normal(s: str) -> str:
    """The form of a string that begins and ends at boundaries."""
    plain = "".join(map(_char, s))
    apart = unicodedata.normalize("NFD", plain)  # an accent may stand on a look-alike letter
    return unicodedata.normalize("NFC", "".join(map(_char, apart)))


#: Segments are short - a letter and its marks - except in texts of marks alone: those are not kept.
SHORT = 16
_segment = lru_cache(maxsize=65536)(_normal)


@lru_cache(maxsize=1)
def _second_halves() -> frozenset[str]:
    """Characters that may compose with a starter before them (quick check: maybe): ends of canonical decompositions, Hangul vowels and finals."""
    ends = {chr(c) for a, b in ((0x1161, 0x1175), (0x11A8, 0x11C2)) for c in range(a, b + 1)}
    for c in range(0xC0, 0x20000):
        parts = unicodedata.decomposition(chr(c))
        if parts and parts[0] != "<" and " " in parts:
            ends.add(chr(int(parts.split()[-1], 16)))
    return frozenset(ends)


@lru_cache(maxsize=65536)
def _stable(c: str) -> bool:
    return not unicodedata.combining(c) and c not in _second_halves() and _normal(c) == c


@lru_cache(maxsize=1024)
def _segments(unstable: str) -> regex.Pattern:
    return regex.compile(f"(?s).?[{regex.escape(unstable)}]+")


def canonical(text: str) -> str:
    """The consistent form of one text; idempotent."""
    if _CONTROLS.search(text):
        text = _CONTROLS.sub("", text)
    if text.isascii():
        return text
    unstable = "".join(sorted(c for c in set(text) if c > "\x7f" and not _stable(c)))
    if not unstable:
        return text
    pattern = _segments(unstable) if len(unstable) <= 64 else regex.compile(f"(?s).?[{regex.escape(unstable)}]+")
    return pattern.sub(lambda m: _segment(m[0]) if len(m[0]) <= SHORT else _normal(m[0]), text)


@F.pandas_udf(T.StringType())
def _canonical_udf(texts: pd.Series) -> pd.Series:
    return texts.map(canonical, na_action="ignore").astype(object).where(texts.notna(), None)


def canonical_form(text: Column) -> Column:
    """Column of the consistent form; null stays null, the empty string stays empty.

    Texts of plain ASCII never leave the JVM: only those with an unstable character are sent to Python.
    """
    return F.coalesce(_canonical_udf(F.when(text.rlike(UNSTABLE_PATTERN), text)), text)


def look_alike_pairs(df: DataFrame, key: str, text: str, within: str | None = None) -> DataFrame:
    """Pairs (id_a < id_b) of rows whose texts differ as strings but have the same consistent form.

    `within` restricts pairs to equal values of that column (null is no value: such rows take part in nothing).
    Null ids and null texts take no part; repeated rows count once; other columns of df are ignored.  Texts are
    grouped into classes of equal strings first, only forms with two different strings go on, and pairs are
    formed between classes, so that any number of exact copies costs no comparisons.
    """
    scope = F.col(within) if within else F.lit("")
    rows = df.select(F.col(key).alias("id"), scope.alias("scope"), F.col(text).alias("raw")).filter("id IS NOT NULL AND scope IS NOT NULL AND raw IS NOT NULL")
    hashed = stage(rows.select("id", "scope", F.unhex(F.md5("raw")).alias("raw"), F.unhex(F.md5(canonical_form(F.col("raw")))).alias("form")), "forms")
    dirty = hashed.groupBy("scope", "form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).filter("lo <> hi").select("scope", "form")
    members = hashed.join(dirty, ["scope", "form"], "left_semi").distinct()
    classes = members.select("scope", "form", "raw").distinct()
    other = classes.select("scope", "form", F.col("raw").alias("raw_b"))
    met = classes.withColumnRenamed("raw", "raw_a").join(other, ["scope", "form"]).filter("raw_a < raw_b")
    left = members.select("scope", "form", F.col("raw").alias("raw_a"), F.col("id").alias("x"))
    right = members.select("scope", "form", F.col("raw").alias("raw_b"), F.col("id").alias("y"))
    return (
        met.join(left, ["scope", "form", "raw_a"]).join(right, ["scope", "form", "raw_b"])
        .filter("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
    )
