"""Passages for the index: paragraphs packed up to a limit, never across a page nor inside a link."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

INDEX_CHARS, CORE_BYTES, SUMMARY_BYTES = 1200, 800, 600
_PARAGRAPH = re.compile(r"\S(?:.*?\S)??(?=\s*?(?:\n[^\S\n]*\n|\Z))", re.S)
_LINK = re.compile(r"\[[^\]]+\]\([^)]+\)")
_SPACE = re.compile(r"\s")


def _length(text: str, unit: str) -> int:
    return len(text) if unit == "chars" else len(text.encode())


def _cut(text: str, limit: int, unit: str) -> int:
    """Characters of the longest prefix within the limit."""
    if unit == "chars":
        return limit
    return len(text.encode()[:limit].decode("utf-8", "ignore"))


def passages(text: str, limit: int, unit: str = "chars") -> list[tuple[int, int]]:
    """(start, end) in characters of each passage of one page."""
    pieces: list[tuple[int, int]] = []
    for m in _PARAGRAPH.finditer(text):
        a, b = m.span()
        links = [(a + x.start(), a + x.end()) for x in _LINK.finditer(text[a:b])] if _length(text[a:b], unit) > limit else []
        starts = [x[0] for x in links]
        while _length(text[a:b], unit) > limit:
            most = a + max(1, _cut(text[a : a + limit + 1], limit, unit))
            spaces = [a + s.start() for s in _SPACE.finditer(text[a:most]) if s.start()]
            free = [s for s in spaces if not ((i := bisect_left(starts, s)) and links[i - 1][0] < s < links[i - 1][1])]
            at = free[-1] if free else most
            if text[a:at].strip():
                pieces.append((a, at))
            a = at
            while a < b and text[a].isspace():
                a += 1
        if a < b:
            pieces.append((a, b))
    merged: list[tuple[int, int]] = []
    for a, b in pieces:
        if merged and _length(text[merged[-1][0] : b], unit) <= limit:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    return merged


def chunk(texts: DataFrame, key: str, text: str, pages: str | None = None, limit: int = INDEX_CHARS, unit: str = "chars", with_text: bool = True) -> DataFrame:
    """(key, ordinal, start_offset, end_offset, page, chunk_text); offsets in UTF-8 bytes, page null where there are none.

    Null and blank texts give no passage; repeated rows count once; page ranges beyond the text are clipped.
    """
    kind = dict(texts.dtypes)[key]
    page_col = F.col(pages) if pages else F.lit(None).cast("array<struct<page:int,start_offset:bigint,end_offset:bigint>>")
    rows = texts.select(F.col(key), F.col(text).alias("__text"), page_col.alias("__pages")).filter(f"{key} IS NOT NULL AND __text IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t, p in zip(pdf[key], pdf["__text"], pdf["__pages"]):
                data, n = t.encode(), 0
                for page, a, b in [(None, 0, len(data))] if p is None else [(x["page"], x["start_offset"], x["end_offset"]) for x in p]:
                    part = data[a:b].decode("utf-8", "ignore")
                    for s, e in passages(part, limit, unit):
                        start = a + len(part[:s].encode())
                        out.append((k, n, start, start + len(part[s:e].encode()), page, part[s:e]))
                        n += 1
            yield pd.DataFrame(out, columns=[key, "ordinal", "start_offset", "end_offset", "page", "chunk_text"], dtype=object)

    cut = rows.mapInPandas(run, f"{key} {kind}, ordinal int, start_offset bigint, end_offset bigint, page int, chunk_text string")
    # a text delivered twice gives equal passages; where their text is not asked for it is not moved
    return cut.distinct() if with_text else cut.drop("chunk_text").distinct()
