"""Problem 4: cutting oversized items at natural boundaries, with overlap.

An item is split at the strongest separators first - section headings, then blank lines, sentence ends, white
space, characters - and a piece that is still too long goes on to the next kind.  Pieces are packed greedily up to
the limit; each further passage begins with the tail of the one before, from a word's start where one lies in the
overlap.  All positions are byte offsets into the UTF-8 content and never fall inside a character, nor between a
letter and its combining mark where that can be helped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Each pattern's match ends a piece; the strongest first.
SEPARATORS = tuple(
    re.compile(p)
    for p in (
        rb"(?:\r?\n|\r)(?=#{1,6} )",
        rb"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)(?:[ \t]*(?:\r\n|\n|\r))*",
        rb"[.!?]+[\"')\]]*(?:[ \t]+|(?=\r|\n))|(?:\r\n|\n|\r)",
        rb"[ \t\r\n\v\f]+|\xc2\xa0|\xe3\x80\x80|\xe2\x80[\x80-\x8a\xaf]",
    )
)
_WORD_START = SEPARATORS[3]
_MARK = re.compile(rb"\xcc[\x80-\xbf]|\xcd[\x80-\xaf]|\xe2\x80[\x8b-\x8f]|\xef\xb8[\x80-\x8f]")


def _whole(data: bytes, at: int, low: int) -> int:
    """The last character boundary at or before `at` and after `low` that no combining mark follows."""
    p = at
    while p > low and p < len(data) and data[p] & 0xC0 == 0x80:
        p -= 1
    q = p
    while q > low and q < len(data) and _MARK.match(data, q):
        q -= 1
        while q > low and data[q] & 0xC0 == 0x80:
            q -= 1
    return q if q > low else p if p > low else at


def _pieces(data: bytes, start: int, end: int, most: int, level: int = 0) -> list[int]:
    """Ends of pieces of at most `most` bytes that cover start..end."""
    stack, ends = [(start, end, level)], []
    while stack:
        a, b, k = stack.pop()
        if b - a <= most:
            ends.append(b)
        elif k == len(SEPARATORS):
            while b - a > most:
                a = _whole(data, a + most, a)
                ends.append(a)
            ends.append(b)
        else:
            cuts = [m.end() for m in SEPARATORS[k].finditer(data, a, b) if a < m.end() < b]
            edges = [a, *cuts, b]
            stack.extend((edges[i], edges[i + 1], k + 1) for i in range(len(edges) - 2, -1, -1))
    return ends


def split_item(data: bytes, start: int, end: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Byte ranges of the passages of data[start:end], in order; one range if it is within the limit, none if empty."""
    if end <= start:
        return []
    if end - start <= limit:
        return [(start, end)]
    overlap = max(0, min(overlap, limit // 2))
    passages, begin, reached, shared = [], start, start, start
    for stop in _pieces(data, start, end, max(4, limit - overlap)):
        if stop - begin > limit:
            passages.append((begin, reached))
            shared = max(begin + 1, reached - overlap)
            while shared < reached and data[shared] & 0xC0 == 0x80:
                shared += 1
            clean = _WORD_START.search(data, max(begin, shared - 1), reached)
            begin = clean.end() if clean and clean.end() < reached else shared
        reached = stop
    passages.append((begin, end))
    return passages


def _split(oversized: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: dict[str, list] = {"id": [], "page": [], "passage_no": [], "start_offset": [], "end_offset": [], "item_bytes": []}
            for id_, text, pages, limit, overlap in zip(pdf["id"], pdf["text"], pdf["pages"], pdf["limit"], pdf["overlap"]):
                data = text.encode()
                items = [(0, 0, len(data))] if pages is None else [(p["page"], p["start_offset"], p["end_offset"]) for p in pages if p is not None]
                for page, a, b in items:
                    if page is None or a is None or b is None:
                        continue
                    a, b = max(0, min(a, len(data))), max(0, min(b, len(data)))
                    while 0 < a < len(data) and data[a] & 0xC0 == 0x80:
                        a -= 1
                    while 0 < b < len(data) and data[b] & 0xC0 == 0x80:
                        b += 1
                    if oversized and b - a <= limit:
                        continue
                    for n, (s, e) in enumerate(split_item(data, a, b, int(limit), int(overlap))):
                        for column, value in zip(out.values(), (id_, page, n, s, e, b - a)):
                            column.append(value)
            yield pd.DataFrame(out)
    return run


def split_passages(texts: DataFrame, files: DataFrame, limits: DataFrame, key: str = "file_id", text: str = "content", oversized: bool = False) -> DataFrame:
    """Passages of every item, or with `oversized` of those over their limit only: (key, page, passage_no, start_offset, end_offset, item_bytes), offsets in UTF-8 bytes.

    `texts` has key, text and pages; `files` has key and media_type; `limits` has media_type, max_bytes and
    overlap_bytes.  Items are the entries of pages, or the whole text as page 0 where pages is null; none crosses a
    page.  Defined results: a null text, an empty item and a file whose media_type is unknown or has no limit give no
    passage; offsets beyond the text are clipped and moved out to character boundaries; a repeated row counts once;
    an overlap of more than half the limit counts as half; other columns are ignored.

    Where only oversized items are wanted, texts that hold nothing longer than the least limit are left out before
    anything is moved.  One join brings the media type to each text; cutting is local to a row, and what a row delivered
    twice gives is made distinct as passages, not as texts.  `limits` is a table of a few rows per media type and is
    broadcast; its least limit comes to the driver.
    """
    kinds = limits.select("media_type", F.col("max_bytes").alias("limit"), F.coalesce("overlap_bytes", F.lit(0)).alias("overlap")).filter("limit > 0").dropDuplicates(["media_type"])
    meta = files.select(F.col(key).alias("id"), "media_type").filter("id IS NOT NULL").groupBy("id").agg(F.min("media_type").alias("media_type"))
    limited = meta.join(F.broadcast(kinds), "media_type").select("id", "limit", "overlap")
    rows = texts.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col("pages")).filter("id IS NOT NULL AND text IS NOT NULL")
    if oversized:
        least = kinds.agg(F.min("limit")).first()[0] or 0
        long_ = F.when(F.col("pages").isNull(), F.octet_length("text") > least).otherwise(F.exists("pages", lambda p: p["end_offset"] - p["start_offset"] > least - 6))  # ends may move to character boundaries
        rows = rows.filter(long_)
    cut = rows.join(limited, "id").mapInPandas(_split(oversized), "id bigint, page int, passage_no int, start_offset bigint, end_offset bigint, item_bytes bigint")
    return cut.distinct().withColumnRenamed("id", key)
