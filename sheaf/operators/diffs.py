"""Differences between two versions of a text."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

MOST_CELLS = 1_000_000


def changed_region(before: str, after: str) -> tuple[int, int, int]:
    """(start, end in before, end in after) of the smallest stretch outside which both are equal, in characters."""
    start = 0
    most = min(len(before), len(after))
    while start < most and before[start] == after[start]:
        start += 1
    tail = 0
    while tail < most - start and before[len(before) - 1 - tail] == after[len(after) - 1 - tail]:
        tail += 1
    return start, len(before) - tail, len(after) - tail


def line_changes(before: str, after: str) -> tuple[str, int, int]:
    """(state, lines removed, lines added); state is same, changed, or tooLarge beyond MOST_CELLS line pairs."""
    if before == after:
        return "same", 0, 0
    a, b = before.splitlines(), after.splitlines()
    if len(a) * len(b) > MOST_CELLS:
        return "tooLarge", 0, 0
    removed = added = 0
    for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag != "equal":
            removed += j - i
            added += m - k
    return "changed", removed, added


def diff_lines(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, state, removed, added, start, before_end, after_end) per row; a null side counts as empty."""
    kind = dict(pairs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, *line_changes(a, b), *changed_region(a, b)) for k, a, b in zip(pdf[key], pdf["__a"], pdf["__b"])]
            yield pd.DataFrame(out, columns=[key, "state", "removed", "added", "start", "before_end", "after_end"], dtype=object)

    rows = pairs.select(F.col(key), F.coalesce(before, F.lit("")).alias("__a"), F.coalesce(after, F.lit("")).alias("__b"))
    return rows.mapInPandas(run, f"{key} {kind}, state string, removed int, added int, start int, before_end int, after_end int")


def line_hunks(before: str, after: str, context: int = 3) -> list[tuple[int, int, int, int, list[str]]]:
    """(first line before, lines, first line after, lines, marked lines) of each hunk, lines counted from 1; empty beyond MOST_CELLS."""
    a, b = before.splitlines(), after.splitlines()
    if before == after or len(a) * len(b) > MOST_CELLS:
        return []
    out = []
    for group in difflib.SequenceMatcher(None, a, b, autojunk=False).get_grouped_opcodes(context):
        marked = []
        for tag, i, j, k, m in group:
            if tag == "equal":
                marked += [" " + line for line in a[i:j]]
            else:
                marked += ["-" + line for line in a[i:j]] + ["+" + line for line in b[k:m]]
        first, last = group[0], group[-1]
        out.append((first[1] + 1, last[2] - first[1], first[3] + 1, last[4] - first[3], marked))
    return out


def diff_hunks(pairs: DataFrame, key: str, before: str, after: str, context: int = 3) -> DataFrame:
    """(key, hunk, before_start, before_lines, after_start, after_lines, lines) per hunk; a null side counts as empty."""
    kind = dict(pairs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [key, "hunk", "before_start", "before_lines", "after_start", "after_lines", "lines"]
        for pdf in batches:
            yield pd.DataFrame([(k, n, *h) for k, a, b in zip(pdf[key], pdf["__a"], pdf["__b"]) for n, h in enumerate(line_hunks(a, b, context))], columns=columns, dtype=object)

    rows = pairs.select(F.col(key), F.coalesce(before, F.lit("")).alias("__a"), F.coalesce(after, F.lit("")).alias("__b"))
    return rows.mapInPandas(run, f"{key} {kind}, hunk int, before_start int, before_lines int, after_start int, after_lines int, lines array<string>")
