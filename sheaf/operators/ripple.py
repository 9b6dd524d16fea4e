"""What an edit touches: lines that mention the replaced phrase, and the documents connected with the edited one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import date_variants

LINES_PER_DOCUMENT, MOST = 5, 25


def _pattern(phrase: str) -> str:
    def quoted(words: str) -> str:
        return "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in words)

    may = phrase.split()[:1] == ["May"]
    parts = []
    for v in date_variants(phrase):
        # lower-case Filipino "may 20 ..." is no date
        parts.append(f"(?-i:May {v[4:]})" if may and v.startswith("may ") else quoted(v))
    return r"(?i)(?<![\p{L}\p{N}])(?:" + "|".join(parts) + r")(?![\p{L}\p{N}])"


def line_mentions(texts: DataFrame, key: str, text: str, phrase: str, most: int = LINES_PER_DOCUMENT) -> DataFrame:
    """(key, line_no, line): the first lines of each document that mention the phrase, or its date in other words."""
    rows = texts.select(F.col(key), F.col(text).alias("__text")).filter(F.col("__text").rlike(_pattern(phrase)))
    lines = rows.select(key, F.posexplode(F.split("__text", "\n")).alias("line_no", "line")).filter(F.col("line").rlike(_pattern(phrase)))
    return lines.select(key, "line_no", F.trim(F.regexp_replace("line", r"\r$", "")).alias("line")).distinct().withColumn("__n", F.expr(f"row_number() OVER (PARTITION BY {key} ORDER BY line_no)")).filter(F.col("__n") <= most).drop("__n")


def impacts(links: DataFrame, edges: DataFrame, mentions: DataFrame, files: DataFrame, target: str, other: str, path: str, content: str, scope: str, most: int = MOST) -> DataFrame:
    """(target, other, strength, reason) for every target: what to review when the mentioned phrase is replaced in it.

    `links` (source, target) are explicit links, `edges` (a, b, kind) displayed edges of kind shared-fact or similarity,
    `mentions` (other) the files that mention the phrase, `files` has other, scope, path and content.  A file linked with the
    target either way, or in a shared fact with it, that mentions the phrase is evidence; one that is only similar and
    mentions it is similarityOnly, and so is an identical copy in the target's scope, whether or not it mentions it.
    Evidence first, then by path, `most` for each target.

    Of the copies of one content only the first by path can be among a target's `most`: each content gives that many,
    so a content that a third of all files have makes no pairs of all with all.
    """
    told = mentions.select(F.col(other)).distinct()
    ends = lambda df, a, b, rank: df.select(F.col(a).alias(target), F.col(b).alias(other), rank.alias("__rank"))
    kind = F.when(F.col("kind") == "shared-fact", 4).otherwise(8)
    near = ends(links, "target", "source", F.lit(1)).unionByName(ends(links, "source", "target", F.lit(2))).unionByName(ends(edges, "a", "b", kind)).unionByName(ends(edges, "b", "a", kind))
    met = near.filter(F.col(target) != F.col(other)).join(told, other, "left_semi").groupBy(target, other).agg(F.bit_or("__rank").alias("__rank"))
    known = files.select(F.col(other), F.col(scope).alias("__scope"), F.col(path).alias("__path"), F.col(content).alias("__content")).distinct()
    sound = known.filter("__scope IS NOT NULL AND __content IS NOT NULL AND __content <> ''")
    first = sound.withColumn("__turn", F.expr(f"row_number() OVER (PARTITION BY __scope, __content ORDER BY __path, {other})")).filter(F.col("__turn") <= most + 1)
    same = sound.select(F.col(other).alias(target), "__scope", "__content").join(first.select("__scope", "__content", other), ["__scope", "__content"]).filter(F.col(target) != F.col(other))
    copies = same.join(met.select(target, other), [target, other], "left_anti").select(target, other, F.lit(16).alias("__rank"))
    r = F.col("__rank")
    has = lambda bit: r.bitwiseAND(F.lit(bit)) > 0
    reason = F.when(has(1) & has(2), "links both ways").when(has(1), "links to the target").when(has(2), "is linked from the target").when(has(4), "may state the same fact").when(has(8), "is similar").otherwise("is a copy")
    strength = F.when(has(7), "evidence").otherwise("similarityOnly")
    placed = met.unionByName(copies).join(known.select(other, "__path"), other).select(target, other, strength.alias("strength"), reason.alias("reason"), "__path")
    turned = placed.withColumn("__turn", F.expr(f"row_number() OVER (PARTITION BY {target} ORDER BY strength <> 'evidence', __path, {other})"))
    return turned.filter(F.col("__turn") <= most).select(target, other, "strength", "reason")


def replaced_phrase(before: str, after: str, most: int = 120) -> str | None:
    """What an edit replaces, widened to whole words and to a date's month or day; None for a mere insertion."""
    from ..functions.text import MONTHS
    from .diffs import changed_region

    def month(word: str) -> bool:
        bare = word.rstrip(".")
        return any(bare.lower() in names for names in MONTHS) and (bare.lower() != "may" or bare.startswith("M"))

    start, end, _ = changed_region(before, after)
    if start >= end:
        return None
    while start and before[start - 1].isalnum():
        start -= 1
    while end < len(before) and before[end].isalnum():
        end += 1
    phrase = before[start:end]
    if phrase.isdigit():
        lead = before[:start].rstrip(" ").rsplit(None, 1)
        if lead and len(before[:start].rstrip(" ")) < start and month(lead[-1]):
            start = before[:start].rstrip(" ").rfind(lead[-1])
    elif month(phrase):
        digits = 0
        while end + 1 + digits < len(before) and before[end] == " " and before[end + 1 + digits].isdigit():
            digits += 1
        if digits in (1, 2):
            end += 1 + digits
    phrase = before[start:end].strip()
    return phrase if phrase and len(phrase) <= most else None


def deletion_impacts(edges: DataFrame, target: str, other: str, kind: str, path: str, most: int = MOST) -> DataFrame:
    """(target, other, strength): whom a deletion touches, the strongest relation of each; at most `most` per target.

    `edges` point from other to target for links (what the target links to is not touched).
    """
    rank = F.when(F.col(kind) == "link", 0).when(F.col(kind) == "shared-fact", 1).otherwise(2)
    best = edges.filter(f"{target} <> {other}").groupBy(target, other).agg(F.min(rank).alias("__rank"), F.min(path).alias("__path"))
    turned = best.withColumn("__turn", F.expr(f"row_number() OVER (PARTITION BY {target} ORDER BY __rank, __path, {other})")).filter(F.col("__turn") <= most)
    return turned.select(target, other, F.element_at(F.array(F.lit("evidence"), F.lit("shared-fact"), F.lit("similarity")), F.col("__rank") + 1).alias("strength"))


def plan_impacts(impacts_: DataFrame, targets: DataFrame, plan: str, index: str, other: str, most: int = MOST) -> DataFrame:
    """(plan, index, other): the impacts of all operations of a plan, the first operation of each document, without the documents the plan itself changes."""
    first = impacts_.groupBy(plan, other).agg(F.min(index).alias(index)).join(targets.select(plan, F.col("target").alias(other)).distinct(), [plan, other], "left_anti")
    return first.withColumn("__turn", F.expr(f"row_number() OVER (PARTITION BY {plan} ORDER BY {index}, {other})")).filter(F.col("__turn") <= most).select(plan, index, other)
