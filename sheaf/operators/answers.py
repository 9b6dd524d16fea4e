"""Naming files in a request, choosing targets, and holding an answer to its sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import array_of, collapsed, fold, occurrences, stem_of, tokens

LEAST_VERBATIM, TARGET_SCORE, TARGET_LEAD, MOST_CANDIDATES = 12, 0.25, 0.15, 5


def verbatim_sources(quotes: DataFrame, passages: DataFrame, quote: str, text: str, by: list[str]) -> DataFrame:
    """`quotes` joined with the passages of the same `by` that hold them word for word (white space and case aside);
    quotes of fewer than LEAST_VERBATIM bytes match nothing."""
    q = quotes.withColumn("__q", collapsed(F.col(quote))).filter(F.octet_length("__q") >= LEAST_VERBATIM)
    p = passages.withColumn("__t", collapsed(F.col(text)))
    return q.join(p, by).filter(F.contains("__t", "__q")).drop("__q", "__t")


def validated(sentences: DataFrame, supplied: DataFrame, answer: str, order: str, text: str, citations: str, source: str) -> DataFrame:
    """(answer, text, sources, sufficient): an answer keeps the sentences that cite a supplied source, and those sources once, in order.

    A citation of anything that was not supplied counts for nothing; without any sentence left the answer is insufficient.
    """
    cited = sentences.select(answer, order, text, F.posexplode_outer(citations).alias("__at", source))
    known = supplied.select(answer, source).distinct().withColumn("__ok", F.lit(True))
    met = cited.join(known, [answer, source], "left")
    kept = met.groupBy(answer, order).agg(F.max(text).alias(text), F.bool_or(F.coalesce("__ok", F.lit(False))).alias("__kept"))
    first = met.filter("__ok").groupBy(answer, source).agg(F.min(F.struct(order, "__at")).alias("__first"))
    sources = first.groupBy(answer).agg(F.transform(F.array_sort(F.collect_list(F.struct("__first", source))), lambda x: x[source]).alias("sources"))
    told = kept.groupBy(answer).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("__kept"), F.struct(order, text)))), lambda x: x[text]), " ").alias("text"))
    return told.join(sources, answer, "left").select(answer, "text", F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), (F.col("text") != "").alias("sufficient"))


def named_files(files: DataFrame, request: str, key: str, name: str) -> DataFrame:
    """(key, name, exact, extra): files a request names - by the full name, or by every informative word of the name.

    Exact ones come alone if there are any; `extra` is how many words of the name are not in the request.
    """
    low = " ".join(request.lower().split())
    asked = [w for w in dict.fromkeys("".join(c if c.isalnum() else " " for c in low).split())]
    stem = stem_of(F.col(name))
    said = tokens(fold(stem))
    exact = F.contains(F.lit(low), F.lower(name))
    informative = F.filter(said, lambda w: (F.length(w) > 2) & ~w.rlike("^[0-9]+$"))
    extra = F.size(F.array_except(said, array_of(asked)))
    partial = (F.size(informative) > 0) & (F.size(F.array_except(informative, array_of(asked))) == 0)
    met = files.select(F.col(key), F.col(name), exact.alias("exact"), extra.alias("extra"), partial.alias("__partial")).distinct().filter("exact OR __partial")
    best = met.agg(F.bool_or("exact").alias("__any"))
    return met.join(F.broadcast(best)).filter("exact OR NOT __any").drop("__partial", "__any")


def resolved_target(candidates: DataFrame, request: str, key: str, score: str) -> DataFrame:
    """(request, key, score, rank, bound): at most MOST_CANDIDATES per request; the first is bound if it scores TARGET_SCORE and leads the next by TARGET_LEAD."""
    order = f"PARTITION BY {request} ORDER BY {score} DESC, {key}"
    ranked = candidates.select(request, key, score).withColumns({"rank": F.expr(f"row_number() OVER ({order})"), "__next": F.expr(f"lead({score}) OVER ({order})")})
    bound = (F.col("rank") == 1) & (F.col(score) >= TARGET_SCORE) & (F.col(score) - F.coalesce("__next", F.lit(0.0)) > TARGET_LEAD)
    return ranked.filter(F.col("rank") <= MOST_CANDIDATES).select(request, key, score, "rank", bound.alias("bound"))


def resolved_edit(texts: DataFrame, key: str, text: str, find: str, replace: str) -> DataFrame:
    """(key, hits, applicable, edited): an edit applies where its text stands exactly once and changes something."""
    hits = (F.length(text) - F.length(F.replace(F.col(text), F.lit(find), F.lit("")))) / max(1, len(find))
    ok = (hits == 1) & F.lit(bool(find) and find != replace)
    return texts.select(F.col(key), hits.cast("int").alias("hits"), ok.alias("applicable"), F.when(ok, F.replace(F.col(text), F.lit(find), F.lit(replace))).alias("edited"))


def mentioning(passages: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """Passages that hold any of the (folded) terms as whole tokens."""
    folded, any_ = fold(F.col(text)), F.lit(False)
    for t in terms:
        any_ |= occurrences(folded, t) > 0
    return passages.filter(any_)


GROUP_PASSAGES, MOST_STAGES = 4, 8


def summary_groups(passages: DataFrame, document: str, order: str) -> DataFrame:
    """`passages` with stage (from 0) and covered: four passages make a group, a document gives eight groups at most; what
    lies beyond is not covered and makes its summary a partial one."""
    turned = passages.withColumn("__n", F.expr(f"row_number() OVER (PARTITION BY {document} ORDER BY {order})"))
    stage_ = F.floor((F.col("__n") - 1) / GROUP_PASSAGES).cast("int")
    return turned.withColumns({"stage": stage_, "covered": stage_ < MOST_STAGES}).drop("__n")


def summarised(passages: DataFrame, document: str, order: str, text: str, note, whole) -> DataFrame:
    """(document, summary, notes, covered, passages, partial): a summary in two steps with a model of one's own.

    `note` makes a note (str or None) of a list of texts, `whole` a summary of a list of notes; both are called where the
    rows are, a document's groups apart from one another.  A document without any note has a null summary.
    """
    import pandas as pd

    kind = dict(passages.dtypes)[document]
    grouped = summary_groups(passages, document, order)

    def noted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pd.DataFrame({document: pdf[document].iloc[:1], "stage": pdf["stage"].iloc[:1], "note": [note(pdf[text].tolist())], "n": [len(pdf)]})

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        notes = [x for x in pdf.sort_values("stage")["note"] if x]
        return pd.DataFrame({document: pdf[document].iloc[:1], "summary": [whole(notes) if notes else None], "notes": [len(notes)], "covered": [int(pdf["n"].sum())]})

    notes = grouped.filter("covered").groupBy(document, "stage").applyInPandas(noted, f"{document} {kind}, stage int, note string, n bigint")
    told = notes.groupBy(document).applyInPandas(joined, f"{document} {kind}, summary string, notes int, covered bigint")
    counted = grouped.groupBy(document).agg(F.count("*").alias("passages"))
    return told.join(counted, document).withColumn("partial", F.col("covered") < F.col("passages"))
