"""Measuring: retrieval checks over distinct contents, tri-state checks, records of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def retrieval_checks(ranked: DataFrame, relevant: DataFrame, negative: DataFrame, query: str, document: str, rank: str, content: str, k: int = 5) -> DataFrame:
    """(query, relevant, found, recall, all_found, no_negative) of every query with relevant documents.

    The top are the documents of the first `k` different contents by rank: a copy is listed with its original and takes
    no place; a document without a content is a content of its own.  no_negative is null where a query has no negatives.
    """
    own = ranked.select(query, document, F.col(rank).alias("__rank"), F.coalesce(F.concat(F.lit("h"), F.col(content).cast("string")), F.concat(F.lit("d"), F.col(document).cast("string"))).alias("__content"))
    first = own.groupBy(query, "__content").agg(F.min("__rank").alias("__first"))
    places = first.withColumn("__place", F.expr(f"row_number() OVER (PARTITION BY {query} ORDER BY __first)")).filter(F.col("__place") <= k).select(query, "__content")
    top = own.join(places, [query, "__content"], "left_semi").select(query, document, F.lit(1).alias("__hit")).distinct()
    labelled = relevant.select(query, document, F.lit(True).alias("__good")).distinct().unionByName(negative.select(query, document, F.lit(False).alias("__good")).distinct())
    met = labelled.join(top, [query, document], "left").groupBy(query).agg(
        F.count_if("__good").alias("relevant"), F.count_if(F.col("__good") & F.col("__hit").isNotNull()).alias("found"),
        F.count_if(~F.col("__good")).alias("__bad"), F.count_if(~F.col("__good") & F.col("__hit").isNotNull()).alias("__seen"),
    )
    told = met.filter("relevant > 0").withColumns({"recall": F.col("found") / F.col("relevant"), "all_found": F.col("found") == F.col("relevant"), "no_negative": F.when(F.col("__bad") > 0, F.col("__seen") == 0)})
    return told.drop("__bad", "__seen")


def tri_state(checks: list[Column]) -> Column:
    """failed if any check is false, passed if all known ones are true, unknown if none is known."""
    false, known = F.lit(False), F.lit(False)
    for c in checks:
        false |= F.coalesce(~c, F.lit(False))
        known |= c.isNotNull()
    return F.when(false, "failed").when(known, "passed").otherwise("unknown")


def record_faults(records: DataFrame) -> DataFrame:
    """`records` with faults: the names of the rules between fields that a benchmark record breaks.

    Fields: task, outcome_kind, cold, request_position, requests_since_start, retry_needed, correctness, model_disk_bytes,
    model_file_bytes, context_tokens, n_ctx, output_sha256, reviews array<struct<output_sha256>>, memory
    array<struct<peak_bytes, unavailable_reason>>.
    """
    failed = ~F.col("outcome_kind").isin("valid", "cancelled")
    summary = F.col("task") == "summary"
    expected = F.when(summary, F.lit(None).cast("boolean")).otherwise(False)
    rules = {
        "diskBytes": F.col("model_disk_bytes") != F.col("model_file_bytes"),
        "contextTokens": F.col("context_tokens") != F.col("n_ctx"),
        "cold": F.col("cold") != (F.col("request_position") == "firstRequestAfterServerRestart"),
        "coldStart": F.col("cold") & (F.col("requests_since_start") != 0),
        "retryNeeded": F.col("retry_needed") != failed,
        "failedCorrectness": failed & ~F.col("correctness").eqNullSafe(expected),
        "summaryCorrectness": summary & F.col("correctness").isNotNull(),
        "memory": F.exists("memory", lambda m: m["peak_bytes"].isNull() == (F.coalesce(m["unavailable_reason"], F.lit("")) == "")),
        "review": F.exists("reviews", lambda r: ~r["output_sha256"].eqNullSafe(F.col("output_sha256"))),
    }
    return records.withColumn("faults", F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules.items()))))


def fact_present(text: Column, fact: Column) -> Column:
    """Whether a required fact stands in a text: every run of digits of its label, else the label itself, without regard to case."""
    digits = F.regexp_extract_all(fact, F.lit(r"(\d+)"), F.lit(1))
    return F.when(F.size(digits) > 0, F.forall(digits, lambda x: F.contains(text, x))).otherwise(F.contains(F.lower(text), F.lower(fact)))


def outcome_counts(records: DataFrame, model: str, outcome: str) -> DataFrame:
    """(model, outcome, n) of all records."""
    return records.groupBy(model, outcome).agg(F.count("*").alias("n"))


def latest_reviews(reviews: DataFrame, output: str, at: str, tie: str) -> DataFrame:
    """The newest review of each output (ties: the larger `tie`)."""
    from .scan import latest

    return latest(reviews, [output], at, [tie])


def listed_runs(runs: DataFrame, at: str, tie: str, task: str | None = None, model: str | None = None, outcome: str | None = None, most: int = 200) -> DataFrame:
    """Runs newest first, at most `most`, of a task, a model and an outcome where those are named."""
    for column, wanted in (("task", task), ("model", model), ("outcome", outcome)):
        if wanted is not None:
            runs = runs.filter(F.col(column) == wanted)
    return runs.orderBy(F.desc_nulls_last(at), F.desc(tie)).limit(most)


def reviewed(runs: DataFrame, reviews: DataFrame, key: str, output: str, at: str) -> DataFrame:
    """`runs` with reviews: those of their own output, oldest first; a review of another output belongs to no run."""
    kept = runs.select(key, output).join(reviews.select(key, output, F.struct(at, *[c for c in reviews.columns if c not in (key, output, at)]).alias("__r")), [key, output])
    told = kept.groupBy(key).agg(F.array_sort(F.collect_list("__r")).alias("reviews"))
    return runs.join(told, key, "left")


def interrupted(runs: DataFrame, state: str, started: str, now: Column) -> DataFrame:
    """`runs` in which what still says running after a restart is marked interrupted; what started after `now` is left alone."""
    stopped = (F.col(state) == "running") & (F.col(started) < now)
    return runs.withColumn(state, F.when(stopped, "interrupted").otherwise(F.col(state)))
