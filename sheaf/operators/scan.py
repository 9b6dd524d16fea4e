"""Incremental scans: what changed between a snapshot and what is there now, and when to try a failed file again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FREE_TRIES, FIRST_WAIT_MS, LONGEST_WAIT_MS = 2, 600_000, 21_600_000


def retry_wait(failures: Column) -> Column:
    """Milliseconds to wait after so many identical failures: none for the first two, then doubling from ten minutes to six hours."""
    shift = F.least(failures - (FREE_TRIES + 1), F.lit(16)).cast("int")
    wait = F.least(F.lit(FIRST_WAIT_MS).cast("bigint") * F.pow(F.lit(2.0), F.greatest(shift, F.lit(0))).cast("bigint"), F.lit(LONGEST_WAIT_MS))
    return F.when(failures <= FREE_TRIES, F.lit(0)).otherwise(wait).cast("bigint")


def retry_due(failures: Column, failed_ms: Column, now_ms: Column, changed: Column) -> Column:
    """Whether to read a failed file: it changed, its wait is over, or the clock went back."""
    waited = now_ms - failed_ms
    return changed | (waited >= retry_wait(failures)) | (waited < 0)


def scan_outcomes(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """(key, outcome) of every file of either side: added, removed, unchanged, metadata, updated, failed or stale.

    `before` has key, size_bytes, modified_at, content_hash and status; `now` has key, size_bytes, modified_at and
    content_hash, null where the file could not be read.  Same size and time: unchanged.  Same bytes: metadata.  An
    unreadable file that was indexed is stale, otherwise failed.  Both sides must have a key once.
    """
    old = before.select(F.col(key), *(F.col(c).alias(f"old_{c}") for c in ("size_bytes", "modified_at", "content_hash", "status")), F.lit(True).alias("was"))
    new = now.select(F.col(key), "size_bytes", "modified_at", "content_hash", F.lit(True).alias("here"))
    same = F.col("size_bytes").eqNullSafe(F.col("old_size_bytes")) & F.col("modified_at").eqNullSafe(F.col("old_modified_at"))
    outcome = (
        F.when(F.col("here").isNull(), "removed")
        .when(F.col("was").isNull(), F.when(F.col("content_hash").isNull(), "failed").otherwise("added"))
        .when(F.col("content_hash").isNull(), F.when(F.col("old_status").isin("indexed", "stale"), "stale").otherwise("failed"))
        .when(same & (F.col("old_status") == "indexed"), "unchanged")
        .when((F.col("content_hash") == F.col("old_content_hash")) & (F.col("old_status") != "failed"), "metadata")
        .otherwise("updated")
    )
    return old.join(new, key, "full").select(key, outcome.alias("outcome"))


def latest(rows: DataFrame, keys: list[str], at: str, tie: list[str] | None = None) -> DataFrame:
    """One row per key: the one written last (ties: the larger of `tie`), as an upsert leaves it.  Null times are oldest."""
    order = ", ".join([f"{at} DESC NULLS LAST", *(f"{c} DESC NULLS LAST" for c in tie or [])])
    return rows.withColumn("__turn", F.expr(f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {order})")).filter("__turn = 1").drop("__turn")


def under_any(path: Column, prefixes: list[str]) -> Column:
    """Whether a path is one of the places or lies under one: files there are not removed, only not seen."""
    got = F.lit(False)
    for p in prefixes:
        got |= (path == p) | path.startswith(f"{p.rstrip('/')}/")
    return got


def retry_outcomes(before: DataFrame, now: DataFrame, key: str, now_ms: Column, supported: Column, asked: DataFrame | None = None) -> DataFrame:
    """(key, outcome): scan_outcomes with the two outcomes that need more than two states.

    `before` has also failures and failed_ms of unreadable files.  A file that is there but not `supported` (a column of
    `now`) is unsupported unless it is unchanged; an unreadable one whose wait is not over, that has not changed since and
    that is not among the keys `asked` for again, is deferredStale or deferredFailed: it is not read.
    """
    told = scan_outcomes(before, now, key)
    kept = before.select(key, "failures", "failed_ms", F.col("size_bytes").alias("__size"), F.col("modified_at").alias("__at"), F.col("status").alias("__status"))
    here = now.select(key, supported.alias("__supported"), F.col("size_bytes").alias("__size_now"), F.col("modified_at").alias("__at_now"))
    met = told.join(kept, key, "left").join(here, key, "left")
    wanted = F.lit(False)
    if asked is not None:
        met = met.join(asked.select(key).distinct().withColumn("__asked", F.lit(True)), key, "left")
        wanted = F.coalesce("__asked", F.lit(False))
    changed = ~(F.col("__size").eqNullSafe(F.col("__size_now")) & F.col("__at").eqNullSafe(F.col("__at_now")))
    waits = F.col("__status").isin("stale", "failed") & ~retry_due(F.coalesce("failures", F.lit(0)), F.coalesce("failed_ms", F.lit(0)), now_ms, changed) & ~wanted
    outcome = (
        F.when(F.col("outcome") == "removed", "removed")
        .when(F.coalesce(waits, F.lit(False)), F.when(F.col("__status") == "stale", "deferredStale").otherwise("deferredFailed"))
        .when((F.col("outcome") != "unchanged") & ~F.coalesce("__supported", F.lit(True)), "unsupported")
        .otherwise(F.col("outcome"))
    )
    return met.select(key, outcome.alias("outcome"))


def scan_counters(outcomes: DataFrame) -> DataFrame:
    """One row: added, updated, removed, unchanged, unsupported, failed, stale, deferred and relink.

    What is deferred also counts as stale or failed; it changed nothing, so it does not call for links to be found anew.
    """
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    told = outcomes.agg(
        n("added").alias("added"), n("updated", "metadata").alias("updated"), n("removed").alias("removed"), n("unchanged").alias("unchanged"), n("unsupported").alias("unsupported"),
        n("failed", "deferredFailed").alias("failed"), n("stale", "deferredStale").alias("stale"), n("deferredStale", "deferredFailed").alias("deferred"), n("deferredFailed").alias("__d"),
    )
    return told.withColumn("relink", F.expr("added + updated + removed + unsupported + failed - __d > 0")).drop("__d")


def recorded_failures(failed: DataFrame, before: DataFrame, key: str, signature: str, now_ms: Column) -> DataFrame:
    """(key, status, failures, retry_after_ms) of files that could not be read: a file that was searchable stays so, as
    stale; any other is failed.  The same failure of the same file (by signature) counts on, another begins at 1."""
    old = before.select(key, F.col("status").alias("__status"), F.col("failures").alias("__failures"), F.col(signature).alias("__signature"))
    met = failed.select(key, signature).join(old, key, "left")
    again = F.col("__status").isin("stale", "failed") & F.col("__signature").eqNullSafe(F.col(signature))
    failures = F.when(again, F.coalesce("__failures", F.lit(0)) + 1).otherwise(1)
    status = F.when(F.col("__status").isin("indexed", "stale"), "stale").otherwise("failed")
    return met.select(key, status.alias("status"), failures.cast("int").alias("failures"), F.when(retry_wait(failures) > 0, now_ms + retry_wait(failures)).alias("retry_after_ms"))


def without_derived(rows: DataFrame, gone: DataFrame, *keys: str, name: str = "document_id") -> DataFrame:
    """`rows` without what was derived from documents (column `name` of `gone`) that are no more or could not be read anew,
    whichever of the columns `keys` names them."""
    for k in keys:
        rows = rows.join(gone.select(F.col(name).alias(k)).distinct(), k, "left_anti")
    return rows
