"""Plans, history and undo as tables of operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KEPT_PLANS, PAGE = 100, 100


def keyset_page(rows: DataFrame, order: list[str], after: tuple | None, size: int = PAGE) -> DataFrame:
    """The newest `size` rows strictly before the cursor in descending `order`; no cursor, the first page.  Null keys sort last."""
    key = F.struct(*order)
    if after is not None:
        kinds = dict(rows.dtypes)
        rows = rows.filter(key < F.struct(*(F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, after))))
    return rows.orderBy(*(F.desc_nulls_last(c) for c in order)).limit(size)


def prune_flags(history: DataFrame, scope: str, plan: str, at: str, kept: int = KEPT_PLANS) -> DataFrame:
    """(scope, plan, turn, recoverable): only the newest `kept` plans of each scope stay recoverable and have a turn.

    Only those are put in order, by a limit that each partition applies first, so a scope of any size is no one task.
    """
    plans = history.filter(f"{plan} IS NOT NULL").groupBy(scope, plan).agg(F.max(at).alias("__at"))
    newest = plans.withColumn("turn", F.expr(f"row_number() OVER (PARTITION BY {scope} ORDER BY __at DESC NULLS LAST, {plan} DESC)")).filter(F.col("turn") <= kept)
    return plans.select(scope, plan).join(newest.select(scope, plan, "turn"), [scope, plan], "left").withColumn("recoverable", F.col("turn").isNotNull())


def settled(operations: DataFrame, plan: str, index: str, failed: Column, cancelled_after: Column | None = None) -> DataFrame:
    """`operations` with outcome: succeeded up to the first failure, that one failed, later ones notStarted - or
    cancelled after a cancellation; a failure beats a cancellation at the same place or before."""
    stop = cancelled_after if cancelled_after is not None else F.lit(None).cast("boolean")
    flagged = operations.withColumns({"__f": F.coalesce(failed, F.lit(False)), "__c": F.coalesce(stop, F.lit(False))})
    marked = flagged.withColumns({
        "__failed": F.expr(f"min(CASE WHEN __f THEN {index} END) OVER (PARTITION BY {plan})"),
        "__stopped": F.expr(f"min(CASE WHEN __c THEN {index} END) OVER (PARTITION BY {plan})"),
    })
    i = F.col(index)
    outcome = F.when(i == F.col("__failed"), "failed").when(i > F.col("__failed"), "notStarted").when(i > F.col("__stopped"), "cancelled").otherwise("succeeded")
    beats = F.col("__failed") <= F.col("__stopped")
    outcome = F.when(~F.coalesce(beats, F.lit(True)) & (i > F.col("__stopped")), "cancelled").otherwise(outcome)
    return marked.withColumn("outcome", outcome).drop("__f", "__c", "__failed", "__stopped")


def undo_conflicts(entries: DataFrame, observed: DataFrame, scope: str, path: str, content_hash: str) -> DataFrame:
    """`entries` (history rows not undone yet) with conflict: why an entry cannot be undone, null if it can.

    notRecoverable; missing - the file that the operation left is not there; externallyModified - it is another
    content; destinationOccupied - a moved file's old place is taken.  A deletion is checked the other way round.
    """
    now = observed.filter(f"{path} IS NOT NULL").groupBy(scope, path).agg(F.max(content_hash).alias("__hash"))
    after = now.select(F.col(scope), F.col(path).alias("after_path"), F.col("__hash").alias("__after"), F.lit(True).alias("__there"))
    before = now.select(F.col(scope), F.col(path).alias("before_path"), F.lit(True).alias("__old"))
    met = entries.join(after, [scope, "after_path"], "left").join(before, [scope, "before_path"], "left")
    there, old = F.coalesce("__there", F.lit(False)), F.coalesce("__old", F.lit(False))
    conflict = (
        F.when(F.coalesce(F.col("recoverable"), F.lit(0)) == 0, "notRecoverable")
        .when(F.col("operation_kind") == "delete", F.when(old, "destinationOccupied"))
        .when(~there, "missing")
        .when(F.col("after_hash").isNotNull() & ~F.col("after_hash").eqNullSafe(F.col("__after")), "externallyModified")
        .when(F.col("operation_kind").isin("move", "rename") & ~F.col("before_path").eqNullSafe(F.col("after_path")) & old, "destinationOccupied")
    )
    return met.withColumn("conflict", conflict).drop("__after", "__there", "__old")


def structural_conflicts(operations: DataFrame, plan: str, target: str) -> DataFrame:
    """(plan, target, n): targets that more than one operation of a plan writes, without regard to case."""
    return operations.filter(f"{target} IS NOT NULL").groupBy(plan, F.lower(target).alias("target")).agg(F.count("*").alias("n")).filter("n > 1")


def rebuilt_activity(plans: DataFrame, history_: DataFrame, outcomes: DataFrame, plan: str, index: str) -> DataFrame:
    """One row per operation that any of the three knows: (plan, index, in_plan, in_history, outcome).

    What history has done is done even if no outcome was recorded; an operation of a plan with neither is notStarted.
    """
    a = plans.select(plan, index, F.lit(True).alias("in_plan")).distinct()
    b = history_.select(plan, index, F.lit(True).alias("in_history")).distinct()
    c = outcomes.groupBy(plan, index).agg(F.max("outcome").alias("__outcome"))
    met = a.join(b, [plan, index], "full").join(c, [plan, index], "full")
    done = F.coalesce("in_history", F.lit(False))
    return met.select(plan, index, F.coalesce("in_plan", F.lit(False)).alias("in_plan"), done.alias("in_history"), F.coalesce("__outcome", F.when(done, "succeeded").otherwise("notStarted")).alias("outcome"))


def page_with_more(rows: DataFrame, order: list[str], after: tuple | None, size: int = PAGE) -> DataFrame:
    """keyset_page with has_more: whether rows follow the page; one row more than the page is looked at."""
    ahead = keyset_page(rows, order, after, size + 1)
    turned = ahead.withColumns({"__n": F.expr(f"row_number() OVER (ORDER BY {', '.join(f'{c} DESC NULLS LAST' for c in order)})"), "has_more": F.expr(f"count(*) OVER () > {size}")})
    return turned.filter(F.col("__n") <= size).drop("__n")


def recent(history_: DataFrame, scope: str, key: str, at: str, most: int = 8) -> DataFrame:
    """(scope, key, last_at, place): the keys used last in each scope, each once; ties go to the smaller key."""
    last = history_.filter(f"{key} IS NOT NULL AND {at} IS NOT NULL").groupBy(scope, key).agg(F.max(at).alias("last_at"))
    return last.withColumn("place", F.expr(f"row_number() OVER (PARTITION BY {scope} ORDER BY last_at DESC, {key})")).filter(F.col("place") <= most)


def state_faults(operations: DataFrame, observed: DataFrame, scope: str, path: str, content_hash: str) -> DataFrame:
    """`operations` (scope, operation_kind, before_path, before_hash, after_path) with fault: why the state of the files
    forbids one, null if nothing does.

    targetMissing - what it changes is not there; targetChanged - it is another content than was seen; destinationExists -
    a create, rename or move would write over something (paths without case).
    """
    now = observed.filter(f"{path} IS NOT NULL").groupBy(scope, F.lower(path).alias("__low")).agg(F.max(content_hash).alias("__hash"))
    reads, writes = F.col("operation_kind") != "create", F.col("operation_kind").isin("create", "rename", "move")
    source = now.select(scope, F.col("__low").alias("__from"), F.col("__hash").alias("__now"), F.lit(True).alias("__there"))
    target = now.select(scope, F.col("__low").alias("__to"), F.lit(True).alias("__taken"))
    met = operations.withColumns({"__from": F.lower("before_path"), "__to": F.lower("after_path")}).join(source, [scope, "__from"], "left").join(target, [scope, "__to"], "left")
    fault = (
        F.when(reads & F.col("before_path").isNotNull() & F.col("__there").isNull(), "targetMissing")
        .when(reads & F.col("before_path").isNotNull() & F.col("before_hash").isNotNull() & ~F.col("before_hash").eqNullSafe(F.col("__now")), "targetChanged")
        .when(writes & F.col("__taken").isNotNull() & ~F.col("__from").eqNullSafe(F.col("__to")), "destinationExists")
    )
    return met.withColumn("fault", fault).drop("__from", "__to", "__now", "__there", "__taken")


def plan_review(operations: DataFrame, plan: str, kind: str, key: str) -> DataFrame:
    """(plan, kind, operations, files): what a reviewer sees of a plan, by kind of operation."""
    return operations.groupBy(plan, kind).agg(F.count("*").alias("operations"), F.count_distinct(key).alias("files"))
