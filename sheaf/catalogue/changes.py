"""Scans, history, undo."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history, scan
from ..sources.tables import table
from . import query

_H = "h AS (SELECT DISTINCT * FROM history)"


def _history(spark, d, *columns):
    """The columns of every operation once: history_id is the key, so that only what is needed is read and shuffled."""
    return table(spark, d, "history").select("history_id", *columns).distinct()


@query(f"WITH {_H} SELECT history_id, workspace_id, operation_kind, applied_at FROM h WHERE (applied_at, history_id) < (TIMESTAMPTZ '2024-06-01 00:00:00+00', 0) ORDER BY applied_at DESC NULLS LAST, history_id DESC LIMIT 100")
def activity_page(spark, d):
    """The hundred operations before a cursor, newest first."""
    import datetime

    at = (datetime.datetime(2024, 6, 1, tzinfo=datetime.timezone.utc), 0)
    h = _history(spark, d, "workspace_id", "operation_kind", "applied_at")
    return history.keyset_page(h.filter("applied_at IS NOT NULL"), ["applied_at", "history_id"], at)


@query(f"""
WITH {_H}, p AS (SELECT workspace_id, plan_id, max(applied_at) AS last_at FROM h WHERE plan_id IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY last_at DESC NULLS LAST, plan_id DESC) AS turn FROM p)
SELECT workspace_id, plan_id, CASE WHEN turn <= 100 THEN turn END AS turn, turn <= 100 AS recoverable FROM r
""")
def prune_flags(spark, d):
    told = history.prune_flags(_history(spark, d, "workspace_id", "plan_id", "applied_at"), "workspace_id", "plan_id", "applied_at")
    return told.withColumn("turn", F.col("turn").cast("bigint"))


@query(f"""
WITH {_H}, m AS (SELECT history_id, plan_id, operation_index, min(operation_index) FILTER (WHERE before_path IS NULL AND after_path IS NULL) OVER (PARTITION BY plan_id) AS failed, min(operation_index) FILTER (WHERE undone_at IS NOT NULL) OVER (PARTITION BY plan_id) AS stopped FROM h)
SELECT history_id, CASE WHEN stopped IS NOT NULL AND failed IS NOT NULL AND failed > stopped AND operation_index > stopped THEN 'cancelled' WHEN operation_index = failed THEN 'failed' WHEN operation_index > failed THEN 'notStarted' WHEN operation_index > stopped THEN 'cancelled' ELSE 'succeeded' END AS outcome FROM m
""")
def settle_prefix(spark, d):
    """Outcomes of each plan's operations: one without paths stands for a failure, an undone one for a cancellation."""
    h = _history(spark, d, "plan_id", "operation_index", "before_path", "after_path", "undone_at")
    told = history.settled(h, "plan_id", "operation_index", F.col("before_path").isNull() & F.col("after_path").isNull(), F.col("undone_at").isNotNull())
    return told.select("history_id", "outcome")


@query(f"""
WITH {_H}, o AS (SELECT workspace_id, relative_path, max(content_hash) AS hash FROM (SELECT DISTINCT * FROM indexed_documents) GROUP BY 1, 2),
e AS (SELECT h.history_id, h.plan_id, coalesce(recoverable, 0) AS rec, operation_kind AS k, before_path AS bp, after_path AS ap, after_hash AS ah, a.relative_path IS NOT NULL AS there, a.hash AS now_hash, b.relative_path IS NOT NULL AS old FROM h LEFT JOIN o a ON a.workspace_id = h.workspace_id AND a.relative_path = h.after_path LEFT JOIN o b ON b.workspace_id = h.workspace_id AND b.relative_path = h.before_path WHERE undone_at IS NULL),
c AS (SELECT *, CASE WHEN rec = 0 THEN 'notRecoverable' WHEN k = 'delete' THEN CASE WHEN old THEN 'destinationOccupied' END WHEN NOT there THEN 'missing' WHEN ah IS NOT NULL AND ah IS DISTINCT FROM now_hash THEN 'externallyModified' WHEN k IN ('move', 'rename') AND bp IS DISTINCT FROM ap AND old THEN 'destinationOccupied' END AS conflict FROM e)
SELECT coalesce(conflict, 'none') AS conflict, count(*) AS entries, count(DISTINCT plan_id) AS plans FROM c GROUP BY 1
""")
def undo_conflicts(spark, d):
    seen = table(spark, d, "indexed_documents").select("workspace_id", F.col("relative_path").alias("path"), "content_hash")
    told = history.undo_conflicts(_history(spark, d, "plan_id", "workspace_id", "operation_kind", "before_path", "after_path", "after_hash", "recoverable", "undone_at").filter("undone_at IS NULL"), seen, "workspace_id", "path", "content_hash")
    return told.groupBy(F.coalesce("conflict", F.lit("none")).alias("conflict")).agg(F.count("*").alias("entries"), F.count_distinct("plan_id").alias("plans"))


@query(f"WITH {_H} SELECT plan_id, lower(after_path) AS target, count(*) AS n FROM h WHERE after_path IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def structural_conflicts(spark, d):
    return history.structural_conflicts(_history(spark, d, "plan_id", "after_path"), "plan_id", "after_path")


@query(f"WITH {_H} SELECT workspace_id, operation_kind, count(*) AS operations, count(undone_at) AS undone, count(*) FILTER (WHERE recoverable = 1) AS recoverable, count(DISTINCT plan_id) AS plans FROM h GROUP BY 1, 2")
def activity_counters(spark, d):
    return _history(spark, d, "workspace_id", "operation_kind", "undone_at", "recoverable", "plan_id").groupBy("workspace_id", "operation_kind").agg(F.count("*").alias("operations"), F.count("undone_at").alias("undone"), F.count_if(F.col("recoverable") == 1).alias("recoverable"), F.count_distinct("plan_id").alias("plans"))


@query(f"""
WITH {_H}, r AS (SELECT file_id, history_id, operation_kind, after_path, row_number() OVER (PARTITION BY file_id ORDER BY applied_at DESC NULLS LAST, history_id DESC) AS k FROM h WHERE file_id IS NOT NULL)
SELECT file_id, history_id, operation_kind, after_path FROM r WHERE k = 1
""")
def last_operation(spark, d):
    """The newest operation on each file, whatever the order in which rows arrived."""
    h = _history(spark, d, "file_id", "operation_kind", "after_path", "applied_at").filter("file_id IS NOT NULL")
    return scan.latest(h, ["file_id"], "applied_at", ["history_id"]).drop("applied_at")


@query("""
WITH b AS (SELECT DISTINCT file_id, size_bytes, modified_at, content_hash, status FROM indexed_documents), n AS (SELECT DISTINCT file_id, size_bytes, modified_at, content_hash FROM document_texts),
j AS (SELECT coalesce(b.file_id, n.file_id) AS file_id, CASE WHEN n.file_id IS NULL THEN 'removed' WHEN b.file_id IS NULL THEN CASE WHEN n.content_hash IS NULL THEN 'failed' ELSE 'added' END WHEN n.content_hash IS NULL THEN CASE WHEN status IN ('indexed', 'stale') THEN 'stale' ELSE 'failed' END
  WHEN n.size_bytes IS NOT DISTINCT FROM b.size_bytes AND n.modified_at IS NOT DISTINCT FROM b.modified_at AND status = 'indexed' THEN 'unchanged' WHEN n.content_hash = b.content_hash AND status <> 'failed' THEN 'metadata' ELSE 'updated' END AS outcome FROM b FULL JOIN n ON b.file_id = n.file_id)
SELECT file_id, outcome FROM j
""")
def scan_outcomes(spark, d):
    before = table(spark, d, "indexed_documents").select("file_id", "size_bytes", "modified_at", "content_hash", "status").distinct()
    now = table(spark, d, "document_texts").select("file_id", "size_bytes", "modified_at", "content_hash").distinct()
    return scan.scan_outcomes(before, now, "file_id")


@query("""
WITH e AS (SELECT user_id, count(*) AS failures FROM events WHERE event_type = 'error' OR value > 50 GROUP BY 1)
SELECT user_id, failures, CASE WHEN failures <= 2 THEN 0 ELSE least(600000 * (1::BIGINT << least(failures - 3, 16)::INT), 21600000) END::BIGINT AS wait_ms FROM e
""")
def retry_backoff(spark, d):
    e = table(spark, d, "events").filter("event_type = 'error' OR value > 50").groupBy("user_id").agg(F.count("*").alias("failures"))
    return e.withColumn("wait_ms", scan.retry_wait(F.col("failures")))


@query("""
WITH c AS (SELECT DISTINCT chunk_id, space_id, vector, embedded_at FROM chunk_vectors), r AS (SELECT chunk_id, space_id, embedded_at, row_number() OVER (PARTITION BY chunk_id ORDER BY embedded_at DESC NULLS LAST, space_id DESC) AS k FROM c)
SELECT chunk_id, space_id, embedded_at FROM r WHERE k = 1
""")
def latest_vectors(spark, d):
    """What an upsert by chunk leaves of all vectors ever written."""
    v = table(spark, d, "chunk_vectors").select("chunk_id", "space_id", "embedded_at").distinct()
    return scan.latest(v, ["chunk_id"], "embedded_at", ["space_id"])


@query("SELECT DISTINCT file_id, workspace_id, relative_path, status, content_hash FROM indexed_documents WHERE file_id IS NOT NULL")
def streamed_index(spark, d):
    """The index as a stream of arriving rows leaves it: micro-batches merged by file, the row indexed last stays.

    The rows arrive in several files, one a micro-batch, and before and after the true rows come outdated ones of the
    same files, which must not win.  Runs the stream to the end of what is there; state and table lie in the shared folder.
    """
    import uuid

    from ..plans.staging import own_dir
    from ..sources.folder import read_table
    from ..streaming.ingest import ingest, watch

    place = f"{own_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = table(spark, d, "indexed_documents").select("file_id", "workspace_id", "relative_path", "status", "content_hash", F.coalesce("indexed_at", F.timestamp_seconds(F.lit(1))).alias("indexed_at")).filter("file_id IS NOT NULL")
    old = rows.withColumns({"status": F.lit("outdated"), "indexed_at": F.timestamp_seconds(F.lit(0))})
    for part in (old, rows, old):
        part.coalesce(1).write.mode("append").parquet(f"{place}/arriving")
    kind = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    ingest(watch(spark, f"{place}/arriving", kind, 1), f"{place}/table", f"{place}/state", ["file_id"], "indexed_at").awaitTermination()
    return read_table(spark, f"{place}/table").drop("indexed_at")
