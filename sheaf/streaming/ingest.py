"""Incremental ingest as a stream: changed files are merged into a table; failures are retried with backoff."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.scan import FIRST_WAIT_MS, FREE_TRIES, LONGEST_WAIT_MS
from ..sources.folder import upsert


def ingest(stream: DataFrame, table_path: str, checkpoint: str, keys: list[str], at: str, once: bool = True):
    """Merge every micro-batch of a stream into the table; a batch delivered again changes nothing."""
    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            upsert(table_path, batch, keys, at)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def watch(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """New parquet files of a folder as a stream of rows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def wait_ms(failures: int) -> int:
    return 0 if failures <= FREE_TRIES else min(FIRST_WAIT_MS << min(failures - FREE_TRIES - 1, 16), LONGEST_WAIT_MS)


def _retries(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    signature, failures, last = state.get if state.exists else ("", 0, 0)
    for pdf in batches:
        for row in pdf.sort_values("at_ms").itertuples():
            failures = 0 if row.ok else failures + 1 if row.signature == signature else 1
            signature, last = row.signature, row.at_ms
    state.update((signature, failures, last))
    yield pd.DataFrame({"path": [key[0]], "failures": [failures], "retry_at_ms": [last + wait_ms(failures) if failures else None]}, dtype=object)


def retry_state(attempts: DataFrame) -> DataFrame:
    """(path, failures, retry_at_ms) after each batch of (path, signature, ok, at_ms): how often the same file has failed
    in a row, and when it is due again; a success or a changed signature starts afresh."""
    return attempts.groupBy("path").applyInPandasWithState(_retries, "path string, failures int, retry_at_ms bigint", "signature string, failures int, last bigint", "update", GroupStateTimeout.NoTimeout)
