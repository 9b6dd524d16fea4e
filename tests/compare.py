"""Spark results against DuckDB's on the same tables."""

from __future__ import annotations

import datetime
import math
from pathlib import Path


def tables(connection, folder: str) -> None:
    for p in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE OR REPLACE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, datetime.datetime):
        return (value.astimezone(datetime.timezone.utc).replace(tzinfo=None) if value.tzinfo else value).isoformat()
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def rows(columns: list[str], found) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def difference(spark_df, connection, sql: str) -> str:
    """'' if both give the same columns and rows."""
    got = spark_df.collect()
    there = connection.execute(sql)
    columns = [c[0] for c in there.description]
    want = there.fetchall()
    if sorted(spark_df.columns) != sorted(columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(columns)}"
    a, b = rows(spark_df.columns, got), rows(columns, want)
    if a != b:
        left = [x for x in a if x not in set(b)][:2]
        right = [x for x in b if x not in set(a)][:2]
        return f"{len(a)} rows against {len(b)}; only Spark {left}; only SQL {right}"
    return ""
