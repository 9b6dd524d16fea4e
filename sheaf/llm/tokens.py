"""Sizes of texts in tokens of a public byte-level BPE tokenizer, read from a vocabulary file outside the repository."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

VOCABULARY = os.environ.get("SHEAF_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: how the vocabulary's tokenizer splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longest stretch given to the tokenizer at once; cut between a line break and what follows it.
PART = 100_000


@lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer of a vocabulary file, or of the copy of it that came with the job where the path is not there."""
    import tiktoken

    if not os.path.exists(path):
        from pyspark import SparkFiles

        path = SparkFiles.get(os.path.basename(path))
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str, path: str = VOCABULARY) -> int:
    return len(encoder(path).encode_ordinary(text))


def token_counts(df: DataFrame, key: str, text: str, *also: str, path: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens, *also) per row with an id; a null text has 0 tokens.  Ids must be bigint; repeated rows count once.

    Only the id and the columns named in `also` come back with the size, so nothing wide is shuffled.  The vocabulary
    file goes with the job to executors that do not have it.
    """
    df.sparkSession.sparkContext.addFile(path)
    kept = [F.col(c).alias(f"k{n}") for n, c in enumerate(also)]
    rows = df.select(F.col(key).cast("bigint").alias("id"), *kept, F.col(text).alias("text")).filter("id IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            sizes = pa.array([len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()], pa.int64())
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, sizes], names=[*batch.schema.names[:-1], "n_tokens"])

    kinds = "".join(f", k{n} {dict(df.dtypes)[c]}" for n, c in enumerate(also))
    sized = rows.mapInArrow(run, f"id bigint{kinds}, n_tokens bigint")
    one = sized.groupBy("id").agg(F.max("n_tokens").alias("n_tokens"), *(F.max(f"k{n}").alias(f"k{n}") for n in range(len(also))))
    return one.withColumnsRenamed({f"k{n}": c for n, c in enumerate(also)})
