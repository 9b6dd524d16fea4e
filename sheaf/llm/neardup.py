"""Problem 3: near-duplicate texts by MinHash banding, signature check and exact verification.

Texts become sets of 64-bit hashes of word sequences (three words, on the consistent form, lower-cased).  Equal
sets form a class with one representative, so copies cost nothing further.  Representatives get one signature of
`BANDS * ROWS` minima of universal hashes; classes that agree in all rows of a band are candidates; candidates whose
signatures agree too little are dropped; the rest are compared exactly.  The links give groups by alternating
large-star and small-star.

Chance that a pair at the threshold shares no band: (1 - 0.6**4)**48, about one in 800.  The classes of a bucket of
more than `HOT_BUCKET` are not compared with one another through it: they mostly share a common passage.  They are
matched exactly instead, by the rarest part of their sets (two sets as alike as the threshold must share one of the
rarest size - ceil(threshold * size) + 1 members of each, counted over these classes), so no bucket is cut off and
no pair of a hot bucket is missed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators.components import connected_components
from ..plans.staging import stage
from .textform import canonical

BANDS, ROWS = 48, 4
HOT_BUCKET = 64
SEED = 20240229
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ROLL = np.uint64(0xBF58476D1CE4E5B9)


def words(text: str) -> list[str]:
    """Runs of letters and digits of the consistent form, lower-cased."""
    return _WORD.findall(canonical(text).lower())


@lru_cache(maxsize=200_000)
def _word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word, SEED)


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingles(found: list[str], width: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the sequences of `width` words."""
    if len(found) < width:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_word_hash, found), np.uint64, len(found))
    n = len(h) - width + 1
    rolled = h[:n].copy()
    for i in range(1, width):
        rolled = _finish(rolled * _ROLL + h[i : i + n])
    return np.unique(rolled)


_LOT = 4096


@lru_cache(maxsize=1)
def _universal() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multipliers and offsets of the hash family, as rows, and room for its values: x -> the upper half of x * a + b
    modulo 2**64, for x of 32 bits, which is strongly universal."""
    rng = np.random.default_rng(SEED)
    n = BANDS * ROWS
    return rng.integers(0, 2**64, (1, n), dtype=np.uint64), rng.integers(0, 2**64, (1, n), dtype=np.uint64), np.empty((_LOT, n), np.uint64)


def minima(items: np.ndarray) -> np.ndarray:
    """The signature: the least value of each universal hash over the set, 32 bits each."""
    a, b, room = _universal()
    x = (items >> np.uint64(32))[:, None]
    low = np.full(a.shape[1], np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(x), _LOT):
        part = x[at : at + _LOT]
        values = room[: len(part)]
        np.multiply(part, a, out=values)
        np.add(values, b, out=values)
        np.minimum(low, values.min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _keys(rows: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit key per run of `width` minima; the run's number is part of it."""
    parts = rows.reshape(-1, width).astype(np.uint64)
    key = np.arange(len(parts), dtype=np.uint64) * _MIX
    for i in range(width):
        key = _finish(key * _ROLL + parts[:, i])
    return key.view(np.int64)


def _signed(batches: Iterator[pd.DataFrame], least_words: int, width: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for id_, text in zip(pdf["id"], pdf["text"]):
            found = words(text)
            if len(found) < max(least_words, width):
                continue
            items = shingles(found, width)
            out.append((id_, xxhash.xxh3_128_digest(items.tobytes()), len(items), minima(items).tobytes()))
        yield pd.DataFrame(out, columns=["id", "class", "size", "sig"])


def _banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keys = [_keys(np.frombuffer(s, np.uint32), ROWS) for s in pdf["sig"]]
        yield pd.DataFrame({"rep": np.repeat(pdf["rep"].to_numpy(np.int64), BANDS), "key": np.concatenate(keys) if keys else np.empty(0, np.int64)})


def _members(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingles(words(t), width).view(np.int64) for t in pdf["text"]]
            sizes = [len(x) for x in sets]
            yield pd.DataFrame({"rep": np.repeat(pdf["rep"].to_numpy(np.int64), sizes), "size": np.repeat(np.array(sizes, np.int32), sizes), "token": np.concatenate(sets) if sets else np.empty(0, np.int64)})
    return run


def _by_rarest(texts: DataFrame, threshold: float, width: int) -> DataFrame:
    """(rep_a, rep_b) of all pairs of texts (rep, text) that share one of the rarest members of both and whose sizes, and
    what follows the shared member in the order of rarity, allow the threshold."""
    tokens = stage(texts.mapInPandas(_members(width), "rep bigint, size int, token bigint").distinct(), "tokens")
    counted = tokens.join(tokens.groupBy("token").agg(F.count("*").alias("df")), "token")
    ranked = counted.withColumn("rank", F.expr("row_number() OVER (PARTITION BY rep ORDER BY df, token)"))
    rare = stage(ranked.filter(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1).filter("df > 1").select("rep", "size", "token", "rank"), "rare")
    a, b = (rare.withColumnsRenamed({c: f"{c}_{x}" for c in ("rep", "size", "rank")}) for x in ("a", "b"))
    fits = (F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * threshold - 1e-9) & (F.col("rep_a") < F.col("rep_b"))
    # the first member that two sets share leaves at most so many more to share; as many as the threshold needs must be left
    needed = (F.col("size_a") + F.col("size_b")) * (threshold / (1 + threshold)) - 1e-9
    left = F.least(F.col("size_a") - F.col("rank_a"), F.col("size_b") - F.col("rank_b")) + 1
    met = a.join(b, "token").filter(fits).groupBy("rep_a", "rep_b").agg(F.max(left).alias("left"), F.first(needed).alias("needed"))
    return met.filter("left >= needed").select("rep_a", "rep_b")


def _agreeing(floor: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                a = np.frombuffer(b"".join(pdf["sig_a"]), np.uint32).reshape(len(pdf), -1)
                b = np.frombuffer(b"".join(pdf["sig_b"]), np.uint32).reshape(len(pdf), -1)
                pdf = pdf[(a == b).mean(axis=1) >= floor]
            yield pdf[["rep_a", "rep_b"]]
    return run


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"rep": pdf["rep"], "items": [shingles(words(t), width).tobytes() for t in pdf["text"]]})
    return run


def _exact(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = np.empty(len(pdf))
            for i, (a, b) in enumerate(zip(pdf["items_a"], pdf["items_b"])):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                got[i] = both / (len(x) + len(y) - both)
            keep = got >= threshold
            yield pd.DataFrame({"rep_a": pdf["rep_a"][keep], "rep_b": pdf["rep_b"][keep], "jaccard": got[keep]})
    return run


def similar_classes(df: DataFrame, key: str, text: str, threshold: float = 0.6, least_words: int = 20, width: int = 3) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has id and rep, the smallest id with an equal set of word sequences; links has
    rep_a < rep_b and their exact jaccard, at least `threshold`.

    Null ids and texts and texts of fewer than `least_words` words are in neither; repeated rows count once; other
    columns of df are ignored; empty input gives empty results.  Ids must be bigint.
    """
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    signed = stage(rows.mapInPandas(lambda it: _signed(it, least_words, width), "id bigint, class binary, size int, sig binary"), "signed")
    reps = signed.groupBy("class").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"))
    members = stage(signed.select("id", "class").join(reps.select("class", "rep"), "class").select("id", "rep").distinct(), "members")
    reps = stage(reps.select("rep", "sig"), "reps")
    banded = reps.mapInPandas(_banded, "rep bigint, key bigint")
    shared = stage(banded.withColumn("n", F.expr("count(*) OVER (PARTITION BY key)")).filter("n > 1"), "buckets")
    buckets = shared.filter(f"n <= {HOT_BUCKET}").select("rep", "key")
    hot = rows.withColumnRenamed("id", "rep").join(shared.filter(f"n > {HOT_BUCKET}").select("rep"), "rep", "left_semi")
    near = buckets.withColumnRenamed("rep", "rep_a").join(buckets.withColumnRenamed("rep", "rep_b"), "key").filter("rep_a < rep_b").select("rep_a", "rep_b")
    near = near.unionByName(_by_rarest(hot, threshold, width)).distinct()
    # 192 minima: at the threshold the agreement has a deviation of at most 0.036; four of them are allowed
    signed_pairs = near.join(reps.select(F.col("rep").alias("rep_a"), F.col("sig").alias("sig_a")), "rep_a").join(reps.select(F.col("rep").alias("rep_b"), F.col("sig").alias("sig_b")), "rep_b")
    likely = stage(signed_pairs.mapInPandas(_agreeing(threshold - 0.15), "rep_a bigint, rep_b bigint"), "likely")
    wanted = likely.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).distinct()
    # a row delivered twice has one text; max() picks it with partial aggregation on both sides
    texts = rows.withColumnRenamed("id", "rep").join(wanted, "rep", "left_semi").mapInPandas(_sets(width), "rep bigint, items binary").distinct()
    sets = stage(texts, "sets")
    met = likely.join(sets.select(F.col("rep").alias("rep_a"), F.col("items").alias("items_a")), "rep_a").join(sets.select(F.col("rep").alias("rep_b"), F.col("items").alias("items_b")), "rep_b")
    return members, stage(met.mapInPandas(_exact(threshold), "rep_a bigint, rep_b bigint, jaccard double"), "links")


def near_duplicate_pairs(df: DataFrame, key: str, text: str, threshold: float = 0.6, least_words: int = 20, width: int = 3) -> DataFrame:
    """Every pair (id_a < id_b) of rows whose texts are at least `threshold` alike, copies included."""
    members, links = similar_classes(df, key, text, threshold, least_words, width)
    a = members.select(F.col("rep").alias("rep_a"), F.col("id").alias("x"))
    b = members.select(F.col("rep").alias("rep_b"), F.col("id").alias("y"))
    across = links.join(a, "rep_a").join(b, "rep_b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    several = members.groupBy("rep").count().filter("count > 1").select("rep")
    own = members.join(several, "rep", "left_semi")
    within = own.withColumnRenamed("id", "id_a").join(own.withColumnRenamed("id", "id_b"), "rep").filter("id_a < id_b").select("id_a", "id_b")
    return across.unionByName(within)


def near_duplicate_groups(df: DataFrame, key: str, text: str, threshold: float = 0.6, least_words: int = 20, width: int = 3) -> DataFrame:
    """One row per eligible id: class_id (equal sets), group_id (connected by links), n_copies, n_links to other classes."""
    members, links = similar_classes(df, key, text, threshold, least_words, width)
    groups = connected_components(links, "rep_a", "rep_b", "rep", "group_id")
    degree = links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    copies = members.groupBy("rep").agg(F.count("*").alias("n_copies"))
    about = copies.join(groups, "rep", "left").join(degree, "rep", "left")
    return members.join(about, "rep").select("id", F.col("rep").alias("class_id"), F.coalesce("group_id", "rep").alias("group_id"), "n_copies", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
