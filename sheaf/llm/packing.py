"""Problem 7: filling containers of fixed capacity, by vector best-fit.

An item has a size in each of three dimensions - tokens, one document, attention cost (tokens squared) - and a
container a capacity in each.  Items come largest first; among the open containers with room in every dimension the
one is taken whose weighted squared residual after placement is least (or, with rule "dot", whose residual has the
largest weighted dot-product with the item).  An item larger than the token capacity is cut into full pieces, each a
container of its own, and a remainder that is packed like any other item; no other item is split.  An item whose
attention cost alone exceeds that capacity cannot share a container with anything and stands alone.

Items are divided by a hash of their id into shards of about SHARD_ITEMS, packed independently: what a shard leaves
open is a few containers, against thousands that it fills.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..plans.staging import stage
from .frames import empty, plain

SHARD_ITEMS = 20_000
#: Weights of the squared residual in tokens, documents and attention cost.
WEIGHTS = (1.0, 0.01, 0.01)
#: Attention cost of a container as a share of the token capacity squared; tokens of capacity per item of the most items in one, and the least that is allowed.
COST_SHARE, TOKENS_AN_ITEM, LEAST_ITEMS = 0.95, 32, 16


def best_fit(sizes: np.ndarray, capacity: int, most_items: int, most_cost: float, rule: str = "norm") -> np.ndarray:
    """The container number of each item; sizes must come in descending order and be at most `capacity`."""
    n = len(sizes)
    where = np.empty(n, np.int64)
    tokens, items, cost, name = (np.empty(n, t) for t in (np.float64, np.float64, np.float64, np.int64))
    used = opened = 0
    w = np.array(WEIGHTS) / np.array([capacity, most_items, most_cost], float) ** 2
    for i, t in enumerate(sizes):
        if t * t > most_cost:
            where[i] = opened
            opened += 1
            continue
        a, b, c = tokens[:used], items[:used], cost[:used]
        ok = np.flatnonzero((a >= t) & (b >= 1) & (c >= t * t))
        if len(ok):
            if rule == "dot":
                k = ok[np.argmax(w[0] * a[ok] * t + w[1] * b[ok] + w[2] * c[ok] * t * t)]
            else:
                k = ok[np.argmin(w[0] * (a[ok] - t) ** 2 + w[1] * (b[ok] - 1) ** 2 + w[2] * (c[ok] - t * t) ** 2)]
        else:
            k = used
            used += 1
            tokens[k], items[k], cost[k], name[k] = capacity, most_items, most_cost, opened
            opened += 1
        where[i] = name[k]
        tokens[k] -= t
        items[k] -= 1
        cost[k] -= t * t
        if i % 256 == 255:  # containers that nothing left can enter are closed
            least = sizes[-1]
            open_ = np.flatnonzero((tokens[:used] >= max(least, 0)) & (items[:used] >= 1) & (cost[:used] >= least * least) & ((tokens[:used] > 0) | (least == 0)))
            if len(open_) < used:
                for x in (tokens, items, cost, name):
                    x[: len(open_)] = x[open_]
                used = len(open_)
    return where


def pack(sizes: DataFrame, containers: DataFrame, key: str = "id", size: str = "n_tokens", most_items: int | None = None, cost_share: float = COST_SHARE, rule: str = "norm") -> DataFrame:
    """(pack_id, pack_no, key, piece_no, start_token, n_tokens): where every item or piece of an item lies.

    `containers` has pack_id and capacity_tokens, one run per row; it is a table of a few rows by design and is read to
    the driver.  At most `most_items` items (by default one for every TOKENS_AN_ITEM tokens of capacity, LEAST_ITEMS at least) and an attention
    cost of `cost_share` * capacity squared go into one container; a single item above that cost has a container to itself.
    Items of size 0 are placed like others; null
    keys or sizes take no part, nor do containers with a null or non-positive capacity; a repeated key counts once.
    """
    if cost_share <= 0 or (most_items is not None and most_items < 1):
        raise ValueError("a container must be able to hold an item")
    runs = sorted((r[0], int(r[1])) for r in containers.filter("pack_id IS NOT NULL AND capacity_tokens > 0").select("pack_id", "capacity_tokens").distinct().collect())
    out = f"pack_id string, pack_no string, {key} bigint, piece_no int, start_token bigint, n_tokens bigint"
    spark = sizes.sparkSession
    if not runs:
        return spark.createDataFrame([], out)
    items = sizes.select(F.col(key).cast("bigint").alias("id"), F.col(size).cast("bigint").alias("n")).filter("id IS NOT NULL AND n >= 0").groupBy("id").agg(F.max("n").alias("n"))
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("pack_id"), F.lit(c).cast("bigint").alias("capacity")) for p, c in runs))).alias("r")
    # the number of shards must be known before rows are dealt to them; ids are counted, not the texts measured again
    items = stage(items, "sizes")
    shards = max(1, -(-items.count() // SHARD_ITEMS))
    dealt = items.select("id", "n", each).select("id", "n", "r.pack_id", "r.capacity")
    # n = pieces * capacity + rest; an item of exactly the capacity is one item, not a piece and an empty rest
    cut = dealt.withColumn("full", F.when(F.col("n") > F.col("capacity"), F.expr("n div capacity")).otherwise(F.lit(0).cast("bigint"))).withColumn("rest", F.expr("n - full * capacity"))
    whole = cut.filter("full > 0").select("pack_id", "id", "capacity", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"))
    whole = whole.select("pack_id", F.concat(F.lit("f"), "id", F.lit("-"), "piece").alias("pack_no"), F.col("id").alias(key), F.col("piece").cast("int").alias("piece_no"), (F.col("piece") * F.col("capacity")).alias("start_token"), F.col("capacity").alias("n_tokens"))
    parts = cut.filter("full = 0 OR rest > 0").select("pack_id", "capacity", "id", F.col("rest").alias("n"), F.col("full").alias("piece"), F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return empty("pack_id", "pack_no", key, "piece_no", "start_token", "n_tokens")
        pdf = pdf.sort_values(["n", "id"], ascending=[False, True])
        capacity, shard = int(pdf["capacity"].iloc[0]), int(pdf["shard"].iloc[0])
        where = best_fit(pdf["n"].to_numpy(np.int64), capacity, most_items or max(LEAST_ITEMS, capacity // TOKENS_AN_ITEM), cost_share * capacity * capacity, rule)
        return plain(pd.DataFrame({"pack_id": pdf["pack_id"].to_numpy(object), "pack_no": [f"s{shard}-{w}" for w in where], key: pdf["id"].to_numpy(), "piece_no": pdf["piece"].to_numpy(), "start_token": (pdf["piece"] * capacity).to_numpy(), "n_tokens": pdf["n"].to_numpy()}))

    packed = parts.groupBy("pack_id", "shard").applyInPandas(run, out)
    return packed.unionByName(whole)


def fill(packs: DataFrame, containers: DataFrame) -> DataFrame:
    """Per pack_id: capacity, n_packs, n_tokens, least_packs (tokens over capacity, rounded up) and the share of space used."""
    one = packs.groupBy("pack_id", "pack_no").agg(F.sum("n_tokens").alias("n"))
    told = one.groupBy("pack_id").agg(F.count("*").alias("n_packs"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest"))
    caps = containers.filter("capacity_tokens > 0").select("pack_id", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct()
    return told.join(caps, "pack_id").select("pack_id", "capacity", "n_packs", "n_tokens", "fullest", F.ceil(F.col("n_tokens") / F.col("capacity")).cast("bigint").alias("least_packs"), (F.col("n_tokens") / (F.col("n_packs") * F.col("capacity"))).alias("used"))
