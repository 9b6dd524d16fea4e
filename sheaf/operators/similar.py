"""All pairs of vectors of a scope from a cosine on, exactly, without meeting what cannot be near.

The rows of a scope are divided into blocks by the nearest of a few pivots, which are drawn from a bounded sample;
each block keeps its radius, the largest angle of a row to its pivot.  Two blocks meet only if the angle between their
pivots is at most the sum of their radii and the angle of the wanted cosine (triangle inequality of angles), so no
pair is missed whatever the pivots are.  A block that holds much more than BLOCK_ROWS is divided by a hash of the id.
Blocks meet as matrices in Arrow batches, the later one of two being sent to the earlier one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import vectors as V
from ..plans.staging import stage

#: Rows a block should hold; rows of a scope that pivots are drawn from.
BLOCK_ROWS, PIVOT_ROWS = 8192, 4096
#: Angles are widened by this much for rounding.
SLACK = 1e-4


def _unit_rows(column: pd.Series, width: int) -> np.ndarray:
    return np.stack([v if len(v) == width else np.zeros(width, np.float32) for v in column]).astype(np.float32)


def _near(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(smaller id, larger id, cosine) of the near rows of two matrices, or of one with itself, block by block."""
    out = [(x[:0], x[:0], np.empty(0))]
    for k in range(0, len(a), 1024):
        i, j = np.nonzero(a[k : k + 1024] @ b.T >= least - 1e-6)
        i = i + k
        if same:
            i, j = i[i < j], j[i < j]
        cos = np.einsum("ij,ij->i", a[i].astype(np.float64), b[j].astype(np.float64))
        p, q = x[i], y[j]
        keep = (cos >= least) & (p != q)
        out.append((np.minimum(p, q)[keep], np.maximum(p, q)[keep], cos[keep]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _found(scope, pairs: tuple) -> pd.DataFrame:
    """A frame of pairs with plain object columns, which convert to any type of scope and id."""
    n = len(pairs[2])
    return pd.DataFrame({"scope": pd.Series([scope] * n, dtype=object), "a": pd.Series(pairs[0], dtype=object), "b": pd.Series(pairs[1], dtype=object), "cosine": pd.Series(pairs[2], dtype=object if not n else None)})


_SCOPE = ["scope", "width"]


def similar_pairs(rows: DataFrame, scope: str, key: str, vector: str, least: float) -> DataFrame:
    """(scope, a, b, cosine) of all rows a < b of one scope with that cosine or more.

    Null scopes, keys and vectors, and vectors that are zero or not finite, take no part; vectors of different lengths
    do not meet; a repeated row counts once.  Keys must be of one orderable type.  A scope of at most BLOCK_ROWS is one block.
    """
    kinds = dict(rows.dtypes)
    sound = rows.filter(F.col(scope).isNotNull() & F.col(key).isNotNull()).select(F.col(scope).alias("scope"), F.col(key).alias("id"), F.size(vector).alias("width"), V.unit(F.col(vector)).cast("array<float>").alias("u"))
    sound = sound.filter("u IS NOT NULL AND width > 0 AND NOT exists(u, x -> x IS NULL OR isnan(x))").dropDuplicates(["scope", "id"])
    units = stage(sound, "units")
    counts = stage(units.groupBy(*_SCOPE).agg(F.count("*").alias("n")), "counts")
    out = f"scope {kinds[scope]}, a {kinds[key]}, b {kinds[key]}, cosine double"

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        u, x = _unit_rows(pdf["u"], int(pdf["width"].iloc[0])), pdf["id"].to_numpy(object if pdf["id"].dtype.kind not in "iu" else None)
        return _found(pdf["scope"].iloc[0], _near(x, x, u, u, least, True))

    small = units.join(counts.filter(F.col("n") <= BLOCK_ROWS).select(*_SCOPE), _SCOPE, "left_semi")
    found = small.groupBy(*_SCOPE).applyInPandas(whole, out)
    large = counts.filter(F.col("n") > BLOCK_ROWS)
    if large.limit(1).count():
        wide = units.join(large.select(*_SCOPE), _SCOPE, "left_semi")
        found = found.unionByName(_divided(wide, large, kinds[scope], kinds[key], least, out))
    return found.withColumnRenamed("scope", scope)


def _divided(units: DataFrame, counts: DataFrame, scope: str, key: str, least: float, out: str) -> DataFrame:
    """The pairs of scopes that are more than one block."""
    spread = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    sample = units.join(counts, _SCOPE).filter(spread < F.lit(PIVOT_ROWS) / F.col("n"))

    def pivots(pdf: pd.DataFrame) -> pd.DataFrame:
        u = _unit_rows(pdf["u"], int(pdf["width"].iloc[0]))
        k = min(len(u), max(1, -(-int(pdf["n"].iloc[0]) // BLOCK_ROWS)))
        rng = np.random.default_rng(5)
        c = u[rng.choice(len(u), k, replace=False)].copy()
        for _ in range(6):
            own = (u @ c.T).argmax(axis=1)
            for j in range(k):
                if (own == j).any():
                    c[j] = u[own == j].sum(axis=0)
                    c[j] /= max(np.linalg.norm(c[j]), 1e-12)
        return pd.DataFrame({"scope": pd.Series([pdf["scope"].iloc[0]], dtype=object), "width": [pdf["width"].iloc[0]], "pivots": [c.ravel()]})

    fitted = stage(sample.groupBy(*_SCOPE).applyInPandas(pivots, f"scope {scope}, width int, pivots array<float>"), "pivots")

    def placed(batches):
        for pdf in batches:
            block, angle = np.zeros(len(pdf), np.int64), np.full(len(pdf), np.pi)
            for at in pdf.groupby(_SCOPE).indices.values():
                p = pdf["pivots"].iloc[at[0]]
                if p is not None:
                    width = int(pdf["width"].iloc[at[0]])
                    cos = _unit_rows(pdf["u"].iloc[at], width) @ np.asarray(p, np.float32).reshape(-1, width).T
                    block[at] = cos.argmax(axis=1)
                    angle[at] = np.arccos(np.clip(cos.max(axis=1), -1, 1))
            yield pdf[[*_SCOPE, "id", "u"]].assign(block=block, angle=angle)

    # pivots are a row per large scope, but of those there may be many: the planner chooses how they meet the rows
    dealt = stage(units.join(fitted, _SCOPE, "left").mapInPandas(placed, f"scope {scope}, width int, id {key}, u array<float>, block bigint, angle double"), "dealt")
    blocks = dealt.groupBy(*_SCOPE, "block").agg(F.max("angle").alias("radius"), F.ceil(F.count("*") / (2 * BLOCK_ROWS)).cast("int").alias("parts"))
    known = stage(blocks.join(fitted, _SCOPE, "left"), "blocks")
    reach = float(np.arccos(np.clip(least, -1, 1))) + SLACK

    def meetings(pdf: pd.DataFrame) -> pd.DataFrame:
        """Which blocks of a scope meet: (first, second), the first being the earlier or the same."""
        pdf = pdf.sort_values("block")
        b, r, p = pdf["block"].to_numpy(), pdf["radius"].to_numpy(), pdf["pivots"].iloc[0]
        if p is None:
            near = np.ones((len(b), len(b)), bool)
        else:
            c = np.asarray(p, np.float64).reshape(-1, int(pdf["width"].iloc[0]))[b]
            near = np.arccos(np.clip(c @ c.T, -1, 1)) <= r[:, None] + r[None, :] + reach
        i, j = np.nonzero(np.triu(near))
        parts = pdf["parts"].to_numpy()
        got = [(b[x], s, b[y], t) for x, y in zip(i, j) for s in range(parts[x]) for t in range(parts[y]) if x != y or s <= t]
        return pd.DataFrame({"scope": pd.Series([pdf["scope"].iloc[0]] * len(got), dtype=object), "width": int(pdf["width"].iloc[0]), "first": [o[0] for o in got], "part": [o[1] for o in got], "second": [o[2] for o in got], "other": [o[3] for o in got]})

    met = stage(known.groupBy(*_SCOPE).applyInPandas(meetings, f"scope {scope}, width int, first bigint, part int, second bigint, other int"), "meetings")
    numbered = dealt.join(known.select(*_SCOPE, "block", "parts"), [*_SCOPE, "block"]).select(*_SCOPE, "id", "u", "block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("own"))
    tile = [*_SCOPE, "first", "part", "second", "other"]
    left = numbered.withColumnsRenamed({"block": "first", "own": "part"}).join(met, [*_SCOPE, "first", "part"]).select(*tile, "id", "u")
    right = numbered.withColumnsRenamed({"block": "second", "own": "other"}).join(met, [*_SCOPE, "second", "other"]).filter("first <> second OR part <> other").select(*tile, "id", "u")

    def compared(own: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return _found(None, (np.empty(0, object), np.empty(0, object), np.empty(0)))
        same = int(own["first"].iloc[0]) == int(own["second"].iloc[0]) and int(own["part"].iloc[0]) == int(own["other"].iloc[0])
        there = own if same else there
        ids = [df["id"].to_numpy(object if df["id"].dtype.kind not in "iu" else None) for df in (own, there)]
        width = int(own["width"].iloc[0])
        if not len(there):
            return _found(None, (ids[0][:0], ids[0][:0], np.empty(0)))
        return _found(own["scope"].iloc[0], _near(*ids, _unit_rows(own["u"], width), _unit_rows(there["u"], width), least, same))

    right = right.toDF(*[f"r_{c}" for c in right.columns]).toDF(*right.columns)  # columns of its own, not those of the left side
    return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInPandas(compared, out)
