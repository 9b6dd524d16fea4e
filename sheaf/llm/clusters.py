"""Problem 6: groups of mutually similar vectors by density clustering over spatial partitions.

Per scope (workspace and space) equal unit vectors are one point with a weight.  The points are reduced by principal
components of a bounded sample and cut into leaves by a k-d tree on the reduced coordinates; a leaf also takes those
points of later leaves that lie within the distance two members of one group can have (`reach_of`), measured to its
borders in the reduced coordinates, which never lengthens a distance, so no pair that belongs together is parted.  Each
leaf is clustered by density on the full vectors, at several densities (LEVELS): a point with a neighbour is a core
point, and linked core points are one local cluster.  Local clusters that share a core point are one (connected
components over all leaves).  A group is one of these clusters if it is compact and apart: at least `least_size`
members, each with cosine `inner` or more to the mean of the members' unit vectors, and no other row of the scope above
`outer`.  A cluster that holds only a part of a group, or a stranger with it, is first moved to the mean of the rows
about its own mean.  Both the moves and the final check are held against every leaf that can have a row near enough.
The member with the highest mean cosine to the others - the one nearest the centre - is the medoid.

A scope of at most LEAF points is one leaf, worked off in one task: the comparison is exact in blocks and nothing but
labels is kept.  Where points have no structure at all (independent directions) no bound can keep leaves apart: each of
g leaves then meets every earlier one, (g + 1) / 2 copies of a point on average, 2.5 at 100,000 points.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.components import connected_components
from ..plans.staging import stage
from .frames import empty, plain

#: Points a leaf should hold; points the tree of a scope is fitted on (bounds the fit alone: every point is assigned).
LEAF, FIT_ROWS = 32_768, 8192
REDUCED, SALT_ROWS = 24, 50_000
#: Cosines of neighbours, the densities of clustering; the first is replaced by the least that two members can have.
LEVELS = (0.55, 0.66, 0.74, 0.80, 0.86)
#: Length of the mean of unit vectors below which a cluster cannot be a group or a part of one; moves of a centre.
COMPACT, MOVES = 0.80, 3
#: Numbers in a block of cosines.
BLOCK = 4_000_000


def reach_of(inner: float) -> float:
    """The least cosine of two vectors that both have `inner` with one centre."""
    return 2 * inner * inner - 1


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keep, out = [], []
        for i, v in enumerate(pdf["vector"]):
            if v is None or not len(v):
                continue
            x = np.array([np.nan if y is None else y for y in v], np.float64)
            n = np.sqrt(x @ x)
            if np.isfinite(n) and n > 0:
                keep.append(i)
                out.append((x / n).astype(np.float32).tobytes())
        yield plain(pdf[["scope", "space", "id"]].iloc[keep]).assign(vec=pd.Series(out, index=pdf.index[keep], dtype=object))


def _matrix(vecs: pd.Series, width: int | None = None, kind: type = np.float32) -> np.ndarray:
    """Rows of one scope; vectors of another length than most (or than `width` bytes) are apart and get a row of zeros."""
    width = width or int(vecs.str.len().mode().iloc[0])
    return np.frombuffer(b"".join(v if len(v) == width else bytes(width) for v in vecs), kind).reshape(len(vecs), -1)


def _unit(total: np.ndarray) -> np.ndarray:
    return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-300)


def marks(ids: np.ndarray) -> np.ndarray:
    """64 mixed bits of each id: equal sets have equal exclusive-ors."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def fit_tree(u: np.ndarray, total: int, leaf: int) -> dict:
    """Reduction and k-d tree on a sample of `total` points: halves at the axis of the largest spread."""
    u = u.astype(np.float64)
    mean = u.mean(axis=0)
    _, _, axes = np.linalg.svd(u - mean, full_matrices=False)
    axes = axes[:REDUCED]
    scale = total / len(u)
    leaves = 0

    def grow(x: np.ndarray) -> dict:
        nonlocal leaves
        if len(x) * scale > leaf and len(x) > 1:
            axis = int(x.var(axis=0).argmax())
            v = np.sort(x[:, axis])
            at = float(v[(len(v) - 1) // 2])
            if at < v[-1]:
                low = x[:, axis] <= at
                return {"axis": axis, "at": at, "low": grow(x[low]), "high": grow(x[~low])}
        leaves += 1
        return {"leaf": leaves - 1}

    return {"mean": mean, "axes": axes, "tree": grow((u - mean) @ axes.T)}


def homes(model: dict, x: np.ndarray) -> np.ndarray:
    """The leaf of each row of reduced coordinates."""
    out = np.empty(len(x), np.int64)
    stack = [(model["tree"], np.arange(len(x)))]
    while stack:
        node, row = stack.pop()
        if "leaf" in node:
            out[row] = node["leaf"]
        elif len(row):
            low = x[row, node["axis"]] <= node["at"]
            stack += [(node["low"], row[low]), (node["high"], row[~low])]
    return out


def reach(model: dict, u: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, row) for every leaf whose points may have `cosine` or more with a row of `u`.

    Unit vectors of that cosine are at most sqrt(2 - 2 * cosine) apart, and the reduction does not lengthen distances.
    """
    x = (u - model["mean"]) @ model["axes"].T
    most = 2 - 2 * cosine + 1e-5
    leaves, rows = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    stack = [(model["tree"], np.arange(len(u)), np.zeros_like(x))]
    while stack:
        node, row, gap = stack.pop()
        near = (gap * gap).sum(axis=1) <= most
        row, gap = row[near], gap[near]
        if not len(row):
            continue
        if "leaf" in node:
            leaves.append(np.full(len(row), node["leaf"]))
            rows.append(row)
            continue
        beyond = x[row, node["axis"]] - node["at"]
        for child, side in (("low", beyond), ("high", -beyond)):
            wider = gap.copy()
            wider[:, node["axis"]] = np.maximum(wider[:, node["axis"]], side)
            stack.append((node[child], row, wider))
    return np.concatenate(leaves), np.concatenate(rows)


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unite the components of linked points; a label is the least point of its component and labels itself."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def components(u: np.ndarray, home: int, levels: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(labels, linked) per level of the points of a leaf, of which the first `home` are its own: two points are linked
    if one of them is the leaf's own and their cosine reaches the level."""
    n = len(u)
    label = np.tile(np.arange(n), (len(levels), 1))
    linked = np.zeros((len(levels), n), bool)
    step = max(1, BLOCK // max(n, 1))
    for a in range(0, home, step):
        b = min(home, a + step)
        near = u[a:b] @ u[a:].T >= levels[0]
        if np.count_nonzero(near) > near.size // 50:  # what is one at the highest density is one at all: a hot spot is met once
            near &= label[-1, a:b, None] != label[-1, None, a:]
        i, j = np.nonzero(near)
        i, j = i + a, j + a
        some = i < j
        i, j = i[some], j[some]
        if not len(i):
            continue
        s = np.einsum("ij,ij->i", u[i], u[j]) if len(i) * u.shape[1] <= 4 * BLOCK else np.concatenate([np.einsum("ij,ij->i", u[i[k : k + 50_000]], u[j[k : k + 50_000]]) for k in range(0, len(i), 50_000)])
        for k, level in enumerate(levels):
            if k:
                some = s >= level
                i, j, s = i[some], j[some], s[some]
            linked[k, i] = linked[k, j] = True
            _join(label[k], i, j)
    return label, linked


def _grouped(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, heads): positions sorted by label and where each label begins."""
    order = np.argsort(label, kind="stable")
    s = label[order]
    return order, np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.empty(0, np.int64)


def _moved(u: np.ndarray, w: np.ndarray, c: np.ndarray, middle: float) -> np.ndarray:
    """The sum of the unit vectors with cosine `middle` or more to each centre."""
    return np.concatenate([((c[a : a + 256] @ u.T >= middle) * w) @ u for a in range(0, len(c), 256)]) if len(c) else c


def solve(u: np.ndarray, w: np.ndarray, inner: float, outer: float, least_size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(points, cosines to the centre) of every group among the weighted points of one scope."""
    levels = (reach_of(inner) - 1e-6, *LEVELS[1:])
    label, _ = components(u, len(u), levels)
    wide = u.astype(np.float64)
    weighted = wide * w[:, None]
    seen: set[tuple[int, int]] = set()
    centres = []
    for k in range(len(levels)):
        order, heads = _grouped(label[k])
        total = np.add.reduceat(weighted[order], heads)
        size = np.add.reduceat(w[order], heads)
        for n in np.flatnonzero((size >= 2) & (np.linalg.norm(total, axis=1) >= COMPACT * size)):
            mark = int(order[heads[n]]), int(size[n])
            if mark not in seen:
                seen.add(mark)
                centres.append(total[n])
    c = _unit(np.array(centres).reshape(len(centres), u.shape[1]))
    for _ in range(MOVES):
        c = np.unique(np.round(_unit(_moved(wide, w, c, (inner + outer) / 2)), 9), axis=0)
    found, told = [], set()
    for a in range(0, len(c), 256):
        for near in c[a : a + 256] @ wide.T > outer:
            at = np.flatnonzero(near)
            if not len(at) or w[at].sum() < least_size or at.tobytes() in told:
                continue
            told.add(at.tobytes())
            cos = wide @ _unit(weighted[at].sum(axis=0, keepdims=True))[0]
            if cos[at].min() >= inner and (cos > outer).sum() == len(at):
                found.append((at, cos[at]))
    return found


_FOUND = "scope string, space string, cluster string, id bigint, n bigint, similarity double"


def _whole(inner: float, outer: float, least_size: int):
    """All groups of one scope."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        w, ids = pdf["n"].to_numpy(np.int64), pdf["id"].to_numpy(np.int64)
        found = solve(_matrix(pdf["vec"]), w, inner, outer, least_size) if w.sum() >= least_size else []
        if not found:
            return empty("scope", "space", "cluster", "id", "n", "similarity")
        at, cos = (np.concatenate(x) for x in zip(*found))
        names = np.repeat([f"{ids[a[0]]}-{len(a)}" for a, _ in found], [len(a) for a, _ in found])
        return plain(pd.DataFrame({"scope": pdf["scope"].iloc[0], "space": pdf["space"].iloc[0], "cluster": names, "id": ids[at], "n": w[at], "similarity": cos}))
    return run


def _local(levels: tuple[float, ...]):
    """The local clusters of one leaf at every level: a row for each point that has a neighbour."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["home", "id"], ascending=[False, True])
        ids = pdf["id"].to_numpy(np.int64)
        label, linked = components(_matrix(pdf["vec"]), int(pdf["home"].sum()), levels)
        single = (pdf["n"].to_numpy() > 1) & pdf["home"].to_numpy(bool)  # equal rows are neighbours of each other
        level, at = np.nonzero(linked | single)
        where = pdf["scope"].iloc[0], pdf["space"].iloc[0], pdf["leaf"].iloc[0]
        nodes = [f"{where[0]}\x1f{where[1]}\x1f{where[2]}\x1f{k}\x1f{ids[label[k, p]]}" for k, p in zip(level, at)]
        return plain(pd.DataFrame({"scope": where[0], "space": where[1], "level": level, "node": nodes, "id": ids[at]}))
    return run


_SUMS = "scope string, space string, cluster string, size bigint, least bigint, mark bigint, total binary"


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole sums from the partial ones of a partition, which has all rows of its clusters: a few per cluster."""
    held: dict[tuple[str, str, str], list] = {}
    for pdf in batches:
        for scope, space, name, size, least, mark, part in zip(*(pdf[c] for c in ("scope", "space", "cluster", "size", "least", "mark", "total"))):
            v, at = np.frombuffer(part, np.float64), (scope, space, name)
            if at not in held:
                held[at] = [int(size), int(least), int(mark), v.copy()]
            elif len(held[at][3]) == len(v):
                h = held[at]
                held[at] = [h[0] + int(size), min(h[1], int(least)), h[2] ^ int(mark), h[3] + v]
    rows = [(*at, h[0], h[1], h[2], h[3].tobytes()) for at, h in held.items()]
    yield pd.DataFrame(rows, columns=["scope", "space", "cluster", "size", "least", "mark", "total"])


def _summed(scope: str, space: str, names: list, picks: list[np.ndarray], ids: np.ndarray, w: np.ndarray, u: np.ndarray) -> pd.DataFrame:
    m = marks(ids)
    rows = [(scope, space, name, int(w[p].sum()), int(ids[p].min()), int(np.bitwise_xor.reduce(m[p])), (w[p] @ u[p]).tobytes()) for name, p in zip(names, picks)]
    return pd.DataFrame(rows, columns=["scope", "space", "cluster", "size", "least", "mark", "total"])


def _seeds(points: pd.DataFrame, named: pd.DataFrame) -> pd.DataFrame:
    """Partial sums of the clusters' points in one part of a scope."""
    if not len(points) or not len(named):
        return empty("scope", "space", "cluster", "size", "least", "mark", "total")
    points = points.sort_values("id")
    ids, w = points["id"].to_numpy(np.int64), points["n"].to_numpy(np.int64)
    u = _matrix(points["vec"]).astype(np.float64)
    named = named[named["id"].isin(ids)]
    at = np.searchsorted(ids, named["id"].to_numpy(np.int64))
    names = named["cluster"].to_numpy(object)
    code, firsts = pd.factorize(names)
    order, heads = _grouped(code)
    picks = np.split(at[order], heads[1:]) if len(heads) else []
    return _summed(points["scope"].iloc[0], points["space"].iloc[0], [firsts[code[order[h]]] for h in heads], picks, ids, w, u)


def _met(points: pd.DataFrame, centres: pd.DataFrame):
    points = points.sort_values("id")
    u = _matrix(points["vec"]).astype(np.float64)
    c = _unit(_matrix(centres["total"], u.shape[1] * 8, np.float64))
    step = max(1, BLOCK // max(len(u), 1))
    blocks = ((centres["cluster"].to_numpy(object)[a : a + step], c[a : a + step] @ u.T) for a in range(0, len(c), step))
    return points["scope"].iloc[0], points["space"].iloc[0], points["id"].to_numpy(np.int64), points["n"].to_numpy(np.int64), u, blocks


def _recentred(middle: float):
    def run(points: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(centres):
            return empty("scope", "space", "cluster", "size", "least", "mark", "total")
        scope, space, ids, w, u, blocks = _met(points, centres)
        names, picks = [], []
        for some, cos in blocks:
            for name, near in zip(some, cos >= middle):
                at = np.flatnonzero(near)
                if len(at):
                    names.append(name)
                    picks.append(at)
        return plain(_summed(scope, space, names, picks, ids, w, u))
    return run


def _around(outer: float):
    def run(points: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(centres):
            return empty("scope", "space", "cluster", "id", "n", "similarity", "mark")
        scope, space, ids, w, _, blocks = _met(points, centres)
        m, out = marks(ids), []
        for some, cos in blocks:
            row, col = np.nonzero(cos > outer)
            out.append(pd.DataFrame({"scope": scope, "space": space, "cluster": some[row], "id": ids[col], "n": w[col], "similarity": cos[row, col], "mark": m[col]}))
        return plain(pd.concat(out, ignore_index=True)).astype({"scope": object, "space": object, "cluster": object})
    return run


def _divided(points: DataFrame, counts: DataFrame, inner: float, outer: float, least_size: int, leaf: int) -> DataFrame:
    """Groups of the scopes that are too large for one leaf, as _FOUND."""
    spread = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    sample = points.join(counts, ["scope", "space"]).filter(spread < F.lit(FIT_ROWS) / F.col("rows"))

    def tree_of(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["rows"].iloc[0])
        return plain(pd.DataFrame({"scope": [pdf["scope"].iloc[0]], "space": [pdf["space"].iloc[0]], "rows": [n], "model": [pickle.dumps(fit_tree(_matrix(pdf["vec"]), n, leaf))]}))

    trees = stage(sample.groupBy("scope", "space").applyInPandas(tree_of, "scope string, space string, rows bigint, model binary"), "trees")
    salts = F.ceil(F.col("rows") / SALT_ROWS).cast("int")
    salted_trees = trees.select("scope", "space", "model", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    dealt = ["scope", "space", "salt"]

    def salted(rows: DataFrame, by: str) -> DataFrame:
        return rows.join(counts, ["scope", "space"]).withColumn("salt", F.pmod(F.xxhash64(by), salts).cast("int")).drop("rows")

    far = reach_of(inner) - 1e-6

    def routed(rows: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(tree):  # a scope has a tree unless its sample is empty; then it is one leaf
            return plain(rows).assign(leaf=0, home=True)[["scope", "space", "leaf", "home", "id", "n", "vec"]] if len(rows) else empty("scope", "space", "leaf", "home", "id", "n", "vec")
        model = pickle.loads(tree["model"].iloc[0])
        u = _matrix(rows["vec"]).astype(np.float64)
        own = homes(model, (u - model["mean"]) @ model["axes"].T)
        at, row = reach(model, u, far)
        some = at < own[row]  # a pair of leaves is compared once, in the earlier one
        at, row = np.concatenate((own, at[some])), np.concatenate((np.arange(len(u)), row[some]))
        got = plain(rows.iloc[row][["scope", "space", "id", "n", "vec"]]).reset_index(drop=True)
        return got.assign(leaf=at, home=np.arange(len(at)) < len(u))[["scope", "space", "leaf", "home", "id", "n", "vec"]]

    spots = stage(salted(points, "id").groupBy(*dealt).cogroup(salted_trees.groupBy(*dealt)).applyInPandas(routed, "scope string, space string, leaf bigint, home boolean, id bigint, n bigint, vec binary"), "spots")
    key = ["scope", "space", "leaf"]
    levels = (far, *LEVELS[1:])
    local = stage(spots.groupBy(*key).applyInPandas(_local(levels), "scope string, space string, level int, node string, id bigint"), "local")
    # one link per (core point, local cluster): to the least local cluster that has the point
    shared = local.groupBy("scope", "space", "level", "id").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first < last").drop("last")
    links = local.join(shared, ["scope", "space", "level", "id"]).filter("node <> first").select("node", "first").distinct()
    merged = connected_components(links, "node", "first", "node", "cluster")
    named = local.join(merged, "node", "left").select("scope", "space", "id", F.coalesce("cluster", "node").alias("cluster")).distinct()
    seeds = salted(points, "id").groupBy(*dealt).cogroup(salted(named, "id").groupBy(*dealt)).applyInPandas(_seeds, _SUMS).repartition("cluster").mapInPandas(_sums, _SUMS)

    def compact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            long_ = np.array([np.linalg.norm(np.frombuffer(t, np.float64)) for t in pdf["total"]])
            yield pdf[(pdf["size"] >= 2) & (long_ >= COMPACT * pdf["size"])] if len(pdf) else pdf

    def sent(cosine: float):
        def run(centres: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
            if not len(centres):
                return empty(*key, "cluster", "total")
            if not len(tree):
                return plain(centres).assign(leaf=0)[[*key, "cluster", "total"]]
            model = pickle.loads(tree["model"].iloc[0])
            at, row = reach(model, _unit(_matrix(centres["total"], model["mean"].nbytes, np.float64)), cosine)
            return plain(centres.iloc[row][["scope", "space", "cluster", "total"]]).reset_index(drop=True).assign(leaf=at)[[*key, "cluster", "total"]]
        return run

    own = spots.filter("home").select(*key, "id", "n", "vec")

    def met(centres: DataFrame, cosine: float, run, schema: str) -> DataFrame:
        """What `run` makes of the points of each leaf and the centres that may have `cosine` with one of them."""
        there = salted(centres, "cluster").groupBy(*dealt).cogroup(salted_trees.groupBy(*dealt)).applyInPandas(sent(cosine), "scope string, space string, leaf bigint, cluster string, total binary")
        return own.groupBy(*key).cogroup(there.groupBy(*key)).applyInPandas(run, schema)

    middle = (inner + outer) / 2
    alike = ["scope", "space", "size", "least", "mark"]
    centres = stage(seeds.mapInPandas(compact, _SUMS).dropDuplicates(alike), "centres")
    for _ in range(MOVES):
        centres = stage(met(centres, middle, _recentred(middle), _SUMS).repartition("cluster").mapInPandas(_sums, _SUMS).dropDuplicates(alike), "centres")
    around = stage(met(centres, outer, _around(outer), f"{_FOUND}, mark bigint"), "around")
    by = ["scope", "space", "cluster"]
    told = around.groupBy(*by).agg(F.sum("n").alias("size"), F.min("similarity").alias("nearest"), F.bit_xor("mark").alias("mark"))
    # the rows above `outer` must be those whose mean the centre is
    stands = told.filter((F.col("size") >= least_size) & (F.col("nearest") >= inner)).join(centres.select(*by, "size", "mark"), [*by, "size", "mark"]).select(*by)
    return around.join(stands, by).drop("mark").select("scope", "space", "cluster", "id", "n", "similarity")


def similarity_groups(df: DataFrame, key: str, vector: str, scope: str, space: str, inner: float = 0.88, outer: float = 0.80, least_size: int = 3) -> tuple[DataFrame, DataFrame]:
    """(members, groups).  members: cluster_key (the smallest id of the group), id, similarity to the centre.  groups:
    cluster_key, scope, space, size, cohesion (mean cosine of all pairs), medoid and the three most typical members.

    Rows whose id, scope, space or vector is null, or whose vector is empty, zero or not finite, belong to no group and
    count nowhere; a repeated row counts once (one row per id is kept); equal vectors are mutually similar; other
    columns are ignored; empty input gives empty results.  Ids must be bigint.
    """
    rows = df.select(F.col(scope).alias("scope"), F.col(space).alias("space"), F.col(key).cast("bigint").alias("id"), F.col(vector).alias("vector"))
    units = rows.filter("scope IS NOT NULL AND space IS NOT NULL AND id IS NOT NULL AND vector IS NOT NULL").mapInPandas(_units, "scope string, space string, id bigint, vec binary")
    units = stage(units, "units").dropDuplicates(["scope", "space", "id"])
    # equal vectors are one point, named by its smallest id
    points = stage(units.groupBy("scope", "space", "vec").agg(F.min("id").alias("id"), F.count("*").alias("n")), "points")
    counts = stage(points.groupBy("scope", "space").agg(F.count("*").alias("rows")), "counts")
    leaf = LEAF
    small = points.join(counts.filter(F.col("rows") <= leaf).select("scope", "space"), ["scope", "space"], "left_semi")
    found = small.groupBy("scope", "space").applyInPandas(_whole(inner, outer, least_size), _FOUND)
    large = counts.filter(F.col("rows") > leaf)
    if large.limit(1).count():
        wide = points.join(large.select("scope", "space"), ["scope", "space"], "left_semi").select("scope", "space", "id", "n", "vec")
        found = found.unionByName(_divided(wide, large, inner, outer, least_size, leaf))
    found = stage(found, "found")
    by = ["scope", "space", "cluster"]
    told = found.groupBy(*by).agg(F.sum("n").alias("size"), F.min("id").alias("cluster_key"), F.sum(F.col("similarity") * F.col("n")).alias("summed_cos"))
    mine = found.join(told.select(*by, "cluster_key"), by)
    several = mine.filter("n > 1").select("scope", "space", F.col("id").alias("first"), "cluster_key", "similarity")
    copied = units.join(points.filter("n > 1").select("scope", "space", "vec", F.col("id").alias("first")), ["scope", "space", "vec"]).select("scope", "space", "first", "id")
    members = mine.filter("n = 1").select("cluster_key", "id", "similarity").unionByName(several.join(copied, ["scope", "space", "first"]).select("cluster_key", "id", "similarity"))
    members = stage(members, "members")
    top = F.expr("slice(array_sort(collect_list(struct(-similarity AS s, id))), 1, 3)")
    ranked = members.withColumn("turn", F.expr("row_number() OVER (PARTITION BY cluster_key ORDER BY similarity DESC, id)")).filter("turn <= 3")
    typical = ranked.groupBy("cluster_key").agg(F.transform(top, lambda x: x["id"]).alias("typical"))
    # the sum of the unit vectors has length sum(cos to centre), so the mean cosine of pairs needs no pairs
    cohesion = (F.col("summed_cos") * F.col("summed_cos") - F.col("size")) / (F.col("size") * (F.col("size") - 1))
    groups = told.dropDuplicates(["cluster_key"]).join(typical, "cluster_key").select("cluster_key", "scope", "space", "size", F.least(F.lit(1.0), cohesion).alias("cohesion"), F.col("typical")[0].alias("medoid"), "typical")
    return members, groups
