"""Problem 1: the most similar vectors for every vector, by one navigable graph per shard and a merge.

Vectors of a space are divided into cells by the nearest of a few centroids, about SHARD_BYTES of vectors to a cell; the
centroids are fitted on a bounded sample, every vector is indexed.  A cell that the sample shows to be larger is
divided further by a hash of the vector.  Each shard builds its graph (see hnsw) and answers for its own vectors and
for those whose centroid is almost as near: within `margin` of the best cosine, whatever number of cells that is.
Equal vectors are one node with a list of ids, and are put together before the shuffle, so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .hnsw import Graph

#: Bytes of vectors in a shard; rows per space that centroids are fitted on; most cells of a space (beyond it cells are divided by hash).
SHARD_BYTES, FIT_ROWS, MOST_CELLS = 16 << 20, 8192, 4096
#: Links of the graphs that have to find neighbours that are hardly nearer than all others.
DENSE = {"forward": 12, "reverse": 24, "mends": 8}


def shard_rows(width: int) -> int:
    """Rows of a shard of vectors with `width` numbers."""
    return max(64, SHARD_BYTES // (4 * width))


def fit_cells(sample: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, shards of each cell) for a space of `count` vectors."""
    most = shard_rows(sample.shape[1])
    k = min(MOST_CELLS, max(1, -(-count // most)), max(1, len(sample)))
    if k == 1:
        return np.zeros((1, sample.shape[1]), np.float32), np.array([max(1, -(-count // (2 * most)))])
    rng = np.random.default_rng(11)
    c = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(8):
        own = (sample @ c.T).argmax(axis=1)
        for j in range(k):
            part = sample[own == j]
            total = part.sum(axis=0) if len(part) else sample[rng.integers(len(sample))]
            c[j] = total / max(np.linalg.norm(total), 1e-12)
    own = (sample @ c.T).argmax(axis=1)
    rows = np.bincount(own, minlength=k) * (count / len(sample))
    return c.astype(np.float32), np.maximum(1, np.ceil(rows / (2 * most))).astype(np.int64)


def _units(vectors: pa.Array, width: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, unit vectors) of those rows whose vector has the width, only finite numbers and a length."""
    offsets = np.frombuffer(vectors.buffers()[1], np.int32, len(vectors) + 1, vectors.offset * 4)
    values = vectors.values
    numbers = np.where(values.is_null().to_numpy(zero_copy_only=False), np.nan, values.to_numpy(zero_copy_only=False)) if values.null_count else values.to_numpy(zero_copy_only=False)
    present = vectors.is_valid().to_numpy(zero_copy_only=False)
    rows = rows[present[rows] & (np.diff(offsets)[rows] == width)]
    x = numbers[offsets[rows][:, None] + np.arange(width)].astype(np.float64)
    with np.errstate(all="ignore"):
        size = np.sqrt((x * x).sum(axis=1))
    ok = np.isfinite(size) & (size > 0)
    return rows[ok], (x[ok] / size[ok, None]).astype(np.float32)


_ROWS = pa.schema([("space", pa.string()), ("cell", pa.int32()), ("part", pa.int32()), ("home", pa.bool_()), ("vec", pa.binary()), ("ids", pa.binary()), ("asks", pa.binary())])


def _routed(widths: dict[str, int], cells: dict[str, tuple[np.ndarray, np.ndarray]], margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in _ROWS.names}
            names = np.asarray(batch.column("space").to_pylist(), dtype=object)
            ids, asks = batch.column("id").to_numpy(zero_copy_only=False), batch.column("asks").to_numpy(zero_copy_only=False)
            for space, width in widths.items():
                rows, x = _units(batch.column("vector"), width, np.flatnonzero(names == space))
                if not len(rows):
                    continue
                raw = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 4))).ravel()
                _, first, group = np.unique(raw, return_index=True, return_inverse=True)
                order = np.argsort(group, kind="stable")
                edges = np.searchsorted(group[order], np.arange(len(first) + 1))
                centroids, parts = cells[space]
                near = x[first] @ centroids.T
                home = near.argmax(axis=1)
                probe = near >= near.max(axis=1)[:, None] - margin
                for n, at in enumerate(first):
                    mine = rows[order[edges[n] : edges[n + 1]]]
                    own, vec = np.unique(ids[mine]), x[at].tobytes()
                    ask = np.unique(ids[mine[asks[mine]]])
                    turn = xxhash.xxh64_intdigest(vec) % int(parts[home[n]])
                    for cell in np.flatnonzero(probe[n]) if parts.size > 1 or parts[0] > 1 else (0,):
                        for part in range(int(parts[cell])):
                            here = cell == home[n] and part == turn
                            if here or len(ask):
                                for column, value in zip(out.values(), (space, int(cell), part, here, vec, own.tobytes() if here else b"", ask.tobytes())):
                                    column.append(value)
            yield pa.RecordBatch.from_pydict(out, _ROWS)
    return run


_FOUND = pa.schema([("space", pa.string()), ("id", pa.int64()), ("neighbor", pa.int64()), ("cosine", pa.float64())])


def _answered(k: int, ef: int, least: float, ef_build: int, links: dict[str, int]):
    def run(shard: pa.Table) -> pa.Table:
        vecs, home = shard.column("vec").to_pylist(), shard.column("home").to_pylist()
        ids, asks = shard.column("ids").to_pylist(), shard.column("asks").to_pylist()
        node: dict[bytes, int] = {}
        members: list = []
        for v, h, i in zip(vecs, home, ids):
            if h:
                at = node.setdefault(v, len(node))
                if at == len(members):
                    members.append([i])
                else:
                    members[at].append(i)
        out: tuple[list, list, list] = ([], [], [])
        if node:
            x = np.frombuffer(b"".join(node), np.float32).reshape(len(node), -1)
            graph = Graph(x, ef_build, **links)
            held = [np.unique(np.frombuffer(b"".join(m), np.int64)) for m in members]
            asked: dict[bytes, list[bytes]] = {}
            for v, a in zip(vecs, asks):
                if a:
                    asked.setdefault(v, []).append(a)
            for own in (True, False):
                q = [v for v in asked if (v in node) is own]
                if not q:
                    continue
                rows = np.array([node[v] for v in q]) if own else None
                near, sims = graph.search(np.frombuffer(b"".join(q), np.float32).reshape(len(q), -1), k + 1, ef, rows, descend=bool(links))
                near = np.where(sims >= least, near, -1)
                for n in np.flatnonzero((near >= 0).any(axis=1)):
                    # only as many of a node's smallest ids as can be among the k most similar
                    pool = [(float(s), held[m][: k + 1]) for m, s in zip(near[n], sims[n]) if m >= 0]
                    other = np.concatenate([p for _, p in pool])
                    cos = np.repeat([s for s, _ in pool], [len(p) for _, p in pool])
                    order = np.lexsort((other, -cos))
                    other, cos = other[order], cos[order]
                    for me in np.unique(np.frombuffer(b"".join(asked[q[n]]), np.int64)):
                        rest = np.flatnonzero(other[: k + 1] != me)[:k] if len(pool) else []
                        out[0].append(np.full(len(rest), me))
                        out[1].append(other[rest])
                        out[2].append(cos[rest])
        joined = [np.concatenate(c) if c else np.empty(0) for c in out]
        space = shard.column("space")[0].as_py() if len(vecs) else ""
        return pa.Table.from_arrays([pa.array([space] * len(joined[0]), pa.string()), pa.array(joined[0].astype(np.int64)), pa.array(joined[1].astype(np.int64)), pa.array(joined[2].astype(np.float64))], schema=_FOUND)
    return run


def nearest(vectors: DataFrame, spaces: DataFrame, k: int = 10, least: float = -2.0, ef: int = 20, ef_build: int = 16, margin: float = 0.09, dense: bool = False, asking: Column | None = None, key: str = "chunk_id", space: str = "space_id", vector: str = "vector") -> DataFrame:
    """(space, id, neighbor, cosine, rank): the k most similar vectors of the same space found for each asking row.

    Among equal cosines the smaller id is first; pairs below cosine `least` are not returned.  A vector takes part if
    it has its space's dimensions, only finite numbers and a length above zero; null keys, spaces and vectors take no
    part; a repeated row counts once; equal vectors are neighbours of cosine 1; other columns are ignored; empty input
    gives an empty result.  `asking` (all rows by default) names the rows that ask; all rows are indexed.  Ids must be
    bigint.  `dense` builds graphs with more links, for neighbours that are hardly nearer than the rest.  `spaces` (space, dimensions) is a table of a few rows by design and is read to the driver, as are the
    counts of its spaces and at most about FIT_ROWS sampled vectors of each.
    """
    asks = F.coalesce(asking.cast("boolean"), F.lit(False)) if asking is not None else F.lit(True)
    rows = vectors.select(F.col(space).alias("space"), F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("vector"), asks.alias("asks"))
    rows = rows.filter("space IS NOT NULL AND id IS NOT NULL AND vector IS NOT NULL")
    widths = {r[0]: int(r[1]) for r in spaces.select(F.col(space), "dimensions").filter(f"{space} IS NOT NULL AND dimensions > 0").orderBy(space).collect()}
    counts = {r[0]: r[1] for r in rows.groupBy("space").agg(F.count("*")).collect() if r[0] in widths}
    cells: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    spread = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    for name, width in widths.items():
        n = counts.get(name, 0)
        sample = np.zeros((0, width), np.float32)
        if n > shard_rows(width):
            got = rows.filter((F.col("space") == name) & (spread < FIT_ROWS / n)).select("vector").toArrow().column("vector").combine_chunks()
            sample = _units(got, width, np.arange(len(got)))[1]
        cells[name] = fit_cells(sample, n)
    routed = rows.mapInArrow(_routed(widths, cells, margin), "space string, cell int, part int, home boolean, vec binary, ids binary, asks binary")
    found = routed.groupBy("space", "cell", "part").applyInArrow(_answered(k, ef, least, ef_build, DENSE if dense else {}), "space string, id bigint, neighbor bigint, cosine double")
    one = found.groupBy("space", "id", "neighbor").agg(F.max("cosine").alias("cosine"))
    return one.withColumn("rank", F.expr("row_number() OVER (PARTITION BY space, id ORDER BY cosine DESC, neighbor)")).filter(F.col("rank") <= k)
