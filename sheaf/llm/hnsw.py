"""A hierarchical navigable small-world graph in flat neighbour arrays, built and searched in batches with numpy.

Each layer holds one int32 array of rows `FORWARD + REVERSE` wide, -1 for no neighbour.  The forward part is chosen at
insertion by the usual heuristic (a candidate is kept if it is closer to the new node than to any kept one, the
rest filled with the closest); the reverse part holds the closest nodes that chose this one.  Nodes are inserted in
batches: a batch searches the graph of all earlier nodes, and sees its own members through one matrix product.  A
search walks a batch of queries in step: every query expands its best few unexpanded candidates at once.

A tight family of vectors far from everything else is hard to reach by walking, so that its members, inserted at
different times, may not find one another.  The lowest layer is therefore mended: the nodes are divided by their
nearest of some random pivots, each block is joined exactly, and pairs closer than a node's links become links.
"""

from __future__ import annotations

import numpy as np

FORWARD, REVERSE = 8, 12
#: One node in LEVEL_UP rises to the next layer.
LEVEL_UP = 16
EXPAND = 3
QUERY_BATCH = 512
#: Nodes per block of the joins that mend the lowest layer, and how many such partitions are joined.
BLOCK, MENDS, KNOWN = 512, 4, 5


def _beam(x: np.ndarray, nbr: np.ndarray, visited: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sims) of the best `ef` nodes found for each query, best first; -1 and -inf where there are fewer."""
    b, e = entry.shape
    ids = np.full((b, ef), -1, np.int32)
    sims = np.full((b, ef), -np.inf, np.float32)
    done = np.ones((b, ef), bool)
    rows = np.arange(b)
    n_all = visited.shape[1]
    seen = visited.reshape(-1)
    touched: list[np.ndarray] = []
    for k in range(e):
        at = entry[:, k]
        ok = np.flatnonzero(at >= 0)
        ok = ok[~visited[ok, at[ok]]]
        visited[ok, at[ok]] = True
        touched.append(ok * n_all + at[ok])
        ids[ok, k] = at[ok]
        sims[ok, k] = np.einsum("ij,ij->i", x[at[ok]], q[ok])
        done[ok, k] = False
    order = np.argsort(-sims, axis=1)
    ids, sims, done = (np.take_along_axis(a, order, 1) for a in (ids, sims, done))
    active = rows
    width = nbr.shape[1]
    while len(active):
        i_, s_, d_ = ids[active], sims[active], done[active]
        pick = np.argsort(d_, axis=1, kind="stable")[:, :EXPAND]
        fresh_r, fresh_id = [], []
        own = np.arange(len(active))
        for k in range(min(EXPAND, ef)):
            col = pick[:, k]
            open_ = np.flatnonzero(~d_[own, col])
            if not len(open_):
                break
            c = col[open_]
            d_[open_, c] = True
            near = nbr[i_[open_, c]]
            spot = (near + (active[open_] * n_all)[:, None]).ravel()
            near = near.ravel()
            ok = np.flatnonzero(near >= 0)
            ok = ok[~seen[spot[ok]]]
            spot, near, r = spot[ok], near[ok], open_[ok // width]
            seen[spot] = True
            touched.append(spot)
            fresh_r.append(r)
            fresh_id.append(near)
        done[active] = d_
        if fresh_r:
            r, n = np.concatenate(fresh_r), np.concatenate(fresh_id)
            s = np.einsum("ij,ij->i", x[n], q[active[r]])
            good = s > s_[r, -1]
            r, n, s = r[good], n[good], s[good]
            if len(r):
                order = np.argsort(r, kind="stable")
                r, n, s = r[order], n[order], s[order]
                head = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
                many = np.diff(np.concatenate((head, [len(r)])))
                rank = np.arange(len(r)) - np.repeat(head, many)
                row = np.repeat(np.arange(len(head)), many)
                hit = r[head]
                shape = (len(head), ef + int(many.max()))
                all_s, all_i, all_d = np.full(shape, -np.inf, np.float32), np.full(shape, -1, np.int32), np.zeros(shape, bool)
                all_s[:, :ef], all_i[:, :ef], all_d[:, :ef] = s_[hit], i_[hit], d_[hit]
                all_s[row, ef + rank] = s
                all_i[row, ef + rank] = n
                top = np.argsort(-all_s, axis=1)[:, :ef]
                line = np.arange(len(head))[:, None]
                at = active[hit]
                sims[at], ids[at] = all_s[line, top], all_i[line, top]
                done[at] = all_d[line, top] | (ids[at] < 0)
        active = active[~done[active].all(axis=1)]
    for spot in touched:
        seen[spot] = False
    return ids, sims


def _diverse(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Forward neighbours out of candidates sorted best first."""
    b, c = ids.shape
    v = x[np.maximum(ids, 0)]
    mutual = v @ v.transpose(0, 2, 1)
    chosen = np.zeros((b, c), bool)
    count = np.zeros(b, np.int64)
    for j in range(c):
        worst = np.where(chosen, mutual[:, j, :], -np.inf).max(axis=1)
        ok = (ids[:, j] >= 0) & (worst < sims[:, j]) & (count < keep)
        chosen[:, j] = ok
        count += ok
    order = np.argsort(~chosen, axis=1, kind="stable")[:, :keep]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


class Layer:
    """One layer over the first `size` nodes of x."""

    def __init__(self, x: np.ndarray, size: int, forward: int, reverse: int):
        self.x, self.size, self.forward, self.reverse = x, size, forward, reverse
        self.nbr = np.full((size, self.forward + self.reverse), -1, np.int32)
        self.back = np.full((size, self.reverse), -np.inf, np.float32)
        self.front = np.full((size, self.forward), -np.inf, np.float32)

    def link(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Give new nodes their forward neighbours and offer them to those as reverse neighbours."""
        ids, sims = _diverse(self.x, ids, sims, self.forward)
        self.nbr[nodes, : ids.shape[1]] = ids
        self.front[nodes, : ids.shape[1]] = np.where(ids >= 0, sims, -np.inf)
        ok = ids >= 0
        self.offer(ids[ok], np.broadcast_to(nodes[:, None], ids.shape)[ok], sims[ok])

    def offer(self, to: np.ndarray, new: np.ndarray, s: np.ndarray) -> None:
        """Let the nodes `to` take the nodes `new` among their closest reverse neighbours."""
        fresh = (self.nbr[to] != new[:, None]).all(axis=1)
        to, new, s = to[fresh], new[fresh], s[fresh]
        if not len(to):
            return
        order = np.lexsort((-s, to))
        to, new, s = to[order], new[order], s[order]
        head = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        rank = np.arange(len(to)) - np.repeat(head, np.diff(np.concatenate((head, [len(to)]))))
        fits = rank < self.reverse
        group = np.cumsum(np.concatenate(([0], (to[1:] != to[:-1]).astype(int))))
        target = to[head]
        offer_i = np.full((len(target), self.reverse), -1, np.int32)
        offer_s = np.full((len(target), self.reverse), -np.inf, np.float32)
        offer_i[group[fits], rank[fits]] = new[fits]
        offer_s[group[fits], rank[fits]] = s[fits]
        all_i = np.concatenate((self.nbr[target, self.forward:], offer_i), axis=1)
        all_s = np.concatenate((self.back[target], offer_s), axis=1)
        top = np.argpartition(-all_s, self.reverse - 1, axis=1)[:, :self.reverse]
        self.nbr[target, self.forward:] = np.take_along_axis(all_i, top, 1)
        self.back[target] = np.take_along_axis(all_s, top, 1)


    def mend(self, rng: np.random.Generator) -> None:
        """Join exactly inside the blocks of one random partition."""
        pivots = self.x[rng.choice(self.size, max(1, self.size // BLOCK), replace=False)]
        cell = np.concatenate([(self.x[a : a + 8192] @ pivots.T).argmax(axis=1) for a in range(0, self.size, 8192)])
        order = np.argsort(cell, kind="stable")
        head = np.searchsorted(cell[order], np.arange(len(pivots) + 1))
        known = -np.sort(-np.concatenate((self.front, self.back), axis=1), axis=1)[:, KNOWN - 1]
        for a, b in zip(head[:-1], head[1:]):
            for lo in range(a, b, 2 * BLOCK):
                rows = order[lo : min(b, lo + 2 * BLOCK)]
                sims = self.x[rows] @ self.x[rows].T
                np.fill_diagonal(sims, -np.inf)
                i, j = np.nonzero(sims > known[rows][:, None])
                self.offer(rows[i], rows[j].astype(np.int32), sims[i, j])


class Graph:
    """The graph over the rows of a float32 matrix of unit vectors; row numbers are those given."""

    def __init__(self, vectors: np.ndarray, ef: int = 24, seed: int = 7, forward: int = FORWARD, reverse: int = REVERSE, mends: int = MENDS):
        self.forward, self.reverse = forward, reverse
        n = len(vectors)
        level = (-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(LEVEL_UP)).astype(int)
        self.order = np.argsort(-level, kind="stable")
        self.x = np.ascontiguousarray(vectors[self.order], np.float32)
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        sizes = [int((level >= k).sum()) for k in range(int(level.max(initial=0)) + 1)]
        sizes = sizes[:1] + [s for s in sizes[1:] if s >= LEVEL_UP]
        self.visited = np.zeros((QUERY_BATCH, n), bool)
        self.layers: list[Layer] = []
        for size in reversed(sizes):
            self._grow(size, ef)
        for _ in range(mends if n > 512 else 0):
            self.layers[-1].mend(np.random.default_rng((seed, _)))

    def _grow(self, size: int, ef: int) -> None:
        layer = Layer(self.x, size, self.forward, self.reverse)
        first = min(size, 512)
        sims = self.x[:first] @ self.x[:first].T
        np.fill_diagonal(sims, -np.inf)
        c = min(ef, max(1, first - 1))
        ids = np.argsort(-sims, axis=1)[:, :c].astype(np.int32)
        if first > 1:
            layer.link(np.arange(first), ids, np.take_along_axis(sims, ids.astype(np.int64), 1))
        at = first
        while at < size:
            to = min(size, at + min(at, 4 * QUERY_BATCH))
            got_i, got_s = [], []
            for a in range(at, to, QUERY_BATCH):
                q = self.x[a : min(to, a + QUERY_BATCH)]
                i, s = _beam(self.x, layer.nbr, self.visited, q, self._descend(q, at), ef)
                got_i.append(i)
                got_s.append(s)
            among = self.x[at:to] @ self.x[at:to].T
            np.fill_diagonal(among, -np.inf)
            m = min(8, to - at)
            near = np.argpartition(-among, m - 1, axis=1)[:, :m]
            ids = np.concatenate((np.concatenate(got_i), (near + at).astype(np.int32)), axis=1)
            sims = np.concatenate((np.concatenate(got_s), np.take_along_axis(among, near, 1)), axis=1)
            ids[~np.isfinite(sims)] = -1
            top = np.argsort(-sims, axis=1)[:, :ef]
            layer.link(np.arange(at, to), np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1))
            at = to
        self.layers.append(layer)

    def _descend(self, q: np.ndarray, inserted: int | None = None) -> np.ndarray:
        """Entry nodes of the lowest layer for each query: the nearest four of the layer above it."""
        above = self.layers if inserted is not None else self.layers[:-1]
        entry = np.zeros((len(q), 1), np.int32)
        for layer in above:
            if layer is above[0] and layer.size <= 1024:  # the top is small enough to look at as a whole
                near = q @ self.x[: layer.size].T
                m = min(4, layer.size)
                entry = np.argpartition(-near, m - 1, axis=1)[:, :m].astype(np.int32)
            else:
                entry, _ = _beam(self.x, layer.nbr, self.visited, q, entry, 4)
        return entry

    def search(self, q: np.ndarray, k: int, ef: int, own: np.ndarray | None = None, descend: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(rows, sims) of the k nearest found.  `own` gives each query's own row, where the walk begins too, or, without
        `descend`, only: enough for neighbours that are close."""
        ids, sims = [], []
        for a in range(0, len(q), QUERY_BATCH):
            part = np.ascontiguousarray(q[a : a + QUERY_BATCH], np.float32)
            entry = self._descend(part) if own is None or descend else np.empty((len(part), 0), np.int32)
            if own is not None:
                entry = np.concatenate((self.place[own[a : a + QUERY_BATCH], None].astype(np.int32), entry), axis=1)
            i, s = _beam(self.x, self.layers[-1].nbr, self.visited, part, entry, max(ef, k))
            twice = np.zeros(i.shape, bool)  # a node may be met as forward and as reverse neighbour at once
            twice[:, 1:] = (i[:, 1:] == i[:, :-1]) & (i[:, 1:] >= 0)
            if twice.any():
                order = np.argsort(twice, axis=1, kind="stable")
                i, s = np.take_along_axis(np.where(twice, -1, i), order, 1), np.take_along_axis(np.where(twice, -np.inf, s), order, 1)
            ids.append(np.where(i[:, :k] >= 0, self.order[np.maximum(i[:, :k], 0)], -1))
            sims.append(s[:, :k])
        if not ids:
            return np.empty((0, k), np.int64), np.empty((0, k), np.float32)
        return np.concatenate(ids), np.concatenate(sims)
