"""A robust-pruned flat graph over some thousand unit vectors: building, greedy and range-expanding search.

All steps run over many points at a time: points are inserted in batches that double, and a search keeps one beam a
query in a matrix.  Neighbour lists are rows of a matrix, filled up with -1.
"""

from __future__ import annotations

import numpy as np

#: Neighbours a point keeps, beam while building, and the squared factor by which a nearer neighbour must win.
DEGREE, BEAM, PRUNE = 16, 32, 1.44
BATCH = 256
#: Pairs of a query and a point that an expansion looks at together.
PAIRS = 1 << 16


def clusters(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of at most ``k`` clusters by spherical k-means; starts from points far apart."""
    at, near = [0], x @ x[0]
    while len(at) < min(k, len(x)):
        at.append(int(near.argmin()))
        near = np.maximum(near, x @ x[at[-1]])
    centres = x[at]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1)
        centres = np.where(size[:, None] > 1e-9, total / np.maximum(size, 1e-9)[:, None], centres)
    return centres


def medoids(x: np.ndarray, k: int = 16) -> np.ndarray:
    """The points nearest to all points' centre and to those of ``k`` clusters of a fixed stride of them."""
    centre = x.mean(0, keepdims=True)
    return np.unique(np.concatenate([(x @ c.T).argmax(0) for c in (centre, clusters(x[:: max(1, len(x) // 512)], k))]))


def cosines(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Of every query with its own rows."""
    return (rows @ queries[:, :, None])[:, :, 0]


def beam(x: np.ndarray, links: np.ndarray, starts: np.ndarray, asked: np.ndarray, width: int, least: float = np.inf) -> tuple[np.ndarray, list, np.ndarray]:
    """Greedy search of every vector in ``asked``: the beams' points, all (queries, points) of cosine ``least`` on the way, and who has seen what."""
    n = len(asked)
    row = np.arange(n)[:, None]
    seen = np.zeros((n, len(x) + 1), bool)
    seen[:, -1] = True
    seen[:, starts] = True
    point = np.broadcast_to(starts, (n, len(starts))).copy()
    near = asked @ x[starts].T
    query, hit = np.nonzero(near >= least)
    hits = [(query, starts[hit])]
    if len(starts) < width:
        point, near = (np.pad(a, ((0, 0), (0, width - len(starts))), constant_values=v) for a, v in ((point, -1), (near, -np.inf)))
    done = point < 0
    while True:
        score = np.where(done, -np.inf, near)
        best = score.argmax(1)
        go = np.flatnonzero(score[np.arange(n), best] > -np.inf)
        if not len(go):
            return point, hits, seen
        done[go, best[go]] = True
        found = links[point[go, best[go]]]
        fresh = ~seen[go[:, None], found]
        seen[go[:, None], found] = True
        cos = np.where(fresh, cosines(x[found], asked[go]), -np.inf).astype(near.dtype)
        query, hit = np.nonzero(cos >= least)
        if len(query):
            hits.append((go[query], found[query, hit]))
        near_all, point_all, done_all = np.hstack((near[go], cos)), np.hstack((point[go], found)), np.hstack((done[go], ~fresh))
        top = np.argpartition(-near_all, width - 1, axis=1)[:, :width]
        near_go, point_go, done_go = (np.take_along_axis(a, top, 1) for a in (near_all, point_all, done_all))
        if near.shape[1] != width:
            keep = np.argpartition(-near, width - 1, axis=1)[:, :width]
            near, point, done = near[row, keep], point[row, keep], done[row, keep]
        near[go], point[go], done[go] = near_go, point_go, done_go


def pruned(x: np.ndarray, own: np.ndarray, found: np.ndarray, degree: int) -> np.ndarray:
    """At most ``degree`` of the points ``found`` (-1: none) for each of ``own``; a kept one drops those it is clearly nearer to."""
    cos = np.where(found >= 0, cosines(x[found], x[own]), -np.inf)
    cos[found == own[:, None]] = -np.inf
    order = np.argsort(-cos, axis=1, kind="stable")
    found, cos = np.take_along_axis(found, order, 1), np.take_along_axis(cos, order, 1)
    alive = np.isfinite(cos)
    alive[:, 1:] &= found[:, 1:] != found[:, :-1]
    far, at = 1 - cos, np.arange(len(own))
    near = x[found]
    between = 1 - near @ near.transpose(0, 2, 1)
    out = np.full((len(own), degree), -1, found.dtype)
    for k in range(degree):
        first = alive.argmax(1)
        ok = alive[at, first]
        if not ok.any():
            break
        out[ok, k] = found[ok, first[ok]]
        alive &= ~((PRUNE * between[at, first] <= far) & ok[:, None])
        alive[at, first] = False
    return out


def build(x: np.ndarray, degree: int = DEGREE, width: int = BEAM, seed: int = 0) -> np.ndarray:
    """Neighbour lists of all points of ``x``, inserted in an order by ``seed``."""
    n = len(x)
    links = np.full((n + 1, degree), -1, np.int64)
    starts = medoids(x)
    order = np.concatenate((starts, np.random.default_rng(seed).permutation(np.setdiff1d(np.arange(n), starts))))
    links[starts] = pruned(x, starts, np.broadcast_to(starts, (len(starts), len(starts))), degree)
    at = len(starts)
    while at < n:
        batch = order[at : at + min(BATCH, at)]
        at += len(batch)
        point, _, _ = beam(x, links, starts, x[batch], width)
        # Points of one batch do not meet in the graph: the nearest of them are candidates too.
        mutual = x[batch] @ x[batch].T
        np.fill_diagonal(mutual, -np.inf)
        beside = np.argpartition(-mutual, min(degree, len(batch)) - 1, axis=1)[:, :degree]
        links[batch] = pruned(x, batch, np.hstack((point, batch[beside])), degree)
        # The way back, for each target the nearest of the new ones.
        source, target = np.repeat(batch, degree), links[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.lexsort((-np.einsum("id,id->i", x[source], x[target]), target))
        source, target = source[by], target[by]
        first = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
        place = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
        some = place < 2 * degree
        own, number = np.unique(target[some], return_inverse=True)
        back = np.full((len(own), 3 * degree), -1, np.int64)
        back[:, :degree] = links[own]
        back[number, degree + place[some]] = source[some]
        back[:, degree:][(back[:, degree:, None] == back[:, None, :degree]).any(2)] = -1
        back = np.take_along_axis(back, np.argsort(back < 0, axis=1, kind="stable"), 1)
        # Lists with room take the new ones as they are.
        full = back[:, degree] >= 0
        links[own[~full]] = back[~full, :degree]
        own, back = own[full], back[full]
        for lo in range(0, len(own), BATCH):
            links[own[lo : lo + BATCH]] = pruned(x, own[lo : lo + BATCH], back[lo : lo + BATCH], degree)
    return links[:n]


class Both:
    """Who keeps whom or is kept by whom, as one list a point."""

    def __init__(self, links: np.ndarray, n: int):
        own, place = np.nonzero(links[:n] >= 0)
        near = links[own, place]
        pair = np.unique(np.concatenate((own * n + near, near * n + own)))
        own, self.near = np.divmod(pair, n)
        self.starts = np.searchsorted(own, np.arange(n + 1))

    def of(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``points``, neighbour) of all neighbours."""
        n = self.starts[points + 1] - self.starts[points]
        place = np.repeat(np.arange(len(points)), n)
        return place, self.near[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[points], n)]


def in_range(x: np.ndarray, links: np.ndarray, both: Both, starts: np.ndarray, asked: np.ndarray, own: np.ndarray, width: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) of cosine ``least`` and more: a greedy search, then the lists of all points in range, both ways, as long as they bring new ones.

    ``own`` is the point that a query itself is, or -1; it counts as found even where no list leads to it.
    """
    _, todo, seen = beam(x, links, starts, asked, width, least)
    lost = np.flatnonzero((own >= 0) & ~seen[np.arange(len(own)), own])
    seen[lost, own[lost]] = True
    todo.append((lost, own[lost]))
    out, flat = list(todo), seen.ravel()
    while todo:
        query, hit = todo.pop()
        for lo in range(0, len(query), PAIRS // 64):
            place, found = both.of(hit[lo : lo + PAIRS // 64])
            pair = query[lo : lo + PAIRS // 64][place] * seen.shape[1] + found
            pair = np.unique(pair[~flat[pair]])
            flat[pair] = True
            q, p = np.divmod(pair, seen.shape[1])
            ok = np.einsum("id,id->i", x[p], asked[q]) >= least
            if ok.any():
                todo.append((q[ok], p[ok]))
                out.append(todo[-1])
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])
