"""Hierarchical navigable small-world graph in numpy; many queries walk it in lockstep."""

from __future__ import annotations

import io

import numpy as np


#: Place in a beam that holds nothing; behind all others, and not open.
_NONE = np.iinfo(np.int64).max - 1


def _packed(sims: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Similarity, id and an open mark in one integer; those of nearer vectors are smaller."""
    bits = sims.view(np.int32).astype(np.int64)
    return ~np.where(bits < 0, bits ^ 0x7FFFFFFF, bits) << 32 | ids.astype(np.int64) << 1 | 1


def _unpacked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    none, bits = keys == _NONE, ~(keys >> 32)
    sims = np.where(bits < 0, bits ^ 0x7FFFFFFF, bits).astype(np.int32).view(np.float32)
    return np.where(none, -1, (keys & 0xFFFFFFFF) >> 1).astype(np.int32), np.where(none, np.float32(-np.inf), sims)


class Hnsw:
    """Graph over unit vectors (float32) with inner product as similarity.

    ``links[l]`` holds the neighbours of every vector on level l, -1 where there are fewer. Vectors
    enter in batches, those of high level first; the members of a batch see each other by a plain
    product, all others through a beam search.
    """

    def __init__(self, vectors: np.ndarray, degree: int = 12, beam: int = 48, seed: int = 7, batch: int = 256):
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        n = len(vectors)
        if not n:
            self.links, self.entry = [np.empty((0, 2 * degree), np.int32)], 0
            return
        draw = np.random.default_rng(seed).random(n)
        levels = np.minimum((-np.log(1 - draw) / np.log(degree)).astype(int), 4)
        order = np.argsort(-levels, kind="stable")
        self.entry = int(order[0])
        self.links = [np.full((n, degree * (1 + (level == 0))), -1, np.int32) for level in range(levels.max() + 1)]
        done = 1
        while done < n:
            new = order[done : done + min(batch, done)]
            self._insert(new, levels, beam)
            done += len(new)

    def _insert(self, new: np.ndarray, levels: np.ndarray, beam: int) -> None:
        queries = self.vectors[new]
        start = np.full((len(new), 1), self.entry, np.int32)
        among = queries @ queries.T
        np.fill_diagonal(among, -np.inf)
        for level in range(len(self.links) - 1, -1, -1):
            inside = levels[new] >= level
            width = beam if inside.any() else 1
            found, sims = self._walk(queries, start, level, width)
            start = found[:, : max(1, width // 4)]
            if not inside.any():
                continue
            at = np.flatnonzero(inside)
            top = min(len(at), beam)
            peers = np.argpartition(-among[np.ix_(at, at)], top - 1, axis=1)[:, :top] if len(at) > 1 else np.zeros((1, 1), int)
            ids = np.concatenate([found[at], new[at][peers]], 1)
            own = np.concatenate([sims[at], among[np.ix_(at, at)][np.arange(len(at))[:, None], peers]], 1)
            own[ids < 0] = -np.inf
            chosen = self._spread(ids, own, self.links[level].shape[1])
            self.links[level][new[at]] = chosen
            self._back(new[at], chosen, level)

    def _spread(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, nearest first, those nearer to the row's vector than to any chosen yet.

        Places left over go to the nearest of the others.
        """
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        rows, width = ids.shape
        vectors = self.vectors.take(np.maximum(ids, 0), 0)
        between = np.empty((rows, width, width), np.float32)
        # Products so small are not worth several threads, which would wait for each other in every one of them.
        step = max(1, 200_000 // max(1, width * vectors.shape[2]))
        for k in range(0, width, step):
            np.matmul(vectors, vectors[:, k : k + step].transpose(0, 2, 1), out=between[:, :, k : k + step])
        nearest = np.full((rows, width), -np.inf, np.float32)
        chosen, count = np.zeros((rows, width), bool), np.zeros(rows, int)
        for k in range(width):
            if (count >= most).all():
                break
            take = (sims[:, k] > nearest[:, k]) & np.isfinite(sims[:, k]) & (count < most)
            chosen[take, k] = True
            count += take
            nearest[take] = np.maximum(nearest[take], between[take, k])
        rank = np.where(chosen, 0, 1) + np.where(np.isfinite(sims), 0, 2)
        best = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(np.where(np.isfinite(sims), ids, -1), best, 1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1).astype(np.int32)

    def _back(self, new: np.ndarray, chosen: np.ndarray, level: int) -> None:
        source = np.repeat(new, chosen.shape[1])[chosen.ravel() >= 0]
        target = chosen.ravel()[chosen.ravel() >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        most = self.links[level].shape[1]
        added = np.full((len(nodes), counts.max(initial=1)), -1, np.int32)
        added[np.repeat(np.arange(len(nodes)), counts), np.arange(len(target)) - np.repeat(first, counts)] = source
        for at in range(0, len(nodes), 512):
            part = nodes[at : at + 512]
            both = np.concatenate([self.links[level][part], added[at : at + 512]], 1)
            both = both[:, (both >= 0).any(0)]
            both = np.sort(both, 1)[:, ::-1]
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            sims = np.einsum("rd,rkd->rk", self.vectors[part], self.vectors[np.maximum(both, 0)])
            sims[both < 0] = -np.inf
            self.links[level][part] = self._spread(both, sims, most)

    def _walk(self, queries: np.ndarray, start: np.ndarray, level: int, beam: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest found for each query, nearest first, walking from ``start``."""
        rows, n = len(queries), len(self.vectors)
        seen = np.zeros((rows, n + 1), bool)
        seen[:, n] = True
        seen = seen.reshape(-1)
        best = np.full((rows, beam), _NONE, np.int64)
        fresh = np.where(start < 0, n, start).astype(np.int32)
        padded = np.vstack([self.links[level], np.full((1, self.links[level].shape[1]), -1, np.int32)])
        padded[padded < 0] = n
        active = np.arange(rows)
        while len(active):
            fresh = np.sort(fresh, 1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = n
            places = (active[:, None] * (n + 1) + fresh).reshape(-1)
            new = np.flatnonzero(~seen.take(places))
            ids = fresh.reshape(-1).take(new)
            seen[places.take(new)] = True
            keys = np.full(fresh.shape, _NONE, np.int64)
            keys.reshape(-1)[new] = _packed(np.einsum("kd,kd->k", queries.take(active.take(new // fresh.shape[1]), 0), self.vectors.take(ids, 0)), ids)
            keys = np.sort(np.concatenate([best[active], keys], 1), 1)[:, :beam]
            open_ = (keys & 1).astype(bool)
            nth = np.cumsum(open_, 1, dtype=np.int32)
            expand = open_ & (nth <= wide)
            best[active] = keys - expand
            busy = expand.any(1)
            expand, active = expand[busy], active[busy]
            picked = np.full((len(active), wide), n, np.int32)
            r, c = np.nonzero(expand)
            picked[r, nth[busy][r, c] - 1] = (keys[busy][r, c] & 0xFFFFFFFF) >> 1
            fresh = padded.take(picked, 0).reshape(len(active), wide * padded.shape[1])
        return _unpacked(best)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Indexes (-1: none) and similarities of the nearest found for each query, nearest first."""
        queries = np.asarray(queries, np.float32)
        start = np.full((len(queries), 1), self.entry, np.int32)
        for level in range(len(self.links) - 1, 0, -1):
            start = self._walk(queries, start, level, 4)[0]
        return self._walk(queries, start, 0, beam, wide=max(4, beam // 16))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, entry=self.entry, **{f"l{k}": v for k, v in enumerate(self.links)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes, vectors: np.ndarray) -> Hnsw:
        self = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as got:
            self.entry = int(got["entry"])
            self.links = [got[f"l{k}"] for k in range(len(got.files) - 1)]
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        return self


def linked_pairs(index: Hnsw, unit: np.ndarray, queries: np.ndarray, least: float, same: bool = False, beam: int = 64, audit: int = 64, recall: float = 0.999, near_recall: float = 0.9, nearest: int = 10) -> tuple[np.ndarray, np.ndarray, float]:
    """Pairs (query, indexed) with cosine of at least ``least``, verified in double precision, and the audited recall.

    A query whose whole beam lies above the threshold gets one of four times the width, and where that
    is most of the index, a plain product. Audits compare ``audit`` queries with brute force: half of
    them those with the nearest neighbours found, where links are likeliest, half a spread over all.
    Their links count, and so that every search has something to be held against, their ``nearest``
    neighbours; a vector is no neighbour of itself (``same``: the queries are the indexed vectors).
    While fewer than ``recall`` of these links or ``near_recall`` of these neighbours are found, all
    beams double; a beam as wide as the index is the brute force itself.
    """
    n = len(unit)
    empty = np.empty(0, np.int64)
    if not n or not len(queries):
        return empty, empty, 1.0
    near = least - 1e-4
    while True:
        found, top = [], np.full(len(queries), -np.inf)
        todo, width = np.arange(len(queries)), beam
        while len(todo):
            again = []
            step = max(1, min(256, 2_000_000 // max(n, width * 8)))
            for at in range(0, len(todo), step):
                part = todo[at : at + step]
                if width >= n or width > beam and 4 * width >= n:
                    q, c = np.nonzero(queries[part] @ unit.T >= least)
                    found.append((part[q], c))
                    continue
                ids, sims = index.search(queries[part], width)
                if width == beam:
                    other = sims if not same else np.where(ids == part[:, None], -np.inf, sims)
                    top[part] = other.max(1)
                full = sims[:, -1] >= near
                again.append(part[full])
                q, k = np.nonzero((sims >= near) & ~full[:, None])
                c = ids[q, k]
                good = np.einsum("kd,kd->k", queries[part[q]], unit[c]) >= least
                found.append((part[q][good], c[good]))
            todo = np.concatenate(again) if again else empty
            width *= 4
        q, c = (np.concatenate([f[k] for f in found]).astype(np.int64) for k in (0, 1))
        if same:
            q, c = q[q != c], c[q != c]
        if beam >= n:
            return q, c, 1.0
        spread = np.linspace(0, len(queries) - 1, min(audit // 2, len(queries))).astype(int)
        checked = np.unique(np.concatenate([np.argsort(-top, kind="stable")[: audit // 2], spread]))
        exact = queries[checked] @ unit.T
        if same:
            exact[np.arange(len(checked)), checked] = -np.inf
        truth = {(int(checked[a]), int(b)) for a, b in np.argwhere(exact >= least)}
        asked = np.isin(q, checked)
        hit = len(truth & set(zip(q[asked].tolist(), c[asked].tolist())))
        k = min(nearest, n - 1)
        best = np.argpartition(-exact, k - 1, axis=1)[:, :k] if k > 0 else np.empty((len(checked), 0), int)
        seen = index.search(queries[checked], beam)[0]
        close = sum(len(set(a) & set(b)) for a, b in zip(best.tolist(), seen.tolist()))
        if hit >= recall * len(truth) and close >= near_recall * best.size:
            return q, c, hit / len(truth) if truth else close / max(1, best.size)
        beam *= 2
