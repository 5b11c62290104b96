"""Hierarchical navigable small-world graphs in numpy, built and searched in batches."""

from __future__ import annotations

import numpy as np

SEED = 17


class Graph:
    """A graph over unit vectors. Nodes get geometric levels; each level links a node to near but diverse ones.
    Searches walk many queries at once: every round expands the best open candidates of all beams."""

    def __init__(self, vectors: np.ndarray, links: int = 12, beam: int = 48, batch: int = 1024):
        self.x, self.links, self.batch = np.ascontiguousarray(vectors, dtype=np.float32), links, batch
        n = len(vectors)
        rng = np.random.default_rng(SEED)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(links)).astype(int), 8)
        if n:
            level[rng.integers(n)] = level.max()
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # members, neighbours by member (-1: none)
        for k in range(int(level.max(initial=0)), -1, -1) if n else ():
            members = np.flatnonzero(level >= k)
            self.layers.append(self._layer(members, 2 * links if k == 0 else links, beam))

    @classmethod
    def of(cls, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> Graph:
        """A graph whose layers are known."""
        out = cls.__new__(cls)
        out.x, out.layers = np.ascontiguousarray(vectors, dtype=np.float32), layers
        return out

    def _layer(self, members: np.ndarray, width: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """One level, its members inserted in growing batches. Links are kept by place among the members."""
        n = len(members)
        near = np.full((n, width), -1, dtype=np.int32)
        sims = np.full((n, width), -2.0, dtype=np.float32)
        x = self.x[members]
        order = np.random.default_rng(SEED + len(self.layers)).permutation(n)
        done = min(n, 256)
        self._connect(x, near, sims, order[:done], np.tile(order[:done], (done, 1)), width)
        while done < n:
            take = order[done : done + min(done, self.batch)]
            old = order[:done]
            starts = self._entries(x[take], members, near, old)
            found, _ = self._walk(x, near, x[take], starts, beam)
            self._connect(x, near, sims, take, np.concatenate([found, np.tile(take, (len(take), 1))], axis=1) if len(take) <= 256 else self._with_batch(x, take, found), width)
            done += len(take)
        return members, near

    @staticmethod
    def _with_batch(x: np.ndarray, take: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Add to each row's candidates the nearest of its own batch."""
        inner = x[take] @ x[take].T
        np.fill_diagonal(inner, -2)
        k = min(16, len(take) - 1)
        return np.concatenate([found, take[np.argpartition(-inner, k, axis=1)[:, :k]]], axis=1)

    def _entries(self, queries: np.ndarray, members: np.ndarray, near: np.ndarray, old: np.ndarray) -> np.ndarray:
        """Where to enter a level: the best nodes of the level above that are in this one already, else any."""
        if not self.layers:
            return np.tile(old[:4], (len(queries), 1))
        above, _ = self.layers[-1]
        place = np.searchsorted(members, above)
        known = np.zeros(len(members), dtype=bool)
        known[old] = True
        place = place[known[place]]
        if not len(place):
            return np.tile(old[:4], (len(queries), 1))
        some = place[:2048]
        sims = queries @ self.x[members[some]].T
        k = min(4, len(some))
        return some[np.argpartition(-sims, k - 1, axis=1)[:, :k]]

    def _connect(self, x: np.ndarray, near: np.ndarray, sims: np.ndarray, nodes: np.ndarray, cand: np.ndarray, width: int) -> None:
        """Give nodes diverse neighbours among their candidates, and the neighbours links back."""
        chosen, weight = self._diverse(x, x[nodes], nodes, cand, width // 2)
        near[nodes, : chosen.shape[1]], sims[nodes, : chosen.shape[1]] = chosen, weight
        flat = chosen >= 0
        target, source, value = chosen[flat], np.repeat(nodes, flat.sum(axis=1)), weight[flat]
        by = np.argsort(target, kind="stable")
        target, source, value = target[by], source[by], value[by]
        heads, first, count = np.unique(target, return_index=True, return_counts=True)
        used = (near[heads] >= 0).sum(axis=1)
        fits = used + count <= width
        rank = np.arange(len(target)) - np.repeat(first, count)
        slot = np.repeat(used, count) + rank
        easy = np.repeat(fits, count)
        near[target[easy], slot[easy]], sims[target[easy], slot[easy]] = source[easy], value[easy]
        if fits.all():
            return
        full = np.flatnonzero(~fits)
        most = int(count[full].max())
        extra = np.full((len(full), most), -1, dtype=np.int64)
        for row, k in enumerate(full):
            extra[row, : count[k]] = source[first[k] : first[k] + count[k]]
        every = np.concatenate([near[heads[full]], extra], axis=1)
        kept, weight = self._diverse(x, x[heads[full]], heads[full], every, width - 2)
        near[heads[full]], sims[heads[full]] = -1, -2.0
        near[heads[full], : kept.shape[1]], sims[heads[full], : kept.shape[1]] = kept, weight

    @staticmethod
    def _diverse(x: np.ndarray, base: np.ndarray, own: np.ndarray, cand: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each row's candidates the nearest, then each next that is nearer to the row than to any taken
        before; places left over go to the nearest of the rest."""
        out, weights = [], []
        for at in range(0, len(base), 128):
            c, b, o = cand[at : at + 128].astype(np.int64), base[at : at + 128], own[at : at + 128]
            s = np.einsum("qcd,qd->qc", x[np.maximum(c, 0)], b)
            s[(c < 0) | (c == o[:, None])] = -2
            by = np.argsort(-s, axis=1, kind="stable")[:, : 3 * most + 8]
            c, s = np.take_along_axis(c, by, 1), np.take_along_axis(s, by, 1)
            rows = np.arange(len(c))
            v = x[np.maximum(c, 0)]
            among = v @ v.transpose(0, 2, 1)
            closest = np.full(s.shape, -2.0, dtype=np.float32)
            taken = np.zeros(s.shape, dtype=bool)
            again = np.zeros(s.shape, dtype=bool)
            again[:, 1:] = c[:, 1:] == c[:, :-1]
            for k in range(s.shape[1]):
                ok = (s[:, k] > -1.5) & ~again[:, k] & (closest[:, k] < s[:, k]) & (taken.sum(axis=1) < most)
                taken[:, k] = ok
                closest = np.where(ok[:, None], np.maximum(closest, among[rows, k]), closest)
            rank = np.where(taken, 0, 1) * 1000 + np.arange(s.shape[1])
            rank[(s <= -1.5) | again] = 1_000_000
            pick = np.argsort(rank, axis=1, kind="stable")[:, :most]
            good = np.take_along_axis(rank, pick, 1) < 1_000_000
            out.append(np.where(good, np.take_along_axis(c, pick, 1), -1))
            weights.append(np.where(good, np.take_along_axis(s, pick, 1), -2.0))
        return np.concatenate(out).astype(np.int32), np.concatenate(weights).astype(np.float32)

    @staticmethod
    def _walk(x: np.ndarray, near: np.ndarray, queries: np.ndarray, starts: np.ndarray, beam: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The best `beam` nodes met from the starts for each query, and their similarities."""
        q, n = len(queries), len(x)
        rows = np.arange(q)
        seen = np.zeros((q, n + 1), dtype=bool)
        ids = np.full((q, beam), n, dtype=np.int64)
        sims = np.full((q, beam), -2.0, dtype=np.float32)
        open_ = np.zeros((q, beam), dtype=bool)

        def merge(live: np.ndarray, fresh: np.ndarray) -> None:
            fresh = np.sort(np.where(fresh < 0, n, fresh), axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = n
            fresh[seen[live[:, None], fresh]] = n
            seen[live[:, None], fresh] = True
            seen[live, n] = False
            s = np.einsum("qcd,qd->qc", x[np.minimum(fresh, n - 1)], queries[live])
            s[fresh == n] = -2
            all_ids = np.concatenate([ids[live], fresh], axis=1)
            all_sims = np.concatenate([sims[live], s], axis=1)
            all_open = np.concatenate([open_[live], fresh < n], axis=1)
            by = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[live], sims[live], open_[live] = (np.take_along_axis(a, by, 1) for a in (all_ids, all_sims, all_open))

        merge(rows, starts.astype(np.int64))
        live = rows
        while len(live):
            rank = np.where(open_[live], np.arange(beam), beam)
            first = np.sort(rank, axis=1)[:, : min(wide, beam)]
            live_on = first[:, 0] < beam
            live, first = live[live_on], first[live_on]
            if not len(live):
                break
            valid = first < beam
            at = np.where(valid, first, first[:, :1])
            open_[live[:, None], at] = False
            nodes = np.where(valid, ids[live[:, None], at], -1)
            fresh = np.where(nodes[:, :, None] >= 0, near[np.minimum(np.maximum(nodes, 0), n - 1)], -1).reshape(len(live), -1)
            merge(live, fresh)
        return np.where(ids < n, ids, -1), sims

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the best nodes found for each query, -1 where there are fewer."""
        n = len(self.x)
        beam = min(beam, n)
        step = max(1, min(1024, (1 << 26) // max(n, 1)))
        ids, sims = [], []
        for at in range(0, len(queries), step):
            q = np.ascontiguousarray(queries[at : at + step], dtype=np.float32)
            top, _ = self.layers[0]
            starts = np.tile(np.arange(min(8, len(top))), (len(q), 1))
            for k, (members, near) in enumerate(self.layers):
                last = k == len(self.layers) - 1
                found, s = self._walk(self.x[members], near, q, starts, beam if last else min(16, len(members)))
                if not last:
                    below = self.layers[k + 1][0]
                    starts = np.where(found >= 0, np.searchsorted(below, members[np.maximum(found, 0)]), -1)
            ids.append(np.where(found >= 0, members[np.maximum(found, 0)], -1))
            sims.append(s)
        return np.concatenate(ids), np.concatenate(sims)
