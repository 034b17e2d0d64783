"""Collapsed particle filter for the same mixture, vectorised over clusters, particles and the cells of a task.

What an observation's density needs of a cluster is kept beside the cluster and refreshed where the cluster changed: one
of each particle for an observation. Paths of particles are kept in ``Paths``, which copies nothing that can't change.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

from vireo.functions.special import BEYOND, LOG_2PI, log_i0, logsumexp, tabled_log_i0
from vireo.operators.vi import EPS, TINY, checked


class _Stretch:
    """A node of the tree: slots of a run of observations, in pieces; what particles have in common before they part."""

    __slots__ = ("parent", "pieces", "uses")

    def __init__(self, parent: _Stretch | None, piece: np.ndarray) -> None:
        self.parent, self.pieces, self.uses = parent, [piece], 0
        if parent is not None:
            parent.uses += 1


class Paths:
    """Each particle's slots of all observations so far.

    The last ``window`` may still change and are an array. Before them, at a resampling, the stretches of the particles
    that survive become leaves of a tree; stretches that nobody descends from go, and a stretch with one descendant takes it
    in. So n observations of p particles take about n + p log p places.
    """

    def __init__(self, particles: int, window: int) -> None:
        self.window, self.length, self.n = window, 0, 0
        self._live = np.zeros((particles, max(64, 2 * window)), np.int32)
        self._heads: list[_Stretch | None] = [None] * particles

    def append(self, slots: np.ndarray) -> None:
        if self.length == self._live.shape[1]:
            self._live = np.concatenate([self._live, np.zeros_like(self._live[:, : max(64, self.length // 2)])], axis=1)
        self._live[:, self.length] = slots
        self.length += 1
        self.n += 1

    def at(self, i: int) -> np.ndarray:
        """[particles]: slots of the i-th observation, one of the last ``window``; to read and to write."""
        return self._live[:, i - (self.n - self.length)]

    def resample(self, ancestors: np.ndarray) -> None:
        """Particle k goes on as ``ancestors[k]`` was."""
        old = self.length - self.window
        heads = self._heads
        if old > 0:
            grown = {u: _Stretch(heads[u], self._live[u, :old].copy()) for u in np.unique(ancestors).tolist()}
            self._live[:, : self.window] = self._live[ancestors, old : self.length]
            self.length = self.window
        else:
            grown = {u: heads[u] for u in np.unique(ancestors).tolist()}
            self._live[:, : self.length] = self._live[ancestors, : self.length]
        self._heads = [grown[u] for u in ancestors.tolist()]
        living = {id(s) for s in self._heads}
        for s in {id(s): s for s in heads}.values():
            while s is not None and not s.uses and id(s) not in living:
                above, s.parent = s.parent, None
                if above is not None:
                    above.uses -= 1
                s = above
        self._contract(living)

    def _contract(self, living: set[int]) -> None:
        """Stretches with one descendant and no particle of their own take the descendant in."""
        children: dict[int, list[_Stretch]] = {}
        seen: dict[int, _Stretch] = {}
        for s in {id(s): s for s in self._heads}.values():
            while s is not None and id(s) not in seen:
                seen[id(s)] = s
                if s.parent is not None:
                    children.setdefault(id(s.parent), []).append(s)
                s = s.parent
        for s in seen.values():
            while id(s) not in living and len(own := children.get(id(s), [])) == 1:
                child = own[0]
                s.pieces += child.pieces
                s.uses = child.uses
                children[id(s)] = children.pop(id(child), [])
                for c in children[id(s)]:
                    c.parent = s
                child.parent, child.uses = s, -1  # taken in
                if id(child) in living:
                    living.discard(id(child))
                    living.add(id(s))
                    self._heads = [s if h is child else h for h in self._heads]
                child.pieces = []

    def path(self, k: int) -> np.ndarray:
        s, out = self._heads[k], [self._live[k, : self.length]]
        while s is not None:
            out += s.pieces[::-1]
            s = s.parent
        return np.concatenate(out[::-1]).astype(np.int64)

    @property
    def places(self) -> int:
        """Slots that are held, without room to grow."""
        seen, total = set(), self._live.shape[0] * self.length
        for s in self._heads:
            while s is not None and id(s) not in seen:
                seen.add(id(s))
                total += sum(map(len, s.pieces))
                s = s.parent
        return total


def vectors(x: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Observations as they stand in sums: the size, x0, x1, their squares and the direction."""
    return np.column_stack([np.ones(len(x)), x, x**2, np.cos(theta), np.sin(theta)])


class ParticleFilters:
    """A filter for each of several cells. Arrays are [slots, cells, particles], so what numpy costs for a step is paid once
    for all cells; in a step a cell takes its next observation or, after it was resampled, draws one of its window again.
    Each cell draws from a generator of its own, so its results hang on no other. A particle's clusters are dense in order of birth.
    """

    def __init__(self, bases, seeds, particles=64, alpha=1.5, heading_kappa=6.0, resample_fraction=0.5, window=24, kappa0=0.05, a0=2.5) -> None:
        if particles < 2 or window < 0 or alpha <= 0 or heading_kappa <= 0 or not 0 < resample_fraction <= 1:
            raise ValueError("need 2 particles, a window of 0 or more, positive concentrations and a fraction in (0, 1]")
        m, v = (np.asarray([b[k] for b in bases], float) for k in (0, 1))
        if m.shape != (len(seeds), 2) or v.shape != m.shape or not (np.isfinite(m).all() and np.isfinite(v).all()) or not (v > 0).all():
            raise ValueError("a fixed base needs two finite means and two positive variances")
        self.p, self.alpha, self.hk, self.kappa0, self.a0 = particles, alpha, heading_kappa, kappa0, a0
        self.m0, self.b0, self.least, self.window = m, v * (a0 - 1), resample_fraction * particles, window
        self.rngs = [np.random.Generator(np.random.PCG64(s)) for s in seeds]
        cells = len(self.rngs)
        self.log_w = np.full((cells, particles), -math.log(particles))  # weights of a cell always sum to 1
        self.n, self.paths = np.zeros(cells, np.int64), [Paths(particles, window) for _ in seeds]
        self._most = 1  # observations of a cell and the next one, at most
        self.sweep = np.full(cells, -1)  # the observation to be drawn again next, where there is one
        self._seen = np.zeros((cells, window + 1, 7))  # only the window is read again
        self.stats = np.zeros((4, cells, particles, 7))
        self._sizes = np.zeros(0)
        self._base()
        #: For each cluster: log of its size and all that no observation changes, the exponent, for both lines mean and factor,
        #: and the direction. The first empty slot of a particle has those of a new cluster, the concentration as its size.
        self._known = np.zeros((8, 4, cells, particles))
        self._known[0], self._known[1] = -np.inf, 1.0
        self._new = self._derived(np.zeros((cells, 1, 7)), np.arange(cells))  # [8, cells, 1]
        self._new[0] = math.log(alpha) + 2 * (math.lgamma(a0 + 0.5) - math.lgamma(a0)) - math.log(math.pi) - LOG_2PI - float(log_i0(heading_kappa)) - 0.5 * np.log(2 * self.b0 * (kappa0 + 1) / kappa0).sum(-1, keepdims=True)
        self._empty, self._rows = np.zeros((cells, particles), np.int64), 1  # first empty slots; no slot further back is in use
        self._room(np.arange(cells))

    def _base(self) -> None:
        """What clusters' densities have of their cells' bases: the mean and the mean square by their weight, and the spread; [2, cells, 1] each."""
        m0 = self.m0.T[:, :, None]
        self._prior = np.stack([self.kappa0 * m0, self.kappa0 * m0**2, self.b0.T[:, :, None]])

    def _log_i0(self, x: np.ndarray) -> np.ndarray:
        """Of lengths of directions, of which none is longer than all observations of a cell are."""
        return tabled_log_i0(x) if self.hk * (self._most + 1) < BEYOND else log_i0(x)

    def _size(self, n: np.ndarray) -> np.ndarray:
        """What a cluster's density has of its whole size alone, from a table that grows: the size, and twice log Gamma(a + 1/2) - log Gamma(a), a = a0 + n / 2."""
        if self._most >= len(self._sizes):
            to = max(self._most + 1, 2 * len(self._sizes), 64)
            a = [self.a0 + k / 2 for k in range(to)]
            fixed = math.log(math.pi) + LOG_2PI + float(log_i0(self.hk))
            self._sizes = np.array([-math.inf, *(math.log(k) + 2 * (math.lgamma(a[k] + 0.5) - math.lgamma(a[k])) - fixed for k in range(1, to))])
        return self._sizes.take(n)

    def _derived(self, s: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """[8, ...]: what densities need of clusters of ``cells`` with statistics ``s`` [cells, clusters, 7]."""
        s = np.ascontiguousarray(s.transpose(2, 0, 1))
        mean0, square0, b0 = self._prior if len(cells) == len(self.rngs) else self._prior[:, :, cells]
        out = np.empty((8, *s.shape[1:]))
        kappa = s[0] + self.kappa0
        mean, factor, turn = out[2:4], out[4:6], out[6:]
        np.add(s[1:3], mean0, out=mean)
        mean /= kappa
        b = kappa * mean
        b *= mean
        np.subtract(s[3:5] + square0, b, out=b)
        b *= 0.5
        b += b0
        spread = np.maximum(b, TINY, out=b)  # degrees of freedom times the squared scale
        spread *= 2 * (kappa + 1) / kappa
        np.divide(1, spread, out=factor)
        np.multiply(s[5:], self.hk, out=turn)
        np.multiply(s[0], 0.5, out=out[1])
        out[1] += self.a0 + 0.5
        logs, square = np.log(spread, out=spread), turn * turn
        logs[0] += logs[1]
        logs[0] *= 0.5
        square[0] += square[1]
        np.subtract(self._size(s[0].astype(np.int64)), logs[0], out=out[0])
        out[0] -= self._log_i0(np.sqrt(square[0], out=square[0]))
        return out

    def _change(self, cells: np.ndarray, slot: np.ndarray, row: np.ndarray, sign: float) -> None:
        """The observation of each of ``cells`` enters (1) or leaves (-1) a cluster of each particle: ``slot`` is [cells, particles]."""
        at = (slot * len(self.rngs) + cells[:, None]) * self.p + np.arange(self.p)
        flat = self.stats.reshape(-1, 7)
        s = flat.take(at, axis=0)
        s += sign * row[:, None]
        if sign < 0:
            s[s[..., 0] <= 0.5] = 0.0
        flat[at] = s
        self._known.reshape(8, -1)[:, at.ravel()] = self._derived(s, cells).reshape(8, -1)
        met = (slot == self._empty[cells]) if sign > 0 else (s[..., 0] == 0)  # clusters that are new, or gone
        if met.any():
            self._room(cells[met.any(axis=1)])

    def _room(self, cells: np.ndarray) -> None:
        """Each particle's first empty slot, after there is one."""
        full = self.stats[..., 0][:, cells] > 0
        if full.all(axis=0).any():
            self.stats = np.concatenate([self.stats, np.zeros((4, *self.stats.shape[1:]))])
            more = np.zeros((8, 4, *self._known.shape[2:]))
            more[0], more[1] = -np.inf, 1.0
            self._known = np.concatenate([self._known, more], axis=1)
            full = self.stats[..., 0][:, cells] > 0
        empty = self._empty[cells] = np.argmin(full, axis=0)
        self._known[0][:, cells] = np.where(full, self._known[0][:, cells], -np.inf)
        for own, new in zip(self._known, self._new, strict=True):
            own[empty, cells[:, None], np.arange(self.p)] = new[cells]
        used = np.flatnonzero((self.stats[..., 0] > 0).any(axis=(1, 2)))
        self._rows = max(int(self._empty.max()), int(used[-1]) if len(used) else 0) + 1

    def _density(self, row: np.ndarray, known: np.ndarray) -> np.ndarray:
        base, power, m0, m1, f0, f1, turn0, turn1 = known
        u = row[..., 1] - m0
        u *= u
        u *= f0
        v = row[..., 2] - m1
        v *= v
        v *= f1
        z = u * v
        z += u
        z += v  # the product of both lines' factors, less 1
        z = np.log1p(z)
        z *= power
        z = base - z
        c = turn0 + self.hk * row[..., 5]
        c *= c
        s = turn1 + self.hk * row[..., 6]
        s *= s
        c += s
        z += self._log_i0(np.sqrt(c, out=c))
        return z

    def _draw(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A slot for each particle, and the log evidence."""
        z = self._density(row[:, None], self._known[:, : self._rows])
        top = z.max(axis=0)
        z -= top
        np.exp(z, out=z)
        for before, own in zip(z, z[1:], strict=False):  # sums so far, a slot at a time: far quicker than cumsum over the first axis
            own += before
        u = np.empty(top.shape)
        for rng, own in zip(self.rngs, u, strict=True):
            rng.random(out=own)
        u *= z[-1]
        below = (u >= z[:-1]).view(np.uint8)  # u is below 1, so below the last
        slot = np.add.reduce(below, axis=0, dtype=np.uint8 if len(z) < 256 else np.int64).astype(np.int64)
        return slot, top + np.log(z[-1])

    def step(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A step of each cell; of ``row`` [cells, 7], those take theirs that have nothing to draw again: which, their scores and effective numbers of particles."""
        every, again = np.arange(len(self.rngs)), np.flatnonzero(self.sweep >= 0)
        self._most = int(self.n.max()) + 1
        if len(again):
            row, at = row.copy(), self.sweep[again]
            row[again] = self._seen[again, at % self._seen.shape[1]]
            old = [self.paths[k].at(i) for k, i in zip(again.tolist(), at.tolist(), strict=True)]
            self._change(again, np.stack(old).astype(np.int64), row[again], -1.0)
        slot, evidence = self._draw(row)
        self._change(every, slot, row, 1.0)
        new = self.sweep < 0
        if len(again):
            for path, own in zip(old, slot[again], strict=True):
                path[:] = own
            self.sweep[again] = np.where(at + 1 < self.n[again], at + 1, -1)
        joint = self.log_w + evidence - np.log(self.n + self.alpha)[:, None]
        top = joint.max(axis=1)
        w = np.exp(joint - top[:, None])
        total = w.sum(axis=1)
        score, ess = top + np.log(total), total * total / (w * w).sum(axis=1)
        taken = np.flatnonzero(new)
        self.log_w[taken] = joint[taken] - score[taken, None]
        for k in taken.tolist():
            self.paths[k].append(slot[k])
        self._seen[taken, self.n[taken] % self._seen.shape[1]] = row[taken]
        self.n[taken] += 1
        low = np.flatnonzero(new & (ess < self.least))
        if len(low):
            for k in low.tolist():
                self._resample(k)
            self._room(low)
            if self.window:  # a Gibbs sweep over the last observations; weights stay
                self.sweep[low] = np.maximum(0, self.n[low] - self.window)
        return new, score, ess

    def _resample(self, cell: int) -> None:
        edges = np.cumsum(np.exp(self.log_w[cell]))
        edges[-1] = 1.0
        at = np.searchsorted(edges, (self.rngs[cell].random() + np.arange(self.p)) / self.p)
        self.stats[:, cell], self._known[:, :, cell] = self.stats[:, cell][:, at], self._known[:, :, cell][:, :, at]
        self.paths[cell].resample(at)
        self.log_w[cell] = -math.log(self.p)

    def log_predictive(self, cell: int, rows: np.ndarray, step: int = 32) -> np.ndarray:
        """Densities of ``rows`` [observations, 7] under the cell's posterior as it stands, ``step`` at a time; nothing is drawn or changed."""
        full = self.stats[: self._rows, cell, :, 0] > 0
        known = self._known[:, : self._rows, cell][:, full]
        known[0] += np.broadcast_to(self.log_w[cell], full.shape)[full]
        fresh = self._density(rows, self._new[:, cell, 0]) + float(logsumexp(self.log_w[cell], 0))
        out = np.empty(len(rows))
        for k in range(0, len(rows), step):
            z, new = self._density(rows[k : k + step, None], known), fresh[k : k + step]
            top = np.maximum(z.max(axis=1, initial=-np.inf), new)
            z -= top[:, None]
            out[k : k + step] = top + np.log(np.exp(z, out=z).sum(axis=1) + np.exp(new - top))
        return out - math.log(self.n[cell] + self.alpha)

    def map_partition(self, cell: int) -> np.ndarray:
        return self.paths[cell].path(int(np.argmax(self.log_w[cell])))

    def keep(self, cells: list[int]) -> None:
        """Only these cells go on."""
        self.m0, self.b0, self.log_w, self.n, self.sweep, self._seen, self._empty = (a[cells] for a in (self.m0, self.b0, self.log_w, self.n, self.sweep, self._seen, self._empty))
        self.stats, self._known, self._new = (np.ascontiguousarray(a) for a in (self.stats[:, cells], self._known[:, :, cells], self._new[:, cells]))
        self.rngs, self.paths = [self.rngs[k] for k in cells], [self.paths[k] for k in cells]
        self._base()


def side_by_side(filters: ParticleFilters, snapshots: list[list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
    """Each cell's snapshots (x, theta) in order, scored with what was learned before, then learned.

    As cells end: their place, scores, labels of all observations and mean effective number of particles.
    """
    cells, due = list(range(len(snapshots))), [iter(s) for s in snapshots]
    rows, scores = [vectors(*checked(*next(s))) for s in due], [[] for _ in snapshots]
    row, done, size, ess = np.zeros((len(cells), 7)), np.zeros(len(cells), np.int64), np.array([len(r) for r in rows]), np.zeros(len(cells))
    while cells:
        for k in np.flatnonzero(filters.sweep < 0).tolist():
            row[k] = rows[k][done[k]]
        new, _, own = filters.step(row)
        done += new
        ess += np.where(new, own, 0.0)
        ended = []
        for k in np.flatnonzero((done == size) & (filters.sweep < 0)).tolist():
            following = next(due[k], None)
            if following is None:
                ended.append(k)
                yield cells[k], np.concatenate(scores[k]) if scores[k] else np.empty(0), filters.map_partition(k), float(ess[k] / filters.n[k])
            else:
                rows[k] = vectors(*checked(*following))
                scores[k].append(filters.log_predictive(k, rows[k]))
                done[k], size[k] = 0, len(rows[k])
        if ended:
            go_on = [k for k in range(len(cells)) if k not in ended]
            cells, due, rows, scores = ([own[k] for k in go_on] for own in (cells, due, rows, scores))
            row, done, size, ess = row[go_on], done[go_on], size[go_on], ess[go_on]
            filters.keep(go_on)


def own_base(first_x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and variances of a cell's first observations."""
    x, _ = checked(first_x, np.zeros(len(first_x)), 2)
    return x.mean(0), np.maximum(x.var(0, ddof=1), EPS)


class ParticleFilter:
    """The filter of one cell."""

    def __init__(self, first_x, particles=64, alpha=1.5, heading_kappa=6.0, resample_fraction=0.5, window=24, seed=2026, base=None, kappa0=0.05, a0=2.5) -> None:
        own = own_base(first_x)
        self.filters = ParticleFilters([own if base is None else base], [seed], particles, alpha, heading_kappa, resample_fraction, window, kappa0, a0)
        self.ess_history: list[float] = []
        self.score_history: list[float] = []

    a0, p = (property(lambda self, name=name: getattr(self.filters, name)) for name in ("a0", "p"))
    m0, b0, log_w, n = (property(lambda self, name=name: getattr(self.filters, name)[0]) for name in ("m0", "b0", "log_w", "n"))

    @property
    def rng(self) -> np.random.Generator:
        return self.filters.rngs[0]

    @property
    def stats(self) -> np.ndarray:
        """[particles, slots, 7]: each cluster's sums."""
        return self.filters.stats[:, 0].transpose(1, 0, 2)

    @property
    def assigned(self) -> np.ndarray:
        """[particles, observations so far]: slots."""
        return np.stack([self.filters.paths[0].path(k) for k in range(self.p)])

    def learn(self, x, theta) -> float:
        """Takes the observations in order; the effective number of particles at the last."""
        rows, k = vectors(*checked(x, theta)), 0
        while k < len(rows) or self.filters.sweep[0] >= 0:
            new, score, ess = self.filters.step(rows[k : k + 1] if k < len(rows) else rows[:1])
            if new[0]:
                self.score_history.append(float(score[0]))
                self.ess_history.append(float(ess[0]))
                k += 1
        return self.ess_history[-1]

    def log_predictive(self, x, theta) -> np.ndarray:
        """Densities under the posterior as it stands; nothing is drawn or changed."""
        return self.filters.log_predictive(0, vectors(*checked(x, theta, 0)))

    def map_partition(self) -> np.ndarray:
        return self.filters.map_partition(0)
