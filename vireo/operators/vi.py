"""Truncated streaming variational mixture on R^2 x S^1: native over many cells at once, and as a numpy kernel for one.

Natively a posterior is a table with a row per cell and component; a snapshot of all cells is one job: seeds or the last
posterior meet the snapshot's observations, responsibilities stay in arrays, and their sums are partial aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vireo.functions.special import LOG_2PI, a1, digamma, digamma_column, lgamma, log_i0, logsumexp
from vireo.operators import order

EPS, TINY = 2.220446049250313e-16, 2.2250738585072014e-308
STATS = ("n", "s0", "s1", "q0", "q1", "dc", "ds")


@dataclass(frozen=True)
class Prior:
    """Truncation, concentrations and forgetting; kappa0 and a0 are the base measure's fixed constants."""

    k: int = 12
    alpha: float = 1.5
    heading_kappa: float = 6.0
    forgetting: float = 1.0
    initial_mass: float = 0.25
    kappa0: float = 0.05
    a0: float = 2.5

    def __post_init__(self) -> None:
        if isinstance(self.k, bool) or not isinstance(self.k, int) or self.k < 2:
            raise ValueError("the truncation must be a whole number of at least 2")
        for name in ("alpha", "heading_kappa", "forgetting", "initial_mass"):
            value = getattr(self, name)
            if isinstance(value, bool) or not math.isfinite(value) or value <= 0:
                raise ValueError(f"{name} must be positive and finite")
        if self.forgetting > 1:
            raise ValueError("forgetting must not exceed 1")


def checked(x: np.ndarray, theta: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    x, theta = np.asarray(x), np.asarray(theta)
    if x.ndim != 2 or x.shape[1] != 2 or theta.shape != x.shape[:1] or len(x) < least or np.iscomplexobj(x) or np.iscomplexobj(theta):
        raise ValueError("need x of shape [N, 2], theta of shape [N], real, and enough of them")
    x, theta = x.astype(float), theta.astype(float)
    if not (np.isfinite(x).all() and np.isfinite(theta).all()):
        raise ValueError("observations must be finite")
    return x, theta


class StreamingMixture:
    """One cell's model. Updates either succeed or leave the state as it was."""

    def __init__(self, prior: Prior = Prior(), base: tuple | None = None) -> None:  # noqa: B008
        self.p, self.base, self.stats, self.bootstrap = prior, base, None, False
        if base is not None:
            m, v = (np.asarray(b, float) for b in base)
            if m.shape != (2,) or v.shape != (2,) or not np.isfinite([*m, *v]).all() or not (v > 0).all():
                raise ValueError("a fixed base needs two finite means and two positive variances")

    def _start(self, x: np.ndarray, theta: np.ndarray) -> None:
        n, k = len(x), self.p.k
        if n < k:
            raise ValueError("the first batch must have at least K observations")
        m, v = self.base if self.base is not None else (x.mean(0), np.maximum(x.var(0, ddof=1), EPS))
        self.m0, self.b0 = np.asarray(m, float), np.asarray(v, float) * (self.p.a0 - 1)
        at = np.argsort(x[:, 0], kind="stable")[np.round(np.linspace(0, n - 1, k)).astype(int)]
        mass = self.p.initial_mass
        self.stats, self.bootstrap = mass * np.column_stack([np.ones(k), x[at], x[at] ** 2, np.cos(theta[at]), np.sin(theta[at])]), True

    def parameters(self) -> dict[str, np.ndarray]:
        p, s = self.p, self.stats
        n = s[:, 0]
        kappa = p.kappa0 + n[:, None]
        mean = (p.kappa0 * self.m0 + s[:, 1:3]) / kappa
        b = np.maximum(self.b0 + 0.5 * (s[:, 3:5] + p.kappa0 * self.m0**2 - kappa * mean**2), TINY)
        eta = p.heading_kappa * s[:, 5:7]
        after = np.cumsum(n[::-1])[::-1][1:]
        return {"kappa": kappa, "mean": mean, "a": p.a0 + 0.5 * n[:, None], "b": b, "eta": eta, "r": np.hypot(*eta.T), "mu": np.arctan2(eta[:, 1], eta[:, 0]), "sa": 1 + n[:-1], "sb": p.alpha + after}

    def log_weights(self) -> np.ndarray:
        q = self.parameters()
        total = digamma(q["sa"] + q["sb"])
        left = np.concatenate([[0.0], np.cumsum(digamma(q["sb"]) - total)])
        return left + np.concatenate([digamma(q["sa"]) - total, [0.0]])

    def weights(self) -> np.ndarray:
        if self.stats is None:
            v = np.full(self.p.k - 1, 1 / (1 + self.p.alpha))
        else:
            q = self.parameters()
            v = q["sa"] / (q["sa"] + q["sb"])
        return np.concatenate([v, [1.0]]) * np.concatenate([[1.0], np.cumprod(1 - v)])

    def responsibilities(self, x: np.ndarray, theta: np.ndarray) -> np.ndarray:
        if self.stats is None:
            raise RuntimeError("no batch has been learned yet")
        x, theta = checked(x, theta, 0)
        q = self.parameters()
        line = 0.5 * (digamma(q["a"]) - np.log(q["b"]) - LOG_2PI - 1 / q["kappa"] - q["a"] / q["b"] * (x[:, None] - q["mean"]) ** 2).sum(2)
        turn = self.p.heading_kappa * a1(q["r"]) * np.cos(theta[:, None] - q["mu"]) - LOG_2PI - log_i0(self.p.heading_kappa)
        z = line + turn + self.log_weights()
        e = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
        return e / e.sum(1, keepdims=True)

    def log_predictive(self, x: np.ndarray, theta: np.ndarray) -> np.ndarray:
        if self.stats is None:
            raise RuntimeError("no batch has been learned yet")
        x, theta = checked(x, theta, 0)
        q = self.parameters()
        return logsumexp(np.log(np.maximum(self.weights(), TINY)) + predictive(x, theta, q, self.p.heading_kappa), 1)

    def learn(self, x: np.ndarray, theta: np.ndarray) -> np.ndarray:
        """One pass; the first batch replaces its seeds, later ones add to the decayed statistics."""
        x, theta = checked(x, theta)
        if self.stats is None:
            self._start(x, theta)
        r = self.responsibilities(x, theta)
        batch = r.T @ np.column_stack([np.ones(len(x)), x, x**2, np.cos(theta), np.sin(theta)])
        self.stats, self.bootstrap = batch if self.bootstrap else self.p.forgetting * self.stats + batch, False
        return r

    def active(self, least: float = 0.01) -> int:
        return int((self.weights() >= least).sum())


def predictive(x: np.ndarray, theta: np.ndarray, q: dict[str, np.ndarray], heading_kappa: float) -> np.ndarray:
    """Log density of each observation under each component: two Student t, and the von Mises integrated over its direction."""
    nu, scale = 2 * q["a"], np.sqrt(q["b"] * (q["kappa"] + 1) / (q["a"] * q["kappa"]))
    z = (x[..., None, :] - q["mean"]) / scale
    line = (lgamma((nu + 1) / 2) - lgamma(nu / 2) - 0.5 * np.log(nu * math.pi) - np.log(scale) - (nu + 1) / 2 * np.log1p(z * z / nu)).sum(-1)
    eta = q["eta"]
    far = np.hypot(eta[..., 0] + heading_kappa * np.cos(theta)[..., None], eta[..., 1] + heading_kappa * np.sin(theta)[..., None])
    return line + log_i0(far) - log_i0(np.hypot(eta[..., 0], eta[..., 1])) - LOG_2PI - log_i0(heading_kappa)


# --- native, over cells -------------------------------------------------------------------------------------------


def seeds(first: DataFrame, cells: list[str], k: int) -> DataFrame:
    """K observations of each cell's first snapshot, evenly spaced by rank of x0 (ties by obs_index): component k from 0."""
    sizes = first.groupBy(*cells).agg((F.count(F.lit(1)) - 1).alias("last"))
    ranked = order.ranked(first, cells, "x0", "obs_index", "place").join(sizes, cells)
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * F.col("last") / F.lit(k - 1.0)).cast("long"))
    return ranked.withColumn("k", F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get(at, i) == F.col("place")))).select(*cells, "k", "x0", "x1", "theta", "obs_index")


def seed_statistics(rows: DataFrame, cells: list[str], mass: float) -> DataFrame:
    m = F.lit(mass)
    return rows.select(
        *cells, "k", m.alias("n"), (m * F.col("x0")).alias("s0"), (m * F.col("x1")).alias("s1"), (m * F.pow("x0", F.lit(2))).alias("q0"), (m * F.pow("x1", F.lit(2))).alias("q1"),
        (m * F.cos("theta")).alias("dc"), (m * F.sin("theta")).alias("ds"),
    )


def parameters(stats: DataFrame, base: DataFrame, cells: list[str], p: Prior) -> DataFrame:
    """Posterior parameters of each component and stick from its statistics and its cell's base (m0, m1, v0, v1)."""
    ahead = Window.partitionBy(*cells).orderBy("k").rowsBetween(1, Window.unboundedFollowing)
    s = stats.join(base, cells)
    out = s.withColumn("kappa", F.col("n") + p.kappa0)
    for d in ("0", "1"):
        m0, kappa = F.col(f"m{d}"), F.col("kappa")
        out = out.withColumn(f"mean{d}", (p.kappa0 * m0 + F.col(f"s{d}")) / kappa)
        b = F.col(f"v{d}") * (p.a0 - 1) + 0.5 * (F.col(f"q{d}") + p.kappa0 * m0 * m0 - kappa * F.col(f"mean{d}") * F.col(f"mean{d}"))
        out = out.withColumn(f"b{d}", F.greatest(b, F.lit(TINY)))
    return out.select(
        *cells, "k", "n", "kappa", "mean0", "mean1", (p.a0 + 0.5 * F.col("n")).alias("a"), "b0", "b1", (p.heading_kappa * F.col("dc")).alias("e0"), (p.heading_kappa * F.col("ds")).alias("e1"),
        (1 + F.col("n")).alias("sa"), (p.alpha + F.coalesce(F.sum("n").over(ahead), F.lit(0.0))).alias("sb"),
    )


def weighted(params: DataFrame, cells: list[str], k: int) -> DataFrame:
    """Expected weight and expected log weight of each component; the last takes what is left."""
    before = Window.partitionBy(*cells).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    sa, sb, last = F.col("sa"), F.col("sb"), F.col("k") == k - 1
    total = digamma_column(sa + sb)
    left = F.coalesce(F.sum(F.log(sb / (sa + sb))).over(before), F.lit(0.0))
    log_left = F.coalesce(F.sum(digamma_column(sb) - total).over(before), F.lit(0.0))
    return params.withColumns(
        {
            "weight": F.exp(left) * F.when(last, 1.0).otherwise(sa / (sa + sb)),
            "log_weight": log_left + F.when(last, 0.0).otherwise(digamma_column(sa) - total),
        }
    )


def labels(obs: DataFrame) -> DataFrame:
    """The first component of greatest responsibility."""
    return obs.withColumn("label", (F.array_position("r", F.array_max("r")) - 1).cast("int"))


def statistics(obs: DataFrame, cells: list[str]) -> DataFrame:
    """Sums of responsibilities, and weighted by features, squares and directions, for each cell and component."""
    x = obs.select(*cells, F.posexplode("r").alias("k", "w"), "x0", "x1", "theta")
    w = F.col("w")
    return x.groupBy(*cells, "k").agg(
        F.sum(w).alias("n"), F.sum(w * F.col("x0")).alias("s0"), F.sum(w * F.col("x1")).alias("s1"), F.sum(w * F.col("x0") * F.col("x0")).alias("q0"), F.sum(w * F.col("x1") * F.col("x1")).alias("q1"),
        F.sum(w * F.cos("theta")).alias("dc"), F.sum(w * F.sin("theta")).alias("ds"),
    )


def merged(state: DataFrame, batch: DataFrame, cells: list[str], forgetting: float) -> DataFrame:
    b = batch.select(*cells, "k", *(F.col(c).alias(f"__{c}") for c in STATS))
    joined = state.join(b, [*cells, "k"], "full")
    none = F.lit(0.0)
    return joined.select(*cells, "k", *((forgetting * F.coalesce(F.col(c), none) + F.coalesce(F.col(f"__{c}"), none)).alias(c) for c in STATS))


# --- native, in chunks: arrays of observations meet the parameters of their cell -----------------------------------

CHUNK = 4096


def chunked(obs: DataFrame, cells: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    """Observations in arrays: a row holds at most ``CHUNK`` of one cell and snapshot, in order of obs_index."""
    columns = ("obs_index", "x0", "x1", "theta", *extra)
    at = obs.withColumn("chunk", F.floor(F.col("obs_index") / CHUNK))
    packed = at.groupBy(*cells, "snapshot_index", "chunk").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("o"))
    return packed.select(*cells, "snapshot_index", *(F.col(f"o.{c}").alias(c) for c in columns))


def unpacked(chunks: DataFrame, cells: list[str], columns: tuple[str, ...]) -> DataFrame:
    return chunks.select(*cells, "snapshot_index", F.inline(F.arrays_zip(*columns)))


def _with_state(chunks: DataFrame, state: DataFrame, base: DataFrame, cells: list[str]) -> DataFrame:
    """Chunks with the statistics (K rows of a cell as one array) and the base of their cell."""
    row = F.array_sort(F.collect_list(F.struct("k", F.array(*STATS).alias("s"))))
    packed = state.groupBy(*cells).agg(F.flatten(F.transform(row, lambda e: e["s"])).alias("stats"))
    return chunks.join(packed.join(base, cells), cells)


def _each_chunk(joined: DataFrame, cells: list[str], p: Prior, schema: T.StructType, make) -> DataFrame:
    """``make(model, row, x, theta)`` for each chunk, with the cell's model restored: a frame of rows below the cell's keys."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                model = StreamingMixture(p)
                model.m0, model.b0 = np.array([row["m0"], row["m1"]]), np.array([row["v0"], row["v1"]]) * (p.a0 - 1)
                model.stats = np.asarray(row["stats"], float).reshape(p.k, len(STATS))
                x, theta = np.column_stack([row["x0"], row["x1"]]), np.asarray(row["theta"], float)
                yield make(model, row, x, theta).assign(**{c: row[c] for c in cells})[schema.names]

    return joined.mapInPandas(run, schema)


def _keys(df: DataFrame, cells: list[str]) -> list[T.StructField]:
    return [T.StructField(c, df.schema[c].dataType) for c in cells]


def learned(chunks: DataFrame, state: DataFrame, base: DataFrame, cells: list[str], p: Prior) -> DataFrame:
    """``statistics`` of the chunks under the state: K sums leave each chunk."""

    def make(model: StreamingMixture, row: dict, x: np.ndarray, theta: np.ndarray) -> pd.DataFrame:
        sums = model.responsibilities(x, theta).T @ np.column_stack([np.ones(len(x)), x, x**2, np.cos(theta), np.sin(theta)])
        return pd.DataFrame(sums, columns=list(STATS)).assign(k=np.arange(p.k))

    joined = _with_state(chunks, state, base, cells)
    schema = T.StructType([*_keys(chunks, cells), T.StructField("k", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in STATS)])
    return _each_chunk(joined, cells, p, schema, make).groupBy(*cells, "k").agg(*(F.sum(c).alias(c) for c in STATS))


def scored(chunks: DataFrame, state: DataFrame, base: DataFrame, cells: list[str], p: Prior, extra: tuple[str, ...] = ()) -> DataFrame:
    """Each observation's ``log_density`` under the state."""
    own = ("snapshot_index", "obs_index", *extra)

    def make(model: StreamingMixture, row: dict, x: np.ndarray, theta: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({c: row[c] for c in own} | {"log_density": model.log_predictive(x, theta)})

    return _each_chunk(_with_state(chunks, state, base, cells), cells, p, _rows_schema(chunks, cells, own, T.StructField("log_density", T.DoubleType())), make)


def assigned(chunks: DataFrame, state: DataFrame, base: DataFrame, cells: list[str], p: Prior, extra: tuple[str, ...] = ()) -> DataFrame:
    """Each observation's responsibilities ``r`` under the state."""
    own = ("snapshot_index", "obs_index", *extra)

    def make(model: StreamingMixture, row: dict, x: np.ndarray, theta: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({c: row[c] for c in own}).assign(r=list(model.responsibilities(x, theta)))

    return _each_chunk(_with_state(chunks, state, base, cells), cells, p, _rows_schema(chunks, cells, own, T.StructField("r", T.ArrayType(T.DoubleType()))), make)


def _rows_schema(chunks: DataFrame, cells: list[str], own: tuple[str, ...], last: T.StructField) -> T.StructType:
    kind = lambda c: t.elementType if isinstance(t := chunks.schema[c].dataType, T.ArrayType) else t
    return T.StructType([*_keys(chunks, cells), *(T.StructField(c, kind(c)) for c in own), last])


@dataclass
class Fitted:
    """What ``fit`` leaves: observations in chunks, each cell's base, and the state before the first and after each snapshot."""

    cells: list[str]
    prior: Prior
    extra: tuple[str, ...]
    chunks: DataFrame
    base: DataFrame
    states: list[DataFrame]

    def scores(self) -> DataFrame:
        """Observations of the snapshots after the first, each under what was learned before it."""
        at = [self.chunks.where(F.col("snapshot_index") == t) for t in range(1, len(self.states) - 1)]
        return reduce(DataFrame.unionByName, [scored(c, s, self.base, self.cells, self.prior, self.extra) for c, s in zip(at, self.states[1:], strict=False)])

    def responsibilities(self) -> DataFrame:
        """All observations under the final state."""
        return assigned(self.chunks, self.states[-1], self.base, self.cells, self.prior, self.extra)


def fit(
    obs: DataFrame, cells: list[str], p: Prior, snapshots: int, base: DataFrame | None = None, keep=lambda df, name: df, extra: tuple[str, ...] = ()
) -> Fitted:
    """All cells through their snapshots, one job each; cells whose first snapshot has fewer than K observations are left out.

    ``keep`` writes a table out and reads it back, so that lineage stays short: the observations once, the state, K
    rows a cell, for each snapshot. ``extra``: columns of ``obs`` that go with an observation.
    """
    from vireo.operators.features import base_moments

    chunks = keep(chunked(obs, cells, extra), "chunks")
    start = chunks.where(F.col("snapshot_index") == 0)
    enough = start.groupBy(*cells).agg(F.sum(F.size("x0")).alias("n")).where(F.col("n") >= p.k).select(*cells)
    first = unpacked(start.join(enough, cells, "left_semi"), cells, ("obs_index", "x0", "x1", "theta"))
    base = keep(base.join(enough, cells, "left_semi") if base is not None else base_moments(first, tuple(cells)), "base")
    states = [keep(seed_statistics(seeds(first, cells, p.k), cells, p.initial_mass), "seeds")]
    for t in range(snapshots):
        now = learned(chunks.where(F.col("snapshot_index") == t), states[-1], base, cells, p)
        states.append(keep(merged(states[-1], now, cells, p.forgetting) if t else now, "posterior"))
    return Fitted(cells, p, extra, chunks, base, states)
