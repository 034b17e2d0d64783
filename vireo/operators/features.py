"""Model features, reproducible seeds, nested thinning and base moments."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16
DROPOUTS = (0.0, 0.15, 0.3)


def with_features(df: DataFrame) -> DataFrame:
    """x0 = log(1 + speed), x1 = asinh(climb / 5), theta = heading in radians within [0, 2 pi)."""
    return df.withColumns({"x0": F.log1p("velocity"), "x1": F.asinh(F.col("vertical_rate") / 5), "theta": F.radians(F.pmod("true_track", F.lit(360.0)))})


def stable_seed(*parts: Column) -> Column:
    """The first 32 bits of SHA-256 over the parts joined by bars, modulo 2^32: bytes 4 to 7 of the first 8."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), 9, 8), 16, 10).cast("long")


def seed_of(*parts: object) -> int:
    return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:8], "big") % (1 << 32)


def hash_uniform(seed: Column, index: Column) -> Column:
    """52 bits of a digest of seed and place, so the same in any engine."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", seed.cast("string"), index.cast("string")), 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def with_uniform(obs: DataFrame, base_seed: int) -> DataFrame:
    """Each observation's uniform number: the same at every dropout rate, so that masks are nested."""
    return obs.withColumn("u", hash_uniform(stable_seed(F.lit(base_seed), F.col("block_id"), F.col("snapshot_index")), F.col("obs_index")))


def with_exact_uniform(obs: DataFrame, base_seed: int) -> DataFrame:
    """The same from numpy's PCG64 stream of the snapshot: the obs_index-th number, wherever the row is.

    The generator jumps ahead to each stretch of rows that a batch has, so no snapshot is gathered and nothing is shuffled.
    """
    schema = obs.withColumn("u", F.lit(0.0)).schema

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            u, index = np.empty(len(f)), f["obs_index"].to_numpy(np.int64)
            for key, at in f.groupby(["block_id", "snapshot_index"], sort=False).indices.items():
                u[at] = stream_at(seed_of(base_seed, *key), index[at])
            yield f.assign(u=u)[schema.names]

    return obs.mapInPandas(draw, schema)


def stream_at(seed: int, places: np.ndarray) -> np.ndarray:
    """``np.random.default_rng(seed).random(n)[places]`` without drawing what isn't asked for."""
    if not len(places):
        return np.empty(0)
    wanted, back = np.unique(places, return_inverse=True)
    rng, out, at = np.random.default_rng(seed), [], 0
    for run in np.split(wanted, np.flatnonzero(np.diff(wanted) != 1) + 1):
        rng.bit_generator.advance(int(run[0]) - at)  # a number takes one step of the generator
        out.append(rng.random(len(run)))
        at = int(run[-1]) + 1
    return np.concatenate(out)[back]


def nested_keep_mask(n: int, dropout: float, seed: int) -> np.ndarray:
    if not (isinstance(n, int) and n >= 0) or not 0 <= dropout < 1:
        raise ValueError("need a count and a dropout rate in [0, 1)")
    return np.random.default_rng(seed).random(n) >= dropout


def thinned(obs: DataFrame, dropouts: tuple[float, ...] = DROPOUTS) -> DataFrame:
    """A row for each rate at which the observation stays."""
    return obs.withColumn("dropout_rate", F.explode(F.filter(F.array(*map(F.lit, dropouts)), lambda d: F.col("u") >= d)))


def base_moments(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Means and unbiased variances, the latter not below the rounding unit."""
    var = lambda c: F.greatest(F.var_samp(c), F.lit(EPS))
    return df.groupBy(*by).agg(F.avg("x0").alias("m0"), F.avg("x1").alias("m1"), var("x0").alias("v0"), var("x1").alias("v1"))


def moment_states(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Of each group: count, means and sums of squared deviations. Such states add up (see ``pooled``)."""
    squares = lambda c: F.var_pop(c) * F.count(c)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("x0").alias("m0"), F.avg("x1").alias("m1"), squares("x0").alias("q0"), squares("x1").alias("q1"))


def pooled(states: DataFrame) -> dict:
    """The state of all groups: n, mean, squares. Deviations are taken about the common mean, so none cancel."""
    own = states.where("n > 0")
    total = own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *((F.sum(F.col("n") * F.col(f"m{d}")) / F.sum("n")).alias(f"m{d}") for d in "01")).first()
    if not total.n:
        return {"n": 0, "mean": [0.0, 0.0], "squares": [0.0, 0.0]}
    squares = own.agg(*(F.sum(F.col(f"q{d}") + F.col("n") * F.pow(F.col(f"m{d}") - F.lit(total[f"m{d}"]), F.lit(2))) for d in "01")).first()
    return {"n": total.n, "mean": [total.m0, total.m1], "squares": list(squares)}


def extended(state: dict, more: dict) -> dict:
    """Two states as one: what was pooled before isn't read again."""
    n = state["n"] + more["n"]
    if not n:
        return state
    gap = [b - a for a, b in zip(state["mean"], more["mean"], strict=True)]
    return {
        "n": n, "mean": [a + g * more["n"] / n for a, g in zip(state["mean"], gap, strict=True)],
        "squares": [a + b + g * g * state["n"] * more["n"] / n for a, b, g in zip(state["squares"], more["squares"], gap, strict=True)],
    }


def base_of(state: dict) -> tuple[list[float], list[float]]:
    """Means and unbiased variances, the latter not below the rounding unit."""
    if state["n"] < 2:
        raise ValueError("a base needs two observations")
    return list(state["mean"]), [max(q / (state["n"] - 1), EPS) for q in state["squares"]]


def batches(rows: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Snapshots of a cell in order, each in order of obs_index: index, x, theta."""
    for k, g in rows.sort_values(["snapshot_index", "obs_index"]).groupby("snapshot_index", sort=True):
        yield int(k), g[["x0", "x1"]].to_numpy(float), g["theta"].to_numpy(float)
