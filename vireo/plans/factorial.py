"""The factorial replay: cells, thinning, calibration, execution, validation and analysis."""

from __future__ import annotations

import heapq
import math
import re
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vireo.operators import metrics
from vireo.operators.features import DROPOUTS, base_of, batches, moment_states, pooled, seed_of, thinned, with_exact_uniform, with_uniform
from vireo.operators.smc import ParticleFilter, ParticleFilters, own_base, side_by_side
from vireo.operators.vi import Prior, StreamingMixture
from vireo.plans.provenance import environment, implementation_sha256, sha256

METHODS = ("streaming_vi", "collapsed_dp_smc")
ENDPOINTS = ("mean_prequential_log_score", "log_latency_per_observation", "occupied_clusters", "category_nmi_evaluation_only")
CELL = ["block_id", "method", "dropout_rate"]
PROTOCOL = "each snapshot scored before it is learned"
RESULT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("block_id", "method")]
    + [T.StructField("dropout_rate", T.DoubleType())]
    + [T.StructField(n, T.LongType()) for n in ("retained_observations", "scored_observations", "category_observations", "occupied_clusters")]
    + [T.StructField(n, T.DoubleType()) for n in ("mean_prequential_log_score", "compute_latency_ms", "compute_latency_ms_per_observation", "category_nmi_evaluation_only", "tail_weight", "particle_ess")]
    + [T.StructField("success", T.BooleanType())]
)
LABELS = T.StructType([T.StructField(n, t) for n, t in (("block_id", T.StringType()), ("method", T.StringType()), ("dropout_rate", T.DoubleType()), ("snapshot_index", T.IntegerType()), ("obs_index", T.IntegerType()), ("label", T.IntegerType()))])


def design(blocks: DataFrame, methods: tuple[str, ...] = METHODS, dropouts: tuple[float, ...] = DROPOUTS) -> DataFrame:
    """Every block by every method and rate; the last two are a fixed handful of literals."""
    cells = F.array(*(F.struct(F.lit(m).alias("method"), F.lit(d).alias("dropout_rate")) for m in methods for d in dropouts))
    return blocks.select("block_id").distinct().select("block_id", F.explode(cells).alias("c")).select("block_id", "c.*")


def pending(cells: DataFrame, done: DataFrame, seed: int = 2026) -> DataFrame:
    """Cells not done yet, within each block in an order that the seed decides."""
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), *CELL), 256)
    return cells.join(done.select(*CELL), CELL, "left_anti").withColumn("position", F.row_number().over(Window.partitionBy("block_id").orderBy(order)))


def leaked(calibration: DataFrame, formal: DataFrame) -> DataFrame:
    return formal.select("block_id").distinct().join(calibration.select("block_id").distinct(), "block_id", "left_semi")


def retained(obs: DataFrame, base_seed: int = 2026, dropouts: tuple[float, ...] = DROPOUTS, exact: bool = False) -> DataFrame:
    """Observations by rate. The same uniform number decides at every rate and for every method."""
    return thinned((with_exact_uniform if exact else with_uniform)(obs, base_seed), dropouts)


def run_cell(rows: pd.DataFrame, method: str, seed: int, k: int, particles: int, window: int, base=None, alpha: float = 1.5, heading_kappa: float = 6.0) -> tuple[dict, np.ndarray]:
    """One cell in order of snapshots: score with what was learned before, then learn. Timed as a whole."""
    if method != METHODS[0]:
        return next(run_filters([rows], [seed], particles, window, base, alpha, heading_kappa))[1:]
    began, scores = time.perf_counter(), []
    parts = list(batches(rows))
    model = StreamingMixture(Prior(k=k, alpha=alpha, heading_kappa=heading_kappa), base)
    for t, (_, x, theta) in enumerate(parts):
        if t:
            scores.append(model.log_predictive(x, theta))
        model.learn(x, theta)
    labels = np.concatenate([model.responsibilities(x, theta).argmax(1) for _, x, theta in parts])
    scores = np.concatenate(scores) if scores else np.empty(0)
    return _found(labels, scores, 1000 * (time.perf_counter() - began), tail_weight=float(model.weights()[-1]), particle_ess=None), labels


def run_filters(cells: list[pd.DataFrame], seeds: list[int], particles: int, window: int, base=None, alpha: float = 1.5, heading_kappa: float = 6.0) -> Iterator[tuple[int, dict, np.ndarray]]:
    """The particle filters of several cells side by side (see ``side_by_side``): a cell's place, results and labels, as cells end.

    What a cell draws and gives is what it would alone; of the time it has its share by observations.
    """
    began = time.perf_counter()
    parts = [[(x, theta) for _, x, theta in batches(rows)] for rows in cells]
    filters = ParticleFilters([own_base(own[0][0]) if base is None else base for own in parts], seeds, particles, alpha, heading_kappa, window=window)
    found = list(side_by_side(filters, parts))
    each = 1000 * (time.perf_counter() - began) / sum(map(len, cells))
    for c, scores, labels, ess in found:
        yield c, _found(labels, scores, each * len(labels), tail_weight=None, particle_ess=ess), labels


def _found(labels: np.ndarray, scores: np.ndarray, elapsed: float, **health) -> dict:
    if not len(scores) or not np.isfinite(scores).all():
        raise ValueError("every observation after the first snapshot needs a finite density")
    return {
        "retained_observations": len(labels), "scored_observations": len(scores), "occupied_clusters": len(np.unique(labels)), "mean_prequential_log_score": float(scores.mean()),
        "compute_latency_ms": elapsed, "compute_latency_ms_per_observation": elapsed / len(labels), "success": True, **health,
    }


def usable(c: pd.Series) -> pd.Series:
    return c.between(2, 20) & (c != 13)


def agreement(labels: np.ndarray, categories: pd.Series) -> float | None:
    """``metrics.nmi`` of one cell: mutual information over the mean of the entropies, of rows whose category is usable."""
    rows = pd.DataFrame({"label": labels, "category": categories.to_numpy()})[usable(categories).to_numpy()]
    if len(rows) < 2:
        return None
    joint = pd.crosstab(rows["label"], rows["category"], normalize=True).to_numpy()
    if joint.size == 1:
        return 1.0
    entropy = [-float((p[p > 0] * np.log(p[p > 0])).sum()) for p in (joint.sum(1), joint.sum(0), joint.ravel())]
    mean = (entropy[0] + entropy[1]) / 2
    return min(1.0, max(0.0, (2 * mean - entropy[2]) / mean)) if mean > 0 else 0.0


_warm: list[bool] = []


def warm_up() -> None:
    """Both engines on a few points, once in a worker process, so that no cell's time has their first use in it."""
    if not _warm:
        at = np.linspace(0, 1, 32)
        x = np.column_stack([at, at[::-1] ** 2])
        for model in (StreamingMixture(Prior(k=8)), ParticleFilter(x, particles=4, window=4)):
            model.learn(x, at)
            model.log_predictive(x[:4], at[:4])
        _warm.append(True)


def cell_rows(obs: DataFrame, cells: DataFrame, base_seed: int = 2026, exact: bool = False) -> DataFrame:
    return retained(obs, base_seed, exact=exact).join(cells, ["block_id", "dropout_rate"])


#: Cells whose costs the driver packs; tasks to a core, so that an unlucky estimate is made up for.
PACKED_CELLS, TASKS_PER_CORE = 20_000, 3
#: Particle filters that a task runs side by side, at most, and observations in them, unless one cell has more.
SIDE_BY_SIDE, HELD = 12, 8_000_000


def longest_first(costs: list[float], tasks: int) -> list[int]:
    """A task for each cost: the dearest first, each to the task with the least so far."""
    load, out = [(0.0, t) for t in range(tasks)], [0] * len(costs)
    for i in sorted(range(len(costs)), key=lambda i: (-costs[i], i)):
        total, t = heapq.heappop(load)
        out[i] = t
        heapq.heappush(load, (total + costs[i], t))
    return out


def dealt(rows: DataFrame, keys: list[str], cost, tasks: int | None = None, per_core: int = TASKS_PER_CORE) -> DataFrame:
    """``rows`` with all of a cell (``keys``) in one task and the tasks' costs alike, each in order of cells, snapshots and observations.

    ``cost(key values, number of rows)`` is an estimate. Partitions are given by number, so adaptive execution, which sees
    bytes and no work, merges none. Up to ``PACKED_CELLS`` cells are packed by their costs on the driver, a number a
    cell; among more, tasks of many cells each are alike by hashing.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).limit(PACKED_CELLS + 1).collect()
    if len(sizes) > PACKED_CELLS:
        n = tasks or max(cores * TASKS_PER_CORE, rows.select(*keys).distinct().count() // 64)
        placed = rows.repartition(n, *keys)
    else:
        n = max(1, min(len(sizes), tasks or cores * per_core))
        at = longest_first([cost(tuple(r[k] for k in keys), r.n) for r in sizes], n)
        kinds = T.StructType([*(rows.schema[k] for k in keys), T.StructField("__task", T.IntegerType())])
        tasks_of = spark.createDataFrame([(*(r[k] for k in keys), t) for r, t in zip(sizes, at, strict=True)], kinds)
        placed = rows.join(F.broadcast(tasks_of), keys).repartitionById(n, F.col("__task")).drop("__task")
    return placed.sortWithinPartitions(*keys, "snapshot_index", "obs_index")


#: Arrays of a packed row, one after another.
PACKED = (("snapshot_index", "<i4"), ("obs_index", "<i4"), ("x0", "<f8"), ("x1", "<f8"), ("theta", "<f8"), ("kept", "|u1"), ("category", "<i4"))


def packed(obs: DataFrame, base_seed: int = 2026, exact: bool = False) -> DataFrame:
    """block_id and rows: observations of a block and an Arrow batch as bytes (see ``PACKED``), each once for all cells of its block.

    kept: at how many of ``DROPOUTS`` the observation stays; masks are nested, so these are the first. category: -1 if null.
    """
    columns = [name for name, _ in PACKED]
    slim = obs.select("block_id", *(F.col(c) for c in columns if c != "kept"))
    u = F.col("u")
    slim = (with_exact_uniform if exact else with_uniform)(slim, base_seed).withColumn("kept", sum((u >= d).cast("int") for d in DROPOUTS))
    slim = slim.select("block_id", *(F.coalesce("category", F.lit(-1)).alias(c) if c == "category" else F.col(c) for c in columns))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column("block_id").dictionary_encode()
            code = block.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(code[order])) + 1).tolist(), len(code)]
            own = [batch.column(name).to_numpy(zero_copy_only=False).astype(kind)[order] for name, kind in PACKED]
            rows = [b"".join(x[a:b].tobytes() for x in own) for a, b in zip(cuts, cuts[1:], strict=False)]
            names = block.dictionary.take(pa.array(code[order][cuts[:-1]]))
            yield pa.RecordBatch.from_arrays([names, pa.array(rows, pa.binary())], names=["block_id", "rows"])

    return slim.mapInArrow(pack, T.StructType([obs.schema["block_id"], T.StructField("rows", T.BinaryType())]))


def unpacked(rows: list[bytes]) -> pd.DataFrame:
    """The observations of packed rows, in order of snapshots and places."""
    width, parts = sum(np.dtype(kind).itemsize for _, kind in PACKED), {name: [] for name, _ in PACKED}
    for data in rows:
        n, at = len(data) // width, 0
        for name, kind in PACKED:
            parts[name].append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
    out = {name: np.concatenate(own) for name, own in parts.items()}
    order = np.lexsort((out["obs_index"], out["snapshot_index"]))
    return pd.DataFrame({name: own[order] for name, own in out.items()})


def dealt_blocks(obs: DataFrame, cells: DataFrame, cost, base_seed: int = 2026, exact: bool = False, tasks: int | None = None, per_core: int = TASKS_PER_CORE) -> DataFrame:
    """Packed rows (see ``packed``) of a block once for each task that has cells of it, with these cells' methods and rates; in order of blocks.

    Cells are dealt as by ``dealt``. Rows don't travel for each cell, so what is shuffled hangs on the tasks that a block's
    cells are in, and not on the number of methods and rates.
    """
    spark, rows = obs.sparkSession, packed(obs, base_seed, exact)
    cores, kinds = spark.sparkContext.defaultParallelism, [cells.schema[k] for k in CELL]
    kept = retained(obs.select("block_id", "snapshot_index", "obs_index"), base_seed, exact=exact).groupBy("block_id", "dropout_rate").agg(F.count(F.lit(1)).alias("n"))
    sizes = kept.join(cells.select(*CELL), ["block_id", "dropout_rate"]).limit(PACKED_CELLS + 1).collect()
    if len(sizes) > PACKED_CELLS:
        n = tasks or max(cores * TASKS_PER_CORE, cells.count() // 64)
        placed = cells.select(*CELL, F.pmod(F.xxhash64(*CELL), F.lit(n)).cast("int").alias("__task"))
    else:
        n = max(1, min(len(sizes), tasks or cores * per_core))
        at = longest_first([cost(tuple(r[k] for k in CELL), r.n) for r in sizes], n)
        placed = spark.createDataFrame([(*(r[k] for k in CELL), t) for r, t in zip(sizes, at, strict=True)], T.StructType([*kinds, T.StructField("__task", T.IntegerType())]))
    own = F.sort_array(F.collect_list(F.struct("method", "dropout_rate")))
    placed = placed.groupBy("block_id", "__task").agg(own.alias("own")).select("block_id", "__task", F.col("own.method").alias("methods"), F.col("own.dropout_rate").alias("rates"))
    if len(sizes) <= PACKED_CELLS:
        placed = F.broadcast(placed)
    return rows.join(placed, "block_id").repartitionById(n, F.col("__task")).drop("__task").sortWithinPartitions("block_id")


def whole_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Each cell of a task's packed rows, with its key; a block is unpacked once."""
    name, cells, held = None, [], []

    def cut() -> Iterator[tuple[tuple, pd.DataFrame]]:
        rows = unpacked(held)
        for method, rate in cells:
            own = rows[rows["kept"] > DROPOUTS.index(rate)]
            if len(own):
                yield (name, method, rate), own.drop(columns="kept").reset_index(drop=True)

    for frame in frames:
        for block, methods, rates, data in frame[["block_id", "methods", "rates", "rows"]].itertuples(index=False):
            if block != name:
                if held:
                    yield from cut()
                name, cells, held = block, list(zip(methods, rates, strict=True)), []
            held.append(data)
    if held:
        yield from cut()


def executor_cores(master: str, cores: str | None) -> int | None:
    """Cores that a task must ask for to have an executor to itself; none where a session can't say so: a local one, or one whose executors don't say how many they have."""
    return int(cores) if cores and not master.startswith("local") else None


def alone(spark: SparkSession) -> tuple[ResourceProfile | None, int | None]:
    """How timed cells run: the profile of a stage whose tasks take an executor each, and the number of tasks.

    A session that has no such profiles (see ``executor_cores``) runs them in one task, one after another.
    """
    conf = spark.sparkContext.getConf()
    cores = executor_cores(spark.sparkContext.master, conf.get("spark.executor.cores", None))
    if cores is None:
        return None, 1
    profile = ResourceProfileBuilder().require(TaskResourceRequests().cpus(cores)).build
    return profile, None if cores == 1 else max(1, TASKS_PER_CORE * spark.sparkContext.defaultParallelism // cores)


def each_cell(rows: DataFrame, keys: list[str], make, schema: T.StructType | str, profile: ResourceProfile | None = None) -> DataFrame:
    """``make(key, frame)`` for each cell of rows that are ``dealt``; a task holds one cell at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, cell in whole(frames, keys):
            yield make(key, cell)

    return rows.mapInPandas(run, schema, profile=profile)


def whole(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Each cell of a task's rows, which are in order of cells, with its key."""
    name, held = None, []
    for frame in frames:
        changes = np.flatnonzero((frame[keys] != frame[keys].shift()).any(axis=1).to_numpy())
        for a, b in zip(changes.tolist(), [*changes.tolist()[1:], len(frame)], strict=True):
            key = tuple(frame[keys].iloc[a])
            if key != name and held:
                yield name, pd.concat(held, ignore_index=True)
                held = []
            name = key
            held.append(frame.iloc[a:b].drop(columns=keys))
    if held:
        yield name, pd.concat(held, ignore_index=True)


def cell_cost(k: int, particles: int, window: int):
    """Relative work of a cell: a variational one passes over its rows for K components, a particle filter draws for all particles, and again for its window where it is resampled, which becomes rare as it grows."""
    draws = particles * (1 + window / 10)
    return lambda key, n: n * 2 * k if key[1] == METHODS[0] else draws * (n + 50 * window)


def execute(obs: DataFrame, cells: DataFrame, k: int = 8, particles: int = 64, window: int = 24, base_seed: int = 2026, base=None, exact: bool = False, tasks: int | None = None, timed: bool = False, **model) -> DataFrame:
    """A result row for each cell. Cells are dealt by their estimated work (see ``dealt_blocks``), a task to each core, so that a
    task has several particle filters to step side by side (see ``run_filters``);
    if ``timed``, each has an executor to itself (see ``alone``), so that latencies are of a cell and not of its neighbours.

    ``base``: means and variances of the pooled calibration observations (see ``pooled_base``); without it, each cell
    takes those of its own first snapshot. ``model``: alpha and heading_kappa, if they aren't the usual ones.
    """

    def row(key: tuple, out: dict, labels: np.ndarray, category: pd.Series) -> pd.DataFrame:
        out |= {"category_observations": int(usable(category).sum()), "category_nmi_evaluation_only": agreement(labels, category)}
        return pd.DataFrame([{**dict(zip(CELL, key, strict=True)), **out}])[RESULT.names]

    def together(held: list[tuple[tuple, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for c, out, labels in run_filters([own for _, own in held], [seed_of(base_seed, *key) for key, _ in held], particles, window, base, **model):
            yield row(held[c][0], out, labels, held[c][1]["category"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        warm_up()
        held, many = [], 1 if timed else SIDE_BY_SIDE
        for key, cell in whole_blocks(frames):
            if key[1] == METHODS[0]:
                yield row(key, *run_cell(cell, key[1], seed_of(base_seed, *key), k, particles, window, base, **model), cell["category"])
                continue
            held.append((key, cell))
            if len(held) == many or sum(len(own) for _, own in held) > HELD:
                yield from together(held)
                held = []
        if held:
            yield from together(held)

    profile, own = alone(obs.sparkSession) if timed else (None, None)
    return dealt_blocks(obs, cells, cell_cost(k, particles, window), base_seed, exact, tasks or own, TASKS_PER_CORE if timed else 1).mapInPandas(run, RESULT, profile=profile)


def partitions(obs: DataFrame, cells: DataFrame, k: int = 8, particles: int = 64, window: int = 24, base_seed: int = 2026, base=None, exact: bool = False) -> DataFrame:
    """Each observation's final label in each cell."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block, method, dropout = key
        _, labels = run_cell(pdf, method, seed_of(base_seed, block, method, dropout), k, particles, window, base)
        return pdf[["snapshot_index", "obs_index"]].assign(block_id=block, method=method, dropout_rate=dropout, label=labels)[LABELS.names]

    return each_cell(dealt(cell_rows(obs, cells, base_seed, exact), CELL, cell_cost(k, particles, window)), CELL, run, LABELS)


#: Settings of the confirmatory study, none of which may differ in it.
GRID = (8, 12, 16, 24, 32)
FROZEN = {"alpha": 1.5, "heading_kappa": 6.0, "particles": 64, "rejuvenation_window": 24, "base_seed": 2026, "tail_threshold": 0.01, "saturation_threshold": 0.05}
COLLECTION = {"bbox": [49.0, 7.0, 54.0, 13.0], "snapshots_per_block": 6, "interval_seconds": 5.0, "minimum_eligible_states": 32, "max_attempts_per_block": 4, "retry_delay_seconds": 900.0}
CALIBRATION_BLOCKS, FORMAL_BLOCKS = 10, 100


def pooled_base(obs: DataFrame) -> dict:
    """The state (see ``features.pooled``) of all observations of all blocks, a block at a time."""
    return pooled(moment_states(obs, ("block_id",)))


def calibrate(
    obs: DataFrame, grid: tuple[int, ...] = GRID, tail: float = 0.01, saturation: float = 0.05, base_seed: int = 2026, base=None, exact: bool = False, snapshots: int | None = None,
    alpha: float = 1.5, heading_kappa: float = 6.0,
) -> DataFrame:
    """For each K: usable, 95th percentile of the worst residual weight, share of saturated blocks, passed.

    Every model has the same base: ``base``, or what ``pooled_base`` gives for ``obs``. A K is usable if at the highest
    rate every block's first snapshot keeps K observations and each of its ``snapshots`` (the most that a block of ``obs``
    has) keeps one; only usable K are fitted. A block's worst value is over the rates.
    """
    spark = obs.sparkSession
    base = base_of(pooled_base(obs)) if base is None else base
    kept = retained(obs, base_seed, exact=exact)
    first = F.count_if(F.col("snapshot_index") == 0)
    thinnest = kept.where(F.col("dropout_rate") == max(DROPOUTS)).groupBy("block_id").agg(first.alias("first"), F.countDistinct("snapshot_index").alias("kept"))
    blocks = obs.groupBy("block_id").agg((F.max("snapshot_index") + 1).alias("due")).join(thinnest, "block_id", "left")
    least = blocks.agg(F.min(F.coalesce("first", F.lit(0))).alias("first"), F.min(F.coalesce("kept", F.lit(0))).alias("kept"), F.max("due").alias("due")).first()
    fit = [k for k in grid if least.due is not None and least.kept >= (snapshots or least.due) and least.first >= k]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block, dropout = key
        models = [StreamingMixture(Prior(k=k, alpha=alpha, heading_kappa=heading_kappa), base) for k in fit]
        for _, x, theta in batches(pdf):
            for model in models:
                model.learn(x, theta)
        return pd.DataFrame([{"k": m.p.k, "block_id": block, "dropout_rate": dropout, "tail": float(m.weights()[-1]), "saturated": float(m.active() >= m.p.k)} for m in models])

    keys = ["block_id", "dropout_rate"]  # a cell's rows travel once and are fitted with every K
    if fit:
        each = each_cell(dealt(kept.select(*keys, "snapshot_index", "obs_index", "x0", "x1", "theta"), keys, lambda key, n: n), keys, run, "k int, block_id string, dropout_rate double, tail double, saturated double")
    else:
        each = spark.createDataFrame([], "k int, block_id string, dropout_rate double, tail double, saturated double")
    known = spark.createDataFrame([(k, k in fit) for k in grid], "k int, usable boolean")
    return selected(each, known, tail, saturation)


def selected(each: DataFrame, known: DataFrame, tail: float = 0.01, saturation: float = 0.05) -> DataFrame:
    """The rule for each K of ``known`` (k, usable), from the fits of the usable ones."""
    worst = each.groupBy("k", "block_id").agg(F.max("tail").alias("tail"), F.max("saturated").alias("saturated"))
    by_k = known.join(worst.groupBy("k").agg(F.percentile("tail", F.lit(0.95)).alias("tail_weight_q95"), F.avg("saturated").alias("saturation_rate")), "k", "left")
    return by_k.withColumn("passed", F.coalesce(F.col("usable") & (F.col("tail_weight_q95") <= tail) & (F.col("saturation_rate") <= saturation), F.lit(False)))


def chosen_k(diagnostics: list[dict]) -> int:
    """The smallest K that passed."""
    passed = [d["k"] for d in diagnostics if d["passed"]]
    if not passed:
        raise RuntimeError("no candidate passed; widen the grid and calibrate again")
    return min(passed)


def lock(spark: SparkSession, diagnostics: list[dict], blocks: dict[str, str], time_end: int, state: dict, contract: dict, settings: dict | None = None, validation_only: bool = False) -> dict:
    """What is fixed before any formal block: settings, the chosen K and why, the pooled base, and what it was learned from.

    ``blocks``: digests of the calibration blocks by their ids. ``settings``: what differs from ``FROZEN``.
    """
    means, variances = base_of(state)
    body = {
        "schema": "vireo-analysis-lock-v2", "status": "locked", "scope": "validation_only" if validation_only else "confirmatory", "endpoint_protocol": PROTOCOL,
        "selected_k": chosen_k(diagnostics), "candidate_diagnostics": diagnostics, **FROZEN, **(settings or {}), "base_state": state, "base_mean": means, "base_variance": variances,
        "dropout_levels": list(DROPOUTS), "endpoints": list(ENDPOINTS), "calibration_blocks": sorted(blocks), "calibration_block_sha256": [blocks[b] for b in sorted(blocks)],
        "calibration_api_time_end": time_end, "contract": contract, "implementation_sha256": implementation_sha256(), "environment": environment(spark),
    }
    body["environment_sha256"] = sha256(body["environment"])
    body = body | {"lock_sha256": sha256(body)}
    lock_faults(body)
    return body


def lock_faults(body: dict) -> None:
    """Raises at the first field of a lock that can't be: for any scope its evidence, for a confirmatory one the protocol."""
    confirmatory = body["scope"] == "confirmatory"

    def need(ok: object, what: str) -> None:
        if not ok:
            raise ValueError(f"the lock's {what}")

    def each(values: object, pattern: str) -> bool:
        return isinstance(values, list) and values and len(set(map(str, values))) == len(values) and all(isinstance(v, str) and re.fullmatch(pattern, v) for v in values)

    need(body["scope"] in ("confirmatory", "validation_only"), "scope is unknown")
    need(each(body.get("calibration_blocks"), "calibration-[0-9]{4}"), "calibration blocks have wrong names")
    need(each(body.get("calibration_block_sha256"), "[0-9a-f]{64}") and len(body["calibration_block_sha256"]) == len(body["calibration_blocks"]), "block digests aren't one for each block")
    time_end = body.get("calibration_api_time_end")
    need(isinstance(time_end, int) and not isinstance(time_end, bool) and time_end >= 1, "calibration has no end")
    state = body.get("base_state")
    need(isinstance(state, dict) and all(math.isfinite(v) for k in ("mean", "squares") for v in state[k]), "base isn't finite")
    need(([*map(float, body.get("base_mean", []))], [*map(float, body.get("base_variance", []))]) == base_of(state) and min(body["base_variance"]) > 0, "base isn't that of its observations")
    need(body.get("dropout_levels") == list(DROPOUTS) and body.get("endpoints") == list(ENDPOINTS) and body.get("endpoint_protocol") == PROTOCOL, "design is another one")
    diagnostics = body.get("candidate_diagnostics")
    need(isinstance(diagnostics, list) and diagnostics and all(isinstance(d, dict) for d in diagnostics), "diagnostics are missing")
    grid = [d.get("k") for d in diagnostics]
    need(grid == sorted(set(grid)), "K grid isn't increasing")
    need(body.get("selected_k") == next((d["k"] for d in diagnostics if d.get("passed") is True), None), "K isn't the first that passed")
    need(all(d.get("passed") is (bool(d.get("usable")) and d["tail_weight_q95"] <= body["tail_threshold"] and d["saturation_rate"] <= body["saturation_threshold"]) for d in diagnostics), "diagnostics contradict its thresholds")
    need(body.get("environment_sha256") == sha256(body.get("environment")), "environment has another digest")
    if confirmatory:
        need(all(body.get(k) == v for k, v in FROZEN.items()), "settings aren't the frozen ones")
        need(tuple(grid) == GRID, "K grid isn't the frozen one")
        need(len(body["calibration_blocks"]) == CALIBRATION_BLOCKS, f"calibration hasn't {CALIBRATION_BLOCKS} blocks")
        need(body.get("contract") == COLLECTION, "blocks were collected under another contract")


def checked_lock(spark: SparkSession, body: dict, same_runtime: bool = False) -> dict:
    """The lock, if its digest holds, its fields can be (see ``lock_faults``), its code is this code and, if asked, its runtime is this runtime."""
    if sha256({k: v for k, v in body.items() if k != "lock_sha256"}) != body.get("lock_sha256"):
        raise ValueError("the lock was changed after it was written")
    lock_faults(body)
    if body["implementation_sha256"] != implementation_sha256():
        raise ValueError("the lock belongs to another implementation")
    if same_runtime and body["environment"] != environment(spark):
        raise ValueError("the lock belongs to another runtime")
    return body


def violations(results: DataFrame, expected: DataFrame, k: int, particles: int = 64, fixed: dict[str, str] | None = None) -> DataFrame:
    """Cells whose results break a rule, with the rules' names.

    ``expected``: CELL and the counts that the masks imply, with ``block_sha256`` if results carry one. ``fixed``: what
    every row must have in a column.
    """
    claims = [c for c in expected.columns if c not in CELL]
    r = expected.select(*CELL, *(F.col(c).alias(f"e_{c}") for c in claims)).join(results, CELL, "full")
    vi = F.col("method") == METHODS[0]
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    missing = lambda c: F.col(c).isNull() | F.isnan(c)
    ms, per = F.col("compute_latency_ms"), F.col("compute_latency_ms_per_observation")
    ratio = ms / F.col("retained_observations")
    rules = {
        "missing": F.col("success").isNull() | F.col("e_retained_observations").isNull(),
        "failed": ~F.coalesce("success", F.lit(False)),
        "counts": ~(F.col("retained_observations").eqNullSafe(F.col("e_retained_observations")) & F.col("scored_observations").eqNullSafe(F.col("e_scored_observations"))) | (F.col("scored_observations") < 1),
        "categories": ~F.col("category_observations").eqNullSafe(F.col("e_category_observations")),
        "score": ~finite("mean_prequential_log_score"),
        "occupied": ~F.coalesce(F.col("occupied_clusters").between(1, F.col("retained_observations")) & (~vi | (F.col("occupied_clusters") <= k)), F.lit(False)),
        "latency": ~(finite("compute_latency_ms") & F.coalesce((ms > 0) & (F.abs(ratio - per) <= 1e-10 * F.greatest(F.abs(ratio), F.abs(per))), F.lit(False))),
        "health": ~F.when(vi, finite("tail_weight") & F.coalesce(F.col("tail_weight").between(0, 1), F.lit(False)) & missing("particle_ess")).otherwise(
            missing("tail_weight") & finite("particle_ess") & F.coalesce(F.col("particle_ess").between(1 - 1e-10, particles + 1e-10), F.lit(False))
        ),
    }
    if "category_nmi_evaluation_only" in results.columns:
        nmi = F.col("category_nmi_evaluation_only")
        rules["agreement"] = ~F.when(F.col("category_observations") < 2, missing("category_nmi_evaluation_only")).otherwise(
            finite("category_nmi_evaluation_only") & F.coalesce(nmi.between(0, 1), F.lit(False))
        )
    rules |= {name: ~F.col(name).eqNullSafe(F.lit(value)) for name, value in (fixed or {}).items()}
    if "block_sha256" in expected.columns:
        rules["block_sha256"] = ~F.col("block_sha256").eqNullSafe(F.col("e_block_sha256"))
    broken = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return r.withColumn("rules", broken).where(F.size("rules") > 0).select(*CELL, "rules")


def expected_counts(obs: DataFrame, cells: DataFrame, base_seed: int = 2026, exact: bool = False) -> DataFrame:
    c = F.col("category")
    kept = retained(obs, base_seed, exact=exact).groupBy("block_id", "dropout_rate").agg(
        F.count(F.lit(1)).alias("retained_observations"), F.count_if(F.col("snapshot_index") > 0).alias("scored_observations"), F.count_if(F.coalesce(c.between(2, 20) & (c != 13), F.lit(False))).alias("category_observations")
    )
    return cells.join(kept, ["block_id", "dropout_rate"], "left")


def coverage(results: DataFrame) -> DataFrame:
    return results.groupBy("method", "dropout_rate").agg(F.sum("retained_observations").alias("retained_observations"), F.sum("category_observations").alias("category_observations"))


def analyse(results: DataFrame) -> dict[str, list[dict]]:
    """Contrasts with intervals for each endpoint. A missing cell fails the analysis."""
    r = results.withColumn("log_latency_per_observation", F.log("compute_latency_ms_per_observation"))
    n = r.agg(F.countDistinct("block_id").alias("blocks"), F.count(F.lit(1)).alias("rows"), F.countDistinct(*CELL).alias("cells")).first()
    if n.rows != n.cells or n.rows != n.blocks * len(METHODS) * len(DROPOUTS):
        raise ValueError("the factorial isn't complete")
    return {e: metrics.inference(metrics.contrast_moments(metrics.contrasts(metrics.contrast_cube(r, e, METHODS, DROPOUTS)))) for e in ENDPOINTS}


def fingerprint(row: dict, kinds: T.StructType = RESULT) -> str:
    """Of a result row, whatever the types its values come in; missing values and NaN are the same.

    A boolean is true, false, 1 or 0, a count a whole number; anything else has no fingerprint.
    """
    kind_of = {f.name: f.dataType for f in kinds.fields}

    def typed(name: str, v: object) -> object:
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        kind, text = kind_of.get(name, T.StringType()), str(v).strip()
        if isinstance(kind, T.DoubleType):
            return None if math.isnan(float(v)) else float(v)
        if isinstance(kind, T.LongType):
            if isinstance(v, bool) or float(text) != int(float(text)):
                raise ValueError(f"{name} is no count: {v!r}")
            return int(float(text))
        if isinstance(kind, T.BooleanType):
            if text.lower() not in ("true", "false", "1", "0"):
                raise ValueError(f"{name} is neither true nor false: {v!r}")
            return text.lower() in ("true", "1")
        return str(v)

    return sha256({k: typed(k, v) for k, v in row.items() if k != "result_sha256"})
