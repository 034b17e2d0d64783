"""Online learning as Structured Streaming: a posterior table updated per micro-batch, and a kernel kept per cell."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vireo.operators import vi
from vireo.operators.features import base_moments, batches, seed_of
from vireo.operators.smc import ParticleFilter
from vireo.sources.tables import discarded, written

SCORES = "cell string, snapshot_index int, n long, mean_log_score double, occupied long"


class OnlineMixture:
    """``foreachBatch`` for the native model over all cells, with its state in ``folder``, a version for each batch.

    Snapshots of a micro-batch are taken one after another, each scored before it is learned: batch borders don't
    matter. A cell starts at the first snapshot that it has, and fails the query if that has fewer than K observations.
    Rows of a snapshot that their cell has passed fail the query too: late data is never dropped in silence.

    A version is complete before the batch ends, and holds all that the next one needs: a row per cell and component,
    with the cell's base and last snapshot. So a query that starts again goes on where its checkpoint does, and a batch
    that comes again is skipped. ``sink(scores, batch_id, snapshot)`` may be called again for a batch that failed midway.
    The last ``keep`` versions stay; older ones, and the tables of a batch that has ended, are removed.
    """

    def __init__(self, cells: list[str], prior: vi.Prior, folder: str, sink: Callable[[DataFrame, int, int], None] | None = None, keep: int = 3) -> None:
        self.cells, self.p, self.folder, self.sink, self.keep, self.scratch = cells, prior, folder.rstrip("/"), sink, max(1, keep), []

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        out = written(df, name)
        self.scratch.append(out)
        return out

    def versions(self) -> list[int]:
        """Batches whose state is complete, in order."""
        at, root = fs.FileSystem.from_uri(self.folder)
        found = [i.path for i in at.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.base_name.startswith("v")]
        whole = at.get_file_info([f"{p}/_SUCCESS" for p in found])  # the folders of the last few versions
        return sorted(int(p.rpartition("/v")[2]) for p, i in zip(found, whole, strict=True) if i.type != fs.FileType.NotFound)

    def state(self, spark: SparkSession, version: int | None = None) -> DataFrame | None:
        """The newest state, or that of a batch."""
        found = self.versions()
        return spark.read.parquet(f"{self.folder}/v{(found[-1] if version is None else version):012d}") if found else None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        done = self.versions()
        if done and batch_id <= done[-1]:
            return
        spark = batch.sparkSession
        state, rows = self.state(spark), self._written(batch, "batch")
        for r in rows.select("snapshot_index").distinct().orderBy("snapshot_index").collect():  # a handful of numbers
            state = self._written(self._snapshot(rows.where(F.col("snapshot_index") == r.snapshot_index), state, r.snapshot_index, batch_id), "posterior")
        if state is not None:
            state.write.mode("overwrite").parquet(f"{self.folder}/v{batch_id:012d}")
        at, root = fs.FileSystem.from_uri(self.folder)
        for old in self.versions()[: -self.keep]:
            at.delete_dir(f"{root}/v{old:012d}")
        discarded(*self.scratch)
        self.scratch = []

    def _snapshot(self, rows: DataFrame, state: DataFrame | None, t: int, batch_id: int) -> DataFrame:
        cells, p = self.cells, self.p
        chunks = self._written(vi.chunked(rows, cells), "chunks")
        fresh = chunks
        if state is not None:
            bases = state.select(*cells, "m0", "m1", "v0", "v1", "last").distinct()
            late = chunks.join(bases.where(F.col("last") >= t), cells).select(*cells, "last").first()
            if late is not None:
                raise ValueError(f"{late[:-1]}: snapshot {t} came after snapshot {late[-1]}")
            fresh = chunks.join(bases, cells, "left_anti")
        size = fresh.groupBy(*cells).agg(F.sum(F.size("x0")).alias("n"))
        few = size.where(F.col("n") < p.k).first()
        if few is not None:
            raise ValueError(f"{few[:-1]}: a first snapshot of {few[-1]} observations can't start {p.k} components")
        first = vi.unpacked(fresh, cells, ("obs_index", "x0", "x1", "theta"))
        base = self._written(base_moments(first, tuple(cells)).select(*cells, "m0", "m1", "v0", "v1"), "base")
        seeds = vi.seed_statistics(vi.seeds(first, cells, p.k), cells, p.initial_mass)
        out = vi.learned(fresh, seeds, base, cells, p).join(base, cells).withColumn("last", F.lit(t))
        if state is None:
            return out
        own, known = state.select(*cells, "k", *vi.STATS), bases.drop("last")
        if self.sink is not None:
            self.sink(vi.scored(chunks, own, known, cells, p), batch_id, t)
        seen = chunks.select(*cells).distinct()
        merged = vi.merged(own.join(seen, cells, "left_semi"), vi.learned(chunks, own, known, cells, p), cells, p.forgetting)
        merged = merged.join(known, cells).withColumn("last", F.lit(t))
        return out.unionByName(merged).unionByName(state.join(seen, cells, "left_anti").select(out.columns))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROGRESS = "m0 double, m1 double, v0 double, v1 double, last int, closed boolean"
COMPONENT = ", ".join(f"{c} double" for c in vi.STATS)


class _Cell(StatefulProcessor):
    """What all kernels share: order of snapshots, silence, and what a cell has come to.

    State ``progress`` has a row per cell: its base, its last snapshot, and whether it was closed for silence.
    """

    def __init__(self, silent_ms: int | None) -> None:
        self.silent_ms = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", PROGRESS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.progress.get() if self.progress.exists() else None
        last, out = (-1 if known is None else known[4]), []
        if known is not None and known[5]:
            raise ValueError(f"{key[0]}: rows came after the cell was closed for silence")
        self.load(known)
        for t, x, theta in batches(pd.concat(list(rows))):
            if t <= last:
                raise ValueError(f"{key[0]}: snapshot {t} came after snapshot {last}")
            score, occupied = self.step(key[0], x, theta)
            out.append((key[0], t, len(x), score, occupied))
            last = t
        base = self.save()
        self.progress.update((*base, last, False))
        if self.silent_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silent_ms)
        yield pd.DataFrame(out, columns=["cell", "snapshot_index", "n", "mean_log_score", "occupied"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """A cell that was silent for so long gives its model up; what comes for it afterwards fails."""
        *base, last, _ = self.progress.get()
        self.progress.update((*base, last, True))
        self.drop()
        yield pd.DataFrame([(key[0], last, 0, None, None)], columns=["cell", "snapshot_index", "n", "mean_log_score", "occupied"]).astype({"mean_log_score": "float64", "occupied": "Int64"})

    def close(self) -> None:
        pass


class MixtureCell(_Cell):
    """The variational model: state ``components`` maps a component's number to its statistics, K typed rows a cell."""

    def __init__(self, prior: vi.Prior, silent_ms: int | None = None) -> None:
        super().__init__(silent_ms)
        self.prior = prior

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.components = handle.getMapState("components", "k int", COMPONENT)

    def load(self, known) -> None:
        self.model = vi.StreamingMixture(self.prior)
        if known is not None:
            self.model.m0, self.model.b0 = np.array(known[:2]), np.array(known[2:4]) * (self.prior.a0 - 1)
            found = {k[0]: v for k, v in self.components.iterator()}
            self.model.stats = np.array([found[k] for k in range(self.prior.k)], float)

    def step(self, cell: str, x: np.ndarray, theta: np.ndarray) -> tuple[float | None, int]:
        score = None if self.model.stats is None else float(np.mean(self.model.log_predictive(x, theta)))
        self.model.learn(x, theta)
        return score, len(np.unique(self.model.responsibilities(x, theta).argmax(1)))

    def save(self) -> tuple[float, ...]:
        for k, row in enumerate(self.model.stats):
            self.components.updateValue((k,), tuple(map(float, row)))
        return *map(float, self.model.m0), *map(float, self.model.b0 / (self.prior.a0 - 1))

    def drop(self) -> None:
        self.components.clear()


class ParticleCell(_Cell):
    """The particle filter: its arrays and paths have no rows of one kind, so state ``kernel`` is the filter itself."""

    def __init__(self, particles: int, window: int, base_seed: int, silent_ms: int | None = None) -> None:
        super().__init__(silent_ms)
        self.settings, self.base_seed = {"particles": particles, "window": window}, base_seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kernel = handle.getValueState("kernel", "filter binary")

    def load(self, known) -> None:
        self.model = None if known is None else pickle.loads(self.kernel.get()[0])

    def step(self, cell: str, x: np.ndarray, theta: np.ndarray) -> tuple[float | None, int]:
        if self.model is None:
            self.model, score = ParticleFilter(x, seed=seed_of(self.base_seed, cell), **self.settings), None
        else:
            score = float(np.mean(self.model.log_predictive(x, theta)))
        self.model.learn(x, theta)
        return score, len(np.unique(self.model.map_partition()))

    def save(self) -> tuple[float, ...]:
        self.kernel.update((pickle.dumps(self.model),))
        return *map(float, self.model.m0), *map(float, self.model.b0 / (self.model.a0 - 1))

    def drop(self) -> None:
        self.kernel.clear()


def kernel_stream(rows: DataFrame, method: str, k: int = 8, particles: int = 64, window: int = 24, base_seed: int = 2026, silent_ms: int | None = None) -> DataFrame:
    """Scores per cell and snapshot from a kernel that lives in the stream's state; ``rows`` has a string column ``cell``.

    A snapshot that its cell has passed fails the query. A cell without rows for ``silent_ms`` of processing time is closed
    by a timer: a row without observations says so, and rows that come for it afterwards fail. The state is typed and
    can be read as a table (``spark.read.format("statestore")``); it needs the RocksDB store (see ``use_typed_state``).
    """
    cell = MixtureCell(vi.Prior(k=k), silent_ms) if method == "vi" else ParticleCell(particles, window, base_seed, silent_ms)
    return rows.groupBy("cell").transformWithStateInPandas(cell, SCORES, "append", "None" if silent_ms is None else "ProcessingTime")


def use_typed_state(spark: SparkSession) -> None:
    """Streams of this session keep their state in RocksDB, which typed state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
