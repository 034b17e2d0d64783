"""Cells' observations on their way to tasks: packed by block, each block once for a task."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_study import frame
from vireo import queries
from vireo.functions.special import BEYOND, log_i0, tabled_log_i0
from vireo.operators.features import DROPOUTS
from vireo.operators.smc import ParticleFilter, ParticleFilters, side_by_side
from vireo.plans import factorial

SIZES = {(f"b{k}", s): 40 + 9 * k for k in range(4) for s in range(2)}
COLUMNS = ["snapshot_index", "obs_index", "x0", "x1", "theta", "category"]


def _cells(rows: pd.DataFrame) -> dict:
    return {k: g.sort_values(["snapshot_index", "obs_index"])[COLUMNS].reset_index(drop=True) for k, g in rows.groupby(factorial.CELL)}


def test_packed_blocks_hold_the_rows_of_all_cells(spark):
    obs = frame(spark, SIZES).repartition(3).withColumn("category", F.when(F.col("obs_index") % 5 > 0, F.col("category")))
    cells = factorial.design(obs)
    for exact in (False, True):
        wanted = _cells(factorial.cell_rows(obs, cells, exact=exact).toPandas())
        given = factorial.dealt_blocks(obs, cells, factorial.cell_cost(4, 4, 2), exact=exact, tasks=3).toPandas()
        found = {}
        for _, task in given.assign(own=given["methods"].map(list).map(str) + given["rates"].map(list).map(str)).groupby(["block_id", "own"]):
            for key, rows in factorial.whole_blocks(iter([task])):
                assert key not in found
                found[key] = rows
        assert sorted(found) == sorted(wanted) and len(found) == 24
        for key, rows in found.items():
            assert list(rows.columns) == COLUMNS
            for c in COLUMNS:
                np.testing.assert_array_equal(rows[c], wanted[key][c].fillna(-1))


def test_a_block_travels_once_for_a_task(spark):
    obs = frame(spark, SIZES)
    cells = factorial.design(obs)
    width = sum(np.dtype(kind).itemsize for _, kind in factorial.PACKED)
    for tasks in (1, 2):
        sent = factorial.dealt_blocks(obs, cells, factorial.cell_cost(4, 4, 2), tasks=tasks).agg(F.sum(F.length("rows"))).first()[0] / width
        assert sent <= tasks * obs.count() < factorial.cell_rows(obs, cells).count()


def test_a_block_may_lack_all_rows_of_a_cell():
    rows = pd.DataFrame({"snapshot_index": [1, 0], "obs_index": [0, 3], "x0": [1.0, 2.0], "x1": 0.5, "theta": 0.1, "kept": [1, 1], "category": [3, -1]})
    data = b"".join(rows[name].to_numpy().astype(kind).tobytes() for name, kind in factorial.PACKED)
    given = pd.DataFrame({"block_id": ["b"], "methods": [["streaming_vi"] * 2], "rates": [[DROPOUTS[0], DROPOUTS[2]]], "rows": [data]})
    [(key, found)] = factorial.whole_blocks(iter([given]))
    assert key == ("b", "streaming_vi", DROPOUTS[0]) and found["obs_index"].tolist() == [3, 0]


def test_observations_are_made_once(spark, sf):
    """What follows reads them as written: neither claims nor places are worked out again, for the cells or for the base."""
    plan = queries._fit_cells(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "get_json_object" not in plan


def test_more_clusters_than_a_byte_counts():
    """With so large a concentration each observation opens a cluster; slots are counted right beyond 255."""
    rng = np.random.default_rng(3)
    x, theta = rng.normal(size=(300, 2)), rng.uniform(0, 6, 300)
    model = ParticleFilter(x, particles=4, window=0, alpha=1e12)
    model.learn(x, theta)
    assert model.map_partition().tolist() == list(range(300))


def test_table_of_log_i0_up_to_its_end():
    x = np.concatenate([[0.0], np.geomspace(1e-6, BEYOND * 0.999, 500)])
    np.testing.assert_array_equal(tabled_log_i0(x), log_i0(x))
    assert float(log_i0(BEYOND * 4)) == pytest.approx(BEYOND * 4 - 0.5 * np.log(2 * np.pi * BEYOND * 4), rel=1e-12)


def test_terms_of_the_base_are_made_once_for_a_set_of_cells(monkeypatch):
    """Not for each observation; they follow the cells that go on."""
    made, real = [], ParticleFilters._base
    monkeypatch.setattr(ParticleFilters, "_base", lambda self: (made.append(len(self.rngs)), real(self))[1])
    rng = np.random.default_rng(5)
    parts = [[(rng.normal(size=(n, 2)), rng.uniform(0, 6, n)) for n in sizes] for sizes in ((9, 8), (14, 12), (5, 5))]
    bases = [([float(k), 0.5], [1.0 + k, 2.0]) for k in range(3)]
    together = {c: (s, own) for c, s, own, _ in side_by_side(ParticleFilters(bases, [1, 2, 3], 8, window=3), parts)}
    assert made == [3, 2, 1, 0]
    for c in range(3):
        [(_, scores, labels, _)] = side_by_side(ParticleFilters([bases[c]], [c + 1], 8, window=3), [parts[c]])
        np.testing.assert_allclose(together[c][0], scores, rtol=0, atol=1e-12)
        assert together[c][1].tolist() == labels.tolist()
