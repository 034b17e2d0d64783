"""Calibration, its lock, the gates of a study, and how its cells are dealt to tasks."""

import json

import numpy as np
import pytest

from tests.test_sources import Feed, clean, contract
from vireo.operators.features import base_of, extended, moment_states, pooled, with_features
from vireo.operators.smc import ParticleFilter
from vireo.operators.vi import Prior, StreamingMixture
from vireo.plans import factorial, study
from vireo.plans.provenance import sha256
from vireo.sources import blocks, rest


@pytest.fixture(scope="module")
def phases(spark, tmp_path_factory):
    """Two formal blocks that were collected before calibration, two calibration blocks and two formal ones after them."""
    folder, feed, found = tmp_path_factory.mktemp("blocks"), Feed(sizes=[40, 30] * 60), {}
    for name in ("early/formal-0001", "early/formal-0002", "calibration/calibration-0001", "calibration/calibration-0002", "late/formal-0001", "late/formal-0002"):
        block = rest.acquired(rest.Session(feed, "u"), contract(), name.split("/")[1], clean, sleep=lambda s: None)
        (folder / name.split("/")[0]).mkdir(exist_ok=True)
        (folder / f"{name}.json.gz").write_bytes(blocks.packed(block))
    for name in ("early", "calibration", "late"):
        found[name] = blocks.read_blocks(spark, str(folder / name), "calibration" if name == "calibration" else "formal")
    return found


SETTINGS = {"tail_threshold": 0.9, "saturation_threshold": 0.99, "particles": 4, "rejuvenation_window": 2}


@pytest.fixture(scope="module")
def locked(spark, phases):
    return study.calibrate(spark, phases["calibration"], 2, (4, 24), True, **SETTINGS)


def frame(spark, sizes, seed=1):
    """Blocks of two snapshots: (block, snapshot) to its number of observations."""
    rng = np.random.default_rng(seed)
    rows = [(b, s, i, float(rng.normal(5, 1)), float(rng.normal()), float(rng.uniform(0, 6.2)), int(rng.integers(0, 21))) for (b, s), n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "block_id string, snapshot_index int, obs_index int, x0 double, x1 double, theta double, category int")


# --- tasks


def test_dearest_cells_go_first():
    rng = np.random.default_rng(5)
    for n, tasks in ((1, 3), (7, 3), (200, 24)):
        costs = rng.lognormal(0, 2, n).tolist()
        load = np.bincount(factorial.longest_first(costs, tasks), costs, tasks)
        assert load.sum() == pytest.approx(sum(costs))
        assert load.max() <= 4 / 3 * max(max(costs), sum(costs) / tasks) + 1e-9  # what the rule guarantees against the least possible


def test_cells_are_dealt_to_as_many_tasks_as_cores(spark):
    """Whatever adaptive execution makes of their few bytes; a cell stays whole and in order."""
    from pyspark.sql import functions as F

    sizes = {(f"b{k:02d}", s): 14 + 40 * (k % 5 == 0) for k in range(20) for s in range(2)}
    obs = frame(spark, sizes)
    rows = factorial.cell_rows(obs, factorial.design(obs))
    cores = spark.sparkContext.defaultParallelism
    out = factorial.dealt(rows, factorial.CELL, factorial.cell_cost(4, 4, 2)).withColumn("task", F.spark_partition_id())
    held = out.groupBy(*factorial.CELL).agg(F.countDistinct("task").alias("tasks"), F.min("task").alias("task"), F.count(F.lit(1)).alias("n")).collect()
    assert {r.tasks for r in held} == {1} and len(held) == 120 and len({r.task for r in held}) >= cores
    cost = factorial.cell_cost(4, 4, 2)
    load = {}
    for r in held:
        load[r.task] = load.get(r.task, 0) + cost((r.block_id, r.method, r.dropout_rate), r.n)
    assert max(load.values()) <= 1.5 * sum(load.values()) / len(load)
    spark.sql("SET spark.sql.adaptive.enabled").collect()
    results = factorial.execute(obs, factorial.design(obs), 4, particles=4, window=2)
    assert results.rdd.getNumPartitions() >= cores and results.count() == 120


def test_many_cells_are_dealt_by_hash(spark, monkeypatch):
    obs = frame(spark, {(f"b{k}", s): 12 for k in range(6) for s in range(2)})
    few = {tuple(r[:3]): r.occupied_clusters for r in factorial.execute(obs, factorial.design(obs), 4, particles=4, window=2).collect()}
    monkeypatch.setattr(factorial, "PACKED_CELLS", 5)
    many = {tuple(r[:3]): r.occupied_clusters for r in factorial.execute(obs, factorial.design(obs), 4, particles=4, window=2).collect()}
    assert many == few and len(few) == 36


# --- the base


def test_pooled_states_are_those_of_all_observations(spark):
    from pyspark.sql import functions as F

    obs = frame(spark, {(f"b{k}", 0): 3 + 17 * k for k in range(6)}).withColumn("x1", F.col("x1") * 1e-3 + 1e7)  # deviations far smaller than the mean
    x = np.array([(r.x0, r.x1) for r in obs.select("x0", "x1").collect()])
    states = moment_states(obs, ("block_id",))
    whole = pooled(states)
    means, variances = base_of(whole)
    assert whole["n"] == len(x) and means == pytest.approx(x.mean(0), rel=1e-14) and variances == pytest.approx(x.var(0, ddof=1), rel=1e-7)
    parts = [pooled(states.where(c)) for c in ("block_id < 'b3'", "block_id >= 'b3'", "block_id = 'none'")]
    joined = extended(extended(parts[2], parts[0]), parts[1])  # what was pooled before isn't read again
    assert joined["n"] == len(x) and base_of(joined)[1] == pytest.approx(variances, rel=1e-9)
    with pytest.raises(ValueError):
        base_of(parts[2])


@pytest.mark.parametrize("method", ["vi", "smc"])
def test_a_fixed_base_is_the_same_whatever_is_learned_first(method):
    rng = np.random.default_rng(3)
    means, variances, models = [4.5, -0.3], [0.4, 1.2], []
    for n in (10, 7):
        x, t = rng.normal(size=(n, 2)), rng.uniform(0, 6, n)
        model = StreamingMixture(Prior(k=4), (means, variances)) if method == "vi" else ParticleFilter(x, particles=4, base=(means, variances))
        model.learn(x, t)
        models.append(model)
    for m in models:
        assert m.m0 == pytest.approx(means) and m.b0 == pytest.approx([1.5 * v for v in variances])
    for bad in (([0, 0], [0, 1]), ([0, np.inf], [1, 1]), ([0], [1])):
        with pytest.raises(ValueError):
            StreamingMixture(Prior(k=4), bad) if method == "vi" else ParticleFilter(np.zeros((9, 2)), particles=4, base=bad)


def test_cells_have_the_base_they_are_given(spark):
    obs = frame(spark, {("b1", 0): 40, ("b1", 1): 30})
    cells = factorial.design(obs, dropouts=(0.0,))
    own, fixed = (
        {r.method: r.mean_prequential_log_score for r in factorial.execute(obs, cells, 4, particles=8, window=2, base=base).collect()} for base in (None, ([0.0, 0.0], [9.0, 9.0]))
    )
    x = np.array([(r.x0, r.x1) for r in obs.orderBy("snapshot_index", "obs_index").collect()])
    t = np.array([r.theta for r in obs.orderBy("snapshot_index", "obs_index").collect()])
    m = StreamingMixture(Prior(k=4), ([0.0, 0.0], [9.0, 9.0]))
    m.learn(x[:40], t[:40])
    assert fixed["streaming_vi"] == pytest.approx(m.log_predictive(x[40:], t[40:]).mean(), rel=1e-12)
    assert all(abs(own[k] - fixed[k]) > 1e-3 for k in own)


# --- calibration and its lock


def test_usable_is_for_every_snapshot_and_block(spark):
    """A block whose first snapshot is small, one that loses a snapshot, and one that has none of it at a rate."""
    whole = {("b1", 0): 60, ("b1", 1): 20, ("b2", 0): 60, ("b2", 1): 20}
    use = lambda sizes, **more: {r.k: (r.usable, r.tail_weight_q95 is not None) for r in factorial.calibrate(frame(spark, sizes), (4, 8, 60), **more).collect()}
    assert use(whole) == {4: (True, True), 8: (True, True), 60: (False, False)}
    assert use(whole | {("b2", 0): 6})[8] == (False, False)
    gone = dict(whole)
    del gone["b2", 1]
    assert {v for v, _ in use(gone).values()} == {False}
    assert {v for v, _ in use(whole, snapshots=3).values()} == {False}
    first = frame(spark, whole).where("NOT (block_id = 'b2' AND snapshot_index = 0)")
    assert not any(r.usable for r in factorial.calibrate(first, (4, 8)).collect())


def test_calibration_is_that_of_plain_models(spark):
    from vireo.operators.features import DROPOUTS, batches

    obs = frame(spark, {(f"b{k}", s): 40 for k in range(4) for s in range(2)})
    rows = factorial.retained(obs).toPandas()
    x = np.array([(r.x0, r.x1) for r in obs.collect()])
    base = x.mean(0), x.var(0, ddof=1)
    for r in factorial.calibrate(obs, (4, 8)).collect():
        tails, full = [], []
        for b in sorted(set(rows.block_id)):
            models = []
            for d in DROPOUTS:
                m = StreamingMixture(Prior(k=r.k), base)
                for _, xs, t in batches(rows[(rows.block_id == b) & (rows.dropout_rate == d)]):
                    m.learn(xs, t)
                models.append(m)
            tails.append(max(m.weights()[-1] for m in models))
            full.append(max(float(m.active() >= r.k) for m in models))
        assert r.tail_weight_q95 == pytest.approx(np.quantile(tails, 0.95)) and r.saturation_rate == pytest.approx(np.mean(full))
        assert r.passed == (np.quantile(tails, 0.95) <= 0.01 and np.mean(full) <= 0.05)


def test_lock_carries_the_pooled_base(spark, phases, locked):
    obs = with_features(phases["calibration"])
    x = np.array([(r.x0, r.x1) for r in obs.select("x0", "x1").collect()])
    assert locked["base_mean"] == pytest.approx(x.mean(0)) and locked["base_variance"] == pytest.approx(x.var(0, ddof=1))
    last = max(r.api_time for r in phases["calibration"].select("api_time").collect())
    assert locked["calibration_api_time_end"] == last and len(set(locked["calibration_block_sha256"])) == 2
    assert factorial.checked_lock(spark, json.loads(json.dumps(locked)), True) == locked


def resealed(body, **change):
    body = {k: v for k, v in (body | change).items() if k != "lock_sha256"}
    return body | {"lock_sha256": sha256(body)}


BAD_FIELDS = {
    "base_mean": [1.0, 2.0], "base_variance": [1.0, -1.0], "calibration_blocks": ["calibration-0001", "formal-0002"], "calibration_block_sha256": ["a" * 64], "calibration_api_time_end": 0,
    "selected_k": 8, "candidate_diagnostics": [], "dropout_levels": [0.0], "endpoints": ["x"], "environment_sha256": "0" * 64, "endpoint_protocol": "other", "scope": "public", "tail_threshold": 1e-9,
    "implementation_sha256": "0" * 64,
}


@pytest.mark.parametrize("field", sorted(BAD_FIELDS))
def test_every_field_of_a_lock_is_checked(spark, locked, field):
    with pytest.raises(ValueError):
        factorial.checked_lock(spark, locked | {field: BAD_FIELDS[field]})  # the seal
    with pytest.raises(ValueError):
        factorial.checked_lock(spark, resealed(locked, **{field: BAD_FIELDS[field]}))


def confirmatory(body):
    """A lock as a confirmatory study would have it."""
    fits = [{"k": k, "usable": True, "tail_weight_q95": 0.5 if k < 16 else 0.001, "saturation_rate": 0.0, "passed": k >= 16} for k in factorial.GRID]
    return resealed(
        body, **factorial.FROZEN, scope="confirmatory", contract=factorial.COLLECTION, candidate_diagnostics=fits, selected_k=16, calibration_blocks=[f"calibration-{k:04d}" for k in range(1, 11)],
        calibration_block_sha256=[f"{k:064x}" for k in range(10)],
    )


@pytest.mark.parametrize(
    "change",
    [{"particles": 4}, {"alpha": 0.1}, {"selected_k": 32}, {"base_seed": 1}, {"rejuvenation_window": 2}, {"tail_threshold": 0.02}, {"calibration_blocks": ["calibration-0001"], "calibration_block_sha256": ["1" * 64]}, {"contract": factorial.COLLECTION | {"interval_seconds": 4.0}}],
)
def test_a_confirmatory_lock_has_the_frozen_settings(spark, locked, change):
    good = confirmatory(locked)
    assert factorial.checked_lock(spark, good)["selected_k"] == 16
    with pytest.raises(ValueError):
        factorial.checked_lock(spark, resealed(good, **change))
    shorter = [d for d in good["candidate_diagnostics"] if d["k"] != 12]
    with pytest.raises(ValueError):
        factorial.checked_lock(spark, resealed(good, candidate_diagnostics=shorter))


def test_gates_of_calibration(spark, phases):
    for more in ({"expected_blocks": 2}, {"expected_blocks": 3, "validation_only": True}, {"expected_blocks": 2, "validation_only": True, "grid": (6, 4)}, {"expected_blocks": 2, "validation_only": True, "tail_threshold": 1.0}, {"expected_blocks": 2, "validation_only": True, "blocks": 1}):
        with pytest.raises(ValueError):
            study.calibrate(spark, phases["calibration"], **({"grid": (4, 6)} | more))
    with pytest.raises(ValueError):
        study.calibrate(spark, phases["late"], 2, (4, 6), True)
    with pytest.raises(RuntimeError):
        study.calibrate(spark, phases["calibration"], 2, (4,), True, **(SETTINGS | {"tail_threshold": 0.0}))


# --- the study


def test_formal_blocks_start_after_calibration(spark, phases, locked, tmp_path):
    with pytest.raises(ValueError, match="overlap"):
        study.run(spark, phases["early"], locked, (tmp_path / "r1").as_uri(), 2, validation_only=True)
    with pytest.raises(ValueError, match="100"):
        study.run(spark, phases["late"], locked, (tmp_path / "r2").as_uri(), 2)
    out = study.run(spark, phases["late"], locked, (tmp_path / "r3").as_uri(), 2, validation_only=True)
    assert out.count() == 12
    base = locked["base_mean"], locked["base_variance"]
    obs = with_features(phases["late"])
    again = factorial.execute(obs, factorial.design(obs), locked["selected_k"], 4, 2, base=base, exact=True)
    score = lambda df: {tuple(r[c] for c in factorial.CELL): r.mean_prequential_log_score for r in df.collect()}
    assert score(out) == pytest.approx(score(again))
    other = resealed(locked, base_state=extended(locked["base_state"], {"n": 5, "mean": [0.0, 0.0], "squares": [1.0, 1.0]}))
    with pytest.raises(ValueError):  # a base that isn't that of its state
        study.run(spark, phases["late"], other, (tmp_path / "r4").as_uri(), 2, validation_only=True)


def test_timed_cells_run_alone(spark, monkeypatch):
    """A cluster's tasks ask for all cores of an executor; a local session runs one cell after another, and rows say so."""
    assert factorial.executor_cores("local[8]", "4") is None and factorial.executor_cores("spark://h:7077", None) is None and factorial.executor_cores("yarn", "4") == 4
    obs = frame(spark, {(f"b{k}", s): 14 for k in range(3) for s in range(2)})
    out = factorial.execute(obs, factorial.design(obs), 4, particles=4, window=2, timed=True)
    assert out.rdd.getNumPartitions() == 1 and out.count() == 18
    assert "alone" in study.DEVICE
    monkeypatch.setattr(factorial, "executor_cores", lambda master, cores: 4)
    profile, tasks = factorial.alone(spark)
    assert profile.taskResources["cpus"].amount == 4 and tasks == 3


def test_particle_filters_side_by_side_are_those_of_each_cell_alone(monkeypatch):
    """The same labels and scores, in about as many steps as the longest cell has, not as all have together."""
    from vireo.operators import smc

    rng, cells, steps = np.random.default_rng(12), [], [0]
    for n in (30, 24, 41, 36, 30):
        x = rng.normal(size=(2 * n, 2)) * [1.0, 3.0]
        cells.append([(x[:n], rng.uniform(0, 6, n)), (x[n:], rng.uniform(0, 6, n))])
    real = smc.ParticleFilters.step

    def counted(self, row):
        steps[0] += 1
        return real(self, row)

    monkeypatch.setattr(smc.ParticleFilters, "step", counted)
    filters = smc.ParticleFilters([smc.own_base(c[0][0]) for c in cells], [3, 4, 5, 6, 7], particles=8, window=4)
    found, together = {c: rest for c, *rest in smc.side_by_side(filters, cells)}, steps[0]
    each = []
    for c, ((x, t), (y, u)) in enumerate(cells):
        steps[0] = 0
        alone = ParticleFilter(x, particles=8, window=4, seed=3 + c)
        alone.learn(x, t)
        scores = alone.log_predictive(y, u)
        alone.learn(y, u)
        each.append(steps[0])
        assert found[c][0] == pytest.approx(scores, abs=1e-12) and found[c][1].tolist() == alone.map_partition().tolist()
        assert found[c][2] == pytest.approx(np.mean(alone.ess_history))
    assert together == max(each) and any(n > 2 * len(c[0][0]) for n, c in zip(each, cells, strict=True))


def test_calibration_deals_each_row_once_for_all_k(spark, monkeypatch):
    real, dealt = factorial.dealt, []
    monkeypatch.setattr(factorial, "dealt", lambda rows, *args, **more: dealt.append(rows) or real(rows, *args, **more))
    obs = frame(spark, {(f"b{k}", s): 40 for k in range(2) for s in range(2)})
    factorial.calibrate(obs, (4, 6, 8))
    assert "k" not in dealt[0].columns and dealt[0].count() == factorial.retained(obs).count()
