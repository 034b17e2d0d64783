import math

import numpy as np
import pytest

from vireo.functions import special
from vireo.operators import vi
from vireo.operators.features import base_moments, nested_keep_mask, seed_of, with_exact_uniform
from vireo.operators.smc import ParticleFilter


def clusters(n=90, seed=1):
    """Three groups in uneven shares: a tight one, a long diagonal one, and one whose headings lie around north."""
    rng = np.random.default_rng(seed)
    at = np.sort(rng.choice(3, n, p=[0.5, 0.3, 0.2]))[rng.permutation(n)]
    at[:3] = [0, 1, 2]
    along = rng.uniform(-1, 1, n)
    x = np.where(at[:, None] == 0, [-1.0, 2.0], np.where(at[:, None] == 1, np.column_stack([8 + along, along]), [3.0, -4.0])) + rng.normal(0, 0.1, (n, 2))
    return x, np.choose(at, [1.1, 4.0, 0.0]) + rng.laplace(0, 0.1, n), at


def test_special_functions():
    assert special.digamma(np.array([1.0, 0.5])) == pytest.approx([-0.5772156649015329, -1.9635100260214235], rel=1e-13)
    x = np.array([0.0, 1e-8, 0.3, 1.0, 10.0, 39.9, 40.1, 700.0])
    terms = [1.0] + [sum(math.exp(2 * k * math.log(v / 2) - 2 * math.lgamma(k + 1)) for k in range(120)) for v in x[1:6]]
    assert special.log_i0(x)[:6] == pytest.approx(np.log(terms), abs=1e-12)
    assert np.all(np.diff(special.log_i0(x)) >= 0) and np.all(np.diff(special.a1(x)) > 0) and special.a1(0.0) == 0
    assert special.a1(np.array([39.999999, 40.000001])) == pytest.approx(np.full(2, special.a1(40.0)), abs=1e-8)
    assert special.t_quantile(0.975, 9) == pytest.approx(2.2621571627409915, rel=1e-10)
    assert special.t_two_sided(2.2621571627409915, 9) == pytest.approx(0.05, rel=1e-10)


def test_special_columns(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(v,) for v in (0.05, 0.7, 3.0, 39.0, 55.0, 900.0)], "x double")
    for r in rows.select("x", special.digamma_column(F.col("x")).alias("d")).collect():
        assert r.d == pytest.approx(float(special.digamma(r.x)), rel=1e-11)


def test_log_i0_is_exact_everywhere():
    """Between the table's places, at its end and beyond, against the sums that the table is made from and against the power series."""
    x = np.concatenate([np.linspace(0, 300, 60_001), [255.99, 256.0, 256.01, 1e3, 1e5], np.geomspace(1e-12, 1, 500)])
    assert special.log_i0(x) == pytest.approx(special._summed_log_i0(x), rel=2e-15, abs=4e-14)
    for v in (0.01, 1.7, 9.3):
        series = sum(math.exp(2 * k * math.log(v / 2) - 2 * math.lgamma(k + 1)) for k in range(80))
        assert float(special.log_i0(v)) == pytest.approx(math.log(series), rel=1e-12)
    assert special.log_i0(np.array([[-2.0], [2.0]])).shape == (2, 1) and special.log_i0(-2.0) == special.log_i0(2.0)


def test_vi_invariants():
    x, t, _ = clusters()
    m = vi.StreamingMixture(vi.Prior(k=6))
    assert m.weights().sum() == pytest.approx(1)
    r = m.learn(x[:60], t[:60])
    assert r.sum(1) == pytest.approx(np.ones(60)) and m.stats[:, 0].sum() == pytest.approx(60) and m.weights().sum() == pytest.approx(1)
    before = m.stats.copy()
    with pytest.raises(ValueError):
        m.learn(np.full((3, 2), np.nan), np.zeros(3))
    assert (m.stats == before).all()
    m.learn(x[60:], t[60:])
    assert m.stats[:, 0].sum() == pytest.approx(90)
    assert m.log_predictive(x, t) == pytest.approx(m.log_predictive(x, t + 2 * math.pi))
    f = vi.StreamingMixture(vi.Prior(k=6, forgetting=0.5))
    f.learn(x[:10], t[:10])
    f.learn(x[10:17], t[10:17])
    assert f.stats[:, 0].sum() == pytest.approx(12)
    for bad in ({"k": 1}, {"k": True}, {"alpha": 0.0}, {"forgetting": 1.5}, {"heading_kappa": math.inf}):
        with pytest.raises(ValueError):
            vi.Prior(**bad)


def test_heading_predictive_integrates_to_one():
    q = {"kappa": np.array([[1.0]]), "mean": np.zeros((1, 2)), "a": np.array([[2.5, 2.5]]), "b": np.ones((1, 2)), "eta": np.array([[12.0, -7.0]])}
    t = (np.arange(4000) + 0.5) * 2 * math.pi / 4000
    line = vi.predictive(np.zeros((1, 2)), np.array([0.0]), q, 6.0)[0, 0]
    far = np.hypot(12 + 6 * np.cos(0.0), -7 + 6 * np.sin(0.0))
    fixed = line - (special.log_i0(far) - special.log_i0(np.hypot(12.0, -7.0)) - special.LOG_2PI - special.log_i0(6.0))
    dens = np.exp(vi.predictive(np.zeros((4000, 2)), t, q, 6.0)[:, 0] - fixed)
    assert dens.mean() * 2 * math.pi == pytest.approx(1, abs=1e-9)


def test_particles():
    x, t, at = clusters(60)
    f = ParticleFilter(x[:20], particles=16, window=6, seed=3)
    f.learn(x[:40], t[:40])
    frozen, rng = f.stats.copy(), f.rng.bit_generator.state
    a = f.log_predictive(x[40:], t[40:])
    assert f.log_predictive(x[40:][::-1], t[40:][::-1])[::-1] == pytest.approx(a)
    assert (f.stats[:, : frozen.shape[1]] == frozen).all() and f.rng.bit_generator.state == rng
    assert all(1 - 1e-9 <= e <= 16 + 1e-9 for e in f.ess_history) and f.stats[..., 0].sum(1) == pytest.approx(np.full(16, 40))
    # A particle's counts agree with its assignments, and its mixture with the written-out predictive.
    for p in range(16):
        assert np.bincount(f.assigned[p], minlength=f.stats.shape[1]) == pytest.approx(f.stats[p, :, 0])
    f.learn(x[40:], t[40:])
    labels = f.map_partition()
    assert len(labels) == 60 and len(np.unique(labels[at == 0])) <= 3
    again = ParticleFilter(x[:20], particles=16, window=6, seed=3)
    again.learn(x, t)
    assert len(again.map_partition()) == 60


class PlainFilter:
    """The same filter without arrays: a particle is a list of clusters, a cluster a list of observations, densities from the formulas."""

    def __init__(self, first, particles, window, seed, alpha=1.5, hk=6.0, kappa0=0.05, a0=2.5):
        self.m0, self.v0 = first.mean(0), first.var(0, ddof=1)
        self.alpha, self.hk, self.kappa0, self.a0, self.window = alpha, hk, kappa0, a0, window
        self.rng, self.seen = np.random.Generator(np.random.PCG64(seed)), []
        self.particles, self.w = [([[]], []) for _ in range(particles)], [1 / particles] * particles
        self.scores, self.ess = [], []

    def density(self, own, row):
        out, n = 0.0, len(own)
        for d in (0, 1):
            x = [self.seen[i][d] for i in own]
            kappa, a = self.kappa0 + n, self.a0 + n / 2
            mean = (self.kappa0 * self.m0[d] + sum(x)) / kappa
            b = self.v0[d] * (self.a0 - 1) + 0.5 * (sum(v * v for v in x) + self.kappa0 * self.m0[d] ** 2 - kappa * mean**2)
            scale2, nu = b * (kappa + 1) / (a * kappa), 2 * a
            out += math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi * scale2) - (nu + 1) / 2 * math.log1p((row[d] - mean) ** 2 / (nu * scale2))
        c, s = (self.hk * sum(f(self.seen[i][2]) for i in own) for f in (math.cos, math.sin))
        far = math.hypot(c + self.hk * math.cos(row[2]), s + self.hk * math.sin(row[2]))
        i0 = lambda v: float(special._summed_log_i0(np.array(v)))
        return out + i0(far) - i0(math.hypot(c, s)) - math.log(2 * math.pi) - i0(self.hk)

    def draw(self, row):
        """A slot for each particle, and the evidence; the first empty slot is a new cluster."""
        room = max(len(c) for c, _ in self.particles)
        if any(all(own for own in c) and len(c) == room for c, _ in self.particles):
            room += 1
        u, slots, evidence = self.rng.random(len(self.particles)), [], []
        for (clusters, _), v in zip(self.particles, u, strict=True):
            clusters += [[] for _ in range(room - len(clusters))]
            fresh = next(k for k, own in enumerate(clusters) if not own)
            p = [len(own) * math.exp(self.density(own, row)) if own else self.alpha * math.exp(self.density([], row)) * (k == fresh) for k, own in enumerate(clusters)]
            edges = np.cumsum(p)
            slots.append(int((v * edges[-1] >= edges).sum()))
            evidence.append(sum(p))
        return slots, evidence

    def learn(self, x, t):
        for row in np.column_stack([x, t]):
            slots, evidence = self.draw(row)
            n = len(self.seen)
            self.seen.append(row)
            joint = [w * e / (n + self.alpha) for w, e in zip(self.w, evidence, strict=True)]
            self.scores.append(math.log(sum(joint)))
            self.w = [j / sum(joint) for j in joint]
            self.ess.append(1 / sum(w * w for w in self.w))
            for (clusters, path), s in zip(self.particles, slots, strict=True):
                clusters[s].append(n)
                path.append(s)
            if self.ess[-1] < len(self.w) / 2:
                edges, p = np.cumsum(self.w), len(self.w)
                edges[-1] = 1.0
                at = np.searchsorted(edges, (self.rng.random() + np.arange(p)) / p)
                self.particles = [([list(own) for own in self.particles[k][0]], list(self.particles[k][1])) for k in at]
                self.w = [1 / p] * p
                for i in range(max(0, n + 1 - self.window), n + 1):
                    for clusters, path in self.particles:
                        clusters[path[i]].remove(i)
                    for (clusters, path), s in zip(self.particles, self.draw(self.seen[i])[0], strict=True):
                        clusters[s].append(i)
                        path[i] = s


def test_filter_equals_one_without_arrays():
    rng = np.random.default_rng(8)
    x, t = rng.normal(size=(70, 2)) * [1.0, 3.0], rng.uniform(0, 2 * math.pi, 70)
    f, plain = ParticleFilter(x[:20], particles=6, window=5, seed=11), PlainFilter(x[:20], 6, 5, 11)
    f.learn(x, t)
    plain.learn(x, t)
    assert sum(e < 3 for e in plain.ess) >= 5  # so that paths are resampled and swept again and again
    assert f.score_history == pytest.approx(plain.scores, rel=1e-10) and f.ess_history == pytest.approx(plain.ess, rel=1e-9)
    assert f.assigned.tolist() == [path for _, path in plain.particles]
    assert f.map_partition().tolist() == plain.particles[int(np.argmax(f.log_w))][1]


@pytest.mark.parametrize("window", [0, 3, 24])
def test_paths_are_those_of_a_matrix_and_take_little_room(window):
    from vireo.operators.smc import Paths

    rng, p, n = np.random.default_rng(4), 16, 4000
    paths, matrix = Paths(p, window), np.zeros((p, 0), int)
    for _ in range(n):
        slots = rng.integers(0, 9, p)
        paths.append(slots)
        matrix = np.concatenate([matrix, slots[:, None]], axis=1)
        if rng.random() < 0.15:
            at = np.sort(rng.choice(p, p, p=rng.dirichlet(np.full(p, 0.4))))
            paths.resample(at)
            matrix = matrix[at]
            for i in range(max(0, matrix.shape[1] - window), matrix.shape[1]):
                paths.at(i)[:] = matrix[:, i] = rng.integers(0, 9, p)
        if rng.random() < 0.01:
            assert np.array_equal(np.stack([paths.path(k) for k in range(p)]), matrix)
    assert np.array_equal(np.stack([paths.path(k) for k in range(p)]), matrix)
    assert paths.places < n + 40 * p * (window + 12) and paths.places < 0.5 * matrix.size


def test_jumps_give_the_stream():
    from vireo.operators.features import stream_at

    whole, rng = np.random.default_rng(99).random(5000), np.random.default_rng(1)
    for places in (np.arange(5000), np.array([4999]), np.array([7, 3, 7, 0]), rng.integers(0, 5000, 300), np.array([], int)):
        assert stream_at(99, places).tolist() == whole[places].tolist()


def test_order_in_groups_of_any_size(spark):
    """Groups far larger than a stretch, ties, nulls as keys; no plan sorts a whole group."""
    import pandas as pd
    from pyspark.sql import functions as F

    from vireo.operators import order

    rng = np.random.default_rng(2)
    rows = pd.DataFrame({"g": rng.choice(["a", "a", "a", "b", "c"], 6000), "v": rng.normal(size=6000).round(1), "id": rng.permutation(6000)})
    rows.loc[rows.g == "c", "g"] = None
    df = spark.createDataFrame(rows).repartition(5)
    out = order.ranked(df, ["g"], "v", "id", "place", 200).toPandas().sort_values("id")
    expect = rows.sort_values(["v", "id"]).groupby("g", dropna=False).cumcount().sort_index()
    assert out.place.tolist() == expect.loc[rows.sort_values("id").index].tolist()
    largest = order.ranked(df, ["g"], "v", "id", "place", 200)
    assert "__stretch" in largest._jdf.queryExecution().optimizedPlan().toString()
    got = order.numbered(df, ["g"], "id", "n", 100).toPandas().sort_values("id")
    assert got.n.tolist() == rows.sort_values("id").groupby("g", dropna=False).cumcount().tolist()
    assert order.ranked(df.where(F.lit(False)), ["g"], "v", "id", "place").count() == 0


def test_masks():
    kept = [nested_keep_mask(500, d, 7) for d in (0.0, 0.15, 0.3)]
    assert kept[0].all() and (kept[1] <= kept[0]).all() and (kept[2] <= kept[1]).all()
    with pytest.raises(ValueError):
        nested_keep_mask(5, 1.0, 7)
    assert seed_of(2026, "formal-0001", 0) == seed_of("2026", "formal-0001", "0")


def test_native_equals_kernel(spark, tmp_path):
    import pandas as pd

    from vireo.sources.tables import written

    x, t, _ = clusters(180, 4)
    rows = pd.DataFrame({"cell": np.where(np.arange(180) % 2, "b", "a"), "snapshot_index": np.arange(180) // 60, "obs_index": np.arange(180) % 60, "x0": x[:, 0], "x1": x[:, 1], "theta": t % (2 * math.pi)})
    obs, p = spark.createDataFrame(rows), vi.Prior(k=5)
    model = vi.fit(obs, ["cell"], p, 3, keep=written)
    state, scored = model.states[-1], model.scores()
    labels = {(r.cell, r.snapshot_index, r.obs_index): r.r for r in model.responsibilities().collect()}
    got = {c: np.array([[r[s] for s in vi.STATS] for r in state.where(f"cell = '{c}'").orderBy("k").collect()]) for c in "ab"}
    scores = {(r.cell, r.snapshot_index, r.obs_index): r.log_density for r in scored.collect()}
    for c in "ab":
        model = vi.StreamingMixture(p)
        for s in range(3):
            part = rows[(rows.cell == c) & (rows.snapshot_index == s)].sort_values("obs_index")
            xs, ts = part[["x0", "x1"]].to_numpy(), part["theta"].to_numpy()
            if s:
                assert [scores[c, s, o] for o in part.obs_index] == pytest.approx(model.log_predictive(xs, ts), rel=1e-7)
            model.learn(xs, ts)
        assert got[c] == pytest.approx(model.stats, rel=1e-7, abs=1e-7)
        part = rows[rows.cell == c]
        want = model.responsibilities(part[["x0", "x1"]].to_numpy(), part["theta"].to_numpy())
        assert np.array([labels[c, s, o] for s, o in zip(part.snapshot_index, part.obs_index, strict=True)]) == pytest.approx(want, abs=1e-7)
    few = vi.fit(obs.where("cell = 'a' OR obs_index < 4"), ["cell"], p, 3, keep=written)  # b has too few observations to start
    assert {r.cell for r in few.states[-1].collect()} == {"a"} == {r.cell for r in few.scores().collect()}


@pytest.fixture
def stream_of(spark, tmp_path):
    """Cell a has three snapshots, cell b the last two; a micro-batch a snapshot."""
    import pandas as pd

    x, t, _ = clusters(150, 6)
    at = np.arange(150)
    rows = pd.DataFrame({"cell": np.where(at < 90, "a", "b"), "snapshot_index": np.where(at < 90, at // 30, 1 + (at - 90) // 30), "obs_index": at % 30, "x0": x[:, 0], "x1": x[:, 1], "theta": t % (2 * math.pi)})
    obs = spark.createDataFrame(rows).selectExpr("cell", "cast(snapshot_index as int) snapshot_index", "cast(obs_index as int) obs_index", "x0", "x1", "theta")

    def feed(*snapshots):
        for s in snapshots:
            obs.where(f"snapshot_index = {s}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    return rows, obs, feed, lambda: spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def posterior(state, cell):
    return np.array([[r[s] for s in vi.STATS] for r in state.where(f"cell = '{cell}'").orderBy("k").collect()])


def test_online_model_survives_a_restart(spark, tmp_path, stream_of):
    """Stopped after the first batch, and killed in the middle of the second: a new process goes on from the folder alone."""
    from vireo.streaming.online import OnlineMixture

    rows, obs, feed, stream = stream_of
    folder, prior = f"file://{tmp_path}/state", vi.Prior(k=4)

    def go(model):
        stream().writeStream.foreachBatch(model).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    feed(0)
    first = OnlineMixture(["cell"], prior, folder)
    go(first)
    assert first.versions() == [0]
    feed(1, 2)

    class Killed(Exception):
        pass

    def dies(scores, batch_id, t):
        raise Killed

    with pytest.raises(Exception, match="Killed"):
        go(OnlineMixture(["cell"], prior, folder, dies))
    assert first.versions() == [0]
    seen = {}
    again = OnlineMixture(["cell"], prior, folder, lambda scores, batch_id, t: seen.update({(t, r.cell, r.obs_index): r.log_density for r in scores.collect()}))
    go(again)
    assert again.versions() == [0, 1, 2] and not again.scratch
    for cell in "ab":
        kernel = vi.StreamingMixture(prior)
        for s, part in rows[rows.cell == cell].groupby("snapshot_index"):
            x, t = part[["x0", "x1"]].to_numpy(), part["theta"].to_numpy()
            if kernel.stats is not None:
                assert [seen[s, cell, o] for o in part.obs_index] == pytest.approx(kernel.log_predictive(x, t))
            kernel.learn(x, t)
        assert posterior(again.state(spark), cell) == pytest.approx(kernel.stats, rel=1e-9)
    with pytest.raises(ValueError, match="snapshot 1 came after snapshot 2"):
        again(obs.where("snapshot_index = 1"), 99)  # late for its cell
    again(obs, 0)  # a batch that came before is skipped
    with pytest.raises(ValueError, match="can't start"):
        again(obs.where("snapshot_index = 2 AND obs_index < 3 AND cell = 'a'").selectExpr("'c' AS cell", "snapshot_index", "obs_index", "x0", "x1", "theta"), 99)
    again(obs.where("snapshot_index = 1 AND cell = 'a'").selectExpr("'c' AS cell", "0 AS snapshot_index", "obs_index", "x0", "x1", "theta"), 99)  # its own order counts
    assert {r.cell: r["last"] for r in again.state(spark).select("cell", "last").distinct().collect()} == {"a": 2, "b": 2, "c": 0}


@pytest.fixture
def typed_state(spark):
    from vireo.streaming.online import use_typed_state

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    use_typed_state(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


@pytest.mark.parametrize("method", ["vi", "smc"])
def test_kernel_stream(spark, tmp_path, stream_of, typed_state, method):
    """Stopped between batches and started again; the state is a table, and a late snapshot fails the query."""
    from vireo.streaming.online import kernel_stream

    rows, obs, feed, stream = stream_of
    point = str(tmp_path / "c2")

    def go():
        out = kernel_stream(stream(), method, k=4, particles=8, window=3)
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", point).trigger(availableNow=True).start().awaitTermination()

    feed(0)
    go()
    feed(1, 2)
    go()
    got = {(r.cell, r.snapshot_index): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 5
    for cell in "ab":
        kernel = vi.StreamingMixture(vi.Prior(k=4)) if method == "vi" else None
        for s, part in rows[rows.cell == cell].groupby("snapshot_index"):
            x, t = part[["x0", "x1"]].to_numpy(), part["theta"].to_numpy()
            if kernel is None:
                kernel = ParticleFilter(x, particles=8, window=3, seed=seed_of(2026, cell))
                assert got[cell, s].mean_log_score is None
            elif method == "smc" or kernel.stats is not None:
                assert got[cell, s].mean_log_score == pytest.approx(kernel.log_predictive(x, t).mean(), rel=1e-9)
            kernel.learn(x, t)
        if method == "vi":
            state = spark.read.format("statestore").option("stateVarName", "components").load(point)
            table = {r.key.cell: {} for r in state.collect()}
            for r in state.collect():
                table[r.key.cell][r.user_map_key.k] = [r.user_map_value[c] for c in vi.STATS]
            assert np.array([table[cell][k] for k in range(4)]) == pytest.approx(kernel.stats, rel=1e-9)
    progress = {r.key.cell: r.value for r in spark.read.format("statestore").option("stateVarName", "progress").load(point).collect()}
    assert {c: v["last"] for c, v in progress.items()} == {"a": 2, "b": 2}
    feed(1)
    with pytest.raises(Exception, match="snapshot 1 came after snapshot 2"):
        go()


def test_silent_cells_are_closed(spark, tmp_path, stream_of, typed_state):
    import time

    from vireo.streaming.online import kernel_stream

    _, _, feed, stream = stream_of
    feed(0)
    out = kernel_stream(stream(), "vi", k=4, silent_ms=1500).writeStream.format("memory").queryName("silent").option("checkpointLocation", str(tmp_path / "c3")).trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            if spark.table("silent").where("n = 0").count():
                break
        closed = spark.table("silent").where("n = 0").collect()
        assert [(r.cell, r.snapshot_index, r.occupied) for r in closed] == [("a", 0, None)]
        feed(1)
        with pytest.raises(Exception, match="closed for silence"):
            out.processAllAvailable()
    finally:
        out.stop()


def test_exact_uniforms_follow_numpy(spark, sf):
    from vireo.queries import _obs

    obs = _obs(spark, sf)
    drawn = with_exact_uniform(obs, 2026)
    plan, before = (df._jdf.queryExecution().executedPlan().toString() for df in (drawn, obs))
    assert plan.count("Exchange") == before.count("Exchange")  # nothing is shuffled after obs_index
    rows = drawn.where("block_id = 'formal-0001' AND snapshot_index = 2").orderBy("obs_index").collect()
    assert [r.u for r in rows] == list(np.random.default_rng(seed_of(2026, "formal-0001", 2)).random(len(rows)))
    assert base_moments(obs).first().v0 > 0
