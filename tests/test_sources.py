import copy
import json

import pytest

from vireo.operators.sanitize import counts, forbidden_fields, parsed_payloads, pseudonym, sanitised
from vireo.plans import factorial
from vireo.plans.provenance import canonical_json, sha256, without_nan, write_once
from vireo.sources import blocks, rest

KEY = bytes(range(32))
BOX = (49.0, 7.0, 54.0, 13.0)


def row(i, **change):
    r = [f"{i:06x}", "SECRET", "Country", 100, 101, 8.2, 50.1, 9000.0, False, 80.0 + 90 * (i % 3) + i % 5, 120.0 * (i % 3) + i % 7, (i % 3 - 1) * 4 + 0.1 * (i % 5), None, None, "7700", False, 0, 2 + i % 3]
    for k, v in change.items():
        r[int(k[1:])] = v
    return r


class Feed:
    """A transport whose time advances by five seconds an answer."""

    def __init__(self, sizes=(), statuses=()):
        self.time, self.sizes, self.statuses, self.calls = 1_700_000_000, list(sizes), list(statuses), []

    def __call__(self, method, url, **ask):
        self.calls.append((method, url, ask))
        if method == "POST":
            return 200, {}, json.dumps({"access_token": f"t{len(self.calls)}", "expires_in": 100}).encode()
        status = self.statuses.pop(0) if self.statuses else 200
        self.time += 5
        n = self.sizes.pop(0) if self.sizes else 18
        return status, {"X-Rate-Limit-Remaining": "7"}, json.dumps({"time": self.time, "states": [row(i) for i in range(n)]}).encode()


def contract(**change):
    return rest.Contract(**({"bbox": BOX, "snapshots": 2, "interval": 5.0, "least": 12, "attempts": 3, "retry_delay": 1.0} | change))


def clean(payload):
    return rest.sanitised_payload(payload, KEY)


def test_payload_rules_agree_with_plain_python(spark):
    states = [row(1), row(2, _9=None), row(3, _9=float("nan")), row(4, _0="xyz"), row(5, _0=123456), row(6, _9=True), row(7, _9="5"), row(8, _9=-1.0), row(1), row(9, _0="00000A"), row(10, _0="00000a"), None, 7, [1, 2], row(11, _17=99), row(12, _17=3.0), row(13, _17=True)]
    states[2][9] = "nan"
    payload = {"time": 5, "states": states}
    frame = spark.createDataFrame([("b", 0, json.dumps(payload)), ("b", 1, json.dumps({"time": 6, "states": None}))], "block_id string, snapshot_index int, payload string")
    marked = sanitised(parsed_payloads(frame).where("ordinal IS NOT NULL"))
    mine = clean(payload)
    got = marked.where("accepted").orderBy("ordinal").select(pseudonym(marked.identity, KEY).alias("k"), "velocity", "category").collect()
    assert [(r.k, r.velocity, r.category) for r in got] == [(o["track_key"], o["velocity"], o["category"]) for o in mine["observations"]]
    c = counts(marked).first()
    assert (c.eligible_observations, c.rejected_incomplete_states) == (len(mine["observations"]), mine["rejected_incomplete_states"])
    for bad in (None, True, "123", 1.5, 0, -1):
        with pytest.raises(Exception):  # noqa: B017
            parsed_payloads(spark.createDataFrame([(json.dumps({"time": bad, "states": []}),)], "payload string")).collect()
        with pytest.raises(ValueError):
            clean({"time": bad, "states": []})


def test_acquisition_stops_at_the_first_good_block():
    feed, log, naps = Feed(sizes=[18, 5]), [], []
    block = rest.acquired(rest.Session(feed, "u"), contract(), "formal-0001", clean, sleep=naps.append, log=log.append)
    assert [r["outcome"] for r in log] == ["rejected", "accepted"] and log[0]["error"] == "EligibilityError" and log[0]["counts"] == [18]
    assert block["acceptance_policy"]["accepted_attempt"] == 2 and naps == [5.0, 1.0, 5.0]
    with pytest.raises(rest.AcquisitionError):
        rest.acquired(rest.Session(Feed(sizes=[1] * 9), "u"), contract(), "formal-0001", clean, sleep=naps.append)
    with pytest.raises(rest.AcquisitionError):
        rest.acquired(rest.Session(Feed(), "u"), contract(), "formal-0001", clean, after=1 << 40, sleep=naps.append)


def test_session_renews_tokens():
    now = [0.0]
    feed = Feed(statuses=[401, 200, 200])
    s = rest.Session(feed, "u", "t", ("id", "secret"), clock=lambda: now[0])
    s.states(BOX)
    assert [m for m, *_ in feed.calls] == ["POST", "GET", "POST", "GET"]
    now[0] = 60.0
    s.states(BOX)
    now[0] = 175.0
    s.states(BOX)
    assert [m for m, *_ in feed.calls[4:]] == ["GET", "POST", "GET"]
    with pytest.raises(rest.AcquisitionError):
        rest.Session(Feed(statuses=[429]), "u").states(BOX)


def test_blocks_round_trip_and_tampering(spark, tmp_path):
    feed = Feed()
    made = [rest.acquired(rest.Session(feed, "u"), contract(), f"formal-{k:04d}", clean, sleep=lambda s: None) for k in (1, 2)]
    for b in made:
        (tmp_path / f"{b['block_id']}.json.gz").write_bytes(blocks.packed(b))
    rows = blocks.read_blocks(spark, str(tmp_path), "formal")
    assert rows.count() == 72 and not forbidden_fields(rows.schema) and blocks.overlaps(rows).count() == 0
    assert blocks.packed(made[0]) == blocks.packed(copy.deepcopy(made[0]))
    out = blocks.write_blocks(spark.createDataFrame([(json.dumps(made[0]),)], "block string"), (tmp_path / "out").as_uri())
    assert out.first().content_sha256 == made[0]["integrity"]["content_sha256"]
    assert (tmp_path / "out" / "formal-0001.json.gz").read_bytes() == blocks.packed(made[0])

    def changed(f):
        b = copy.deepcopy(made[0])
        f(b)
        return b

    def every_observation(b):
        return [o for s in b["snapshots"] for o in s["observations"]]

    wrong = {
        "a snapshot is gone": lambda b: b["snapshots"].pop(),
        "snapshots stand in another order": lambda b: b["snapshots"].reverse(),
        "an observation is gone": lambda b: b["snapshots"][1]["observations"].pop(),
        "an observation moved to the next snapshot": lambda b: b["snapshots"][1]["observations"].append(b["snapshots"][0]["observations"].pop()),
        "a state vector became text": lambda b: every_observation(b)[5].update({k: str(v) for k, v in every_observation(b)[5].items() if isinstance(v, float)}),
        "a plain identity was put back": lambda b: every_observation(b)[0].update(icao24="abc123"),
    }
    for why, f in wrong.items():
        with pytest.raises(blocks.BlockError):
            blocks.verified(blocks.packed(blocks.sealed(changed(f))))
            pytest.fail(why)
    with pytest.raises(blocks.BlockError):
        blocks.verified(blocks.packed(changed(lambda b: b.update(interval_seconds=6.0))))


def test_state_stream(spark, tmp_path):
    spark.dataSource.register(rest.StateSource)
    q = spark.readStream.format("states").option("transport", "tests.test_sources:FEED").option("snapshots", "3").option("history", (tmp_path / "history").as_uri()).load()
    s = q.writeStream.format("memory").queryName("payloads").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    for _ in range(60):
        s.processAllAvailable()
        if spark.table("payloads").count() >= 3:
            break
    s.stop()
    assert [r.sequence for r in spark.table("payloads").orderBy("sequence").collect()] == [0, 1, 2]


FEED = Feed()


def test_payloads_are_read_again_after_a_restart(tmp_path):
    """What was handed out and not committed comes from the history; the transport isn't asked again."""
    ask = {"transport": "tests.test_sources:FEED", "snapshots": "9", "history": (tmp_path / "h").as_uri()}
    one = rest.StateReader(ask)
    rows, at = [], one.initialOffset()
    for _ in range(3):
        got, at = one.read(at)
        rows += got
    one.commit({"sequence": 1})
    asked = len(FEED.calls)
    two = rest.StateReader(ask)
    assert list(two.readBetweenOffsets({"sequence": 1}, {"sequence": 3})) == rows[1:] and len(FEED.calls) == asked
    assert list(two.read({"sequence": 2})[0]) == rows[2:] and len(FEED.calls) == asked
    with pytest.raises(rest.AcquisitionError):
        two.readBetweenOffsets({"sequence": 0}, {"sequence": 2})
    assert list(two.read({"sequence": 3})[0])[0][0] == 3


def test_live_example(spark):
    from vireo.plans import study

    snapshot = rest.fetch(rest.Session(Feed(), "u"), BOX, KEY)
    out = {r.dropout_rate: r for r in study.live_example(spark, snapshot).collect()}
    assert out[0.0].observations == len(snapshot["observations"]) and all(r.k == min(12, r.observations) and 1 <= r.occupied <= r.k for r in out.values())
    with pytest.raises(ValueError):
        study.live_example(spark, snapshot | {"observations": snapshot["observations"][:11]})
    with pytest.raises(ValueError):
        rest.fetch(rest.Session(Feed(), "u"), (54.0, 7.0, 49.0, 13.0), KEY)


def test_salt(tmp_path):
    p = str(tmp_path / "a" / "salt")
    assert rest.salt(p) == rest.salt(p) and len(rest.salt(p)) == 32
    (tmp_path / "short").write_bytes(b"x")
    with pytest.raises(rest.AcquisitionError):
        rest.salt(str(tmp_path / "short"))


def test_provenance(spark, tmp_path):
    assert canonical_json({"b": 1, "a": [1.5]}) == b'{"a":[1.5],"b":1}' and without_nan({"x": float("nan"), "y": [1]}) == {"x": None, "y": [1]}
    path = tmp_path / "lock.json"
    assert write_once(path, {"a": 1}) == sha256({"a": 1})
    with pytest.raises(FileExistsError):
        write_once(path, {})
    for same in (("True", True), ("1", True), ("false", False), (0, False)):
        assert factorial.fingerprint({"success": same[0]}) == factorial.fingerprint({"success": same[1]})
    assert factorial.fingerprint({"success": "False"}) != factorial.fingerprint({"success": True})
    for bad in ({"success": "no"}, {"occupied_clusters": "3.5"}, {"occupied_clusters": True}):
        with pytest.raises(ValueError):
            factorial.fingerprint(bad)
    assert factorial.fingerprint({"occupied_clusters": "3", "tail_weight": float("nan")}) == factorial.fingerprint({"occupied_clusters": 3, "tail_weight": None})


def test_factorial_end_to_end(spark, sf):
    from vireo import queries as q
    from vireo.operators import metrics

    obs = q._fit_cells(spark, "/root/testdata/sf0.01").where("block_id <= 'formal-0004'")
    cells = factorial.design(obs)
    results = factorial.execute(obs, cells, 4, particles=4, window=2).cache()
    assert factorial.violations(results, factorial.expected_counts(obs, cells), 4, 4).count() == 0
    assert factorial.pending(cells, results).count() == 0
    labels = factorial.partitions(obs, cells, 4, particles=4, window=2).join(obs.select("block_id", "snapshot_index", "obs_index", "category"), ["block_id", "snapshot_index", "obs_index"])
    agreement = {tuple(r[:3]): r.nmi for r in metrics.nmi(labels, factorial.CELL).collect()}
    assert {tuple(r): v for *r, v in results.select(*factorial.CELL, "category_nmi_evaluation_only").collect()} == pytest.approx(agreement)
    out = factorial.analyse(results)
    assert set(out) == set(factorial.ENDPOINTS) and all(len(v) == 8 for v in out.values()) and all(0 <= r["p_holm"] <= 1 for r in out["occupied_clusters"] if r["n"] >= 2)
    with pytest.raises(ValueError):
        factorial.analyse(results.where("dropout_rate < 0.3"))


def test_known_contrasts_and_agreement(spark):
    from vireo.operators import metrics

    rows = [(f"b{b}", m, d, 3.0 + k) for b in range(5) for k, m in enumerate(factorial.METHODS) for d in factorial.DROPOUTS]
    cube = metrics.contrast_cube(spark.createDataFrame(rows, "block_id string, method string, dropout_rate double, v double"), "v", factorial.METHODS, factorial.DROPOUTS)
    out = {r["contrast"]: r for r in metrics.inference(metrics.contrast_moments(metrics.contrasts(cube)))}
    assert out["paired_1"]["estimate"] == 1 and out["paired_1"]["p"] == 0 and out["dropout_linear"]["p"] == 1
    labels = spark.createDataFrame([("a", x, c) for x, c in zip([8, 8, 3, 3, 5, 5, 1], [2, 2, 3, 3, 4, 4, 13])] + [("b", 1, 0), ("c", 1, 2), ("c", 1, 2)], "cell string, label int, category int")
    got = {r.cell: r.nmi for r in metrics.nmi(labels, ["cell"]).collect()}
    assert got["a"] == pytest.approx(1) and got["b"] is None and got["c"] == 1
    assert metrics.holm([0.01, float("nan"), 0.04, 0.03])[0] == pytest.approx(0.03)


def test_chains(spark):
    import numpy as np
    import pandas as pd

    from vireo.operators import metrics

    rng = np.random.default_rng(2)
    x = rng.normal(size=(4, 200))
    ar = np.zeros((4, 200))
    for k in range(1, 200):
        ar[:, k] = 0.9 * ar[:, k - 1] + rng.normal(size=4)

    def frame(v):
        return spark.createDataFrame(pd.DataFrame({"chain": np.repeat(range(len(v)), v.shape[1]), "draw": np.tile(range(v.shape[1]), len(v)), "value": v.ravel()}))

    assert metrics.rank_rhat(frame(x))["max"] < 1.05 < metrics.rank_rhat(frame(x + np.array([[0], [0], [0], [4]])))["bulk"]
    assert metrics.bulk_ess(frame(x)) > 4 * metrics.bulk_ess(frame(ar))
    for bad in (x[:3], x[:, :10], np.where(np.arange(200) == 3, np.nan, x)):
        with pytest.raises(ValueError):
            metrics.rank_rhat(frame(bad))
    with pytest.raises(ValueError):
        metrics.bulk_ess(frame(np.ones((4, 40))))
    rho = np.mean([(d[:-1] * d[1:]).sum() / (d * d).sum() for d in ar - ar.mean(1, keepdims=True)])
    r = metrics.first_order_ess(frame(ar)).first()
    assert r.rho == pytest.approx(rho) and r.ess == pytest.approx(800 * (1 - rho) / (1 + rho)) and metrics.first_order_ess(frame(np.tile([1.0, -1.0], (4, 30)))).first().ess == 240


def test_chains_in_bounded_parts(spark, monkeypatch):
    """Ranks, medians and autocovariances of cut tables equal those of whole ones, and only a block of lags reaches the driver."""
    import statistics

    import numpy as np
    import pandas as pd

    from vireo.operators import metrics

    rng = np.random.default_rng(3)
    x = rng.normal(size=(4, 601)).round(2)
    for k in range(1, 601):
        x[:, k] = (0.8 * x[:, k - 1] + x[:, k]).round(2)
    draws = spark.createDataFrame(pd.DataFrame({"chain": np.repeat(range(4), 601), "draw": np.tile(range(601), 4), "value": x.ravel()}))
    halves = np.concatenate([x[:, :300], x[:, 301:]])
    inv = np.vectorize(statistics.NormalDist().inv_cdf)
    z = inv((pd.Series(halves.ravel()).rank().to_numpy() - 0.375) / (2400 + 0.25)).reshape(8, 300)
    c = z - z.mean(1, keepdims=True)
    cov = [(c[:, : 300 - k] * c[:, k:]).sum() / 2400 for k in range(300)]
    within = z.var(1, ddof=1).mean()
    total = 299 / 300 * within + z.mean(1).var(ddof=1)
    rho, sums = [1.0] + [1 - (within - v) / total for v in cov[1:]], []
    for k in range(0, 299, 2):
        if rho[k] + rho[k + 1] < 0:
            break
        sums.append(min([rho[k] + rho[k + 1], *sums[-1:]]))

    collect, most = type(draws).collect, []

    def counted(df):
        out = collect(df)
        most.append(len(out))
        return out

    monkeypatch.setattr(type(draws), "collect", counted)
    for bucket, lags in ((16_384, 64), (64, 4)):
        monkeypatch.setattr(metrics, "BUCKET", bucket, raising=False)
        monkeypatch.setattr(metrics, "LAGS", lags, raising=False)
        most.clear()
        assert metrics.bulk_ess(draws) == pytest.approx(2400 / (2 * sum(sums) - 1), rel=1e-9)
        assert max(most) <= 64
        split = metrics.split_chains(draws)
        assert metrics.middle(split, "value") == pytest.approx(np.median(halves))
        ranks = metrics.average_ranks(split, "value")
        assert "windowspecdefinition(value" not in ranks._jdf.queryExecution().optimizedPlan().toString()
        got = sorted((r.value, r["rank"]) for r in ranks.select("value", "rank").collect())
        assert got == sorted(zip(halves.ravel().tolist(), pd.Series(halves.ravel()).rank().tolist(), strict=True))


def test_study_stops_resumes_and_reports(spark, tmp_path):
    """Blocks from files to a summary: gates, a run cut off after its first wave, tampered rows, CSV and back."""
    from vireo.plans import study

    feed = Feed(sizes=[40] * 60)
    for name in ("calibration-0001", "calibration-0002", "formal-0001", "formal-0002", "formal-0003"):
        block = rest.acquired(rest.Session(feed, "u"), contract(), name, clean, sleep=lambda s: None)
        (tmp_path / f"{block['block_id']}.json.gz").write_bytes(blocks.packed(block))
    rows, calibration = (blocks.read_blocks(spark, str(tmp_path), phase) for phase in ("formal", "calibration"))
    promise = blocks.contract_of(block)
    lock = study.calibrate(spark, calibration, 2, (4, 24), True, tail_threshold=0.9, saturation_threshold=0.99, particles=4, rejuvenation_window=2)
    assert lock["calibration_blocks"] == ["calibration-0001", "calibration-0002"] and lock["selected_k"] == 24
    write_once(tmp_path / "lock.json", lock)
    assert study.read_lock(spark, tmp_path / "lock.json") == lock
    folder = (tmp_path / "results").as_uri()
    go = lambda **change: study.run(spark, **({"rows": rows, "lock": lock, "folder": folder, "expected_blocks": 3, "wave": 2, "validation_only": True} | change))
    for change in ({"expected_blocks": 2}, {"validation_only": False}, {"rows": rows.withColumn("phase", rows.snapshot_index.cast("string"))}, {"lock": lock | {"base_seed": 1}}):
        with pytest.raises(ValueError):
            go(**change)
    from pyspark.sql import functions as F

    broken = {
        "times": rows.withColumn("api_time", F.when(F.col("snapshot_index") == 1, 5).otherwise(F.col("api_time"))), "overlap": rows.withColumn("api_time", F.col("snapshot_index").cast("long") + 1),
        "contract": rows.withColumn("contract", F.lit("{}")), "repeated content": rows.withColumn("content_sha256", F.lit("x")),
    }
    for rule, changed in broken.items():
        assert any(rule in r.rules for r in study.block_faults(changed, "formal", promise).collect()), rule
    assert study.block_faults(rows, "formal", promise, after=10**10).count() == 1

    real, waves = factorial.execute, []

    def dies(*args, **more):
        waves.append(1)
        if len(waves) == 2:
            raise RuntimeError("killed")
        return real(*args, **more)

    factorial.execute = dies
    try:
        with pytest.raises(RuntimeError):
            go()
    finally:
        factorial.execute = real
    before = {tuple(r[c] for c in factorial.CELL): r.result_sha256 for r in study.stored(spark, folder).collect()}
    assert len(before) == 12
    out = go()
    after = {tuple(r[c] for c in factorial.CELL): r.result_sha256 for r in out.collect()}
    assert len(after) == 18 and before.items() <= after.items() and len(out.columns) == 21
    assert go().count() == 18  # nothing left to do

    from vireo.operators.features import with_features

    obs = with_features(rows)
    expected = study.expected_rows(obs, factorial.design(rows), lock)
    study.write_csv(out, (tmp_path / "csv").as_uri())
    back = study.read_csv(spark, str(tmp_path / "csv"))
    study.checked_results(back, expected, lock)
    assert sorted(map(str, back.collect())) == sorted(map(str, out.select(study.ROW.names).collect()))
    for name, change in {
        "altered": out.withColumn("occupied_clusters", F.col("occupied_clusters") + 1), "twice": out.union(out.limit(1)), "missing": out.where("dropout_rate < 0.3"),
        "other lock": study._sealed(out.withColumn("lock_sha256", F.lit("x"))), "other block": study._sealed(out.withColumn("block_sha256", F.lit("x"))),
        "agreement": study._sealed(out.withColumn("category_nmi_evaluation_only", F.lit(2.0))),
    }.items():
        with pytest.raises(ValueError):
            study.checked_results(change, expected, lock)
            pytest.fail(name)
    body = study.summary(out, expected, lock, 3, True)
    assert study.complete(body) and not study.complete(body | {"executions_completed": 17}) and len(body["endpoints"]) == 4
    for change in ({"expected_blocks": 2}, {"validation_only": False}):
        with pytest.raises(ValueError):
            study.summary(out, expected, lock, **({"expected_blocks": 3, "validation_only": True} | change))
    study.publish(body, tmp_path / "summary.json", tmp_path / "status.json")
    assert (tmp_path / "summary.json").exists() and not (tmp_path / "status.json").exists()  # validation only
    short = body | {"scope": "confirmatory"}  # three blocks are no confirmatory study, whatever the summary says of itself
    with pytest.raises(ValueError):
        study.publish(short, tmp_path / "summary2.json", tmp_path / "status.json")
    assert not (tmp_path / "status.json").exists()
    whole = short | {"blocks": 100, "executions_completed": 600, "executions_expected": 600}
    study.publish(whole, tmp_path / "summary3.json", tmp_path / "status.json")
    assert json.loads((tmp_path / "status.json").read_text())["executions_completed"] == 600
    (tmp_path / "short.csv").write_text("block_id,method\na,b\n")
    with pytest.raises(ValueError):
        study.read_csv(spark, str(tmp_path / "short.csv"))


def test_files_are_chosen_before_they_are_opened(spark, tmp_path):
    """Filters on phase and id are decided by names: broken files of others do no harm, and each file is a partition."""
    from pyspark.sql import functions as F

    feed = Feed()
    for name in ("formal-0001", "formal-0002", "formal-0003", "calibration-0001"):
        block = rest.acquired(rest.Session(feed, "u"), contract(), name, clean, sleep=lambda s: None)
        (tmp_path / f"{name}.json.gz").write_bytes(blocks.packed(block))
    for name in ("calibration-0002.json.gz", "formal-0009.json.gz"):
        (tmp_path / name).write_bytes(b"broken")
    (tmp_path / "notes.txt").write_text("x")
    some = blocks.read_blocks(spark, str(tmp_path), "formal", ["formal-0001", "formal-0003"])
    assert {r.block_id for r in some.select("block_id").distinct().collect()} == {"formal-0001", "formal-0003"}
    assert some.rdd.getNumPartitions() == 2  # files opened
    one = blocks.read_blocks(spark, tmp_path.as_uri(), "calibration").where("block_id = 'calibration-0001' AND snapshot_index = 1")
    assert one.rdd.getNumPartitions() == 1 and one.agg(F.min("snapshot_index")).first()[0] == 1
    assert blocks.read_blocks(spark, str(tmp_path), "formal", ["formal-0077"]).count() == 0
    with pytest.raises(Exception, match="unreadable block"):
        blocks.read_blocks(spark, str(tmp_path), "formal").count()


@pytest.fixture
def typed(spark):
    from vireo.streaming.online import use_typed_state

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    use_typed_state(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_collection_as_a_stream(spark, tmp_path, typed):
    """Windows of two snapshots over batches of any cut; poor and late snapshots reject attempts; a killed epoch leaves nothing and its lines come once."""
    from vireo.streaming import collect

    payloads = [{"time": t, "states": [row(i) for i in range(n)]} for t, n in ((5, 18), (10, 18), (15, 18), (20, 3), (25, 18), (25, 18), (30, 18), (35, 18), (40, 18))]

    def feed(*numbers):
        rows = [("one", k, json.dumps(payloads[k])) for k in numbers]
        spark.createDataFrame(rows, "collection string, sequence long, payload string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    folder = (tmp_path / "blocks").as_uri()

    def go():
        stream = spark.readStream.schema("collection string, sequence long, payload string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        found = collect.attempts(stream, contract(attempts=4), "formal", KEY)
        collect.collected(found, folder, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    def lines():
        return [json.loads(x) for p in sorted((tmp_path / "blocks" / "audit").glob("epoch-*.jsonl")) for x in p.read_text().splitlines()]

    feed(0, 1, 2)
    go()
    assert [(r["block_id"], r["outcome"]) for r in lines()] == [("formal-0001", "accepted")]
    feed(3, 4)
    feed(5, 6)  # the second 25 is late for the first, so the attempt starts again with 30
    move = blocks.EpochWriter.commit
    before = sorted(p.name for p in (tmp_path / "blocks").glob("*.json.gz"))
    writer = blocks.EpochWriter(folder)
    block = rest.acquired(rest.Session(Feed(), "u"), contract(), "formal-0050", clean, sleep=lambda s: None)
    staged = writer.write(iter([{"sequence": 1, "block": json.dumps(block), "record": "{}"}]))
    assert sorted(p.name for p in (tmp_path / "blocks").glob("*.json.gz")) == before and len(lines()) == 1  # nothing is seen before the commit
    writer.abort([staged, None], 7)
    assert not list((tmp_path / "blocks" / "_staged").iterdir())
    for _ in range(2):  # an epoch that comes again
        staged = writer.write(iter([{"sequence": 1, "block": json.dumps(block), "record": '{"x":1}'}]))
        move(writer, [staged], 99)
    assert (tmp_path / "blocks" / "formal-0050.json.gz").exists() and sum(r == {"x": 1} for r in lines()) == 1
    other = rest.acquired(rest.Session(Feed(), "u"), contract(), "formal-0050", lambda p: clean(p | {"time": p["time"] + 1}), sleep=lambda s: None)
    with pytest.raises(blocks.BlockError):
        move(writer, [writer.write(iter([{"sequence": 1, "block": json.dumps(other), "record": "{}"}]))], 100)
    go()
    feed(7, 8)
    go()
    got = [(r.get("block_id"), r.get("attempt"), r["outcome"], r.get("error")) for r in lines() if "outcome" in r]
    assert got == [
        ("formal-0001", 1, "accepted", None), ("formal-0002", 1, "rejected", "EligibilityError"), ("formal-0002", 2, "rejected", "AcquisitionError"), ("formal-0002", 3, "accepted", None),
    ]
    rows = blocks.read_blocks(spark, str(tmp_path / "blocks"), "formal", ["formal-0001", "formal-0002"])
    times = {(r.block_id, r.snapshot_index): r.api_time for r in rows.select("block_id", "snapshot_index", "api_time").distinct().collect()}
    assert times == {("formal-0001", 0): 5, ("formal-0001", 1): 10, ("formal-0002", 0): 30, ("formal-0002", 1): 35}
