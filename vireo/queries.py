"""Registered queries for the mixture laboratory, each over the whole ``events`` table, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vireo.operators import metrics, vi
from vireo.operators.features import DROPOUTS, base_moments, base_of, hash_uniform, stable_seed, thinned, with_features, with_uniform
from vireo.operators.sanitize import counts, pseudonym, sanitised, usable_category
from vireo.plans import factorial
from vireo.sources.events import events, spoiled, states
from vireo.sources.tables import written

SEED, K = 2026, 4
SALT = bytes(range(32))
PRIOR = vi.Prior(k=K)
PAIR = ("view", "purchase")


def _states(spark: SparkSession, d: str) -> DataFrame:
    return states(events(spark, d))


def _obs(spark: SparkSession, d: str) -> DataFrame:
    return with_features(sanitised(_states(spark, d)).where("accepted"))


def _kept(spark: SparkSession, d: str) -> DataFrame:
    return thinned(with_uniform(_obs(spark, d), SEED))


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that engines that add in another order agree; no negative zero."""
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def sanitize_counts(spark, d):
    return counts(sanitised(spoiled(_states(spark, d)))).select("block_id", "snapshot_index", "eligible_observations", "rejected_incomplete_states")


def dedup_first(spark, d):
    return sanitised(spoiled(_states(spark, d))).where("accepted").select("block_id", "snapshot_index", "obs_index", "ordinal", "identity", "category")


def features(spark, d):
    return _r(_obs(spark, d).select("ordinal", "x0", "x1", "theta", F.coalesce("category", F.lit(-1)).alias("category")))


def pseudonym_hmac(spark, d):
    return _states(spark, d).select("ordinal", pseudonym(F.col("identity"), SALT).alias("track_key"))


def stable_seeds(spark, d):
    return _states(spark, d).select("block_id", "snapshot_index").distinct().select("block_id", "snapshot_index", stable_seed(F.lit(SEED), F.col("block_id"), F.col("snapshot_index")).alias("seed"))


def nested_mask_counts(spark, d):
    scored = F.count_if(F.col("snapshot_index") > 0)
    return _kept(spark, d).groupBy("block_id", "dropout_rate").agg(
        F.count(F.lit(1)).alias("retained_observations"), scored.alias("scored_observations"), F.count_if(usable_category(F.col("category"))).alias("category_observations")
    )


def mask_is_nested(spark, d):
    """Observations kept at a rate and not at a lower one: none, for each pair of rates."""
    each = _kept(spark, d).groupBy("ordinal").agg(F.collect_set("dropout_rate").alias("rates"))
    pairs = [(a, b) for a in DROPOUTS for b in DROPOUTS if a < b]
    broken = [F.count_if(F.array_contains("rates", b) & ~F.array_contains("rates", a)).alias(f"broken_{i}") for i, (a, b) in enumerate(pairs)]
    return each.agg(F.count(F.lit(1)).alias("n"), *broken)


def moments(spark, d):
    return _r(base_moments(_obs(spark, d), ("block_id",)))


def eligible_blocks(spark, d):
    per = counts(sanitised(_states(spark, d))).groupBy("block_id").agg(F.min("eligible_observations").alias("least"), F.count(F.lit(1)).alias("snapshots"))
    return per.withColumn("accepted", (F.col("least") >= 32) & (F.col("snapshots") == 6))


def _spans(spark, d):
    """First and last event of each snapshot in epoch microseconds."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events(spark, d).withColumn("at", at)
    s = states(rows).select("block_id", "snapshot_index", "ordinal").join(rows.select(F.col("event_id").alias("ordinal"), "at"), "ordinal")
    return s.groupBy("block_id", "snapshot_index").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def chronology_violations(spark, d):
    """Snapshots that don't start after the one before within the block, and whether the block starts after the block before."""
    s = _spans(spark, d)
    inside = Window.partitionBy("block_id").orderBy("snapshot_index")
    bad = s.withColumn("bad", F.coalesce(F.col("first_at") <= F.lag("last_at").over(inside), F.lit(False)))
    blocks = bad.groupBy("block_id").agg(F.count_if("bad").alias("snapshots_out_of_order"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    across = Window.orderBy("block_id")  # a row per block
    return blocks.select("block_id", "snapshots_out_of_order", F.coalesce(F.col("first_at") <= F.lag("last_at").over(across), F.lit(False)).alias("overlaps"))


def _first(spark, d):
    return _obs(spark, d).where("snapshot_index = 0")


def _enough(first: DataFrame) -> DataFrame:
    """Observations of blocks whose first snapshot has K of them: the model can't start with fewer."""
    n = F.count(F.lit(1)).over(Window.partitionBy("block_id"))
    return first.withColumn("__n", n).where(F.col("__n") >= K).drop("__n")


def init_seeds(spark, d):
    return _r(vi.seeds(_enough(_first(spark, d)), ["block_id"], K))


def _hard(spark, d):
    """Observations of startable blocks with hard labels: quarter of the heading circle."""
    ok = _enough(_first(spark, d)).select("block_id").distinct()
    return _obs(spark, d).join(ok, "block_id", "left_semi").withColumn("label", F.least(F.floor(F.col("true_track") / 90), F.lit(K - 1)).cast("int"))


def _one_hot(df: DataFrame) -> DataFrame:
    return df.withColumn("r", F.transform(F.sequence(F.lit(0), F.lit(K - 1)), lambda i: F.when(i == F.col("label"), 1.0).otherwise(0.0)))


def suff_stats_hard(spark, d):
    return _r(vi.statistics(_one_hot(_hard(spark, d)), ["block_id"]))


def _hard_parameters(spark, d):
    rows = _hard(spark, d)
    return vi.parameters(vi.statistics(_one_hot(rows), ["block_id"]), base_moments(rows, ("block_id",)), ["block_id"], PRIOR)


def posterior_params(spark, d):
    return _r(_hard_parameters(spark, d).select("block_id", "k", "kappa", "mean0", "mean1", "a", "b0", "b1", "e0", "e1"))


def stick_params(spark, d):
    return _r(_hard_parameters(spark, d).select("block_id", "k", "sa", "sb"))


def expected_weights(spark, d):
    return _r(vi.weighted(_hard_parameters(spark, d), ["block_id"], K).select("block_id", "k", "weight", "log_weight"))


def _by_snapshot(spark, d):
    return vi.statistics(_one_hot(_hard(spark, d)), ["block_id", "snapshot_index"])


def forgetting_merge(spark, d):
    """Statistics merged snapshot by snapshot with forgetting 0.9."""
    rows = _by_snapshot(spark, d)
    state = rows.where("snapshot_index = 0").drop("snapshot_index")
    for t in range(1, 6):
        state = vi.merged(state, rows.where(F.col("snapshot_index") == t), ["block_id"], 0.9)
    return _r(state.select("block_id", "k", "n", "s0", "s1", "dc", "ds"))


def forgetting_closed_form(spark, d):
    """The same in one aggregate: a snapshot weighs 0.9 to the number of snapshots after it."""
    w = F.pow(F.lit(0.9), 5 - F.col("snapshot_index"))
    return _r(_by_snapshot(spark, d).groupBy("block_id", "k").agg(*(F.sum(w * F.col(c)).alias(c) for c in ("n", "s0", "s1", "dc", "ds"))))


def _fitted(spark, d, snapshots: int = 6) -> vi.Fitted:
    return vi.fit(_obs(spark, d), ["block_id"], PRIOR, snapshots, keep=_written, extra=("ordinal",))


def vi_responsibilities(spark, d):
    """Of all observations, under the final posterior."""
    out = _fitted(spark, d).responsibilities()
    return _r(out.select("ordinal", *(F.get("r", F.lit(k)).alias(f"r{k}") for k in range(K))), 4)


def argmax_labels(spark, d):
    """Final labels of all observations, and how sure they are."""
    out = vi.labels(_fitted(spark, d).responsibilities())
    return _r(out.select("ordinal", "label", F.array_max("r").alias("responsibility")), 4)


def vi_one_step(spark, d):
    """Statistics after the first snapshot: one pass from the seeds."""
    return _r(_fitted(spark, d, 1).states[-1], 4)


def vi_log_predictive(spark, d):
    """Each observation after the first snapshot, under what was learned from the snapshots before its own."""
    return _r(_fitted(spark, d).scores().select("ordinal", "log_density"), 3)


def vi_prequential(spark, d):
    """Mean score of all snapshots after the first, each under what was learned before it, and the final residual weight."""
    model = _fitted(spark, d)
    last = vi.weighted(vi.parameters(model.states[-1], model.base, ["block_id"], PRIOR), ["block_id"], K).where(F.col("k") == K - 1)
    score = model.scores().groupBy("block_id").agg(F.avg("log_density").alias("mean_prequential_log_score"), F.count(F.lit(1)).alias("scored_observations"))
    return _r(score.join(last.select("block_id", F.col("weight").alias("tail_weight")), "block_id"), 5)


def _written(df: DataFrame, name: str) -> DataFrame:
    from vireo.sources.tables import written

    return written(df, name)


def occupied_clusters(spark, d):
    return _hard(spark, d).groupBy("block_id").agg(F.countDistinct("label").alias("occupied_clusters"))


def category_coverage(spark, d):
    """By method and rate, as in the study; methods share their masks."""
    usable = usable_category(F.col("category"))
    per = _kept(spark, d).groupBy("block_id", "dropout_rate").agg(F.count(F.lit(1)).alias("retained_observations"), F.count_if(usable).alias("category_observations"))
    return factorial.coverage(per.withColumn("method", F.explode(F.array(*map(F.lit, factorial.METHODS)))))


def nmi(spark, d):
    return _r(metrics.nmi(_hard(spark, d), ["block_id"]))


def _tails(spark, d):
    """A residual weight and an indicator per block, from hard labels at each rate."""
    kept = thinned(with_uniform(_hard(spark, d), SEED))
    n = kept.groupBy("block_id", "dropout_rate").agg(F.count_if(F.col("label") == K - 1).alias("last"), F.count(F.lit(1)).alias("n"))
    return n.groupBy("block_id").agg(F.max(F.col("last") / F.col("n")).alias("tail"), F.max((F.col("last") * 4 >= F.col("n")).cast("double")).alias("saturated"))


def tail_q95(spark, d):
    return _r(_tails(spark, d).agg(F.percentile("tail", F.lit(0.95)).alias("tail_weight_q95")))


def saturation_rate(spark, d):
    return _r(_tails(spark, d).agg(F.avg("saturated").alias("saturation_rate")))


def _cells(spark, d):
    """A made-up endpoint per cell: mean value by day, views and purchases against all other kinds as method, third of the hours as rate."""
    e = events(spark, d)
    rate = F.element_at(F.array(*map(F.lit, DROPOUTS)), F.hour("ts") % 3 + 1)
    rows = e.select(F.datediff("ts", F.lit("2024-01-01")).cast("string").alias("block_id"), F.when(F.col("event_type").isin(*PAIR), factorial.METHODS[0]).otherwise(factorial.METHODS[1]).alias("method"), rate.alias("dropout_rate"), "value")
    return rows.groupBy("block_id", "method", "dropout_rate").agg(F.avg("value").alias("endpoint"), F.count(F.lit(1)).alias("n"))


def _cube(spark, d):
    return metrics.contrast_cube(_cells(spark, d), "endpoint", factorial.METHODS, DROPOUTS)


def contrast_cube(spark, d):
    return _r(_cube(spark, d))


def paired_contrasts(spark, d):
    return _r(metrics.contrast_moments(metrics.contrasts(_cube(spark, d))))


def _p(spark, d):
    """A p-like number for each contrast: where its estimate stands among numbers of that size."""
    m = metrics.contrast_moments(metrics.contrasts(_cube(spark, d)))
    return m.select("contrast", F.round(F.exp(-F.abs(F.col("t"))), 9).alias("p"))


def holm(spark, d):
    return _r(metrics.holm_column(_p(spark, d), []))


def _draws(spark, d):
    """Events as four chains by their number. The statistics are defined for chains of one length only: of a number that
    four doesn't divide, the last one to three events have no place in them."""
    e = events(spark, d)
    n = metrics.in_order(e.select((F.col("event_id") % 4).alias("chain"), "event_id", "value"), "chain", "event_id", metrics.BUCKET, "draw").select("chain", F.col("draw").cast("int").alias("draw"), "value")
    least = n.groupBy("chain").count().agg(F.min("count").alias("least")).first().least
    return n.where(F.col("draw") <= F.lit(least or 0))


def avg_ranks(spark, d):
    """Ranks of values rounded to tenths within their kind, so that there are ties."""
    e = events(spark, d).select("event_id", "event_type", F.round("value", 1).alias("value"))
    return _r(metrics.average_ranks(e, "value", ["event_type"]).select("event_id", "rank"))


def split_rhat_raw(spark, d):
    return _r(metrics.rhat(metrics.split_chains(_draws(spark, d))))


def _particles(spark, d):
    """All events as particles, 64 to a cell by their number, weighted by their values."""
    cell = F.floor(F.col("event_id") / 64).alias("cell")
    e = events(spark, d).select(cell, (F.col("event_id") % 64).alias("particle"), F.col("value").alias("v"))
    return e.withColumn("weight", F.col("v") / F.sum("v").over(Window.partitionBy("cell"))).drop("v")


def particle_ess(spark, d):
    return _r(metrics.particle_ess(_particles(spark, d), ["cell"]))


def resample_ancestors(spark, d):
    return metrics.ancestors(_particles(spark, d), ["cell"], 0.37)


def log_mean_weight(spark, d):
    """Log of the sum of exponentials, by the largest first."""
    p = _particles(spark, d).withColumn("l", F.log("weight") * 3)
    top = p.withColumn("m", F.max("l").over(Window.partitionBy("cell")))
    return _r(top.groupBy("cell").agg((F.first("m") + F.log(F.sum(F.exp(F.col("l") - F.col("m"))))).alias("logsumexp")))


def design_cross(spark, d):
    return factorial.design(_states(spark, d))


def pending_cells(spark, d):
    """Cells without a result; those count as done whose number of rows four doesn't divide."""
    all_cells = factorial.design(_cells(spark, d))
    return factorial.pending(all_cells, _cells(spark, d).where("n % 4 != 0"), SEED)


def leakage(spark, d):
    """Blocks that are in both parts when the days that two divides calibrate and those that three divides, or neither, are formal."""
    blocks = _states(spark, d).select("block_id").distinct().withColumn("day", F.substring("block_id", 8, 4).cast("int"))
    return factorial.leaked(blocks.where("day % 2 = 0"), blocks.where("day % 3 = 0 OR day % 2 != 0"))


def key_equality(spark, d):
    """Cells expected and not found, and found and not expected."""
    cells, keys = factorial.design(_cells(spark, d)), factorial.CELL
    found = _cells(spark, d).where("n % 4 != 0").select(*keys)
    return cells.exceptAll(found).withColumn("side", F.lit("missing")).union(found.exceptAll(cells).withColumn("side", F.lit("unexpected")))


def unique_ids(spark, d):
    """Per block: observations, identities, and whether one identity is in two places of a snapshot."""
    o = _obs(spark, d)
    return o.groupBy("block_id", "snapshot_index").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("identity").alias("identities")).withColumn("unique", F.col("n") == F.col("identities"))


def result_violations(spark, d):
    """Rules that the made-up results break: a count off by one on odd days, a late time on days that three divides."""
    obs = _obs(spark, d)
    cells = factorial.design(obs)
    expected = factorial.expected_counts(obs, cells, SEED).where("retained_observations IS NOT NULL")
    day, vi_cell = F.substring("block_id", 8, 4).cast("int"), F.col("method") == factorial.METHODS[0]
    results = expected.withColumns(
        {
            "retained_observations": F.col("retained_observations") + day % 2, "occupied_clusters": F.when(day % 5 == 0, 0).otherwise(F.lit(3)), "mean_prequential_log_score": F.lit(-1.5),
            "compute_latency_ms": F.when(day % 3 == 0, -1.0).otherwise(F.col("retained_observations") * 0.5), "compute_latency_ms_per_observation": F.lit(0.5),
            "tail_weight": F.when(vi_cell, 0.01), "particle_ess": F.when(~vi_cell, 40.0), "success": day % 7 != 0,
        }
    )
    out = factorial.violations(results, expected, 8)
    return out.select("block_id", "method", "dropout_rate", F.array_join("rules", ",").alias("rules"))


def mean_score(spark, d):
    """Mean of snapshots after the first, for a score that needs no model: minus the distance from the middle."""
    s = -F.abs(F.col("x0") - 4) - F.abs("x1")
    return _r(_kept(spark, d).where("snapshot_index > 0").groupBy("block_id", "dropout_rate").agg(F.avg(s).alias("mean_prequential_log_score")))


def chain_autocovariance(spark, d):
    """Autocovariances of a chain's first lags, by a self join on the draw."""
    draws = _draws(spark, d)
    x = draws.join(F.broadcast(draws.groupBy("chain").agg(F.avg("value").alias("mean"))), "chain").withColumn("c", F.col("value") - F.col("mean"))
    lags = x.select("chain", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("lag"), "draw", "c")
    later = x.select("chain", F.col("draw").alias("at"), F.col("c").alias("c2"))
    pairs = lags.withColumn("at", F.col("draw") + F.col("lag")).join(later, ["chain", "at"])
    n = x.groupBy("chain").agg(F.count(F.lit(1)).alias("n"))
    return _r(pairs.groupBy("chain", "lag").agg(F.sum(F.col("c") * F.col("c2")).alias("s")).join(n, "chain").select("chain", "lag", (F.col("s") / F.col("n")).alias("autocovariance")), 4)


def snapshot_union(spark, d):
    """Snapshots one after another, with their places in the whole block."""
    obs = _obs(spark, d)
    sizes = obs.groupBy("block_id", "snapshot_index").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("block_id").orderBy("snapshot_index").rowsBetween(Window.unboundedPreceding, -1)  # a row per snapshot
    first = sizes.select("block_id", "snapshot_index", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return obs.join(first, ["block_id", "snapshot_index"]).select("block_id", "ordinal", (F.col("first") + F.col("obs_index")).cast("int").alias("place"))


def arc_distance(spark, d):
    """Shortest arc between a heading and 350 degrees."""
    turn = F.pmod(F.col("true_track") - 350, F.lit(360.0))
    return _r(_states(spark, d).select("ordinal", F.least(turn, 360 - turn).alias("arc")))


def gem_residual(spark, d):
    """Residual stick weight after as many sticks as a block has snapshots, for a concentration that grows with its day."""
    b = counts(sanitised(_states(spark, d))).groupBy("block_id").agg(F.count(F.lit(1)).alias("k"), F.sum("eligible_observations").alias("n"))
    alpha = F.log1p("n")
    return _r(b.select("block_id", F.pow(alpha / (1 + alpha), F.col("k") - 1).alias("residual"), (1 - F.pow(alpha / (1 + alpha), F.col("k") - 1)).alias("represented")))


def mask_demo(spark, d):
    """A mask of 73 i mod 101 over event ids."""
    u = F.pmod(F.col("event_id") * 73, F.lit(101)) / 101.0
    return events(spark, d).groupBy((F.col("event_id") % 10).alias("digit")).agg(*(F.count_if(u >= r).alias(f"kept_{i}") for i, r in enumerate(DROPOUTS)))


def rhat_demo(spark, d):
    """Plain potential scale reduction of whole chains."""
    return _r(metrics.rhat(_draws(spark, d).withColumn("side", F.lit(0))))


def ess_demo(spark, d):
    """Draws that a first-order autoregression leaves of the chains."""
    return _r(metrics.first_order_ess(_draws(spark, d)), 4)


def uniforms(spark, d):
    """The uniform numbers themselves."""
    o = _obs(spark, d)
    return _r(o.select("ordinal", hash_uniform(stable_seed(F.lit(SEED), F.col("block_id"), F.col("snapshot_index")), F.col("obs_index")).alias("u")), 12)


# --- sequential or random kernels ---------------------------------------------------------------------


FIT_K = 8  # of factorial.execute and factorial.partitions, whose defaults hold below


def _fit_cells(spark, d):
    """Blocks whose most thinned first snapshot can start the model, six snapshots each.

    Observations are written once, as all that follows reads them several times, and the blocks' names, so that Spark sees how few they are.
    """
    obs = written(_obs(spark, d).select("block_id", "snapshot_index", "obs_index", "x0", "x1", "theta", "category"), "observations")
    first = thinned(with_uniform(obs, SEED), (max(DROPOUTS),)).groupBy("block_id").agg(F.count_if(F.col("snapshot_index") == 0).alias("n"), F.countDistinct("snapshot_index").alias("s"))
    ok = written(first.where((F.col("n") >= FIT_K) & (F.col("s") == 6)).select("block_id"), "blocks")
    return obs.join(ok, "block_id", "left_semi")


def _executed(spark, d):
    """All cells, both methods and three rates, every model with the base that all observations give."""
    obs = _fit_cells(spark, d)
    return factorial.execute(obs, factorial.design(obs), FIT_K, base_seed=SEED, base=base_of(factorial.pooled_base(obs)))


def factorial_results(spark, d):
    """Results of all cells; latency aside, which no two runs share."""
    out = _executed(spark, d)
    return _r(out.drop("compute_latency_ms", "compute_latency_ms_per_observation"))


def factorial_contrasts(spark, d):
    out = _executed(spark, d)
    return metrics.contrast_moments(metrics.contrasts(metrics.contrast_cube(out, "mean_prequential_log_score", factorial.METHODS, DROPOUTS)))


def calibration_diagnostics(spark, d):
    return _r(factorial.calibrate(_obs(spark, d), base_seed=SEED))


def vi_kernel_labels(spark, d):
    obs = _fit_cells(spark, d)
    cells = factorial.design(obs, (factorial.METHODS[0],), (0.0,))
    return factorial.partitions(obs, cells, FIT_K, base_seed=SEED, base=base_of(factorial.pooled_base(obs)))


def exact_mask_counts(spark, d):
    """The same counts as nested_mask_counts from numpy's stream instead of digests."""
    return factorial.expected_counts(_obs(spark, d), factorial.design(_obs(spark, d), (factorial.METHODS[0],)), SEED, exact=True)


def rank_rhat(spark, d):
    out = metrics.rank_rhat(_draws(spark, d))
    return _r(spark.range(1).select(*(F.lit(v).alias(k) for k, v in out.items())))


def bulk_ess(spark, d):
    return _r(spark.range(1).select(F.lit(metrics.bulk_ess(_draws(spark, d))).alias("ess")), 3)


#: Those with SQL of their own; what needs the mixture's posterior (the vi_ queries and argmax_labels) runs it in Arrow batches.
CHECKED = (
    sanitize_counts, dedup_first, features, pseudonym_hmac, stable_seeds, nested_mask_counts, mask_is_nested, moments, eligible_blocks, chronology_violations, init_seeds, suff_stats_hard, posterior_params,
    stick_params, expected_weights, forgetting_merge, forgetting_closed_form, vi_responsibilities, argmax_labels, vi_one_step, vi_log_predictive, vi_prequential, occupied_clusters, category_coverage, nmi,
    tail_q95, saturation_rate, contrast_cube, paired_contrasts, holm, avg_ranks, split_rhat_raw, particle_ess, resample_ancestors, log_mean_weight, design_cross, pending_cells, leakage, key_equality, unique_ids,
    result_violations, mean_score, chain_autocovariance, snapshot_union, arc_distance, gem_residual, mask_demo, rhat_demo, ess_demo, uniforms,
)
KERNELS = (factorial_results, factorial_contrasts, calibration_diagnostics, vi_kernel_labels, exact_mask_counts, rank_rhat, bulk_ess)
QUERIES = {f.__name__: f for f in (*CHECKED, *KERNELS)}
