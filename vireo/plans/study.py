"""A study over verified blocks: gates, a run that can be stopped and resumed, its rows, their export, and the summary.

Results are a Parquet table that grows by whole waves of blocks; a wave that was cut off leaves nothing. Each row has
the digests of its block, its lock, its code and its environment, and one of itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vireo.operators.features import DROPOUTS, base_of, with_features
from vireo.operators.vi import Prior, StreamingMixture
from vireo.plans import factorial
from vireo.plans.provenance import canonical_json, sha256, without_nan, write_once

#: Each row says how its latency was measured.
DEVICE, PROTOCOL = "cpu, a cell alone on its executor", factorial.PROTOCOL
_STRINGS = ("block_id", "block_sha256", "method", "device", "endpoint_protocol", "implementation_sha256", "execution_environment_sha256", "lock_sha256")
#: The 21 columns of a result.
ROW = T.StructType(
    [T.StructField(n, T.StringType()) for n in _STRINGS]
    + [f for f in factorial.RESULT.fields if f.name not in ("block_id", "method")]
    + [T.StructField("result_sha256", T.StringType())]
)


def read_lock(spark: SparkSession, path: str | Path, same_runtime: bool = True) -> dict:
    """A lock file, if it holds (see ``factorial.checked_lock``)."""
    body = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(body, dict) or body.get("status") != "locked":
        raise ValueError("no lock")
    return factorial.checked_lock(spark, body, same_runtime)


def block_faults(rows: DataFrame, phase: str, contract: dict, after: int = 0) -> DataFrame:
    """Blocks of ``rows`` (see ``blocks.read_blocks``) that can't be in the set, with the rules they break.

    Every block is of the phase and of one contract, no content comes twice, and each starts after the last of the block
    before it, the first after ``after``, with times that rise.
    """
    at = rows.groupBy("block_id", "phase", "content_sha256", "contract", "snapshot_index").agg(F.min("api_time").alias("time"), F.max("api_time").alias("until"))
    rises = F.coalesce(F.col("time") > F.lag("until").over(Window.partitionBy("block_id").orderBy("snapshot_index")), F.lit(True))
    each = at.withColumn("rises", rises & (F.col("time") == F.col("until"))).groupBy("block_id").agg(
        F.count(F.lit(1)).alias("snapshots"), F.countDistinct("snapshot_index").alias("different"), F.min("rises").alias("rises"), F.min("time").alias("first"),
        F.max("until").alias("last"), F.min("phase").alias("phase"), F.min("content_sha256").alias("digest"), F.min("contract").alias("contract"),
    )
    order = Window.orderBy("block_id")  # a row per block
    wanted = contract.get("snapshots_per_block", 2)
    rules = {
        "phase": (F.col("phase") != phase) | ~F.col("block_id").rlike(f"^{phase}-[0-9]{{4}}$"),
        "contract": F.col("contract") != canonical_json(contract).decode(),
        "repeated content": F.count(F.lit(1)).over(Window.partitionBy("digest")) > 1,
        "times": ~F.col("rises") | (F.col("snapshots") != F.col("different")) | (F.col("snapshots") != wanted),
        "overlap": F.col("first") <= F.coalesce(F.lag("last").over(order), F.lit(after)),
    }
    broken = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return each.withColumn("rules", broken).where(F.size("rules") > 0).select("block_id", "rules")


def checked_blocks(rows: DataFrame, phase: str, count: int, contract: dict, after: int = 0) -> None:
    found = rows.select("block_id").distinct().count()
    if found != count:
        raise ValueError(f"need {count} {phase} blocks, found {found}")
    worst = block_faults(rows, phase, contract, after).orderBy("block_id").first()
    if worst is not None:
        raise ValueError(f"{worst.block_id}: {', '.join(worst.rules)}")


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """Results written so far."""
    try:
        return spark.read.schema(ROW).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ROW)


def _fixed(lock: dict) -> dict[str, str]:
    return {
        "device": DEVICE, "endpoint_protocol": PROTOCOL, "implementation_sha256": lock["implementation_sha256"],
        "execution_environment_sha256": sha256(lock["environment"]), "lock_sha256": lock["lock_sha256"],
    }


def _sealed(results: DataFrame) -> DataFrame:
    def seal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(result_sha256=[factorial.fingerprint(r, ROW) for r in f.to_dict("records")])[ROW.names]

    return results.mapInPandas(seal, ROW)


def _altered(results: DataFrame) -> DataFrame:
    """Rows that aren't what their own digest says."""

    def differ(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[[r["result_sha256"] != factorial.fingerprint(r, ROW) for r in f.to_dict("records")]][factorial.CELL]

    return results.mapInPandas(differ, T.StructType([ROW[c] for c in factorial.CELL]))


def expected_rows(obs: DataFrame, cells: DataFrame, lock: dict, exact: bool = True) -> DataFrame:
    digests = obs.groupBy("block_id").agg(F.min("content_sha256").alias("block_sha256"))
    return factorial.expected_counts(obs, cells, lock["base_seed"], exact).join(digests, "block_id")


def checked_results(results: DataFrame, expected: DataFrame, lock: dict, complete: bool = True) -> None:
    """Raises at the first row that breaks a rule, lies outside the design, comes twice or was altered."""
    cells = results.groupBy(*factorial.CELL).count()
    outside = cells.join(expected, factorial.CELL, "left_anti").union(cells.where("count > 1")).first()
    if outside is not None:
        raise ValueError(f"a result is outside the design or comes twice: {outside[:3]}")
    altered = _altered(results).first()
    if altered is not None:
        raise ValueError(f"a result was altered: {tuple(altered)}")
    due = expected if complete else expected.join(cells, factorial.CELL, "left_semi")
    bad = factorial.violations(results, due, lock["selected_k"], lock["particles"], _fixed(lock)).first()
    if bad is not None:
        raise ValueError(f"{bad.block_id} {bad.method} {bad.dropout_rate}: {', '.join(bad.rules)}")


def protocol_count(count: int, wanted: int, what: str, validation_only: bool) -> int:
    """``count``, if it may be: outside of validation only the protocol's own."""
    if isinstance(count, bool) or not isinstance(count, int) or count < 1:
        raise ValueError(f"the number of {what} blocks must be a whole number of at least 1")
    if count != wanted and not validation_only:
        raise ValueError(f"a confirmatory study has {wanted} {what} blocks")
    return count


def calibrate(
    spark: SparkSession, rows: DataFrame, expected_blocks: int = factorial.CALIBRATION_BLOCKS, grid: tuple[int, ...] = factorial.GRID, validation_only: bool = False, exact: bool = True, **settings
) -> dict:
    """The lock that calibration blocks give (see ``blocks.read_blocks`` for ``rows``).

    ``settings`` change ``factorial.FROZEN``, for validation only. The blocks are of one contract and one after the other;
    their pooled observations are the base of every model, here and in the study; formal blocks start after the last of them.
    """
    protocol_count(expected_blocks, factorial.CALIBRATION_BLOCKS, "calibration", validation_only)
    if unknown := settings.keys() - factorial.FROZEN.keys():
        raise ValueError(f"no such setting: {', '.join(sorted(unknown))}")
    use = factorial.FROZEN | settings
    if not grid or list(grid) != sorted(set(grid)) or not all(0 <= use[k] < 1 for k in ("tail_threshold", "saturation_threshold")):
        raise ValueError("the K grid must increase and thresholds lie in [0, 1)")
    if not validation_only and (settings or tuple(grid) != factorial.GRID):
        raise ValueError("a confirmatory study can't change the frozen settings")
    one = rows.select("contract").first()
    if one is None:
        raise ValueError("no calibration blocks")
    contract = json.loads(one.contract)
    checked_blocks(rows, "calibration", expected_blocks, contract)
    blocks = rows.groupBy("block_id").agg(F.min("content_sha256").alias("digest"), F.max("api_time").alias("last")).collect()  # a row per block
    obs = with_features(rows)
    state = factorial.pooled_base(obs)
    found = factorial.calibrate(
        obs, grid, use["tail_threshold"], use["saturation_threshold"], use["base_seed"], base_of(state), exact, contract["snapshots_per_block"], use["alpha"], use["heading_kappa"]
    )
    names = ("k", "usable", "tail_weight_q95", "saturation_rate", "passed")
    diagnostics = [{n: r[n] for n in names} for r in found.orderBy("k").collect()]
    return factorial.lock(spark, diagnostics, {r.block_id: r.digest for r in blocks}, max(r["last"] for r in blocks), state, contract, use, validation_only)


def run(spark: SparkSession, rows: DataFrame, lock: dict, folder: str, expected_blocks: int = factorial.FORMAL_BLOCKS, wave: int = 16, validation_only: bool = False, exact: bool = True) -> DataFrame:
    """All cells of all blocks of ``rows``; what ``folder`` holds already is verified and not done again.

    Blocks are taken in waves of ``wave``, in order; a wave's missing cells are appended together. Cells are timed, so none
    runs beside another on an executor (see ``factorial.alone``). Outside of validation there are exactly ``factorial.FORMAL_BLOCKS`` blocks; all start after calibration has ended, and
    every cell's model has the lock's base.
    """
    factorial.checked_lock(spark, lock, same_runtime=True)
    protocol_count(expected_blocks, factorial.FORMAL_BLOCKS, "formal", validation_only)
    if lock["scope"] != ("validation_only" if validation_only else "confirmatory"):
        raise ValueError("the lock has another scope")
    checked_blocks(rows, "formal", expected_blocks, lock["contract"], lock["calibration_api_time_end"])
    names = spark.createDataFrame([(b,) for b in lock["calibration_blocks"]], "block_id string")
    if not factorial.leaked(names, rows).isEmpty():
        raise ValueError("a block is in both phases")
    obs = with_features(rows)
    cells = factorial.design(rows)
    expected = expected_rows(obs, cells, lock, exact)
    checked_results(stored(spark, folder), expected, lock, complete=False)
    numbered = rows.select("block_id").distinct().withColumn("wave", F.floor((F.row_number().over(Window.orderBy("block_id")) - 1) / wave))  # a row per block
    due = factorial.pending(cells, stored(spark, folder), lock["base_seed"]).join(numbered, "block_id")
    digests = obs.groupBy("block_id").agg(F.min("content_sha256").alias("block_sha256"))
    base = lock["base_mean"], lock["base_variance"]
    for r in due.select("wave").distinct().orderBy("wave").collect():
        now = due.where(F.col("wave") == r.wave).select(*factorial.CELL)
        own = obs.join(now.select("block_id").distinct(), "block_id", "left_semi")
        made = factorial.execute(
            own, now, lock["selected_k"], lock["particles"], lock["rejuvenation_window"], lock["base_seed"], base, exact, timed=True, alpha=lock["alpha"], heading_kappa=lock["heading_kappa"]
        )
        made = made.join(digests, "block_id").withColumns({c: F.lit(v) for c, v in _fixed(lock).items()}).withColumn("result_sha256", F.lit(""))
        _sealed(made.select(ROW.names)).write.mode("append").parquet(folder)
    out = stored(spark, folder)
    checked_results(out, expected, lock)
    return out


def write_csv(results: DataFrame, folder: str) -> None:
    """Results as CSV with a header; a missing number is written NaN."""
    shown = [F.coalesce(c, F.lit(float("nan"))).alias(c) if isinstance(ROW[c].dataType, T.DoubleType) else F.col(c) for c in ROW.names]
    results.select(shown).write.option("header", True).mode("errorifexists").csv(folder)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Results from CSV: the 21 columns in any order, every cell filled, every value of its type; NaN is missing again."""
    head = spark.read.option("header", True).csv(path).columns
    if sorted(head) != sorted(ROW.names):
        raise ValueError("the file has other columns")
    text = T.StructType([T.StructField(c, T.StringType()) for c in head])
    raw = spark.read.option("header", True).option("mode", "FAILFAST").schema(text).csv(path)

    def typed(f: T.StructField):
        c = F.when(F.col(f.name).isNull(), F.raise_error(F.lit(f"{f.name} is empty"))).otherwise(F.col(f.name))
        if isinstance(f.dataType, T.BooleanType):
            known = F.lower(c)
            return F.when(known.isin("true", "1"), True).when(known.isin("false", "0"), False).otherwise(F.raise_error(F.lit("success is neither true nor false").cast("string")).cast("boolean"))
        if isinstance(f.dataType, T.LongType):
            return F.when(c.rlike("^[0-9]+$"), c).otherwise(F.raise_error(F.lit(f"{f.name} is no count"))).cast("long")
        return F.nullif(c.cast(f.dataType), F.lit(float("nan"))) if isinstance(f.dataType, T.DoubleType) else c

    return raw.select(*(typed(f).alias(f.name) for f in ROW.fields))


def executions(blocks: int) -> int:
    return blocks * len(factorial.METHODS) * len(DROPOUTS)


def summary(results: DataFrame, expected: DataFrame, lock: dict, expected_blocks: int = factorial.FORMAL_BLOCKS, validation_only: bool = False) -> dict:
    """The analysis of a complete set of results, with coverage and provenance; how many there must be is the protocol's to say."""
    protocol_count(expected_blocks, factorial.FORMAL_BLOCKS, "formal", validation_only)
    if lock["scope"] != ("validation_only" if validation_only else "confirmatory"):
        raise ValueError("the lock has another scope")
    checked_results(results, expected, lock)
    per = factorial.coverage(results).withColumn("coverage", F.col("category_observations") / F.col("retained_observations"))
    n = results.agg(F.count(F.lit(1)).alias("cells"), F.countDistinct("block_id").alias("blocks")).first()
    if n.blocks != expected_blocks or n.cells != executions(expected_blocks):
        raise ValueError(f"need {expected_blocks} blocks and {executions(expected_blocks)} executions, found {n.blocks} and {n.cells}")
    return {
        "schema": "vireo-summary-v1", "scope": lock["scope"], "blocks": n.blocks, "executions_completed": n.cells, "executions_expected": executions(expected_blocks),
        "endpoints": factorial.analyse(results), "category_coverage": [r.asDict() for r in per.orderBy("method", "dropout_rate").collect()], "selected_k": lock["selected_k"], **_fixed(lock),
    }


def complete(body: dict) -> bool:
    """Whether a summary may be shown: every execution is in it that its blocks, and for a confirmatory study the protocol, ask for."""
    blocks = factorial.FORMAL_BLOCKS if body.get("scope") == "confirmatory" else body.get("blocks", 0)
    return body.get("schema") == "vireo-summary-v1" and body.get("blocks") == blocks > 0 and body.get("executions_completed") == body.get("executions_expected") == executions(blocks)


def publish(body: dict, summary_path: str | Path, status_path: str | Path) -> str:
    """Writes the summary once; the public status only for a confirmatory study, whole or not at all."""
    if not complete(body):
        raise ValueError("the summary isn't complete")
    digest = write_once(summary_path, body)
    if body["scope"] == "confirmatory":
        status, part = Path(status_path), Path(f"{status_path}.part")
        part.write_text(json.dumps(without_nan({"status": "complete", "summary_sha256": digest, "blocks": body["blocks"], "executions_completed": body["executions_completed"]}), sort_keys=True, indent=2))
        part.replace(status)
    return digest


def live_example(spark: SparkSession, snapshot: dict, base_seed: int = 2026, least: int = 12) -> DataFrame:
    """One live snapshot (see ``rest.fetch``) as one batch at each rate: dropout_rate, observations, k, occupied, agreement.

    At least ``least`` observations are needed; K is 12, or as many observations as stay if these are fewer.
    """
    if len(snapshot["observations"]) < least:
        raise ValueError(f"need {least} observations")
    columns = ("velocity", "true_track", "vertical_rate", "category")
    rows = [("live", 0, k, *(o[c] for c in columns)) for k, o in enumerate(snapshot["observations"])]
    made = spark.createDataFrame(rows, "block_id string, snapshot_index int, obs_index int, velocity double, true_track double, vertical_rate double, category int")
    kept = factorial.retained(with_features(made), base_seed, DROPOUTS)

    def learn(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("obs_index")
        x, theta = pdf[["x0", "x1"]].to_numpy(), pdf["theta"].to_numpy()
        model = StreamingMixture(Prior(k=min(12, len(x))))
        model.learn(x, theta)
        labels = model.responsibilities(x, theta).argmax(1)
        return pd.DataFrame({"dropout_rate": [key[0]], "observations": [len(x)], "k": [model.p.k], "occupied": [len(np.unique(labels))], "agreement": [factorial.agreement(labels, pdf["category"])]})

    return kept.groupBy("dropout_rate").applyInPandas(learn, "dropout_rate double, observations long, k int, occupied long, agreement double")
