"""Kinematic observations from the ``events`` table: a stand-in for state vectors, with every row of the table used.

A day is a block, four hours are a snapshot, the user is the identity, the value the speed, ``props.k`` the heading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_DAY = "2024-01-01"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def block_of(ts: Column) -> Column:
    return F.concat(F.lit("formal-"), F.lpad((F.datediff(ts, F.lit(FIRST_DAY)) + 1).cast("string"), 4, "0"))


def states(df: DataFrame) -> DataFrame:
    """Raw state rows: block_id, snapshot_index, ordinal, identity, velocity, true_track, vertical_rate, category."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    return df.select(
        block_of(F.col("ts")).alias("block_id"),
        F.floor(F.hour("ts") / 4).cast("int").alias("snapshot_index"),
        F.col("event_id").alias("ordinal"),
        F.lower(F.lpad(F.hex("user_id"), 6, "0")).alias("identity"),
        F.col("value").alias("velocity"),
        (k * F.lit(3.6)).alias("true_track"),
        ((F.pmod(F.col("event_id") * 37, F.lit(101)) - 50) / F.lit(5.0)).alias("vertical_rate"),
        F.when(kind == "click", 2).when(kind == "view", 3).when(kind == "purchase", 4).when(kind == "signup", 1).alias("category"),
    )


def spoiled(rows: DataFrame) -> DataFrame:
    """The same rows with faults at fixed ordinals, so that every rule of the sanitiser has something to reject."""
    n = F.col("ordinal")
    bad = lambda k: F.pmod(n, F.lit(k)) == 0
    return rows.withColumns(
        {
            "identity": F.when(bad(53), F.lit("xyz")).when(bad(67), F.lit(None)).otherwise(F.col("identity")),
            "velocity": F.when(bad(59), -F.col("velocity") - 1).when(bad(61), F.lit(float("inf"))).when(bad(71), F.lit(None)).otherwise(F.col("velocity")),
            "true_track": F.when(bad(73), F.lit(float("nan"))).otherwise(F.col("true_track")),
            "category": F.when(bad(7), F.col("category") + 19).otherwise(F.col("category")),
        }
    )
