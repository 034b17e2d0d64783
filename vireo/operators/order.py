"""Places in an order within groups of any size: a group is cut into stretches that don't overlap, each is sorted alone, and counts of the stretches before give the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that are sorted together, about; a group of no more is one stretch.
STRETCH = 1 << 16
#: Stretches of a group by value, at most.
MOST = 1024


def _placed(at: DataFrame, by: list[str], order: list[str | Column], name: str) -> DataFrame:
    """``at`` (with ``__stretch``) with the gapless place from 0 of each row by stretch and ``order``."""
    counts = at.groupBy(*by, "__stretch").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row per stretch
    keys = {c: f"__by{k}" for k, c in enumerate(by)}
    first = counts.select(*(F.col(c).alias(n) for c, n in keys.items()), F.col("__stretch").alias("__at"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    within = F.row_number().over(Window.partitionBy(*by, "__stretch").orderBy(*order)) - 1
    same = F.col("__stretch").eqNullSafe(F.col("__at"))
    for c, n in keys.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    out = at.withColumn("__within", within).join(first, same)
    return out.withColumn(name, F.col("__first") + F.col("__within")).drop("__stretch", "__at", "__first", "__within", *keys.values())


def numbered(df: DataFrame, by: list[str], order: str, name: str, width: int = STRETCH) -> DataFrame:
    """``df`` with a gapless number from 0 by the whole number ``order``, which doesn't repeat within ``by``: so ``width`` of its values hold no more rows."""
    return _placed(df.withColumn("__stretch", F.floor(F.col(order) / width)), by, [order], name)


def ranked(df: DataFrame, by: list[str], value: str, ties: str, name: str, width: int | None = None) -> DataFrame:
    """``df`` with a gapless number from 0 by ``value``, then ``ties``, within ``by``.

    Groups of more than ``width`` rows are cut at quantiles of their own, up to ``MOST`` stretches. Quantiles are of a sketch
    and decide only what is sorted together, so places are exact. Equal values of a group share a stretch.
    """
    width = width or STRETCH
    x = F.col(value).cast("double")
    steps = F.percentile_approx(x, [k / MOST for k in range(1, MOST)], 20 * MOST)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__rows"), steps.alias("__steps")).where(F.col("__rows") > width)
    parts = F.least(F.lit(MOST), F.ceil(F.col("__rows") / width)).cast("int")
    edges = F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.element_at("__steps", F.floor(i * MOST / parts).cast("int")))
    sizes = sizes.withColumn("__edges", F.coalesce(edges, F.array().cast("array<double>")))  # no steps where all values are null
    keys = {c: f"__of{k}" for k, c in enumerate(by)}
    large = sizes.select(*(F.col(c).alias(n) for c, n in keys.items()), "__edges")
    same = F.lit(True)
    for c, n in keys.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    stretch = F.when(x.isNull() | F.col("__edges").isNull(), 0).otherwise(F.size(F.filter("__edges", lambda e: e < x)))
    at = df.join(large, same, "left").withColumn("__stretch", stretch.cast("long")).drop("__edges", *keys.values())
    return _placed(at, by, [value, ties], name)
