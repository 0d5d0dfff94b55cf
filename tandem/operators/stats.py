"""Summary statistics: describe, histograms on floating-point edges, confidence intervals, value counts, rankings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.measures import Z95


def describe(df: DataFrame, value: str, *by: str) -> DataFrame:
    """count, mean, std (sample), min, quartiles and max of a column, per group."""
    v = F.col(value).cast("double")
    out = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p"), F.max(v).alias("max"))
    return out.select(*by, "count", "mean", "std", "min", F.col("p")[0].alias("p25"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p75"), "max")


def extent(df: DataFrame, value: str, *by: str) -> DataFrame:
    """min, max, median (interpolated), the number of distinct values and the share of rows above zero, per group."""
    v = F.col(value)
    return df.where(v.isNotNull()).groupBy(*by).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.median(v.cast("double")).alias("median"), F.count_distinct(v).alias("nunique"), F.avg((v > 0).cast("double")).alias("positive"))


def mean_ci(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Per group: count, mean, std and the normal 95 % interval of the mean."""
    out = df.groupBy(*by).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    half = F.lit(Z95) * F.col("std") / F.sqrt(F.col("count"))
    return out.select(*by, "count", "mean", "std", (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"))


def linear_edges(low: float, high: float, bins: int) -> list[float]:
    step = (high - low) / bins
    return [low + i * step for i in range(bins)] + [high]


def log_edges(low: float, high: float, bins: int) -> list[float]:
    a, b = math.log10(low), math.log10(high)
    return [10 ** (a + i * (b - a) / bins) for i in range(bins)] + [high]


def bin_of(value: Column, edges: list[float]) -> Column:
    """1-based bin of a value against an edge array, the last bin closed, null outside. The edges are one literal; a value's bin is the number of edges
    at or below it, found without a join."""
    at = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= value))
    return F.when((value >= edges[0]) & (value <= edges[-1]), F.least(at, F.lit(len(edges) - 1)))


def histogram(df: DataFrame, value: str, edges: list[float], *by: str) -> DataFrame:
    """Count per bin (and group), and percent of all values, those out of range included."""
    v = F.col(value).cast("double")
    counts = df.where(v.isNotNull()).select(*by, bin_of(v, edges).alias("bin")).groupBy(*by, "bin").agg(F.count("*").alias("count"))
    total = counts.groupBy(*by).agg(F.sum("count").alias("_total"))
    out = counts.where("bin IS NOT NULL")
    out = out.join(total, list(by)) if by else out.join(F.broadcast(total))  # without groups, one row
    return out.select(*by, "bin", "count", (100.0 * F.col("count") / F.col("_total")).alias("percent"))


def value_counts(df: DataFrame, key: str) -> DataFrame:
    """Counts per value, nulls dropped, most frequent first."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("count")).orderBy(F.desc("count"), key)


def most_common(df: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """The k most frequent values; on ties the one seen first by order."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("count"), F.min(order).alias("_first")).orderBy(F.desc("count"), "_first").limit(k).drop("_first")


def reindex(counts: DataFrame, key: str, labels: list[str], value: str = "count") -> DataFrame:
    """One row per label, in their order, 0 where counts has none."""
    spark = counts.sparkSession
    fixed = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], f"position int, `{key}` string")
    return fixed.join(counts, key, "left").select("position", key, F.coalesce(value, F.lit(0)).alias(value)).orderBy("position")


def ranked(df: DataFrame, value: str, key: str, k: int = 100) -> DataFrame:
    """Positions 1..k by value, largest first, ties by key: the window runs over the k rows that a top-k step leaves."""
    top = df.orderBy(F.desc(value), key).limit(k)
    return top.withColumn("position", F.row_number().over(Window.orderBy(F.desc(value), key)))


def rank_change(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Of keys in both rankings: positions, change, line width and opacity."""
    both = a.select(key, F.col("position").alias("a_position")).join(b.select(key, F.col("position").alias("b_position")), key)
    change = F.col("b_position") - F.col("a_position")
    return both.select(key, "a_position", "b_position", change.alias("change"), F.least(0.5 + F.abs(change) * 0.02, F.lit(3.0)).alias("width"), (0.3 + F.least(F.abs(change) / 50, F.lit(0.4))).alias("alpha"))


def category_order(df: DataFrame, category: str, order: list[str], value: str) -> DataFrame:
    """Rows by the categories' given order, then by value, largest first; unknown categories last."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(category))
    return df.withColumn("category_position", F.nullif(at, F.lit(0).cast("long"))).orderBy(F.col("category_position").asc_nulls_last(), F.desc(value))
