"""Outlier marking and feature scaling against group statistics."""

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.operators.profile import attach, beside, exact_quantiles, usable, with_stats
from tidewatch.session import materialize

QUARTILES = {"_q1": 0.25, "_q3": 0.75}


def _fences():
    iqr = F.col("_q3") - F.col("_q1")
    return F.col("_q1") - 1.5 * iqr, F.col("_q3") + 1.5 * iqr


def mark_iqr(df: DataFrame, column: str, keys=(), name: str = "is_outlier") -> DataFrame:
    """Flag values outside 1.5 IQR of the quartiles; missing values count as clean."""
    keys = list(keys)
    quartiles = exact_quantiles(df, column, QUARTILES, keys)
    low, high = _fences()
    v = usable(column)
    with_fences = attach(df, quartiles, keys) if keys else beside(df, quartiles)
    marked = with_fences.withColumn(name, F.coalesce((v < low) | (v > high), F.lit(False)))
    return marked.drop(*QUARTILES)


def iqr_bounds(df: DataFrame, column: str, keys=()) -> DataFrame:
    """Quartiles, fences and the number of outliers."""
    keys = list(keys)
    low, high = _fences()
    quartiles = exact_quantiles(df, column, QUARTILES, keys)
    bounds = materialize(quartiles.select(
        *keys, "_q1", "_q3", low.alias("_low"), high.alias("_high")), "bounds")
    v = usable(column)
    outside = (v < F.col("_low")) | (v > F.col("_high"))
    counted = (beside(df, bounds, keys).groupBy(*keys)
               .agg(F.sum(F.when(outside, 1).otherwise(0)).alias("outlier_count")))
    r4 = lambda c, n: F.round(c, 4).alias(n)
    return beside(bounds, counted, keys).select(
        *keys, r4("_q1", "q1"), r4("_q3", "q3"), r4(F.col("_q3") - F.col("_q1"), "iqr"),
        r4("_low", "lower_bound"), r4("_high", "upper_bound"), "outlier_count")


def mark_zscore(df: DataFrame, column: str, threshold: float = 3.0, keys=(),
                name: str = "is_outlier") -> DataFrame:
    """Flag values more than ``threshold`` population deviations from the mean."""
    v = usable(column)
    stats = [F.avg(v).alias("_mean"), F.stddev_pop(v).alias("_std")]
    z = F.try_divide(v - F.col("_mean"), F.col("_std"))
    return (with_stats(df, stats, keys)
            .withColumn(name, F.coalesce(F.abs(z) > threshold, F.lit(False)))
            .drop("_mean", "_std"))


def without_outliers(marked: DataFrame, name: str = "is_outlier") -> DataFrame:
    return marked.where(~F.col(name)).drop(name)


def only_outliers(marked: DataFrame, name: str = "is_outlier") -> DataFrame:
    return marked.where(F.col(name)).drop(name)


def _scaled(value: Column, center: str, spread: Column) -> Column:
    ratio = F.try_divide(value - F.col(center), spread)
    return F.when(spread == 0, 0.0).otherwise(ratio)


def min_max_scale(df: DataFrame, column: str, keys=(), name: str | None = None) -> DataFrame:
    """Scale to [0, 1]; a constant column becomes 0, missing values stay missing."""
    v = usable(column)
    stats = [F.min(v).alias("_lo"), F.max(v).alias("_hi")]
    return (with_stats(df, stats, keys)
            .withColumn(name or f"{column}_minmax",
                        _scaled(v, "_lo", F.col("_hi") - F.col("_lo")))
            .drop("_lo", "_hi"))


def standard_scale(df: DataFrame, column: str, keys=(), name: str | None = None) -> DataFrame:
    """Population z-scores; a constant column becomes 0, missing values stay missing."""
    v = usable(column)
    stats = [F.avg(v).alias("_mean"), F.stddev_pop(v).alias("_std")]
    return (with_stats(df, stats, keys)
            .withColumn(name or f"{column}_standard", _scaled(v, "_mean", F.col("_std")))
            .drop("_mean", "_std"))
