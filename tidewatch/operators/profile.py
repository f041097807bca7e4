"""Descriptive statistics: exact quantiles, profiles, relations, histograms."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.contracts import KURTOSIS_LABELS, SKEW_LABELS
from tidewatch.functions.distributions import student_t_cdf
from tidewatch.session import materialize

QUANTILE_SLICES = 4096
#: Rows of different values that one task may put in order; fuller slices are cut again.
SLICE_ROWS = 1 << 20


def usable(column: str) -> Column:
    """The column as double, NaN read as missing."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def with_stats(df: DataFrame, stats, keys=(), of: DataFrame | None = None) -> DataFrame:
    """Attach aggregate columns to every row.

    Without keys the aggregate is one scalar subquery, evaluated once and handed
    to every task; per key it is a small table, see :func:`attach`.
    """
    keys, source = list(keys), df if of is None else of
    if keys:
        return attach(df, source.groupBy(*keys).agg(*stats), keys, "inner")
    one = source.agg(*stats)
    packed = one.select(F.struct(*one.columns).alias("_stats")).scalar()
    return df.withColumn("_stats", packed).select(*df.columns, "_stats.*")


def attach(df: DataFrame, summary: DataFrame, keys, how: str = "left") -> DataFrame:
    """Join a per-key summary to a large table.

    The summary is written first. Its size is then known when the join is
    planned: below the broadcast threshold the large side, whose keys may be
    badly skewed, is not shuffled at all; above it Spark shuffles both.
    """
    return df.join(materialize(summary, "summary"), list(keys), how)


def beside(base: DataFrame, other: DataFrame, keys=()) -> DataFrame:
    """Put the columns of one more aggregate of the same grouping next to ``base``."""
    keys = list(keys)
    if keys:
        return base.join(other, keys, "left")
    packed = other.select(F.struct(*other.columns).alias("_o")).scalar()
    return base.withColumn("_o", packed).select(*base.columns, "_o.*")


def exact_quantiles(df: DataFrame, column: str, probabilities: dict, keys=(),
                    slices: int = QUANTILE_SLICES) -> DataFrame:
    """Exact linear-interpolation quantiles without gathering a column in one task.

    Values are counted in ``slices`` slices; only the slices that hold a wanted rank
    are looked at value by value, equal values merged first. Slices are even on a
    scale that is linear about the middle of the values and logarithmic far from it, so
    a few huge values leave the others spread over many slices. A slice of more than SLICE_ROWS
    rows is cut again between its own least and largest value, until none is left.
    ``probabilities`` maps output names to probabilities.
    """
    keys = list(keys)
    values = df.select(*keys, usable(column).alias("_v")).where("_v is not null")
    # Approximate quartiles set the scale. They may differ from one evaluation to the next, so they are
    # written once and every use of a slice number sees the same ones.
    guess = F.percentile_approx("_v", [0.25, 0.5, 0.75], 1000)
    bounds = materialize(
        values.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("_v").alias("_size"),
                                  guess.alias("_q"))
        .withColumn("_mid", F.col("_q")[1]).withColumn("_unit", F.col("_q")[2] - F.col("_q")[0]).drop("_q"), "bounds")
    placed = values.join(bounds, keys) if keys else with_stats(values, [F.max(c).alias(c) for c in bounds.columns], of=bounds)

    def scaled(v):
        """Does not decrease with ``v``: built from steps that do not."""
        away = (v - F.col("_mid")) / F.when(F.col("_unit") > 0, F.col("_unit")).otherwise(1.0)
        return F.signum(away) * F.log1p(F.abs(away))

    low, high = scaled(F.col("_lo")), scaled(F.col("_hi"))
    share = (scaled(F.col("_v")) - low) / (high - low)
    placed = placed.withColumn("_slice", F.when(
        (high > low) & (high - low < float("inf")),
        F.least(F.floor(share * slices), F.lit(slices - 1))).otherwise(F.lit(0)).cast("int")).drop("_lo", "_hi", "_mid", "_unit")

    def rank(p):
        return F.lit(float(p)) * (F.col("_size") - 1)

    wanted = F.array_distinct(F.array(*[
        edge(rank(p)).cast("bigint") for p in probabilities.values() for edge in (F.floor, F.ceil)]))
    rows, sizes = _narrowed(placed.withColumns({"_no": F.lit(0), "_before": F.lit(0).cast("bigint"), "_ranks": wanted}), keys, slices)
    inside = lambda r: (r >= F.col("_start")) & (r < F.col("_start") + F.col("_n"))
    within = Window.partitionBy(*keys, "_slice").orderBy("_v")
    found = (attach(rows.drop("_no", "_before", "_ranks"), sizes.drop("_n", "_least", "_most"), [*keys, "_slice"], "inner")
             .groupBy(*keys, "_slice", "_size", "_before", "_ranks", "_v")
             .agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_start", F.col("_before") + F.sum("_n").over(within) - F.col("_n"))
             .withColumn("_rank", F.explode(F.filter("_ranks", inside))))
    table = found.groupBy(*keys).agg(
        F.max("_size").alias("_size"),
        F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))

    def quantile(p):
        at = lambda edge: F.element_at("_at", edge(rank(p)).cast("bigint"))
        return at(F.floor) + (at(F.ceil) - at(F.floor)) * (rank(p) - F.floor(rank(p)))

    return table.select(*keys, *[quantile(p).alias(n) for n, p in probabilities.items()])


def _narrowed(rows: DataFrame, keys: list, slices: int, most_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, sizes): rows with their ``_slice``, and of each slice that holds a wanted rank its number ``_no`` per
    key, the rows ``_before`` it, its ``_ranks``, size and bounds.

    ``rows`` come with the slice they lie in and with ``_no``, ``_before`` and ``_ranks`` of what it was cut
    from. As the least and the largest value of a cut slice end in different parts, every round makes
    the full ones smaller; rows outside them are dropped, the others written.
    """
    most_rows = SLICE_ROWS if most_rows is None else most_rows
    inside = lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n"))
    earlier = Window.partitionBy(*keys, "_no").orderBy("_slice")
    while True:
        counted = (rows.groupBy(*keys, "_slice", "_no", "_before", "_ranks")
                   .agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
                   .withColumn("_before", F.col("_before") + F.sum("_n").over(earlier) - F.col("_n"))
                   .withColumn("_ranks", F.filter("_ranks", inside)).where(F.size("_ranks") > 0)
                   .withColumn("_no", F.row_number().over(Window.partitionBy(*keys).orderBy("_slice")) - 1))
        sizes = materialize(counted, "slices")
        fullest = sizes.where("_least < _most").agg(F.max("_n")).first()[0]
        if fullest is None or fullest <= most_rows:
            return rows, sizes
        held = rows.drop("_no", "_before", "_ranks").join(sizes, [*keys, "_slice"])
        # Halves, so that no range overflows.
        share = (F.col("_v") / 2 - F.col("_least") / 2) / (F.col("_most") / 2 - F.col("_least") / 2)
        part = F.when(F.col("_least") < F.col("_most"), F.least(F.floor(share * slices), F.lit(slices - 1))).otherwise(0)
        rows = materialize(held.withColumn("_slice", (F.col("_no") * slices + F.coalesce(part, F.lit(0))).cast("int"))
                           .drop("_n", "_least", "_most"), "narrowed")


def most_common(df: DataFrame, column: str, keys=(), name: str = "mode") -> DataFrame:
    """Most frequent value, the smallest one on ties; counted before it is compared."""
    keys = list(keys)
    counts = (df.select(*keys, usable(column).alias("_v")).where("_v is not null")
              .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")))
    best = F.max_by("_v", F.struct(F.col("_n"), -F.col("_v")))
    return counts.groupBy(*keys).agg(best.alias(name))


def univariate_profile(df: DataFrame, column: str, keys=()) -> DataFrame:
    """One row of descriptive statistics per group."""
    keys, v = list(keys), usable(column)
    base = df.groupBy(*keys).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance"),
        F.stddev_samp(v).alias("std_dev"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"))
    wanted = {"q1": 0.25, "median": 0.5, "q3": 0.75, "percentile_90": 0.9}
    full = beside(beside(base, exact_quantiles(df, column, wanted, keys), keys),
                  most_common(df, column, keys), keys)
    n = F.col("count")
    small = lambda name, floor: F.when(n <= floor, F.when(n > 0, 0.0)).otherwise(F.col(name))
    skew, kurt = small("skewness", 2), small("kurtosis", 3)
    r4 = lambda c: F.round(c, 4)
    return full.select(
        *keys, n.alias("count"), r4("mean").alias("mean"), r4("median").alias("median"),
        r4("mode").alias("mode"), r4(small("variance", 1)).alias("variance"),
        r4(small("std_dev", 1)).alias("std_dev"), r4(F.col("max") - F.col("min")).alias("range"),
        r4("min").alias("min"), r4("max").alias("max"), r4("q1").alias("q1"),
        r4("median").alias("q2_median"), r4("q3").alias("q3"),
        r4(F.col("q3") - F.col("q1")).alias("iqr"), r4("percentile_90").alias("percentile_90"),
        r4(skew).alias("skewness"), skew_label(skew).alias("skewness_interpretation"),
        r4(kurt).alias("kurtosis"), kurtosis_label(kurt).alias("kurtosis_interpretation"))


def skew_label(skew: Column) -> Column:
    """Constant columns have no skew and get no label."""
    even, right, left = SKEW_LABELS
    return (F.when(F.abs(skew) < 0.5, even).when(skew >= 0.5, right)
            .when(skew.isNotNull(), left))


def kurtosis_label(kurt: Column) -> Column:
    heavy, flat, normal = KURTOSIS_LABELS
    return F.when(kurt > 1.0, heavy).when(kurt < -1.0, flat).when(kurt.isNotNull(), normal)


def pearson(x: Column, y: Column) -> Column:
    """Pearson r from moments; NULL when either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    # least and greatest skip NULLs, so an undefined r is kept out of the clamp.
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def bivariate(df: DataFrame, x: str, y: str, keys=()) -> DataFrame:
    """Covariance, Pearson r and its two-sided p-value over complete pairs."""
    keys, a, b = list(keys), usable(x), usable(y)
    n, r = F.col("sample_size"), F.col("_r")
    moments = (df.where(a.isNotNull() & b.isNotNull()).groupBy(*keys)
               .agg(F.count(F.lit(1)).alias("sample_size"), F.covar_samp(a, b).alias("_cov"),
                    pearson(a, b).alias("_r")))
    t = F.abs(r) * F.sqrt(F.try_divide(n - 2, 1 - r * r))
    tail = 2 * (1 - student_t_cdf(t, n - 2))
    p = (F.when(n < 2, 0.0).when(n == 2, 1.0).when(F.abs(r) >= 1, 0.0)
         .when(r.isNotNull(), F.greatest(F.lit(0.0), tail)))
    zero_if_small = lambda c: F.when(n < 2, 0.0).otherwise(c)
    return moments.select(
        *keys, F.lit(x).alias("feature_x"), F.lit(y).alias("feature_y"), n.alias("sample_size"),
        F.round(zero_if_small(F.col("_cov")), 4).alias("covariance"),
        F.round(zero_if_small(r), 4).alias("pearson_correlation"), F.round(p, 6).alias("p_value"))


def correlation_matrix(df: DataFrame, columns) -> DataFrame:
    """All pairs in long form, from one pass; columns the table lacks are skipped."""
    columns = [c for c in columns if c in df.columns]
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = df.agg(*[pearson(usable(a), usable(b)).alias(f"{a}|{b}") for a, b in pairs])
    cells = [F.struct(F.lit(a).alias("feature_x"), F.lit(b).alias("feature_y"),
                      F.round(F.col(f"`{x}|{y}`"), 4).alias("correlation"))
             for x, y in pairs for a, b in {(x, y), (y, x)}]
    return wide.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def histogram(df: DataFrame, column: str, bins: int = 15) -> DataFrame:
    """Equal-width counts and density between minimum and maximum; the last bin is closed.

    Computed values may differ in their last bit between the pass that finds the bounds
    and the one that counts: what falls outside belongs to the outermost bins.
    """
    v = F.col("_v")
    values = df.select(usable(column).alias("_v")).where("_v is not null")
    bounds = [F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("_v").alias("_size")]
    share = F.try_divide(v - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    counts = (with_stats(values, bounds)
              .groupBy(F.greatest(F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1)), F.lit(0))
                       .cast("int").alias("bin"))
              .agg(F.count(F.lit(1)).alias("n")))
    width = (F.col("_hi") - F.col("_lo")) / bins
    grid = (values.agg(*bounds).where("_size > 0")
            .withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))))
    n = F.coalesce(F.col("n"), F.lit(0))
    return grid.join(counts, "bin", "left").select(
        "bin", F.round(F.col("_lo") + width * F.col("bin"), 6).alias("bin_low"),
        F.round(F.col("_lo") + width * (F.col("bin") + 1), 6).alias("bin_high"), n.alias("n"),
        F.round(F.try_divide(n, F.col("_size") * width), 6).alias("density"))
