"""Tests, intervals, resampling and arrival models over grouped data."""

from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.contracts import (
    BASELINE_NEGATIVE_RATIO, H0_TEXT, H1_TEXT, SEED, SURGE_PER_MINUTE, TEST_ALPHA, VERDICT_KEEP,
    VERDICT_REJECT,
)
from tidewatch.functions import distributions as dist
from tidewatch.operators.ordering import ID_SLICE, id_bucket, with_position
from tidewatch.operators.profile import usable, with_stats
from tidewatch.session import materialize

MAX_BROADCAST_DRAWS = 1_000_000


def t_statistic(n, mean, std, mu_0: float):
    """One-sample t; NULL below three values.

    Without spread it is infinite in the direction of the mean, and undefined
    (never rejected) when the mean equals the baseline.
    """
    return (F.when(n < 3, None)
            .when(std > 0, F.try_divide(mean - mu_0, std / F.sqrt(n)))
            .when(mean > mu_0, float("inf")).when(mean < mu_0, float("-inf")))


def upper_p_value(n, t):
    """P(T > t); 1 below three values."""
    return F.when(n < 3, 1.0).otherwise(1 - dist.student_t_cdf(t, n - 1))


def rejects(p, t, alpha: float):
    return F.coalesce((p < alpha) & (t > 0), F.lit(False))


def half_width(n, std, level: float):
    """Half the width of the mean's confidence interval."""
    return dist.student_t_quantile((1 + level) / 2, n - 1) * std / F.sqrt(n)


def one_sample_t_test(df: DataFrame, column: str, keys=(), mu_0: float = BASELINE_NEGATIVE_RATIO,
                      alpha: float = TEST_ALPHA) -> DataFrame:
    """Right-tailed one-sample t-test of the mean of ``column``, one row per group."""
    keys, v = list(keys), usable(column)
    n, mean, std, t = (F.col(c) for c in ("_n", "_mean", "_std", "_t"))
    tested = (df.groupBy(*keys)
              .agg(F.count(v).alias("_n"), F.avg(v).alias("_mean"),
                   F.stddev_samp(v).alias("_std"))
              .withColumn("_t", t_statistic(n, mean, std, mu_0))
              .withColumns({"_p": upper_p_value(n, t), "_half95": half_width(n, std, 0.95),
                            "_half99": half_width(n, std, 0.99),
                            "_critical": dist.student_t_quantile(1 - alpha, n - 1)}))
    enough = n >= 3
    known = lambda c: F.when(enough, F.round(c, 4))
    rejected = rejects(F.col("_p"), t, alpha)
    return tested.select(
        *keys, F.when(enough, "OK").otherwise("INSUFFICIENT_DATA").alias("status"),
        F.when(enough, H0_TEXT.format(mu_0)).alias("null_hypothesis"),
        F.when(enough, H1_TEXT.format(mu_0)).alias("alt_hypothesis"),
        n.alias("sample_size"), known(mean).alias("sample_mean"), known(std).alias("sample_std"),
        known(std / F.sqrt(n)).alias("standard_error"),
        F.when(enough, n - 1).alias("degrees_of_freedom"), known(t).alias("t_statistic"),
        known("_critical").alias("t_critical"), F.round("_p", 6).alias("p_value"),
        rejected.alias("reject_null"),
        F.when(enough, F.when(rejected, VERDICT_REJECT).otherwise(VERDICT_KEEP)).alias("verdict"),
        known(mean - F.col("_half95")).alias("ci95_low"),
        known(mean + F.col("_half95")).alias("ci95_high"),
        known(mean - F.col("_half99")).alias("ci99_low"),
        known(mean + F.col("_half99")).alias("ci99_high"))


def mean_interval(df: DataFrame, column: str, level: float = 0.95, keys=()) -> DataFrame:
    """Confidence interval of the mean at any level."""
    keys, v = list(keys), usable(column)
    n, mean, half = F.col("n"), F.col("_mean"), F.col("_half")
    return (df.groupBy(*keys)
            .agg(F.count(v).alias("n"), F.avg(v).alias("_mean"), F.stddev_samp(v).alias("_std"))
            .withColumn("_half", half_width(n, F.col("_std"), level))
            .select(*keys, "n", F.round(mean, 4).alias("mean"),
                    F.round(mean - half, 4).alias("ci_low"),
                    F.round(mean + half, 4).alias("ci_high")))


def bootstrap_means(df: DataFrame, column: str, id: str = "id", sample_size: int = 30,
                    samples: int = 500, seed: int = SEED, width: int = ID_SLICE) -> DataFrame:
    """Means of seeded samples drawn with replacement.

    Rows are numbered, draws are ``samples * sample_size`` generated indices, and
    an equi-join looks the drawn rows up; the number of draws does not grow with
    the data. The means are written once, one row for each sample: their last bits depend on
    the order of the tasks, and whatever is computed from them must see the same ones.
    """
    spark = df.sparkSession
    values = df.select(id, usable(column).alias("_v")).where("_v is not null")
    rows = with_position(values, [id], id_bucket(id, width)).select(
        (F.col("pos") - 1).alias("_index"), "_v")
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string"))), 1, 15)
    draws = with_stats(
        spark.range(samples * sample_size).select(
            F.floor(F.col("id") / sample_size).alias("sample"),
            F.conv(digest, 16, 10).cast("bigint").alias("_hash")),
        [F.count(F.lit(1)).alias("_size")], of=values)
    drawn = (draws.where("_size > 0")
             .select("sample", (F.col("_hash") % F.col("_size")).alias("_index")))
    if samples * sample_size <= MAX_BROADCAST_DRAWS:
        drawn = F.broadcast(drawn)
    means = rows.join(drawn, "_index").groupBy("sample").agg(F.avg("_v").alias("sample_mean"))
    return materialize(means, "sample-means")


def bootstrap_summary(df: DataFrame, column: str, id: str = "id", sample_size: int = 30,
                      samples: int = 500, seed: int = SEED) -> DataFrame:
    """Spread of the sample means against the theoretical standard error."""
    means = bootstrap_means(df, column, id, sample_size, samples, seed)
    v = usable(column)
    population = [F.avg(v).alias("_mu"), F.stddev_pop(v).alias("_sigma")]
    summary = means.agg(F.count(F.lit(1)).alias("_samples"), F.avg("sample_mean").alias("_m"),
                        F.stddev_pop("sample_mean").alias("_s"))
    r4 = lambda c, n: F.round(c, 4).alias(n)
    return with_stats(summary, population, of=df).select(
        r4("_mu", "population_mean"), r4("_sigma", "population_std"),
        F.lit(sample_size).alias("sample_size"), F.col("_samples").alias("simulations"),
        r4("_m", "mean_of_means"), r4("_s", "empirical_std_error"),
        r4(F.col("_sigma") / F.sqrt(F.lit(sample_size)), "theoretical_std_error"),
        (F.abs(F.col("_m") - F.col("_mu")) < 0.2).alias("clt_holds"))


# -- arrival models ------------------------------------------------------------

def arrival_counts(df: DataFrame, time: str, size: str = "1 hour", keys=()) -> DataFrame:
    """Rows per tumbling event-time window and key."""
    windowed = df.withColumn("_w", F.window(time, size))
    return (windowed.groupBy(*keys, F.col("_w.start").alias("window_start"))
            .agg(F.count(F.lit(1)).alias("n")))


def arrival_rate(df: DataFrame, time: str, minutes: int = 60, keys=()) -> DataFrame:
    """Rows per minute in each window."""
    counts = arrival_counts(df, time, f"{minutes} minutes", keys)
    return counts.withColumn("per_minute", F.round(F.col("n") / minutes, 4))


def poisson_scores(counts: DataFrame, keys=(), minutes: int = 60) -> DataFrame:
    """Score window counts against the mean count of their key."""
    # The output name ``rate`` must not shadow the input inside the lambdas below.
    scored = with_stats(counts, [F.avg("n").alias("_rate")], keys)
    n, rate = F.col("n"), F.col("_rate")
    return scored.select(
        *counts.columns, F.round(rate, 4).alias("rate"),
        F.round(dist.poisson_pmf(n, rate), 5).alias("pmf"),
        F.round(dist.poisson_cdf(n, rate), 5).alias("cdf"),
        F.round(dist.poisson_upper_tail(n, rate), 5).alias("upper_tail"),
        F.round(rate, 4).alias("expected_value"), F.round(rate, 4).alias("variance"),
        (n / minutes > SURGE_PER_MINUTE).alias("is_surge"))


def binomial_scores(df: DataFrame, negatives: str, total: str,
                    p: float = BASELINE_NEGATIVE_RATIO) -> DataFrame:
    """Probability of a count of negatives under the baseline rate."""
    k, n = F.col(negatives), F.col(total)
    return df.select(
        *df.columns, F.round(dist.binomial_pmf(k, n, p), 5).alias("pmf"),
        F.round(dist.binomial_cdf(k, n, p), 5).alias("cdf"),
        F.round(dist.binomial_upper_tail(k, n, p), 5).alias("upper_tail"),
        F.round(n * p, 4).alias("expected_value"), F.round(n * p * (1 - p), 4).alias("variance"))


def normal_scores(df: DataFrame, column: str, mu: float | None = None, sigma: float | None = None,
                  keys=()) -> DataFrame:
    """Normal density and distribution of a column, by default around its own moments."""
    v = usable(column)
    fitted = with_stats(df, [F.avg(v).alias("_mu"), F.stddev_pop(v).alias("_sigma")], keys)
    mu = F.col("_mu") if mu is None else F.lit(mu)
    sigma = F.col("_sigma") if sigma is None else F.lit(sigma)
    return fitted.select(
        *df.columns, F.round(dist.normal_pdf(v, mu, sigma), 5).alias("pdf"),
        F.round(dist.normal_cdf(v, mu, sigma), 5).alias("cdf"))


def gaps(df: DataFrame, time: str, id: str = "id", keys=(), slice_size: str = "hour",
         name: str = "gap_seconds") -> DataFrame:
    """Seconds since the previous row of the same key.

    The previous row is searched inside a time slice; the first row of a slice
    takes the last time of the slice before it from the slice table.
    """
    keys = list(keys)
    tagged = df.withColumn("_slice", F.date_trunc(slice_size, F.col(time)))
    ends = tagged.groupBy(*keys, "_slice").agg(F.max(time).alias("_last"))
    previous = ends.select(
        *keys, "_slice",
        F.lag("_last").over(Window.partitionBy(*keys).orderBy("_slice")).alias("_previous"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(time, id)
    lagged = tagged.withColumn("_before", F.lag(time).over(inside))
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    return (lagged.join(previous, [*keys, "_slice"])
            .withColumn("_before", F.coalesce("_before", "_previous"))
            .withColumn(name, seconds(time) - seconds("_before"))
            .drop("_slice", "_before", "_previous"))


def exponential_scores(df: DataFrame, gap: str = "gap_seconds", keys=()) -> DataFrame:
    """Density and distribution of inter-arrival gaps under their mean gap."""
    scored = with_stats(df, [F.avg(gap).alias("_beta")], keys)
    x, beta = F.col(gap), F.col("_beta")
    return scored.select(
        *df.columns, F.round(beta, 4).alias("scale_beta"),
        F.round(F.try_divide(F.lit(1.0), F.when(beta <= 0, 1.0).otherwise(beta)), 4)
        .alias("rate_lambda"),
        F.round(dist.exponential_pdf(x, beta), 5).alias("pdf"),
        F.round(dist.exponential_cdf(x, beta), 5).alias("cdf"))
