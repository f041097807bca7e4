import datetime as dt
import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tidewatch.operators import inference as I
from tidewatch.operators import outliers as Out
from tidewatch.operators import profile as P


def values(spark, seed=1, n=400):
    rng = random.Random(seed)
    rows = [(i, rng.choice("ab") if rng.random() < .3 else "hot",
             rng.choice([5.0, round(rng.lognormvariate(0, 2), 2)])) for i in range(n)]
    rows += [(n + 1, "hot", None), (n + 2, "a", float("nan"))]
    return rows, spark.createDataFrame(rows, "id bigint, k string, v double")


def by_key(rows):
    groups = defaultdict(list)
    for _, k, v in rows:
        if v is not None and not math.isnan(v):
            groups[k].append(v)
    return groups


def test_exact_quantiles_match_numpy(spark):
    rows, df = values(spark)
    wanted = {"p25": .25, "p50": .5, "p90": .9, "p0": 0.0, "p100": 1.0}
    groups = by_key(rows)
    for slices in (1, 3, 4096):
        for r in P.exact_quantiles(df, "v", wanted, ["k"], slices).collect():
            for name, p in wanted.items():
                assert math.isclose(r[name], np.percentile(groups[r.k], 100 * p), rel_tol=1e-12)
        whole = [v for vs in groups.values() for v in vs]
        r = P.exact_quantiles(df, "v", wanted, slices=slices).first()
        assert all(math.isclose(r[n], np.percentile(whole, 100 * p), rel_tol=1e-12) for n, p in wanted.items())


def test_quantiles_beside_outliers(spark):
    """Huge values neither change a quantile nor gather the others in a few slices."""
    rng = np.random.default_rng(5)
    data = [*rng.normal(50, 3, 5000).tolist(), 1e12, -1e15, 1e300, *[7.0] * 500]
    df = spark.createDataFrame([(float(v),) for v in data], "v double")
    wanted = {"p10": .1, "p50": .5, "p99": .99, "p0": 0.0, "p100": 1.0}
    for slices in (5, 4096):
        r = P.exact_quantiles(df, "v", wanted, slices=slices).first()
        assert all(math.isclose(r[n], np.percentile(data, 100 * p), rel_tol=1e-12) for n, p in wanted.items())
    constant = P.exact_quantiles(df.where("v = 7"), "v", wanted).first()
    assert set(constant) == {7.0}


def test_profile_matches_moments(spark):
    rows, df = values(spark)
    for r in P.univariate_profile(df, "v", ["k"]).collect():
        a = np.array(by_key(rows)[r.k])
        z = (a - a.mean()) / a.std()
        assert r["count"] == len(a) and r.mean == round(a.mean(), 4)
        assert abs(r.variance - a.var(ddof=1)) < 1e-3 and abs(r.skewness - (z**3).mean()) < 1e-3
        assert abs(r.kurtosis - ((z**4).mean() - 3)) < 1e-3
        counts = Counter(a.tolist())
        assert r.mode == min(v for v, c in counts.items() if c == max(counts.values()))


def test_profile_guards(spark):
    one = P.univariate_profile(spark.createDataFrame([(2.0,)], "v double"), "v").first()
    assert (one["count"], one.mean, one.variance, one.skewness, one.kurtosis) == (1, 2.0, 0.0, 0.0, 0.0)
    flat = P.univariate_profile(spark.createDataFrame([(2.0,)] * 6, "v double"), "v").first()
    assert flat.skewness is None and flat.skewness_interpretation is None and flat.kurtosis is None
    none = P.univariate_profile(spark.createDataFrame([], "v double"), "v").first()
    assert none["count"] == 0 and none.mean is None


def test_bivariate_and_matrix(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=12)
    y = x + rng.normal(size=12)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(1.0, None)], "x double, y double")
    r = P.bivariate(df, "x", "y").first()
    assert r.sample_size == 12 and abs(r.covariance - np.cov(x, y)[0, 1]) < 1e-4
    assert abs(r.pearson_correlation - np.corrcoef(x, y)[0, 1]) < 1e-4 and 0 < r.p_value < 0.1
    perfect = P.bivariate(spark.createDataFrame([(float(i), 2.0 * i) for i in range(5)], "x double, y double"), "x", "y").first()
    assert perfect.pearson_correlation == 1.0 and perfect.p_value == 0.0
    small = P.bivariate(df.limit(1), "x", "y").first()
    assert (small.covariance, small.pearson_correlation) == (0.0, 0.0)
    flat = P.bivariate(spark.createDataFrame([(1.0, float(i)) for i in range(5)], "x double, y double"), "x", "y").first()
    assert flat.pearson_correlation is None and flat.p_value is None
    matrix = {(m.feature_x, m.feature_y): m.correlation for m in P.correlation_matrix(df, ["x", "y", "absent"]).collect()}
    assert len(matrix) == 4 and matrix[("x", "x")] == 1.0 and matrix[("x", "y")] == matrix[("y", "x")]


def test_histogram_matches_numpy(spark):
    _, df = values(spark)
    data = [r.v for r in df.collect() if r.v is not None and not math.isnan(r.v)]
    counts, edges = np.histogram(data, bins=15)
    density, _ = np.histogram(data, bins=15, density=True)
    got = P.histogram(df, "v", 15).orderBy("bin").collect()
    assert [r.n for r in got] == counts.tolist()
    assert np.allclose([r.bin_low for r in got], edges[:-1], atol=1e-5)
    assert np.allclose([r.density for r in got], density, atol=1e-5)
    flat = P.histogram(spark.createDataFrame([(3.0,)] * 4, "v double"), "v", 5).collect()
    assert sum(r.n for r in flat) == 4


def test_outliers_partition_the_input(spark):
    rows, df = values(spark)
    whole = [v for vs in by_key(rows).values() for v in vs]
    q1, q3 = np.percentile(whole, [25, 75])
    marked = Out.mark_iqr(df, "v")
    outside = {r[0] for r in rows if r[2] is not None and (r[2] < q1 - 1.5 * (q3 - q1) or r[2] > q3 + 1.5 * (q3 - q1))}
    assert {r.id for r in Out.only_outliers(marked).collect()} == outside
    assert Out.without_outliers(marked).count() == len(rows) - len(outside)
    assert Out.iqr_bounds(df, "v").first().outlier_count == len(outside)
    z = {r[0] for r in rows if r[2] is not None and abs((r[2] - np.mean(whole)) / np.std(whole)) > 3}
    assert {r.id for r in Out.only_outliers(Out.mark_zscore(df, "v")).collect()} == z
    flat = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert Out.only_outliers(Out.mark_zscore(flat, "v")).count() == 0


def test_scaling(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (5.0,), (None,), (float("nan"),)], "v double")
    assert [r.s for r in Out.min_max_scale(df, "v", name="s").collect()] == [0.0, .5, 1.0, None, None]
    z = [r.s for r in Out.standard_scale(df, "v", name="s").collect()]
    assert z[1] == 0.0 and abs(z[2] - 2 / np.std([1, 3, 5])) < 1e-12
    flat = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [r.s for r in Out.standard_scale(flat, "v", name="s").collect()] == [0.0, 0.0]


def test_t_test_values(spark):
    df = spark.createDataFrame([(v,) for v in (0.7, 0.8, 0.75, 0.9, 0.65)], "r double")
    r = I.one_sample_t_test(df, "r").first()
    assert (r.sample_size, r.sample_mean, r.sample_std, r.t_statistic) == (5, 0.76, 0.0962, 14.8797)
    assert r.t_critical == 3.7469 and abs(r.p_value - 5.94e-5) < 1e-6 and r.reject_null
    assert r.verdict.startswith("CRISIS") and r.ci95_low < 0.76 < r.ci95_high
    few = I.one_sample_t_test(df.limit(2), "r").first()
    assert (few.status, few.p_value, few.reject_null, few.t_statistic) == ("INSUFFICIENT_DATA", 1.0, False, None)


def test_t_test_without_spread(spark):
    rows = [("up", .5)] * 3 + [("down", .1)] * 3 + [("even", .12)] * 3
    got = {r.k: r for r in I.one_sample_t_test(spark.createDataFrame(rows, "k string, r double"), "r", ["k"]).collect()}
    assert got["up"].reject_null and got["up"].p_value == 0.0
    assert not got["down"].reject_null and got["down"].p_value == 1.0
    assert not got["even"].reject_null and got["even"].p_value is None


def test_mean_interval(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 11)], "v double")
    r = I.mean_interval(df, "v").first()
    half = 2.2621572 * np.std(range(1, 11), ddof=1) / math.sqrt(10)
    assert abs(r.ci_low - (5.5 - half)) < 1e-4 and abs(r.ci_high - (5.5 + half)) < 1e-4


def test_bootstrap(spark):
    rows, df = values(spark)
    means = I.bootstrap_means(df, "v", sample_size=10, samples=40, width=64)
    assert means.count() == 40
    again = I.bootstrap_means(df.repartition(3), "v", sample_size=10, samples=40, width=50)
    first, second = ({r.sample: r.sample_mean for r in m.collect()} for m in (means, again))
    assert first.keys() == second.keys()
    assert all(math.isclose(first[k], second[k], rel_tol=1e-12) for k in first)  # sums differ in order
    s = I.bootstrap_summary(df, "v").first()
    assert s.simulations == 500 and s.clt_holds == (abs(s.mean_of_means - s.population_mean) < .2)


def test_gaps_match_sorting(spark):
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, rng.choice("xy"), start + dt.timedelta(seconds=rng.randrange(200_000))) for i in range(150)]
    got = {r.id: r.gap_seconds for r in I.gaps(spark.createDataFrame(rows, "id int, k string, t timestamp_ntz"), "t", "id", ["k"]).collect()}
    for key in "xy":
        part = sorted((t, i) for i, k, t in rows if k == key)
        assert got[part[0][1]] is None
        for (a, _), (b, i) in zip(part, part[1:]):
            assert abs(got[i] - (b - a).total_seconds()) < 1e-6


def test_arrival_scores(spark):
    rows = [(i, "a", dt.datetime(2024, 1, 1, i % 3, i % 60)) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, k string, t timestamp_ntz")
    counts = I.arrival_counts(df, "t", "1 hour", ["k"])
    r = I.poisson_scores(counts, ["k"]).orderBy("window_start").first()
    pmf = [math.exp(-10) * 10**k / math.factorial(k) for k in range(80)]
    assert (r.n, r.rate, r.is_surge) == (10, 10.0, False)
    assert (r.pmf, r.cdf, r.upper_tail) == (round(pmf[10], 5), round(sum(pmf[:11]), 5), round(sum(pmf[10:]), 5))
    surge = I.poisson_scores(spark.createDataFrame([("a", 1600), ("a", 10)], "k string, n bigint"), ["k"])
    assert {s.n: s.is_surge for s in surge.collect()} == {1600: True, 10: False}
    n = I.normal_scores(spark.createDataFrame([(0.0,)], "v double"), "v", 0.0, 1.0).first()
    assert (n.pdf, n.cdf) == (0.39894, 0.5)
    e = I.exponential_scores(spark.createDataFrame([(2.0,), (4.0,)], "gap_seconds double")).collect()
    assert e[0].scale_beta == 3.0 and e[0].cdf == round(1 - math.exp(-2 / 3), 5)


def test_histogram_keeps_values_beside_the_bounds(spark):
    """A share a last bit below zero or above one stays in the outermost bins."""
    rows = spark.createDataFrame([(i, float(i % 7) / 3) for i in range(300)], "id bigint, x double").repartition(5)
    means = I.bootstrap_means(rows, "x", samples=80)
    first, second = means.orderBy("sample").collect(), means.orderBy("sample").collect()
    assert first == second and len(first) == 80
    counts = {r.bin: r.n for r in P.histogram(means, "sample_mean", 20).collect()}
    values = np.array([r.sample_mean for r in first])
    assert [counts[k] for k in range(20)] == np.histogram(values, 20)[0].tolist() and sum(counts.values()) == 80


def test_quantiles_of_tight_clusters_stay_bounded(spark, monkeypatch):
    """Two clusters a million apart would fill one slice each; they are cut until every slice is small."""
    rng = np.random.default_rng(8)
    data = np.concatenate([rng.normal(0, 1e-3, 3000), rng.normal(1e6, 1e-3, 2000), np.full(1500, 7.25), [1e300, -1e300, 5e-324, 1.7e308, -1.7e308]])
    rows = [(("x", "y")[i % 2] if i % 11 else None, float(v)) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    wanted = {"a": 0.0, "b": 0.1, "c": 0.25, "d": 0.5, "e": 0.77, "f": 1.0}
    seen, narrowed = [], P._narrowed
    monkeypatch.setattr(P, "SLICE_ROWS", 40)
    monkeypatch.setattr(P, "_narrowed", lambda *args: seen.append(narrowed(*args)) or seen[-1])
    got = P.exact_quantiles(df, "v", wanted, slices=64).first()
    assert [got[n] for n in wanted] == np.quantile(data, list(wanted.values())).tolist()
    for r in P.exact_quantiles(df.where("k is not null"), "v", wanted, ["k"], 64).collect():
        own = [v for k, v in rows if k == r.k]
        assert [r[n] for n in wanted] == np.quantile(own, list(wanted.values())).tolist()
    for _, sizes in seen:
        assert sizes.where("_least < _most").agg(F.max("_n")).first()[0] <= 40
