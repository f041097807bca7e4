"""Distribution, outlier, scaling, resampling and arrival-model queries."""

from pyspark.sql import functions as F

from tidewatch.contracts import KURTOSIS_LABELS, SKEW_LABELS
from tidewatch.operators import anomaly, enrich, inference, outliers, profile, rollup
from tidewatch.plans.registry import (
    CDOC, CEV, comment_documents, comment_events, query, stamp, stamp_sql, table,
)
from tidewatch.plans.sql import clean_sql, erf_sql, has_word_sql, t_cdf_sql
from tidewatch.contracts import PROFANE_WORDS, SEVERE_WORDS

PLATFORM = ["platform"]


def _profile_sql(source: str, v: str, key: str = "") -> str:
    head, part = (f"{key}, ", f"PARTITION BY {key} ") if key else ("", "")
    group = f"GROUP BY {key}" if key else ""
    join = f"JOIN modes USING ({key}) JOIN mom USING ({key})" if key else ", modes, mom"
    s, k = SKEW_LABELS, KURTOSIS_LABELS
    moments = f"avg(pow(x.{v} - c.mu, 3)) / pow(stddev_pop(x.{v}), 3)"
    on = f"JOIN (SELECT {head}avg({v}) AS mu FROM {source} {group}) c" + (f" USING ({key})" if key else " ON true")
    return f"""counts AS (SELECT {head}{v} AS v, count(*) AS n FROM {source} WHERE {v} IS NOT NULL GROUP BY {head}{v}),
modes AS (SELECT {head}v AS mode FROM (SELECT {head}v, row_number() OVER ({part}ORDER BY n DESC, v) AS rn FROM counts) WHERE rn = 1),
mom AS (SELECT {head}{moments} AS sk FROM {source} x {on} {group}),
st AS (SELECT {head}count({v}) AS n, avg({v}) AS m, quantile_cont({v}, 0.5) AS md, var_samp({v}) AS va,
  stddev_samp({v}) AS sd, min({v}) AS lo, max({v}) AS hi, quantile_cont({v}, 0.25) AS q1,
  quantile_cont({v}, 0.75) AS q3, quantile_cont({v}, 0.9) AS p90, kurtosis_pop({v}) AS ku FROM {source} {group})
SELECT {head}n AS count, round(m, 4) AS mean, round(md, 4) AS median, round(mode, 4) AS mode,
  round(va, 4) AS variance, round(sd, 4) AS std_dev, round(hi - lo, 4) AS range, round(lo, 4) AS min,
  round(hi, 4) AS max, round(q1, 4) AS q1, round(md, 4) AS q2_median, round(q3, 4) AS q3,
  round(q3 - q1, 4) AS iqr, round(p90, 4) AS percentile_90, round(sk, 4) AS skewness,
  CASE WHEN abs(sk) < 0.5 THEN '{s[0]}' WHEN sk >= 0.5 THEN '{s[1]}' ELSE '{s[2]}' END AS skewness_interpretation,
  round(ku, 4) AS kurtosis,
  CASE WHEN ku > 1 THEN '{k[0]}' WHEN ku < -1 THEN '{k[1]}' ELSE '{k[2]}' END AS kurtosis_interpretation
FROM st {join}"""


@query("univariate_profile", f"WITH {CEV}, {_profile_sql('cev', 'sentiment_score')}")
def univariate_profile(spark, folder):
    return profile.univariate_profile(comment_events(spark, folder), "sentiment_score")


@query("univariate_by_platform", f"WITH {CEV}, {_profile_sql('cev', 'sentiment_score', 'platform')}")
def univariate_by_platform(spark, folder):
    return profile.univariate_profile(comment_events(spark, folder), "sentiment_score", PLATFORM)


def _bivariate_sql(source: str, x: str, y: str) -> str:
    return f"""b AS (SELECT count(*) AS n, covar_samp({x}, {y}) AS cv, corr({x}, {y}) AS r
  FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
c AS (SELECT *, abs(r) * sqrt((n - 2) / (1 - r * r)) AS t, (n - 2)::DOUBLE AS df FROM b)
SELECT '{x}' AS feature_x, '{y}' AS feature_y, n AS sample_size, round(cv, 4) AS covariance,
  round(r, 4) AS pearson_correlation,
  round(greatest(0, 2 * (1 - ({t_cdf_sql('t', 'df')}))), 6) AS p_value FROM c"""


@query("bivariate", f"WITH {CEV}, {_bivariate_sql('cev', 'sentiment_score', 'is_toxic')}")
def bivariate(spark, folder):
    return profile.bivariate(comment_events(spark, folder), "sentiment_score", "is_toxic")


@query("bivariate_lineitem", f"WITH {_bivariate_sql('lineitem', 'l_quantity', 'l_discount')}")
def bivariate_lineitem(spark, folder):
    return profile.bivariate(table(spark, folder, "lineitem"), "l_quantity", "l_discount")


LINE_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS feature_x, '{b}' AS feature_y, round(corr({a}, {b}), 4) AS correlation FROM lineitem"
    for a in LINE_COLUMNS for b in LINE_COLUMNS))
def correlation_matrix(spark, folder):
    return profile.correlation_matrix(table(spark, folder, "lineitem"), LINE_COLUMNS)


@query("score_histogram", f"""WITH {CEV},
b AS (SELECT min(sentiment_score) AS lo, max(sentiment_score) AS hi, count(*) AS size FROM cev),
c AS (SELECT least(floor((sentiment_score - lo) / (hi - lo) * 15), 14)::INT AS bin, count(*) AS n
  FROM cev, b GROUP BY bin),
g AS (SELECT unnest(range(0, 15))::INT AS bin)
SELECT g.bin, round(lo + (hi - lo) / 15 * g.bin, 6) AS bin_low, round(lo + (hi - lo) / 15 * (g.bin + 1), 6) AS bin_high,
  coalesce(n, 0) AS n, round(coalesce(n, 0) / (size * ((hi - lo) / 15)), 6) AS density
FROM g CROSS JOIN b LEFT JOIN c USING (bin)""")
def score_histogram(spark, folder):
    return profile.histogram(comment_events(spark, folder), "sentiment_score", 15)


@query("length_vs_toxicity", f"""WITH {CDOC},
c AS (SELECT id, {clean_sql('raw_text')} AS t FROM cdoc),
f AS (SELECT id, t, {has_word_sql('t', SEVERE_WORDS)} AS sev, {has_word_sql('t', PROFANE_WORDS)} AS pro FROM c)
SELECT id, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END::INT AS word_count,
  least(1.0, round(CASE WHEN sev THEN 0.7 ELSE 0 END + CASE WHEN pro THEN 0.45 ELSE 0 END, 4))::DOUBLE AS toxicity_score,
  (sev OR pro)::INT AS is_toxic FROM f""")
def length_vs_toxicity(spark, folder):
    rows = enrich.with_text_features(comment_documents(spark, folder))
    return rollup.length_vs_toxicity(enrich.score_texts(rows))


# -- outliers and scaling --------------------------------------------------------

FENCES = f"""WITH {CEV},
q AS (SELECT quantile_cont(sentiment_score, 0.25) AS q1, quantile_cont(sentiment_score, 0.75) AS q3 FROM cev),
f AS (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)"""


@query("outliers_iqr", f"""{FENCES}
SELECT id, sentiment_score, sentiment_score < lo OR sentiment_score > hi AS is_outlier FROM cev, f""")
def outliers_iqr(spark, folder):
    marked = outliers.mark_iqr(comment_events(spark, folder), "sentiment_score")
    return marked.select("id", "sentiment_score", "is_outlier")


@query("outliers_iqr_bounds", f"""{FENCES}
SELECT round(q1, 4) AS q1, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr, round(lo, 4) AS lower_bound,
  round(hi, 4) AS upper_bound,
  (SELECT count(*) FROM cev, f WHERE sentiment_score < lo OR sentiment_score > hi) AS outlier_count FROM f""")
def outliers_iqr_bounds(spark, folder):
    return outliers.iqr_bounds(comment_events(spark, folder), "sentiment_score")


@query("outliers_iqr_by_platform", f"""WITH {CEV},
q AS (SELECT platform, quantile_cont(sentiment_score, 0.25) AS q1, quantile_cont(sentiment_score, 0.75) AS q3
  FROM cev GROUP BY platform)
SELECT platform, round(q1, 4) AS q1, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr,
  round(q1 - 1.5 * (q3 - q1), 2) AS lower_bound, round(q3 + 1.5 * (q3 - q1), 2) AS upper_bound,
  count(*) FILTER (sentiment_score < q1 - 1.5 * (q3 - q1) OR sentiment_score > q3 + 1.5 * (q3 - q1)) AS outlier_count
FROM cev JOIN q USING (platform) GROUP BY platform, q1, q3""")
def outliers_iqr_by_platform(spark, folder):
    bounds = outliers.iqr_bounds(comment_events(spark, folder), "sentiment_score", PLATFORM)
    fences = {c: F.round(c, 2) for c in ("lower_bound", "upper_bound")}  # 4 digits would hit a tie
    return bounds.withColumns(fences)


@query("outliers_zscore", f"""WITH {CEV}, s AS (SELECT avg(sentiment_score) AS m, stddev_pop(sentiment_score) AS sd FROM cev)
SELECT id, sentiment_score FROM cev, s WHERE abs((sentiment_score - m) / sd) > 3""")
def outliers_zscore(spark, folder):
    marked = outliers.mark_zscore(comment_events(spark, folder), "sentiment_score")
    return outliers.only_outliers(marked).select("id", "sentiment_score")


@query("minmax_scale", """SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 6) AS scaled
FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)""")
def minmax_scale(spark, folder):
    rows = outliers.min_max_scale(table(spark, folder, "customer"), "c_acctbal", name="scaled")
    return rows.select("c_custkey", F.round("scaled", 6).alias("scaled"))


@query("standard_scale", """SELECT c_custkey, round((c_acctbal - m) / s, 6) AS scaled
FROM customer, (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer)""")
def standard_scale(spark, folder):
    rows = outliers.standard_scale(table(spark, folder, "customer"), "c_acctbal", name="scaled")
    return rows.select("c_custkey", F.round("scaled", 6).alias("scaled"))


# -- resampling ------------------------------------------------------------------

BOOTSTRAP = f"""WITH {CEV},
pop AS (SELECT row_number() OVER (ORDER BY id) - 1 AS idx, sentiment_score AS v FROM cev),
size AS (SELECT count(*) AS n FROM cev),
draws AS (SELECT d // 30 AS sample, ('0x' || substr(md5('42-' || d), 1, 15))::BIGINT % n AS idx
  FROM range(0, 15000) r(d), size),
means AS (SELECT sample, avg(v) AS m FROM draws JOIN pop USING (idx) GROUP BY sample)"""


@query("bootstrap_means", f"{BOOTSTRAP} SELECT sample::BIGINT AS sample, round(m, 6) AS sample_mean FROM means")
def bootstrap_means(spark, folder):
    means = inference.bootstrap_means(comment_events(spark, folder), "sentiment_score")
    return means.withColumn("sample_mean", F.round("sample_mean", 6))


@query("bootstrap_summary", f"""{BOOTSTRAP},
p AS (SELECT avg(sentiment_score) AS mu, stddev_pop(sentiment_score) AS sd FROM cev),
a AS (SELECT count(*) AS sims, avg(m) AS mm, stddev_pop(m) AS ms FROM means)
SELECT round(mu, 4) AS population_mean, round(sd, 4) AS population_std, 30 AS sample_size, sims AS simulations,
  round(mm, 4) AS mean_of_means, round(ms, 4) AS empirical_std_error, round(sd / sqrt(30), 4) AS theoretical_std_error,
  abs(mm - mu) < 0.2 AS clt_holds FROM p, a""")
def bootstrap_summary(spark, folder):
    return inference.bootstrap_summary(comment_events(spark, folder), "sentiment_score")


@query("sampling_histogram", f"""{BOOTSTRAP},
b AS (SELECT min(m) AS lo, max(m) AS hi, count(*) AS size FROM means),
c AS (SELECT least(floor((m - lo) / (hi - lo) * 20), 19)::INT AS bin, count(*) AS n FROM means, b GROUP BY bin),
g AS (SELECT unnest(range(0, 20))::INT AS bin)
SELECT g.bin, round(lo + (hi - lo) / 20 * g.bin, 6) AS bin_low, round(lo + (hi - lo) / 20 * (g.bin + 1), 6) AS bin_high,
  coalesce(n, 0) AS n, round(coalesce(n, 0) / (size * ((hi - lo) / 20)), 6) AS density
FROM g CROSS JOIN b LEFT JOIN c USING (bin)""")
def sampling_histogram(spark, folder):
    means = inference.bootstrap_means(comment_events(spark, folder), "sentiment_score")
    return profile.histogram(means, "sample_mean", 20)


# -- distribution scores ---------------------------------------------------------

@query("poisson_arrival_score", f"""WITH {CEV},
w AS (SELECT platform, date_trunc('hour', created_at) AS h, count(*) AS n FROM cev GROUP BY platform, h),
r AS (SELECT platform, avg(n) AS rate FROM w GROUP BY platform),
x AS (SELECT *, list_transform(range(0, n + 60), lambda k: exp(k * ln(rate) - rate - lgamma(k + 1.0))) AS p
  FROM w JOIN r USING (platform))
SELECT platform, {stamp_sql('h')} AS window_start, n, round(rate, 4) AS rate, round(p[n + 1], 5) AS pmf,
  round(list_sum(p[1:n + 1]), 5) AS cdf, round(list_sum(p[n + 1:]), 5) AS upper_tail,
  round(rate, 4) AS expected_value, round(rate, 4) AS variance, n / 60 > 25 AS is_surge FROM x""")
def poisson_arrival_score(spark, folder):
    counts = inference.arrival_counts(comment_events(spark, folder), "created_at", "1 hour", PLATFORM)
    scored = inference.poisson_scores(counts, PLATFORM)
    return scored.withColumn("window_start", stamp("window_start"))


@query("binomial_negative_tail", f"""WITH {CEV},
w AS (SELECT platform, strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n,
  count(*) FILTER (sentiment = 'NEGATIVE') AS negatives FROM cev GROUP BY platform, day),
x AS (SELECT *, list_transform(range(0, n + 1), lambda k: exp(lgamma(n + 1.0) - lgamma(k + 1.0)
  - lgamma(n - k + 1.0) + k * ln(0.12) + (n - k) * ln(0.88))) AS p FROM w)
SELECT platform, day, n, negatives, round(p[negatives + 1], 5) AS pmf, round(list_sum(p[1:negatives + 1]), 5) AS cdf,
  round(list_sum(p[negatives + 1:]), 5) AS upper_tail, round(n * 0.12::DOUBLE, 4) AS expected_value,
  round(n * 0.12::DOUBLE * 0.88::DOUBLE, 4) AS variance FROM x""")
def binomial_negative_tail(spark, folder):
    rows = comment_events(spark, folder).withColumn("day", F.date_format("created_at", "yyyy-MM-dd"))
    counts = rows.groupBy("platform", "day").agg(
        F.count(F.lit(1)).alias("n"), F.sum(anomaly.is_negative()).alias("negatives"))
    return inference.binomial_scores(counts, "negatives", "n")


@query("normal_score", f"""WITH {CEV},
s AS (SELECT avg(sentiment_score) AS mu, stddev_pop(sentiment_score) AS sd FROM cev),
z AS (SELECT id, (sentiment_score - mu) / sd AS z, sd FROM cev, s),
y AS (SELECT *, z / sqrt(2) AS x FROM z)
SELECT id, round(exp(-z * z / 2) / (sd * sqrt(2 * pi())), 5) AS pdf,
  round(0.5 + 0.5 * {erf_sql('x')}, 5) AS cdf FROM y""")
def normal_score(spark, folder):
    scored = inference.normal_scores(comment_events(spark, folder), "sentiment_score")
    return scored.select("id", "pdf", "cdf")


@query("interarrival_exponential", f"""WITH {CEV},
t AS (SELECT id, platform, epoch_us(created_at) / 1e6 AS s, epoch_us(lag(created_at)
  OVER (PARTITION BY platform ORDER BY created_at, id)) / 1e6 AS p FROM cev WHERE sentiment = 'NEGATIVE'),
g AS (SELECT id, platform, s - p AS gap FROM t),
b AS (SELECT platform, avg(gap) AS beta FROM g GROUP BY platform)
SELECT id, platform, round(gap, 3) AS gap_seconds, round(beta, 4) AS scale_beta, round(1 / beta, 4) AS rate_lambda,
  round(exp(-gap / beta) / beta, 5) AS pdf, round(1 - exp(-gap / beta), 5) AS cdf
FROM g JOIN b USING (platform)""")
def interarrival_exponential(spark, folder):
    negatives = comment_events(spark, folder).where("sentiment = 'NEGATIVE'")
    spaced = inference.gaps(negatives, "created_at", "id", PLATFORM)
    scored = inference.exponential_scores(spaced, keys=PLATFORM)
    return scored.select("id", "platform", F.round("gap_seconds", 3).alias("gap_seconds"),
                         "scale_beta", "rate_lambda", "pdf", "cdf")
