"""Channel rollups, windows, alerts: the dashboard's queries."""

from pyspark.sql import functions as F

from tidewatch.contracts import DASHBOARD_ROWS, WINDOW_ROWS
from tidewatch.operators import anomaly, inference, ordering, rollup
from tidewatch.plans.registry import (
    CDOC, CEV, CSURGE, comment_documents, comment_events, query, stamp, stamp_sql, surge_events,
)
from tidewatch.plans.sql import shown_sql, t_cdf_sql, t_quantile_sql
from tidewatch.session import materialize, scratch_path
from tidewatch.sources import store

PLATFORM = ["platform"]


def _scored_events(spark, folder):
    return comment_events(spark, folder).withColumn("toxicity_score", F.col("sentiment_score") / 100)


@query("platform_rollup", f"""WITH {CEV}
SELECT platform, count(id) AS total_comments,
  count(*) FILTER (sentiment = 'NEGATIVE') AS negative_count,
  count(*) FILTER (sentiment = 'POSITIVE') AS positive_count,
  sum(is_toxic)::BIGINT AS toxic_count,
  round(avg(sentiment_score), 4) AS avg_sentiment_score,
  round(avg(sentiment_score / 100), 4) AS avg_toxicity_score,
  round(count(*) FILTER (sentiment = 'NEGATIVE') / count(id), 4) AS negative_ratio,
  round(sum(is_toxic) / count(id), 4) AS toxic_ratio
FROM cev GROUP BY platform ORDER BY negative_ratio DESC, platform""")
def platform_rollup(spark, folder):
    return rollup.platform_rollup(_scored_events(spark, folder))


@query("kpi_header", f"""WITH {CEV}
SELECT count(*) AS total_comments, count(*) FILTER (sentiment = 'NEGATIVE') AS negative_count,
  sum(is_toxic)::BIGINT AS toxic_count,
  round(count(*) FILTER (sentiment = 'NEGATIVE') / count(*), 4) AS negative_ratio,
  count(*) FILTER (sentiment = 'NEGATIVE') / count(*) > 0.25 AS is_high
FROM cev""")
def kpi_header(spark, folder):
    return rollup.headline(comment_events(spark, folder))


@query("audit_verdict", f"""WITH {CDOC}
SELECT source_target, count(*) AS n,
  round(avg((sentiment = 'POSITIVE')::INT) * 100, 1) AS positive_percent,
  round(avg((sentiment = 'NEGATIVE')::INT) * 100, 1) AS negative_percent,
  sum(is_toxic)::BIGINT AS toxic_count,
  CASE WHEN avg((sentiment = 'NEGATIVE')::INT) > 0.35 THEN 'CRITICAL ACTION REQUIRED'
    WHEN avg((sentiment = 'NEGATIVE')::INT) > 0.20 THEN 'MODERATE FRICTION'
    ELSE 'HEALTHY PUBLIC SENTIMENT' END AS verdict
FROM cdoc GROUP BY source_target""")
def audit_verdict(spark, folder):
    return rollup.audit_brief(comment_documents(spark, folder))


@query("sentiment_counts", f"""WITH {CEV}
SELECT sentiment, count(*) AS n FROM cev GROUP BY sentiment""")
def sentiment_counts(spark, folder):
    return rollup.value_counts(comment_events(spark, folder), "sentiment")


@query("recent_by_platform", f"""WITH {CEV}
SELECT id, platform, author, sentiment, sentiment_score, is_toxic, {stamp_sql('created_at')} AS created_at
FROM cev WHERE platform = 'Reddit' ORDER BY id DESC LIMIT 100""")
def recent_by_platform(spark, folder):
    rows = store.recent_comments(comment_events(spark, folder), 100, "Reddit")
    return rows.withColumn("created_at", stamp("created_at"))


@query("recent_all_platforms", f"""WITH {CEV}
SELECT id, platform, sentiment FROM cev ORDER BY id DESC LIMIT 100""")
def recent_all_platforms(spark, folder):
    rows = store.recent_comments(comment_events(spark, folder), 100, "All")
    return rows.select("id", "platform", "sentiment")


@query("recent_window", f"""WITH {CEV}
SELECT id, platform, sentiment FROM cev ORDER BY id DESC LIMIT {WINDOW_ROWS}""")
def recent_window(spark, folder):
    newest = ordering.latest(comment_events(spark, folder), DASHBOARD_ROWS)
    return ordering.latest(newest, WINDOW_ROWS).select("id", "platform", "sentiment")


# -- rolling ratios and chunks ---------------------------------------------------

def rolling_sql(partition: str = "") -> str:
    frame = f"({partition}ORDER BY id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"
    return f"""rolled AS (SELECT id, platform, row_number() OVER ({partition}ORDER BY id) AS pos,
  CASE WHEN count(*) OVER {frame} >= 3 THEN avg((sentiment = 'NEGATIVE')::INT) OVER {frame} END AS r
  FROM cev)"""


@query("rolling_negative", f"""WITH {CEV}, {rolling_sql()}
SELECT id, (pos - 1)::BIGINT AS sequence_no, round(r, 6) AS rolling_negative FROM rolled""")
def rolling_negative(spark, folder):
    rows = anomaly.rolling_negative(comment_events(spark, folder))
    return rows.select("id", (F.col("pos") - 1).alias("sequence_no"),
                       F.round("rolling_negative", 6).alias("rolling_negative"))


@query("rolling_negative_by_platform", f"""WITH {CEV}, {rolling_sql('PARTITION BY platform ')}
SELECT id, platform, round(r, 6) AS rolling_negative FROM rolled""")
def rolling_negative_by_platform(spark, folder):
    rows = anomaly.rolling_negative(comment_events(spark, folder), PLATFORM)
    return rows.select("id", "platform", F.round("rolling_negative", 6).alias("rolling_negative"))


@query("ewma_negative", f"""WITH {CEV}
SELECT id, platform, round(list_reduce(list((sentiment = 'NEGATIVE')::INT::DOUBLE) OVER (
    PARTITION BY platform ORDER BY id ROWS BETWEEN 299 PRECEDING AND CURRENT ROW),
    lambda s, x: (11 * s + 2 * x) / 13), 6) AS ewma_negative FROM cev""")
def ewma_negative(spark, folder):
    rows = anomaly.ewma_negative(comment_events(spark, folder), PLATFORM)
    return rows.select("id", "platform", F.round("ewma_negative", 6).alias("ewma_negative"))


@query("velocity_bands", f"""WITH {CEV}, {rolling_sql('PARTITION BY platform ')}
SELECT id, platform, CASE WHEN r < 0.25 THEN 'safe' WHEN r < 0.40 THEN 'elevated'
  WHEN r IS NOT NULL THEN 'critical' END AS band FROM rolled""")
def velocity_bands(spark, folder):
    rows = anomaly.rolling_negative(comment_events(spark, folder), PLATFORM)
    return rows.select("id", "platform", anomaly.velocity_band(F.col("rolling_negative")).alias("band"))


def _chunks_sql(size: str, partition: str = "", key: str = "") -> str:
    return f"""placed AS (SELECT {key}id, sentiment, row_number() OVER ({partition}ORDER BY id DESC) AS rn,
  count(*) OVER ({partition}) AS total FROM cev),
chunks AS (SELECT {key}(rn - 1) // ({size}) AS chunk, count(*) AS n,
  count(*) FILTER (sentiment = 'NEGATIVE') AS negatives,
  count(*) FILTER (sentiment = 'NEGATIVE') / count(*) AS ratio FROM placed GROUP BY {key}chunk)"""


@query("chunk_ratios", f"""WITH {CEV}, {_chunks_sql('greatest(3, total // 6)')}
SELECT chunk, n, negatives, round(ratio, 6) AS ratio FROM chunks""")
def chunk_ratios(spark, folder):
    rows = anomaly.chunk_ratios(comment_events(spark, folder))
    return rows.withColumn("ratio", F.round("ratio", 6))


@query("chunk8_ratios", f"""WITH {CEV}, {_chunks_sql('8')}
SELECT chunk, n, negatives, round(ratio, 6) AS ratio FROM chunks WHERE n >= 4""")
def chunk8_ratios(spark, folder):
    rows = anomaly.chunk_ratios(comment_events(spark, folder), size=8, min_rows=4)
    return rows.withColumn("ratio", F.round("ratio", 6))


# -- t-tests -----------------------------------------------------------------------

def _t_test_sql(source: str, keys: str = "", by: str = "") -> str:
    group = f"GROUP BY {by}" if by else ""
    q = {p: t_quantile_sql(p, "df") for p in (0.99, 0.975, 0.995)}
    return f"""g AS (SELECT {keys}count(*) AS n, avg(ratio) AS m, stddev_samp(ratio) AS s
  FROM {source} {group}),
h AS (SELECT {keys}n, m, s, s / sqrt(n) AS se, (n - 1)::DOUBLE AS df, (m - 0.12) / (s / sqrt(n)) AS t FROM g),
k AS (SELECT *, 1 - ({t_cdf_sql('t', 'df')}) AS p FROM h)
SELECT {keys}'OK' AS status, 'mu = 0.1200 (Brand is stable)' AS null_hypothesis,
  'mu > 0.1200 (Brand is under crisis backlash)' AS alt_hypothesis,
  n AS sample_size, round(m, 4) AS sample_mean, round(s, 4) AS sample_std,
  round(se, 4) AS standard_error, df::BIGINT AS degrees_of_freedom, round(t, 4) AS t_statistic,
  round({q[0.99]}, 4) AS t_critical, round(p, 6) AS p_value, p < 0.01 AND t > 0 AS reject_null,
  CASE WHEN p < 0.01 AND t > 0 THEN 'CRISIS DETECTED (Statistically Significant)'
    ELSE 'NORMAL (Fail to reject H0)' END AS verdict,
  round(m - ({q[0.975]}) * se, 4) AS ci95_low, round(m + ({q[0.975]}) * se, 4) AS ci95_high,
  round(m - ({q[0.995]}) * se, 4) AS ci99_low, round(m + ({q[0.995]}) * se, 4) AS ci99_high
FROM k"""


@query("ttest_one_sample", f"""WITH {CEV}, {_chunks_sql('8')},
kept AS (SELECT * FROM chunks WHERE n >= 4), {_t_test_sql('kept')}""")
def ttest_one_sample(spark, folder):
    chunks = anomaly.chunk_ratios(comment_events(spark, folder), size=8, min_rows=4)
    return inference.one_sample_t_test(chunks, "ratio")


@query("ttest_by_platform", f"""WITH {CEV},
{_chunks_sql('greatest(3, total // 6)', 'PARTITION BY platform ', 'platform, ')},
{_t_test_sql('chunks', 'platform, ', 'platform')}""")
def ttest_by_platform(spark, folder):
    chunks = anomaly.chunk_ratios(comment_events(spark, folder), keys=PLATFORM)
    return inference.one_sample_t_test(chunks, "ratio", PLATFORM)


@query("mean_ci", f"""WITH {CEV}, g AS (SELECT platform, count(*) AS n, avg(sentiment_score) AS m,
  stddev_samp(sentiment_score) / sqrt(count(*)) AS se, count(*) - 1.0::DOUBLE AS df FROM cev GROUP BY platform)
SELECT platform, n, round(m, 4) AS mean, round(m - ({t_quantile_sql(0.975, 'df')}) * se, 4) AS ci_low,
  round(m + ({t_quantile_sql(0.975, 'df')}) * se, 4) AS ci_high FROM g""")
def mean_ci(spark, folder):
    return inference.mean_interval(comment_events(spark, folder), "sentiment_score", 0.95, PLATFORM)


# -- window evaluation -----------------------------------------------------------

def evaluate_sql(source: str, keys=(), window: int = WINDOW_ROWS, limit: int = 8) -> str:
    key = "".join(f"{k}, " for k in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    q = t_quantile_sql(0.975, "df", limit)
    return f"""newest AS (SELECT * FROM (SELECT *, row_number() OVER ({part}ORDER BY id DESC) AS rn FROM {source})
  WHERE rn <= {window}),
sized AS (SELECT *, count(*) OVER ({part}) AS total FROM newest),
chunks AS (SELECT {key}(rn - 1) // greatest(3, total // 6) AS chunk, count(*) AS n,
  count(*) FILTER (sentiment = 'NEGATIVE') AS negatives,
  count(*) FILTER (sentiment = 'NEGATIVE') / count(*) AS ratio FROM sized GROUP BY {key}chunk),
g AS (SELECT {key}sum(n)::BIGINT AS total, sum(negatives)::BIGINT AS neg, count(*) AS chunks,
  avg(ratio) AS m, stddev_samp(ratio) AS s FROM chunks {group}),
h AS (SELECT *, neg / total AS ratio, (chunks - 1)::DOUBLE AS df, s / sqrt(chunks) AS se,
  (neg / total - 0.12) / CASE WHEN s >= 0.02 THEN s ELSE 0.08 END AS z,
  CASE WHEN chunks < 3 THEN NULL WHEN s > 0 THEN (m - 0.12) / (s / sqrt(chunks)) END AS t FROM g),
k AS (SELECT *, CASE WHEN chunks < 3 THEN 1.0 WHEN s = 0 AND m > 0.12 THEN 0.0 WHEN s = 0 AND m < 0.12 THEN 1.0
  ELSE 1 - ({t_cdf_sql('t', 'df')}) END AS p FROM h),
r AS (SELECT *, coalesce(p < 0.01 AND m > 0.12, false) AS reject FROM k),
alerts AS (SELECT *, CASE WHEN z >= 2.8 OR (reject AND ratio >= 0.40) THEN 'CRITICAL'
  WHEN z >= 2.0 OR ratio >= 0.25 THEN 'ELEVATED' ELSE 'SAFE' END AS level FROM r),
evaluated AS (SELECT {key}level AS alert_level, round(ratio, 4) AS negative_velocity, neg AS negative_count,
  total AS total_comments, chunks, round(z, 3) AS z_score, round(p, 6) AS p_value, reject AS reject_null,
  CASE WHEN chunks >= 3 THEN round(m - ({q}) * se, 4) ELSE 0 END AS ci95_low,
  CASE WHEN chunks >= 3 THEN round(m + ({q}) * se, 4) ELSE 0 END AS ci95_high,
  CASE level WHEN 'CRITICAL' THEN printf('EMERGENCY: Statistically abnormal crisis backlash detected! (Z=%.2f, p=%.4f)', {shown_sql('z', 2)}, {shown_sql('round(p, 6)', 4)})
    WHEN 'ELEVATED' THEN printf('WARNING: Negative sentiment velocity rising above threshold (Z=%.2f)', {shown_sql('z', 2)})
    ELSE printf('Normal brand sentiment velocity (Z=%.2f)', {shown_sql('z', 2)}) END AS message FROM alerts)"""


@query("evaluate_window", f"WITH {CEV}, {evaluate_sql('cev')} SELECT * FROM evaluated")
def evaluate_window(spark, folder):
    return anomaly.evaluate_window(comment_events(spark, folder))


@query("evaluate_window_by_platform",
       f"WITH {CEV}, {evaluate_sql('cev', PLATFORM)} SELECT * FROM evaluated")
def evaluate_window_by_platform(spark, folder):
    return anomaly.evaluate_window(comment_events(spark, folder), keys=PLATFORM)


DAILY = ["platform", "day"]
DAILY_SOURCE = "daily AS (SELECT *, strftime(created_at, '%Y-%m-%d') AS day FROM csurge)"


def _daily(spark, folder):
    return surge_events(spark, folder).withColumn("day", F.date_format("created_at", "yyyy-MM-dd"))


@query("evaluate_window_daily",
       f"WITH {CSURGE}, {DAILY_SOURCE}, {evaluate_sql('daily', DAILY)} SELECT * FROM evaluated")
def evaluate_window_daily(spark, folder):
    return anomaly.evaluate_window(_daily(spark, folder), keys=DAILY)


@query("recent_alerts", f"""WITH {CSURGE}, {DAILY_SOURCE}, {evaluate_sql('daily', DAILY)}
SELECT day, platform, alert_level, z_score, p_value, negative_velocity AS negative_ratio, total_comments::INT AS sample_size
FROM evaluated WHERE alert_level <> 'SAFE' ORDER BY day DESC, platform DESC LIMIT 10""")
def recent_alerts(spark, folder):
    """Alerts of the surge appended channel by channel, read back newest first."""
    alerts = materialize(store.alert_rows(anomaly.evaluate_window(_daily(spark, folder), keys=DAILY)), "alerts")
    root = scratch_path(spark, "store")
    store.create_tables(spark, root)
    for channel in sorted(r[0] for r in alerts.select("platform").distinct().collect()):
        store.append_alerts(alerts.where(F.col("platform") == channel)
                            .withColumn("triggered_at", F.to_timestamp("day")), root)
    return store.recent_alerts(store.read_table(spark, root, "crisis_alerts"), 10).select(
        F.date_format("triggered_at", "yyyy-MM-dd").alias("day"), "platform", "alert_level", "z_score",
        "p_value", "negative_ratio", "sample_size")


@query("brand_report", f"""WITH {CEV}, {evaluate_sql('cev')},
kpi AS (SELECT count(*) AS volume, round(count(*) FILTER (sentiment = 'NEGATIVE') / count(*), 4) AS negative_ratio,
  sum(is_toxic)::BIGINT AS toxic_hits FROM cev)
SELECT alert_level AS status, z_score, volume, negative_ratio, p_value,
  CASE WHEN reject_null THEN 'CRITICAL ANOMALY' ELSE 'NORMAL VARIATION' END AS verdict, toxic_hits,
  'Channel health: ' || alert_level || printf(', z = %.2f', {shown_sql('z_score', 2)})
  || chr(10) || format('{{:,}} posts', volume) || printf(', %.2f%% negative against 12.00%% expected', {shown_sql('negative_ratio * 100', 2)})
  || chr(10) || printf('One-sided test: p = %.6f, ', p_value) || CASE WHEN reject_null THEN 'CRITICAL ANOMALY' ELSE 'NORMAL VARIATION' END
  || chr(10) || 'Posts flagged as toxic: ' || toxic_hits AS report
FROM evaluated, kpi""")
def brand_report(spark, folder):
    rows = comment_events(spark, folder)
    return store.brand_report(rollup.headline(rows), anomaly.evaluate_window(rows))


@query("arrival_rate", f"""WITH {CEV}
SELECT platform, {stamp_sql("date_trunc('hour', created_at)")} AS window_start, count(*) AS n,
  round(count(*) / 60, 4) AS per_minute
FROM cev GROUP BY platform, date_trunc('hour', created_at)""")
def arrival_rate(spark, folder):
    rows = inference.arrival_rate(comment_events(spark, folder), "created_at", 60, PLATFORM)
    return rows.withColumn("window_start", stamp("window_start"))
