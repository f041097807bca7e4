from pyspark.sql import functions as F

from tidewatch.operators import anomaly as A
from tidewatch.operators import rollup as R


def newest_first(spark, negatives_per_chunk, size, total, platform="X"):
    flags = []
    for chunk, negatives in enumerate(negatives_per_chunk):
        rows = min(size, total - chunk * size)
        flags += [1] * negatives + [0] * (rows - negatives)
    rows = [(total - i, platform, "NEGATIVE" if f else "POSITIVE") for i, f in enumerate(flags)]
    return spark.createDataFrame(rows, "id bigint, platform string, sentiment string")


def test_window_of_fifty(spark):
    df = newest_first(spark, [4, 0, 1, 0, 3, 2, 0], 8, 50)
    ratios = [r.ratio for r in A.recent_chunk_ratios(df).orderBy("chunk").collect()]
    assert ratios == [.5, 0, .125, 0, .375, .25, 0]
    r = A.evaluate_window(df).first()
    assert (r.alert_level, r.negative_velocity, r.total_comments, r.chunks) == ("SAFE", .2, 50, 7)
    assert r.z_score == .395 and not r.reject_null and r.message == "Normal brand sentiment velocity (Z=0.40)"


def test_levels(spark):
    elevated = A.evaluate_window(newest_first(spark, [3, 2, 2, 2, 2, 3, 0], 8, 50)).first()
    assert elevated.alert_level == "ELEVATED" and elevated.negative_velocity == .28
    critical = A.evaluate_window(newest_first(spark, [8, 7, 8, 7, 8, 8, 2], 8, 50)).first()
    assert critical.alert_level == "CRITICAL" and critical.message.startswith("EMERGENCY")


def test_edges(spark):
    empty = A.evaluate_window(newest_first(spark, [], 8, 0)).first()
    assert (empty.alert_level, empty.z_score, empty.p_value, empty.total_comments) == ("SAFE", 0.0, 1.0, 0)
    assert empty.message == "No comments in buffer."
    two = A.evaluate_window(newest_first(spark, [1], 3, 2)).first()
    assert (two.chunks, two.p_value, two.z_score) == (1, 1.0, round((.5 - .12) / .08, 3))
    assert (two.ci95_low, two.ci95_high) == (0.0, 0.0)
    assert A.evaluate_window(newest_first(spark, [], 8, 0), keys=["platform"]).count() == 0


def test_only_the_newest_rows_count(spark):
    recent = newest_first(spark, [0] * 7, 8, 50).withColumn("id", F.col("id") + 1000)
    old = newest_first(spark, [8] * 7, 8, 50).withColumn("sentiment", F.lit("NEGATIVE"))
    both = recent.unionByName(old)
    assert A.evaluate_window(both, keys=["platform"]).first().negative_count == 0
    assert A.evaluate_window(both, window=100).first().negative_count == 50


def test_whole_table_chunks(spark):
    df = newest_first(spark, [4, 0, 1, 0, 3, 2, 0], 8, 50)
    whole = A.chunk_ratios(df, width=7).orderBy("chunk").collect()
    assert [r.ratio for r in whole] == [.5, 0, .125, 0, .375, .25, 0]
    eights = A.chunk_ratios(df, size=8, min_rows=4, width=11).orderBy("chunk").collect()
    assert [r.n for r in eights] == [8] * 6
    keyed = A.chunk_ratios(df.unionByName(df.withColumn("platform", F.lit("Y"))), keys=["platform"], width=9)
    assert keyed.groupBy("platform").count().count() == 2 and keyed.count() == 14


def test_bands(spark):
    df = spark.createDataFrame([(0.0,), (.25,), (.4,), (None,)], "r double")
    assert [r.b for r in df.select(A.velocity_band(F.col("r")).alias("b")).collect()] == ["safe", "elevated", "critical", None]


def test_rollups(spark):
    rows = [(1, "A", "NEGATIVE", 1, .5, .1, "t"), (2, "A", "POSITIVE", 0, .7, .3, "t"),
            (3, "B", "NEUTRAL", 0, .2, .0, "u"), (4, None, "NEGATIVE", 1, .2, .0, "u")]
    df = spark.createDataFrame(rows, "id int, platform string, sentiment string, is_toxic int, "
                                     "sentiment_score double, toxicity_score double, source_target string")
    top = R.platform_rollup(df).collect()
    assert [(r.platform, r.total_comments, r.negative_ratio, r.toxic_ratio) for r in top] == [("A", 2, .5, .5), ("B", 1, 0.0, 0.0)]
    assert tuple(R.headline(df).first()) == (4, 2, 2, .5, True)
    assert tuple(R.headline(df.where("id > 9")).first()) == (0, 0, 0, 0.0, False)
    verdicts = {r.source_target: r.verdict for r in R.audit_brief(df).collect()}
    assert verdicts == {"t": "CRITICAL ACTION REQUIRED", "u": "CRITICAL ACTION REQUIRED"}
    assert R.for_platform(df, "All").count() == 4 and R.for_platform(df, "A").count() == 2
