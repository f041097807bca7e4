"""Channel rollups, headline figures and the audit brief."""

from pyspark.sql import DataFrame, functions as F

from tidewatch.contracts import AUDIT_CRITICAL_RATIO, AUDIT_MODERATE_RATIO, ELEVATED_RATIO


def _count(sentiment: str):
    return F.count_if(F.col("sentiment") == sentiment)


def for_platform(df: DataFrame, platform: str | None = None) -> DataFrame:
    """Rows of one platform; no platform or ``All`` keeps everything."""
    return df if platform in (None, "", "All") else df.where(F.col("platform") == platform)


def negative_texts(df: DataFrame, text: str = "clean_text") -> DataFrame:
    return df.where(F.col("sentiment") == "NEGATIVE").select("id", text)


def platform_rollup(df: DataFrame) -> DataFrame:
    """Volume, polarity, toxicity and mean scores per channel, worst first."""
    total = F.col("total_comments")
    return (df.where(F.col("platform").isNotNull()).groupBy("platform")
            .agg(F.count("id").alias("total_comments"), _count("NEGATIVE").alias("negative_count"),
                 _count("POSITIVE").alias("positive_count"),
                 F.sum(F.col("is_toxic").cast("int")).alias("toxic_count"),
                 F.round(F.avg("sentiment_score"), 4).alias("avg_sentiment_score"),
                 F.round(F.avg("toxicity_score"), 4).alias("avg_toxicity_score"))
            .withColumn("negative_ratio", F.round(F.try_divide("negative_count", total), 4))
            .withColumn("toxic_ratio", F.round(F.try_divide("toxic_count", total), 4))
            .orderBy(F.desc("negative_ratio"), "platform"))


def headline(df: DataFrame) -> DataFrame:
    """Volume, negatives, negative share and toxic flags; zeros on an empty table."""
    ratio = F.coalesce(F.try_divide("negative_count", "total_comments"), F.lit(0.0))
    return (df.agg(F.count(F.lit(1)).alias("total_comments"),
                   _count("NEGATIVE").alias("negative_count"),
                   F.coalesce(F.sum(F.col("is_toxic").cast("int")), F.lit(0)).alias("toxic_count"))
            .withColumn("negative_ratio", F.round(ratio, 4))
            .withColumn("is_high", ratio > ELEVATED_RATIO))


def audit_brief(df: DataFrame, target: str = "source_target") -> DataFrame:
    """Size, polarity shares, toxic flags and verdict per audited target."""
    negative = F.col("_negative")
    verdict = (F.when(negative > AUDIT_CRITICAL_RATIO, "CRITICAL ACTION REQUIRED")
               .when(negative > AUDIT_MODERATE_RATIO, "MODERATE FRICTION")
               .otherwise("HEALTHY PUBLIC SENTIMENT"))
    share = lambda name: F.avg((F.col("sentiment") == name).cast("double"))
    return (df.groupBy(target)
            .agg(F.count(F.lit(1)).alias("n"), share("POSITIVE").alias("_positive"),
                 share("NEGATIVE").alias("_negative"),
                 F.sum(F.col("is_toxic").cast("int")).alias("toxic_count"))
            .select(target, "n", F.round(F.col("_positive") * 100, 1).alias("positive_percent"),
                    F.round(negative * 100, 1).alias("negative_percent"), "toxic_count",
                    verdict.alias("verdict")))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def length_vs_toxicity(df: DataFrame) -> DataFrame:
    return df.select("id", "word_count", "toxicity_score", "is_toxic")
