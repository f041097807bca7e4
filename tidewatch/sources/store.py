"""The two-table store: comments and alerts as Parquet folders."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from tidewatch.contracts import ALERT_DEFAULTS, ALERTS, COMMENT_DEFAULTS, COMMENTS
from tidewatch.operators.anomaly import printable
from tidewatch.operators.ordering import latest
from tidewatch.operators.rollup import for_platform
from tidewatch.sources import ledger
from tidewatch.sources.folders import Folder

TABLES = {"comments": COMMENTS, "crisis_alerts": ALERTS}


def conform(df: DataFrame, schema: T.StructType, defaults: dict, time: str) -> DataFrame:
    """Cast to the table's columns; absent or NULL fields take their defaults. An absent id stays NULL."""
    columns = []
    for field in schema.fields:
        if field.name in df.columns:
            value = F.col(field.name).cast(field.dataType)
        else:
            value = F.lit(None).cast(field.dataType)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]).cast(field.dataType))
        elif field.name == time:
            value = F.coalesce(value, F.current_timestamp())
        columns.append(value.alias(field.name))
    return df.select(*columns)


def conform_comments(df: DataFrame) -> DataFrame:
    return conform(df, COMMENTS, COMMENT_DEFAULTS, "created_at")


def conform_alerts(df: DataFrame) -> DataFrame:
    return conform(df, ALERTS, ALERT_DEFAULTS, "triggered_at")


def alert_rows(evaluated: DataFrame) -> DataFrame:
    """Alert records of evaluated windows; SAFE windows raise none."""
    return evaluated.where("alert_level <> 'SAFE'").withColumnsRenamed(
        {"negative_velocity": "negative_ratio", "total_comments": "sample_size"})


def create_tables(spark: SparkSession, root: str) -> None:
    """Create or reset both tables as empty Parquet folders; their numbers start again."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{root}/{name}")
        Folder(spark, root).remove(f"_ids/{name}")


clear_all = create_tables


def register_tables(spark: SparkSession, root: str) -> None:
    """Expose the store to SQL as views ``comments`` and ``crisis_alerts``."""
    for name in TABLES:
        read_table(spark, root, name).createOrReplaceTempView(name)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The whole table: what was appended to its folder and, by batch, to the folders inside it."""
    return spark.read.schema(TABLES[name]).option("recursiveFileLookup", "true").parquet(f"{root}/{name}")


def last_id(spark: SparkSession, root: str, name: str) -> int:
    """Largest stored id, -1 for an empty or absent table; reads the one column."""
    try:
        found = read_table(spark, root, name).agg(F.max("id")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = None
    return -1 if found is None else found


def _append(df: DataFrame, root: str, name: str, conformed, writer: str | None, batch: int | None) -> None:
    """Rows without an ``id`` column get consecutive ids along ``df`` from the table's ledger.

    The table itself is read for the first reservation only. Rows with ids keep them,
    and the ledger is moved past the largest one. With a writer and a batch number the rows go to
    a folder of their own, with the same ids each time, so a repeated batch adds nothing twice.
    """
    spark, numbers = df.sparkSession, f"{root}/_ids/{name}"
    target = f"{root}/{name}" if writer is None else f"{root}/{name}/{writer}-{batch}"
    mode = "append" if writer is None else "overwrite"
    if "id" in df.columns:
        seen = Observation()
        conformed(df).observe(seen, F.max("id").alias("last")).write.mode(mode).parquet(target)
        if seen.get["last"] is not None:
            ledger.raise_to(spark, numbers, seen.get["last"] + 1, lambda: last_id(spark, root, name) + 1)
        return
    numbered = ledger.number_rows(df, "id", lambda n: ledger.reserve(
        spark, numbers, n, lambda: last_id(spark, root, name) + 1, writer, batch))
    conformed(numbered).write.mode(mode).parquet(target)


def append_comments(df: DataFrame, root: str, writer: str | None = None, batch: int | None = None) -> None:
    """Append comment rows; any number of writers at a time. See :func:`_append` for ids and repeated batches."""
    _append(df, root, "comments", conform_comments, writer, batch)


def append_alerts(df: DataFrame, root: str, writer: str | None = None, batch: int | None = None) -> None:
    """Append alerts, numbered like comments."""
    _append(df, root, "crisis_alerts", conform_alerts, writer, batch)


def recent_comments(df: DataFrame, limit: int = 100, platform: str | None = None) -> DataFrame:
    return latest(for_platform(df, platform), limit)


def recent_alerts(df: DataFrame, limit: int = 10) -> DataFrame:
    """Newest alerts by time; of one time, the last appended first."""
    return df.orderBy(F.desc("triggered_at"), F.desc("id")).limit(limit)


def brand_report(headline: DataFrame, evaluated: DataFrame) -> DataFrame:
    """The brand report as one text cell, from the two one-row summaries."""
    packed = evaluated.select(F.struct(*evaluated.columns).alias("e")).scalar()
    facts = headline.withColumn("e", packed)
    verdict = F.when(F.col("e.reject_null"), "CRITICAL ANOMALY").otherwise("NORMAL VARIATION")
    body = F.format_string(
        "Channel health: %s, z = %.2f\n"
        "%,d posts, %.2f%% negative against 12.00%% expected\n"
        "One-sided test: p = %.6f, %s\n"
        "Posts flagged as toxic: %d",
        F.col("e.alert_level"), printable(F.col("e.z_score"), 2), F.col("total_comments"),
        printable(F.col("negative_ratio") * 100, 2), F.col("e.p_value"), verdict, F.col("toxic_count"))
    return facts.select(
        F.col("e.alert_level").alias("status"), F.col("e.z_score").alias("z_score"),
        F.col("total_comments").alias("volume"), "negative_ratio",
        F.col("e.p_value").alias("p_value"), verdict.alias("verdict"),
        F.col("toxic_count").alias("toxic_hits"), body.alias("report"))
