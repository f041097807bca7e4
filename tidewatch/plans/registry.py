"""Query registry and the table adapters shared by queries and their SQL checks."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.session import spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder) -> DataFrame``, with equivalent SQL where there is any."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return register


TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; text tables are spread when a few files leave task slots idle."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def _platform(number) -> F.Column:
    return (F.when(number % 4 == 0, "YouTube").when(number % 4 == 1, "Twitter")
            .when(number % 4 == 2, "Reddit").otherwise("Telegram"))


def comment_events(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as scored comments (no text)."""
    kind, value = F.col("event_type"), F.col("value")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"), _platform(F.col("user_id")).alias("platform"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("author"),
        F.when(kind == "error", "NEGATIVE").when(kind.isin("purchase", "signup"), "POSITIVE")
        .otherwise("NEUTRAL").alias("sentiment"),
        value.alias("sentiment_score"),
        F.when((kind == "error") & (value >= 20), 1).otherwise(0).alias("is_toxic"),
        F.col("ts").alias("created_at"))


def comment_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` with their labels as comments (no time)."""
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), _platform(F.col("doc_id")).alias("platform"),
        F.col("source").alias("source_target"), F.col("text").alias("raw_text"), "n_chars",
        F.when(F.col("quality") == 1, "POSITIVE").when(F.col("quality") == 0, "NEGATIVE")
        .otherwise("NEUTRAL").alias("sentiment"),
        F.coalesce("toxic", F.lit(0)).alias("is_toxic"))


def surge_events(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` with a crisis from the 25th of the month on."""
    kind = F.col("event_type")
    crisis = (F.dayofmonth("ts") >= 25) & kind.isin("signup", "view")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"), _platform(F.col("user_id")).alias("platform"),
        F.when(kind == "error", "NEGATIVE").when(crisis, "NEGATIVE")
        .when(kind == "purchase", "POSITIVE").otherwise("NEUTRAL").alias("sentiment"),
        F.col("ts").alias("created_at"))


def stamp(time) -> F.Column:
    """Timestamps leave queries as text, so both engines print them alike."""
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss")


# -- the same adapters as SQL ----------------------------------------------------

def _platform_sql(column: str) -> str:
    return (f"CASE {column} % 4 WHEN 0 THEN 'YouTube' WHEN 1 THEN 'Twitter' "
            f"WHEN 2 THEN 'Reddit' ELSE 'Telegram' END")


CEV = f"""cev AS (
  SELECT event_id AS id, {_platform_sql('user_id')} AS platform,
    'user_' || user_id AS author,
    CASE event_type WHEN 'error' THEN 'NEGATIVE' WHEN 'purchase' THEN 'POSITIVE'
      WHEN 'signup' THEN 'POSITIVE' ELSE 'NEUTRAL' END AS sentiment,
    value AS sentiment_score,
    CASE WHEN event_type = 'error' AND value >= 20 THEN 1 ELSE 0 END AS is_toxic,
    ts AS created_at
  FROM events)"""

CDOC = f"""cdoc AS (
  SELECT d.doc_id AS id, {_platform_sql('d.doc_id')} AS platform, d.source AS source_target,
    d.text AS raw_text, d.n_chars,
    CASE l.quality WHEN 1 THEN 'POSITIVE' WHEN 0 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS sentiment,
    COALESCE(l.toxic, 0) AS is_toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

CSURGE = f"""csurge AS (
  SELECT event_id AS id, {_platform_sql('user_id')} AS platform,
    CASE WHEN event_type = 'error' THEN 'NEGATIVE'
      WHEN EXTRACT(DAY FROM ts) >= 25 AND event_type IN ('signup', 'view') THEN 'NEGATIVE'
      WHEN event_type = 'purchase' THEN 'POSITIVE' ELSE 'NEUTRAL' END AS sentiment,
    ts AS created_at
  FROM events)"""


def stamp_sql(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


def words_sql(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)
