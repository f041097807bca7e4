"""Crisis evaluation of comment windows."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.contracts import (
    ALERT_TEXTS, BASELINE_NEGATIVE_RATIO, BASELINE_STD, CRISIS_Z, CRITICAL_RATIO, CRITICAL_Z, ELEVATED_RATIO, EWMA_ROWS,
    MIN_EFFECTIVE_STD, TEST_ALPHA, WINDOW_ROWS,
)
from tidewatch.operators.inference import half_width, rejects, t_statistic, upper_p_value
from tidewatch.operators.ordering import ID_SLICE, ewma, id_bucket, latest, rolling_mean, with_position

NEGATIVE = "NEGATIVE"


def is_negative() -> Column:
    return (F.col("sentiment") == NEGATIVE).cast("int")


def _ratios(chunked: DataFrame, keys) -> DataFrame:
    return chunked.groupBy(*keys, "chunk").agg(
        F.count(F.lit(1)).alias("n"), F.sum(is_negative()).alias("negatives"),
        F.avg(is_negative()).alias("ratio"))


def _sixth(total: Column) -> Column:
    return F.greatest(F.lit(3), F.floor(total / 6))


def chunk_ratios(df: DataFrame, size: int | None = None, min_rows: int = 1, keys=(),
                 id: str = "id", width: int = ID_SLICE) -> DataFrame:
    """Negative share of consecutive chunks, newest rows first, over a whole table.

    ``size`` rows per chunk, or about a sixth of the rows; chunks below
    ``min_rows`` are left out.
    """
    keys = list(keys)
    placed = with_position(df, [F.desc(id)], id_bucket(id, width, descending=True), keys,
                           total="_total")
    rows = F.lit(size) if size else _sixth(F.col("_total"))
    chunked = placed.withColumn("chunk", F.floor((F.col("pos") - 1) / rows))
    return _ratios(chunked, keys).where(F.col("n") >= min_rows)


def recent_chunk_ratios(df: DataFrame, window: int = WINDOW_ROWS, keys=(),
                        id: str = "id") -> DataFrame:
    """The same over the newest ``window`` rows of each key, which fit in one task."""
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy(F.desc(id))
    placed = (latest(df, window, keys, id)
              .withColumn("_rn", F.row_number().over(order))
              .withColumn("_total", F.count(F.lit(1)).over(Window.partitionBy(*keys))))
    chunked = placed.withColumn("chunk", F.floor((F.col("_rn") - 1) / _sixth(F.col("_total"))))
    return _ratios(chunked, keys)


def alert_level(z: Column, reject: Column, ratio: Column) -> Column:
    return (F.when((z >= CRITICAL_Z) | (reject & (ratio >= CRITICAL_RATIO)), "CRITICAL")
            .when((z >= CRISIS_Z) | (ratio >= ELEVATED_RATIO), "ELEVATED").otherwise("SAFE"))


def printable(value: Column, digits: int) -> Column:
    """``value`` to ``digits`` places, a tie (to a millionth of the last place) towards zero.

    Printed values would otherwise depend on the last bit of a ratio such as 1.515.
    """
    scale = float(10**digits)
    return F.signum(value) * F.floor(F.abs(value) * scale + (0.5 - 1e-6)).cast("double") / scale


def evaluate_chunks(chunks: DataFrame, keys=(), baseline: float = BASELINE_NEGATIVE_RATIO,
                    alpha: float = TEST_ALPHA) -> DataFrame:
    """Alert level and evidence from chunk ratios, one row per key.

    An empty input without keys gives one SAFE row.
    """
    keys = list(keys)
    total, negatives = F.col("total_comments"), F.col("negative_count")
    base = chunks.groupBy(*keys).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_comments"),
        F.coalesce(F.sum("negatives"), F.lit(0)).alias("negative_count"),
        F.count("ratio").alias("chunks"), F.avg("ratio").alias("_mean"),
        F.stddev_samp("ratio").alias("_std"))
    n, mean, std = F.col("chunks"), F.col("_mean"), F.col("_std")
    spread = F.when(std >= MIN_EFFECTIVE_STD, std).otherwise(BASELINE_STD)
    ratio = F.coalesce(F.try_divide(negatives, total), F.lit(0.0))
    facts = (base.withColumns({"_ratio": ratio, "_t": t_statistic(n, mean, std, baseline)})
             .withColumns({
                 "_z": F.when(total > 0, (F.col("_ratio") - baseline) / spread).otherwise(0.0),
                 "_p": upper_p_value(n, F.col("_t")), "_half": half_width(n, std, 0.95)})
             .withColumn("_reject", rejects(F.col("_p"), F.col("_t"), alpha))
             .withColumn("alert_level",
                         alert_level(F.col("_z"), F.col("_reject"), F.col("_ratio"))))
    z, level = F.col("_z"), F.col("alert_level")
    p_shown = F.round(F.col("_p"), 6)
    tested = lambda c: F.when(n >= 3, F.round(c, 4)).otherwise(0.0)
    z_text, p_text = printable(z, 2), printable(p_shown, 4)
    message = (
        F.when(total == 0, ALERT_TEXTS["EMPTY"])
        .when(level == "CRITICAL", F.format_string(ALERT_TEXTS["CRITICAL"], z_text, p_text))
        .when(level == "ELEVATED", F.format_string(ALERT_TEXTS["ELEVATED"], z_text))
        .otherwise(F.format_string(ALERT_TEXTS["SAFE"], z_text)))
    return facts.select(
        *keys, "alert_level", F.round("_ratio", 4).alias("negative_velocity"), "negative_count",
        "total_comments", "chunks", F.round(z, 3).alias("z_score"), p_shown.alias("p_value"),
        F.col("_reject").alias("reject_null"), tested(mean - F.col("_half")).alias("ci95_low"),
        tested(mean + F.col("_half")).alias("ci95_high"), message.alias("message"))


def evaluate_window(df: DataFrame, window: int = WINDOW_ROWS, keys=(), id: str = "id") -> DataFrame:
    """Evaluate the newest ``window`` comments of each key."""
    return evaluate_chunks(recent_chunk_ratios(df, window, keys, id), keys)


def rolling_negative(df: DataFrame, keys=(), id: str = "id", width: int = ID_SLICE) -> DataFrame:
    """Rolling negative share over 12 rows, in id order."""
    return rolling_mean(df, is_negative(), keys=keys, id=id, name="rolling_negative", width=width)


def ewma_negative(df: DataFrame, keys=(), rows: int = EWMA_ROWS, id: str = "id", width: int = ID_SLICE) -> DataFrame:
    """Exponentially weighted negative rate in id order; the newest row weighs 2 / (``rows`` + 1)."""
    return ewma(df, is_negative(), 2 / (rows + 1), keys, id, "ewma_negative", width)


def velocity_band(ratio: Column) -> Column:
    return (F.when(ratio < ELEVATED_RATIO, "safe").when(ratio < CRITICAL_RATIO, "elevated")
            .when(ratio.isNotNull(), "critical"))
