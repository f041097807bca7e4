"""Classification metrics from counts, in one pass over the predictions."""

from pyspark.sql import DataFrame, functions as F

ACTUAL, PREDICTED = "actual", "predicted"


def confusion_counts(df: DataFrame, actual: str = ACTUAL, predicted: str = PREDICTED) -> DataFrame:
    """Rows per (actual, predicted) pair that occurs."""
    return (df.groupBy(F.col(actual).alias(ACTUAL), F.col(predicted).alias(PREDICTED))
            .agg(F.count(F.lit(1)).alias("n")))


def confusion_matrix(df: DataFrame, actual: str = ACTUAL, predicted: str = PREDICTED) -> DataFrame:
    """Every pair of the classes that occur, zeros included.

    The pair counts, at most classes squared, are folded into one row and
    spread over the class grid from there, so the predictions are read once.
    """
    counts = confusion_counts(df, actual, predicted)
    classes = F.array_sort(F.array_distinct(F.flatten(F.array(
        F.collect_set(ACTUAL), F.collect_set(PREDICTED)))))
    cells = F.map_from_entries(F.collect_list(F.struct(F.struct(ACTUAL, PREDICTED), "n")))
    grid = (counts.agg(classes.alias("_classes"), cells.alias("_cells"))
            .select("*", F.explode("_classes").alias(ACTUAL))
            .select("*", F.explode("_classes").alias(PREDICTED)))
    n = F.try_element_at("_cells", F.struct(ACTUAL, PREDICTED))
    return grid.select(ACTUAL, PREDICTED, F.coalesce(n, F.lit(0)).alias("n"))


def accuracy(df: DataFrame, actual: str = ACTUAL, predicted: str = PREDICTED) -> DataFrame:
    hit = (F.col(actual) == F.col(predicted)).cast("int")
    return df.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit), 4).alias("accuracy"))


def class_scores(df: DataFrame, actual: str = ACTUAL, predicted: str = PREDICTED) -> DataFrame:
    """Unrounded precision, recall, F1 and support per class; 0 where undefined."""
    n, zero = F.col("n"), F.lit(0)
    hit = F.when(F.col(ACTUAL) == F.col(PREDICTED), n).otherwise(zero)
    roles = F.explode(F.array(
        F.struct(F.col(ACTUAL).alias("label"), n.alias("support"), zero.alias("guessed"),
                 hit.alias("hits")),
        F.struct(F.col(PREDICTED).alias("label"), zero.alias("support"), n.alias("guessed"),
                 zero.alias("hits"))))
    sums = (confusion_counts(df, actual, predicted).select(roles.alias("r")).select("r.*")
            .groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "guessed", "hits")]))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = F.col("precision"), F.col("recall")
    return (sums.withColumn("precision", ratio(F.col("hits"), F.col("guessed")))
            .withColumn("recall", ratio(F.col("hits"), F.col("support")))
            .withColumn("f1", ratio(2 * p * r, p + r))
            .select("label", "precision", "recall", "f1", "support"))


METRICS = ("precision", "recall", "f1")


def _weighted_means(rows: DataFrame) -> DataFrame:
    """Means of the class metrics per report line, rounded."""
    weight = F.sum("_weight")
    return rows.groupBy("label").agg(
        *[F.round(F.coalesce(F.try_divide(F.sum(F.col(m) * F.col("_weight")), weight), F.lit(0.0)),
                  4).alias(m) for m in METRICS],
        F.sum("support").alias("support"))


def classification_report(df: DataFrame, actual: str = ACTUAL,
                          predicted: str = PREDICTED) -> DataFrame:
    """Per-class scores plus macro and support-weighted averages."""
    one = F.lit(1.0)
    lines = F.explode(F.array(
        F.struct(F.col("label").cast("string").alias("label"), one.alias("_weight")),
        F.struct(F.lit("macro avg").alias("label"), one.alias("_weight")),
        F.struct(F.lit("weighted avg").alias("label"),
                 F.col("support").cast("double").alias("_weight"))))
    scores = class_scores(df, actual, predicted)
    return _weighted_means(scores.select(lines.alias("l"), *METRICS, "support")
                           .select("l.*", *METRICS, "support"))


def weighted_scores(df: DataFrame, actual: str = ACTUAL, predicted: str = PREDICTED) -> DataFrame:
    """Support-weighted precision, recall and F1."""
    scores = class_scores(df, actual, predicted)
    weighted = scores.withColumn("label", F.lit("weighted avg")).withColumn(
        "_weight", F.col("support").cast("double"))
    return _weighted_means(weighted).drop("label")


def best_run(runs: DataFrame, metric: str = "f1", run: str = "run", loss: str = "loss") -> DataFrame:
    """Run with the best metric (earliest on ties), and the mean loss of all runs."""
    return runs.agg(
        F.max_by(run, F.struct(F.col(metric), -F.col(run))).alias("best_run"),
        F.round(F.max(metric), 4).alias(f"best_{metric}"),
        F.round(F.avg(loss), 4).alias("mean_loss"))
