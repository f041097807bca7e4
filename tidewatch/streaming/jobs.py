"""Structured Streaming jobs built from the batch operators."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidewatch.contracts import EWMA_ROWS, WINDOW_ROWS
from tidewatch.functions.linear import LinearScorer
from tidewatch.operators.anomaly import evaluate_window, is_negative
from tidewatch.operators.enrich import enrich_comments
from tidewatch.operators.ordering import ID_SLICE, ewma_over, id_bucket, keep_first, latest, rolling_over, with_position
from tidewatch.operators.profile import attach
from tidewatch.sources.folders import Folder
from tidewatch.sources.store import alert_rows, append_alerts, append_comments
from tidewatch.sources.versions import VersionedTable

WATERMARK = "10 minutes"


def read_folder(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet",
                files_per_trigger: int | None = None) -> DataFrame:
    """File stream over a folder; ``pattern`` picks its files by name."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def event_time(df: DataFrame, column: str) -> DataFrame:
    """Timestamps without zone cannot carry a watermark; read them in the session zone."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def enrich(stream: DataFrame, sentiment: LinearScorer | None = None, toxicity: LinearScorer | None = None) -> DataFrame:
    """Continuous ingest: clean and score each post as it arrives, with trained models where there are any."""
    return enrich_comments(stream, sentiment=sentiment, toxicity=toxicity)


def append_to(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Append to a Parquet folder; by default process what is there and stop."""
    return (stream.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(**(trigger or {"availableNow": True})).start())


def _batch_folder(root: str, batch: int) -> str:
    return f"{root}/batch={batch}"


def append_batches(stream: DataFrame, root: str, checkpoint: str, writer: str = "stream", **trigger):
    """Micro-batch append of comment rows to the store below ``root``.

    A replayed batch overwrites its own folder with the same ids and adds nothing twice;
    streams that append to one store need different ``writer`` names.
    """
    def write(batch: DataFrame, number: int) -> None:
        append_comments(batch, root, writer, number)

    return _for_each(stream, write, checkpoint, trigger)


def _for_each(stream, write, checkpoint, trigger, mode: str = "append"):
    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode)
            .trigger(**(trigger or {"availableNow": True})).start())


def _forget(spark: SparkSession, root: str, before: int) -> None:
    """Remove the batch folders that no replay can ask for any more."""
    folder = Folder(spark, root)
    for number in folder.numbers("batch=", finished=False):
        if number < before:
            folder.remove(f"batch={number}")


def watch_channels(stream: DataFrame, root: str, checkpoint: str, window: int = WINDOW_ROWS,
                   keys=("platform",), **trigger):
    """Re-evaluate the newest ``window`` comments of every channel after each batch.

    Between batches only those rows are kept, in the last two folders below
    ``root/tail``; inside a batch each task prunes to its newest rows before the
    shuffle. Writes every evaluation to ``root/evaluations`` and appends the alerts to the
    store's table below ``root``, numbered on from batch to batch, in the order of the keys.
    """
    keys, columns = list(keys), [*keys, "id", "sentiment"]

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*columns)
        if number > 0:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(
                _batch_folder(f"{root}/tail", number - 1)))
        tail_path = _batch_folder(f"{root}/tail", number)
        latest(rows, window, keys).write.mode("overwrite").parquet(tail_path)
        tail = spark.read.schema(rows.schema).parquet(tail_path)
        evaluated_path = _batch_folder(f"{root}/evaluations", number)
        evaluate_window(tail, window, keys).write.mode("overwrite").parquet(evaluated_path)
        evaluated = spark.read.parquet(evaluated_path)
        append_alerts(alert_rows(evaluated).orderBy(*keys), root, "watch", number)
        _forget(spark, f"{root}/tail", number - 1)

    return _for_each(stream, write, checkpoint, trigger)


def last_batch(df: DataFrame) -> DataFrame:
    """Rows of the newest batch folder."""
    newest = df.agg(F.max("batch")).scalar()
    return df.where(F.col("batch") == newest).drop("batch")


def keep_versions(counts: DataFrame, root: str, checkpoint: str, keys, **trigger):
    """Write a windowed aggregation to a versioned table, windows that are still open included.

    Every batch puts the windows it changed; :func:`versions` reads the last state of each. A
    replayed batch replaces its own rows. State ends with the watermark, the table keeps all windows.
    """
    def write(batch: DataFrame, number: int) -> None:
        VersionedTable(batch.sparkSession, root, counts.schema, keys).put(batch, number)

    return _for_each(counts, write, checkpoint, trigger, "update")


def versions(spark: SparkSession, root: str, schema, keys) -> DataFrame:
    """The newest row of each key that :func:`keep_versions` wrote."""
    return VersionedTable(spark, root, schema, keys).read()


def row_rates(stream: DataFrame, root: str, checkpoint: str, keys=("platform",), id: str = "id",
              rolling: int = 12, min_rows: int = 3, weighted: int = EWMA_ROWS, width: int = ID_SLICE, **trigger):
    """Rolling and exponentially weighted negative rate of every row, to ``root/rates/batch=N``.

    Equal to ``rolling_negative`` and ``ewma_negative`` over all rows so far: channels go on
    where the batch before left them. What is carried is a ring of the last ``rolling - 1`` rows
    of each channel with their positions and the last weighted rate, in ``root/ring/batch=N``.
    Rows of a batch go by ``id``; batches are taken as they come. A state operator would hand a
    channel's rows to one task, one after the other; here a batch's rows are cut into
    slices of ids and blocks of positions, however hot the channel. A replayed batch reads
    the ring of the batch before and replaces its own folders.
    """
    keys, alpha, value = list(keys), 2 / (weighted + 1), F.col("_negative")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*keys, id, is_negative().cast("double").alias("_negative"))
        ring_schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema.fields)}, pos bigint, ewma_negative double"
        ring = spark.createDataFrame([], ring_schema)
        if number > 0:
            ring = spark.read.schema(ring_schema).parquet(_batch_folder(f"{root}/ring", number - 1))
        ends = ring.groupBy(*keys).agg(F.max("pos").alias("_last"), F.max_by("ewma_negative", "pos").alias("_rate"))
        fresh = attach(with_position(rows, [id], id_bucket(id, width), keys), ends.select(*keys, "_last"), keys)
        fresh = fresh.withColumn("pos", F.col("pos") + F.coalesce("_last", F.lit(0))).drop("_last")
        both = fresh.withColumn("_new", F.lit(True)).unionByName(
            ring.select(*keys, id, "_negative", "pos", F.lit(False).alias("_new")))
        rolled = rolling_over(both, value, rolling, min_rows, keys, "rolling_negative", width).where("_new")
        before = ends.select(*keys, F.lit(None).cast(rows.schema[id].dataType).alias(id), F.col("_rate").alias("_negative"),
                             F.col("_last").alias("pos"), F.lit(None).cast("double").alias("rolling_negative"),
                             F.lit(False).alias("_new"))
        rated = ewma_over(rolled.unionByName(before), value, alpha, keys, "ewma_negative", ~F.col("_new") | (F.col("pos") == 1))
        path = _batch_folder(f"{root}/rates", number)
        done = rated.where("_new").select(*keys, id, "_negative", "pos", "rolling_negative", "ewma_negative")
        done.write.mode("overwrite").parquet(path)
        done = spark.read.schema(done.schema).parquet(path).drop("rolling_negative")
        kept = latest(done.unionByName(ring.select(done.columns)), max(rolling - 1, 1), keys, "pos")
        kept.select(*keys, id, "_negative", "pos", "ewma_negative").write.mode("overwrite").parquet(_batch_folder(f"{root}/ring", number))
        _forget(spark, f"{root}/ring", number - 1)

    return _for_each(stream, write, checkpoint, trigger)


def arrival_counts(stream: DataFrame, time: str = "created_at", size: str = "1 hour",
                   keys=("platform",), watermark: str = WATERMARK) -> DataFrame:
    """Rows per tumbling window and channel."""
    counts = (stream.withWatermark(time, watermark).groupBy(F.window(time, size), *keys)
              .agg(F.count(F.lit(1)).alias("n")))
    return counts.select(*keys, F.col("window.start").alias("window_start"), "n")


def sliding_negative(stream: DataFrame, time: str = "created_at", size: str = "1 hour",
                     slide: str = "30 minutes", keys=("platform",),
                     watermark: str = WATERMARK) -> DataFrame:
    """Negative share in sliding event-time windows; row frames do not exist on streams."""
    shares = (stream.withWatermark(time, watermark).groupBy(F.window(time, size, slide), *keys)
              .agg(F.count(F.lit(1)).alias("n"), F.sum(is_negative()).alias("negatives")))
    return shares.select(*keys, F.col("window.start").alias("window_start"), "n", "negatives",
                         F.round(F.col("negatives") / F.col("n"), 4).alias("negative_ratio"))


def drop_repeats(stream: DataFrame, text: str = "raw_text", time: str = "created_at",
                 watermark: str = WATERMARK) -> DataFrame:
    """Drop texts repeated within the watermark, which also bounds the state."""
    return stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark([text])


def keep_first_texts(stream: DataFrame, root: str, checkpoint: str, text: str = "raw_text", order="id", **trigger):
    """Keep one row of each text of the whole stream, in ``root/kept/batch=N``.

    The row that stays is of the first batch that holds the text, and there the first by
    ``order``; missing texts are one text. Nothing depends on a watermark: the keys of all texts so far are a
    versioned table below ``root/seen``, 32 bytes a text. Copies are merged inside every
    task before the shuffle, so a text that makes up a third of a batch sends one row a task.
    A replayed batch looks at the keys of the batches before it and replaces its own folders.
    """
    key = F.sha2(F.concat(F.when(F.col(text).isNull(), "-").otherwise("+"), F.coalesce(text, F.lit(""))), 256)
    key_schema = T.StructType([T.StructField("_key", T.BinaryType())])

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = VersionedTable(spark, f"{root}/seen", key_schema, ["_key"])
        first = keep_first(batch.withColumn("_key", F.unhex(key)), "_key", order)
        path = _batch_folder(f"{root}/kept", number)
        fresh = first.join(seen.read(number - 1), "_key", "left_anti")
        fresh.write.mode("overwrite").parquet(path)
        seen.put(spark.read.schema(key_schema).parquet(path), number)

    return _for_each(stream, write, checkpoint, trigger)


def kept_texts(spark: SparkSession, root: str, schema) -> DataFrame:
    """The rows that :func:`keep_first_texts` kept, with their batch number."""
    batch = T.StructField("batch", T.LongType())
    return spark.read.schema(T.StructType([*schema.fields, batch])).parquet(f"{root}/kept")
