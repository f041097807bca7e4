import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import anomaly
from tidewatch.session import scratch_path
from tidewatch.sources import store, versions
from tidewatch.sources.folders import Folder
from tidewatch.streaming import jobs


def landed(spark, files=4, rows=90):
    """Comment files that arrive one after the other."""
    rng, folder, start = random.Random(5), scratch_path(spark, "landing"), dt.datetime(2024, 1, 1)
    everything = []
    for n in range(files):
        part = [(n * rows + i, "hot" if rng.random() < .7 else rng.choice("ab"), rng.choice(["NEGATIVE", "POSITIVE", "NEUTRAL"]),
                 f"text {rng.randrange(50)}", start + dt.timedelta(minutes=2 * (n * rows + i))) for i in range(rows)]
        everything += part
        df = spark.createDataFrame(part, "id bigint, platform string, sentiment string, raw_text string, created_at timestamp_ntz")
        df.coalesce(1).write.mode("append").parquet(folder)
    return folder, spark.createDataFrame(everything, df.schema)


def stream(spark, folder, batch):
    return jobs.event_time(jobs.read_folder(spark, folder, batch.schema, "*.parquet", 1), "created_at")


def test_last_n_state_equals_batch(spark):
    folder, batch = landed(spark)
    root = scratch_path(spark, "watch")
    jobs.watch_channels(stream(spark, folder, batch), root, f"{root}-cp", window=30).awaitTermination()
    assert spark.read.parquet(f"{root}/evaluations").select("batch").distinct().count() == 4
    got = jobs.last_batch(spark.read.parquet(f"{root}/evaluations"))
    want = anomaly.evaluate_window(batch, 30, ["platform"])
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    alerts = store.read_table(spark, root, "crisis_alerts").collect()
    raised = spark.read.parquet(f"{root}/evaluations").where("alert_level <> 'SAFE'").orderBy("batch", "platform").collect()
    assert [(r.id, r.platform, r.z_score) for r in sorted(alerts)] == [(i, r.platform, r.z_score) for i, r in enumerate(raised)]
    # Two folders of state are kept, whatever the number of batches.
    tails = Folder(spark, f"{root}/tail").numbers("batch=")
    assert tails == [2, 3]
    assert spark.read.parquet(f"{root}/tail").groupBy("batch", "platform").count().agg(F.max("count")).first()[0] <= 30


def test_append_batches_and_enrich(spark):
    folder, batch = landed(spark)
    root = scratch_path(spark, "store")
    jobs.append_batches(stream(spark, folder, batch), root, f"{root}-cp").awaitTermination()
    jobs.append_batches(stream(spark, folder, batch), root, f"{root}-cp").awaitTermination()
    rows = store.read_table(spark, root, "comments")
    assert rows.count() == batch.count() and rows.select("id").distinct().count() == batch.count()
    out = scratch_path(spark, "enriched")
    posts = jobs.read_folder(spark, folder, batch.schema).select("id", "raw_text")
    jobs.append_to(jobs.enrich(posts), out, f"{out}-cp").awaitTermination()
    assert spark.read.parquet(out).where("clean_text = raw_text").count() == batch.count()


def test_batches_without_ids_are_numbered_on(spark):
    folder, batch = landed(spark)
    root = scratch_path(spark, "store")
    # A replay after lost progress: the same batches again, from a new checkpoint.
    for checkpoint in ("a", "a", "b"):
        unnumbered = stream(spark, folder, batch).select("platform", "sentiment", F.col("id").cast("double").alias("sentiment_score"))
        jobs.append_batches(unnumbered, root, f"{root}-{checkpoint}").awaitTermination()
        rows = store.read_table(spark, root, "comments").select("id", "sentiment_score").collect()
        assert len(rows) == 360 and len({r.id for r in rows}) == 360
        if checkpoint == "a":
            assert sorted(r.id for r in rows) == list(range(360))
            assert all(r.id == r.sentiment_score for r in rows)


def drain(spark, df):
    out = scratch_path(spark, "out")
    jobs.append_to(df, out, f"{out}-cp").awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def windows(batch, size, slide=None):
    counted = batch.groupBy("platform", F.window("created_at", size, slide).alias("w")).agg(
        F.count("*").alias("n"), F.sum((F.col("sentiment") == "NEGATIVE").cast("int")).alias("negatives"))
    return {(r.platform, r.w.start): (r.n, r.negatives) for r in counted.collect()}


def test_windows_close_behind_the_watermark(spark):
    folder, batch = landed(spark)
    closed = batch.agg((F.max("created_at") - F.expr("interval 10 minutes")).alias("t")).first().t
    got = drain(spark, jobs.arrival_counts(stream(spark, folder, batch)))
    want = {k: n for k, (n, _) in windows(batch, "1 hour").items() if k[1] + dt.timedelta(hours=1) <= closed}
    assert {(r.platform, r.window_start): r.n for r in got.collect()} == want


@pytest.mark.parametrize("fold_after", [1, 2, 16])
def test_versions_hold_every_window(spark, monkeypatch, fold_after):
    monkeypatch.setattr(versions, "FOLD_AFTER", fold_after)
    folder, batch = landed(spark)
    root, keys = scratch_path(spark, "versions"), ["platform", "window_start"]
    shares = jobs.sliding_negative(stream(spark, folder, batch))
    for checkpoint in ("a", "a"):
        jobs.keep_versions(shares, root, f"{root}-{checkpoint}", keys).awaitTermination()
        rows = jobs.versions(spark, root, shares.schema, keys).collect()
        want = windows(batch, "1 hour", "30 minutes")
        assert {(r.platform, r.window_start): (r.n, r.negatives) for r in rows} == want and len(rows) == len(want)
    if fold_after == 1:
        assert len(Folder(spark, root).numbers("base-")) == 2
        assert len(Folder(spark, f"{root}/changes").numbers("batch=")) <= 2


def test_versions_take_the_last_run_of_a_batch(spark):
    root = scratch_path(spark, "versions")
    make = lambda rows: spark.createDataFrame(rows, "k string, v bigint")
    table = versions.VersionedTable(spark, root, make([]).schema, ["k"])
    assert table.read().count() == 0
    table.put(make([("a", 1), ("b", 1)]), 0)
    table.put(make([("a", 2)]), 1)
    table.put(make([("a", 3), (None, 9)]), 1)
    found = lambda: {(r.k, r.v) for r in table.read().collect()}
    assert found() == {("a", 3), ("b", 1), (None, 9)}
    table.fold(1)
    table.fold(1)
    table.put(make([("b", 4)]), 2)
    assert found() == {("a", 3), ("b", 4), (None, 9)}
    # An unfinished folder, as a lost driver leaves it, is not read.
    Folder(spark, root).remove("changes/batch=2/_SUCCESS")
    assert found() == {("a", 3), ("b", 1), (None, 9)}


@pytest.mark.parametrize("width", [1 << 20, 16])
def test_row_rates_equal_the_batch_operators(spark, width):
    folder, batch = landed(spark)
    root = scratch_path(spark, "rates")
    for _ in range(2):  # the second run has nothing left to read
        jobs.row_rates(stream(spark, folder, batch), root, f"{root}-cp", width=width).awaitTermination()
    rates = spark.read.parquet(f"{root}/rates")
    assert rates.select("batch").distinct().count() == 4 and Folder(spark, f"{root}/ring").numbers("batch=") == [2, 3]
    rolled = {r.id: r.rolling_negative for r in anomaly.rolling_negative(batch, ["platform"]).collect()}
    weighted = {r.id: r.ewma_negative for r in anomaly.ewma_negative(batch, ["platform"]).collect()}
    got = rates.collect()
    assert len(got) == 360
    for r in got:
        assert r.ewma_negative == pytest.approx(weighted[r.id], abs=1e-12)
        assert r.rolling_negative == (None if rolled[r.id] is None else pytest.approx(rolled[r.id], abs=1e-12))


def test_repeats_are_dropped(spark):
    folder, batch = landed(spark)
    everything = jobs.event_time(jobs.read_folder(spark, folder, batch.schema), "created_at")
    got = drain(spark, jobs.drop_repeats(everything))
    assert sorted(r.raw_text for r in got.collect()) == sorted(r.raw_text for r in batch.select("raw_text").distinct().collect())


def test_first_texts_of_all_batches(spark):
    """One row of each text, of its first batch and there the first by id, whatever was replayed; a missing text is one text."""
    root, folder = scratch_path(spark, "kept"), scratch_path(spark, "landing")
    schema = "id bigint, raw_text string, created_at timestamp, batch_name string"
    rng, want, parts = random.Random(3), {}, []
    for n in range(4):
        texts = ["hot"] * 60 + [rng.choice([f"t{rng.randrange(40)}", "", None]) for _ in range(60)]
        # Ids fall from batch to batch, so the least id of a text is not the one that stays.
        part = [(1000 * (4 - n) + i, text, dt.datetime(2024, 1, 1), "x") for i, text in enumerate(texts)]
        for row in part:
            want.setdefault(row[1], (n, row[0]))
        rng.shuffle(part)
        parts.append(spark.createDataFrame(part, schema).repartition(3))
    for n, part in enumerate(parts):
        part.write.mode("append").parquet(folder)
        posts = jobs.read_folder(spark, folder, part.schema)
        jobs.keep_first_texts(posts, root, f"{root}-cp").awaitTermination()
        if n == 2:  # the batch's commit is lost with the driver: the next run replays it
            Folder(spark, f"{root}-cp/commits").remove("2")
            jobs.keep_first_texts(posts, root, f"{root}-cp").awaitTermination()
    got = [(r.raw_text, (r.batch, r.id)) for r in jobs.kept_texts(spark, root, parts[0].schema).collect()]
    assert len(got) == len(want) and dict(got) == want
