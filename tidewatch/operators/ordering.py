"""Order-dependent operators that never sort a whole table in one task.

The building block is :func:`with_position`. A *bucket*, a monotone function of
the sort key, splits the order into slices; slice sizes are counted with partial
aggregation, summed up over the (small) slice table, and rows are numbered inside
their slice only.
"""

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from tidewatch.session import materialize

ID_SLICE = 1 << 20
SPAN_SLICES = 1 << 22
EWMA_BLOCK = 1024
HASH_DIGITS = 4


def id_bucket(column: str = "id", width: int = ID_SLICE, descending: bool = False) -> Column:
    """Slices of ``width`` consecutive whole numbers; unique ids bound the rows of each."""
    bucket = F.floor(F.col(column) / F.lit(width))
    return -bucket if descending else bucket


def seeded_hash(key: str, seed: int) -> Column:
    """Reproducible pseudo-random order key for a row."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))


def hash_bucket(hashed: str, digits: int = HASH_DIGITS) -> Column:
    """Leading hex digits: evenly filled slices whatever the data looks like."""
    return F.substring(hashed, 1, digits)


def _slice_offsets(tagged: DataFrame, keys: list[str]) -> DataFrame:
    """Rows before each slice, and rows per key.

    Sparse ids may fill as many slices as there are rows, so numbered slices are summed up
    in spans of SPAN_SLICES: whatever the ids, one task orders the slices of one
    span, or the spans of one key (at most 2^21 of 64-bit ids).
    """
    numbered = not isinstance(tagged.schema["_bucket"].dataType, StringType)
    span = F.floor(F.col("_bucket") / F.lit(SPAN_SLICES)) if numbered else F.lit(0)
    sizes = (tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_span", span))

    def before(group, order):
        earlier = group.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_n").over(earlier), F.lit(0))

    group = Window.partitionBy(*keys)
    spans = sizes.groupBy(*keys, "_span").agg(F.sum("_n").alias("_n")).select(
        *keys, "_span", before(group, "_span").alias("_start"), F.sum("_n").over(group).alias("_total"))
    inside = sizes.select(*keys, "_bucket", "_span", before(Window.partitionBy(*keys, "_span"), "_bucket").alias("_inside"))
    return inside.join(spans, [*keys, "_span"]).select(
        *keys, "_bucket", (F.col("_start") + F.col("_inside")).alias("_before"), "_total")


def with_position(df: DataFrame, order, bucket: Column, keys=(), name: str = "pos",
                  total: str | None = None, first: int | None = None) -> DataFrame:
    """Add the 1-based position of each row in ``order``, per ``keys``.

    ``bucket`` must not decrease along ``order``. ``first`` keeps the leading
    rows and skips the slices behind them. Rows with a NULL key are dropped, as
    grouping drops them.
    """
    keys = list(keys)
    tagged = df.withColumn("_bucket", bucket)
    offsets = _slice_offsets(tagged, keys)
    if first is not None:
        # Written first, so that its known size lets Spark drop the other slices by a
        # broadcast join before rows are shuffled.
        offsets = materialize(offsets.where(F.col("_before") < first), "slices")
        tagged = tagged.join(offsets, [*keys, "_bucket"])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = tagged.withColumn("_row", F.row_number().over(inside))
    if first is None:
        ranked = ranked.join(offsets, [*keys, "_bucket"])
    out = ranked.withColumn(name, F.col("_before") + F.col("_row"))
    if first is not None:
        out = out.where(F.col(name) <= first)
    columns = [*df.columns, name]
    if total:
        out, columns = out.withColumnRenamed("_total", total), [*columns, total]
    return out.select(*columns)


def rolling_mean(df: DataFrame, value: Column, size: int = 12, min_rows: int = 3, keys=(),
                 id: str = "id", name: str = "rolling", width: int = ID_SLICE) -> DataFrame:
    """Mean of ``value`` over the last ``size`` rows by ``id``; NULL below ``min_rows``.

    Rows are cut into blocks of consecutive positions, and the last ``size - 1``
    rows of a block are copied into the next one, so each block is complete.
    """
    return rolling_over(with_position(df, [id], id_bucket(id, width), keys), value, size, min_rows, keys, name, width)


def rolling_over(placed: DataFrame, value: Column, size: int, min_rows: int, keys, name: str,
                 width: int = ID_SLICE) -> DataFrame:
    """The same for rows that have their consecutive ``pos`` per key, from any first one on."""
    keys, placed = list(keys), placed.withColumn("_value", value)
    block = F.floor((F.col("pos") - 1) / F.lit(width))
    edge = (F.col("pos") - 1) % width >= width - (size - 1)
    copied = (placed.withColumn("_home", block)
              .withColumn("_block", F.explode(
                  F.when(edge, F.array(block, block + 1)).otherwise(F.array(block)))))
    frame = (Window.partitionBy(*keys, "_block").orderBy("pos").rowsBetween(-(size - 1), 0))
    mean = F.when(F.count("_value").over(frame) >= min_rows, F.avg("_value").over(frame))
    return (copied.withColumn(name, mean)
            .where(F.col("_home") == F.col("_block"))
            .drop("_value", "_home", "_block"))


def ewma(df: DataFrame, value: Column, alpha: float, keys=(), id: str = "id", name: str = "ewma",
         width: int = ID_SLICE, block: int = EWMA_BLOCK) -> DataFrame:
    """Exponentially weighted mean of ``value`` by ``id``: s = alpha * value + (1 - alpha) * previous s.

    The first row of a key starts the series. Rows are cut into blocks of consecutive
    positions; inside one, a running sum of values that grow by 1 / (1 - alpha) a row, scaled
    back, is the recursion. A block starts from the last value of the one before, itself
    started from zero two blocks back: what that leaves out is below double precision.
    NULL values count as zero.
    """
    placed = with_position(df, [id], id_bucket(id, width), keys)
    return ewma_over(placed, value, alpha, keys, name, F.col("pos") == 1, block).select(*df.columns, "pos", name)


def ewma_over(placed: DataFrame, value: Column, alpha: float, keys, name: str, starts: Column,
              block: int = EWMA_BLOCK) -> DataFrame:
    """The same for rows that have their consecutive ``pos`` per key; ``starts`` marks the rows whose value
    counts whole: the first of a series, or the last result of an earlier part of it."""
    keys, stay = list(keys), 1.0 - alpha
    # Growth within a block must stay in a double, and weights a block old must vanish.
    block = max(int(math.ceil(-40 / math.log(stay))), min(block, int(-600 / math.log(stay))))
    inside = F.pmod(F.col("pos") - 1, F.lit(block))
    weight = F.when(starts, 1.0).otherwise(alpha)
    grown = weight * F.coalesce(value.cast("double"), F.lit(0.0)) * F.pow(F.lit(stay), -inside)
    running = Window.partitionBy(*keys, "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = (placed.withColumns({"_block": F.floor((F.col("pos") - 1) / F.lit(block)), "_inside": inside, "_grown": grown})
             .withColumn("_local", F.pow(F.lit(stay), F.col("_inside")) * F.sum("_grown").over(running)))
    ends = (local.where(F.col("_inside") == block - 1)
            .select(*keys, (F.col("_block") + 1).alias("_block"), F.col("_local").alias("_carried")))
    carried = F.coalesce("_carried", F.lit(0.0)) * F.pow(F.lit(stay), F.col("_inside") + 1)
    return (local.join(ends, [*keys, "_block"], "left").withColumn(name, F.col("_local") + carried)
            .drop("_block", "_inside", "_grown", "_local", "_carried"))


def latest(df: DataFrame, n: int, keys=(), id: str = "id") -> DataFrame:
    """Newest ``n`` rows, overall or per key.

    Per key Spark prunes to ``n`` rows in every task before the shuffle
    (``WindowGroupLimit``), so a hot key moves only its tails.
    """
    keys = list(keys)
    if not keys:
        return df.orderBy(F.desc(id)).limit(n)
    order = Window.partitionBy(*keys).orderBy(F.desc(id))
    return df.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n).drop("_rn")


def keep_first(df: DataFrame, on: str, order) -> DataFrame:
    """Keep the first row, by ``order``, of each value of ``on``.

    Copies are merged inside every task before the shuffle, so one value held by
    a third of all rows costs one row per task. The leading hash lets the sort
    compare numbers instead of long texts; equality is still on the value.
    """
    order = F.struct(*order) if isinstance(order, (list, tuple)) else F.col(order)
    rest = [c for c in df.columns if c != on]
    first = (df.groupBy(F.xxhash64(on).alias("_hash"), on)
             .agg(F.min_by(F.struct(*rest), order).alias("_first")))
    return first.select(*[F.col(on) if c == on else F.col(f"_first.{c}").alias(c)
                          for c in df.columns])


def duplicate_count(df: DataFrame, on: str) -> DataFrame:
    """Rows, distinct values of ``on`` and the difference."""
    counts = df.groupBy(F.xxhash64(on), on).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in"),
        F.count(F.lit(1)).alias("distinct_rows"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count(F.lit(1))).alias("duplicates"))


def seeded_shuffle(df: DataFrame, key: str, seed: int, name: str = "pos") -> DataFrame:
    """Reproducible random order, as a position column."""
    hashed = df.withColumn("_hash", seeded_hash(key, seed))
    placed = with_position(hashed, ["_hash", key], hash_bucket("_hash"), name=name)
    return placed.drop("_hash")


def sample_capped(df: DataFrame, cap: int, key: str, seed: int, keys=()) -> DataFrame:
    """Seeded sample without replacement of at most ``cap`` rows per key."""
    hashed = df.withColumn("_hash", seeded_hash(key, seed))
    return with_position(hashed, ["_hash", key], hash_bucket("_hash"), keys,
                         name="sample_rank", first=cap).drop("_hash")


def stratified_split(df: DataFrame, key: str, test_percent: int, seed: int,
                     stratum: str | None = None, name: str = "split") -> DataFrame:
    """Mark rows ``train`` or ``test``; each stratum gives ceil(n * percent) to test."""
    keys = [stratum] if stratum else []
    hashed = df.withColumn("_hash", seeded_hash(key, seed))
    placed = with_position(hashed, ["_hash", key], hash_bucket("_hash"), keys,
                           name="_pos", total="_total")
    cut = F.floor((F.col("_total") * test_percent + 99) / 100)
    side = F.when(F.col("_pos") <= cut, "test").otherwise("train")
    return placed.withColumn(name, side).drop("_hash", "_pos", "_total")


def union_all(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
