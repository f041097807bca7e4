"""Helpers shared by the operators of this package."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.session import materialize

#: A word, as every operator of this package counts it: no ASCII white space inside.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def map_rows(df: DataFrame, rows: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """Send the rows of each partition through a generator, in Arrow batches.

    ``rows`` gets tuples in the order of ``df``'s columns and yields tuples in
    the order of ``schema``. Batches go out after OUT_ROWS rows or OUT_BYTES of
    texts, so a task holds a few megabytes whatever its partition holds.
    """
    target = df.sparkSession.createDataFrame([], schema).schema
    arrow = _arrow_schema(target)

    def run(batches):
        yield from to_batches(rows(from_batches(batches)), arrow)

    return df.mapInArrow(run, target)


OUT_ROWS = 4096
OUT_BYTES = 8 << 20


def _arrow_schema(target) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(target)


def from_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            yield from zip(*(column.to_pylist() for column in part.columns))


def to_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def batch():
        return pa.RecordBatch.from_arrays(
            [pa.array(column, type=field.type) for column, field in zip(zip(*held), schema)], schema=schema)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(cell) for cell in row if isinstance(cell, (str, bytes, list, np.ndarray)))
        if len(held) >= OUT_ROWS or size >= OUT_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def row_key(id: str = "doc_id", text: str = "text") -> list[Column]:
    """``_id`` and ``_hash``: which document a row is. A null id is ''; rows equal in both are one document."""
    return [F.coalesce(F.col(id).cast("string"), F.lit("")).alias("_id"), F.xxhash64(text).alias("_hash")]


def without(docs: DataFrame, removed: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` less the rows whose :func:`row_key` is in ``removed`` (a written table).

    Both sides are shuffled, at every size: ``removed`` grows with the documents.
    """
    id_key, hash_key = row_key(id, text)
    mine = docs.select(F.struct("*").alias("_row"), id_key, hash_key)
    return mine.join(removed.select("_id", "_hash").hint("merge"), ["_id", "_hash"], "left_anti").select("_row.*")


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b long) to (node, root): the smallest node reachable from each node that has an edge.

    Large and small stars in turn until nothing changes: O(log^2) rounds, and each
    round keeps at most as many edges as the one before. Minima are merged inside
    tasks before the shuffle; the joins carry no grouping on top, so AQE may split
    the partition of a hub. Every round is written to the shared scratch folder.
    """
    def large_star(e):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        return (both.join(least, "a").where(F.col("b") > F.col("a"))
                .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())

    def small_star(e):
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        rest = e.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return rest.union(least.select("a", F.col("m").alias("b"))).distinct()

    def state(e):
        mark = F.xxhash64("a", "b")
        # Two sums of independent pieces: an exact fingerprint of the edge set, in 64 bits without overflow.
        return e.agg(F.count(F.lit(1)), F.sum(mark.bitwiseAND(0xFFFFFFFF)),
                     F.sum(F.shiftrightunsigned(mark, 32))).first()

    now = materialize(edges.where(F.col("a") != F.col("b"))
                      .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = state(now)
    while True:
        now = materialize(small_star(large_star(now)), "edges")
        after = state(now)
        if after == before:
            break
        before = after
    # Stars: every node but the root points at it.
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
