"""Row numbers for tables with several writers: ranges are reserved, never searched for in the table.

A ledger is a folder with one small file for each range that was given out, named by its
first number. A writer reads the last file, and claims the next range by creating the file
of that name; of two writers only one can, and the other looks again. A stream names
itself and its batch, so that a batch run again gets the range it had.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidewatch.session import materialize
from tidewatch.sources.folders import Folder

_DIGITS = 20


def _end(ledger: Folder) -> int | None:
    """First number that is not given out; None for a new ledger."""
    taken = [name for name in ledger.names() if name.isdigit()]
    return int(taken[-1]) + int(ledger.read(taken[-1]).split()[0]) if taken else None


def reserve(spark: SparkSession, path: str, n: int, start: Callable[[], int] = lambda: 0,
            writer: str | None = None, batch: int | None = None) -> int:
    """First of ``n`` consecutive numbers that nobody else gets.

    ``start`` is asked once, for a ledger without entries: the first free number of a
    table that is older than its ledger. A ``batch`` that a ``writer`` reserved last
    gets the same range again, if it still has ``n`` rows.
    """
    ledger = Folder(spark, path)
    mark = f"{writer} {batch}"
    if writer is not None:
        held = (ledger.read(f"writer-{writer}") or "").split()
        if held and held[0] == str(batch) and held[2] == str(n):
            return int(held[1])
    while True:
        end = _end(ledger)
        first = start() if end is None else end
        if n == 0 or ledger.publish(f"{first:0{_DIGITS}d}", f"{n} {mark}\n"):
            break
    if writer is not None:
        ledger.write(f"writer-{writer}", f"{batch} {first} {n}")
    return first


def raise_to(spark: SparkSession, path: str, end: int, start: Callable[[], int] = lambda: 0) -> None:
    """Numbers below ``end`` were brought by the rows themselves: give none of them out. ``start`` as in :func:`reserve`."""
    ledger = Folder(spark, path)
    while True:
        now = _end(ledger)
        if now is None:
            now, end = 0, max(end, start())
        if now >= end or ledger.publish(f"{now:0{_DIGITS}d}", f"{end - now} brought\n"):
            return


def number_rows(df: DataFrame, name: str, first: Callable[[int], int]) -> DataFrame:
    """Add consecutive numbers along the rows of ``df``; ``first`` gets their count and gives the first number.

    The rows are written once to the scratch folder, so that counting and numbering see
    the same ones; one row for each partition is summed up.
    """
    stored = materialize(df.withColumn("_at", F.monotonically_increasing_id()), "to-number")
    part = F.shiftright("_at", 33)
    counts = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.select("_part", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "parts")
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    inside = F.col("_at") - F.shiftleft("_part", 33)
    return (stored.withColumn("_part", part).join(counts.drop("_n"), "_part")
            .withColumn(name, F.lit(first(total)) + F.col("_before") + inside).drop("_at", "_part", "_before"))
