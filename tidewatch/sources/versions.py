"""A keyed table that keeps the newest version of each row, written batch by batch.

``changes/batch=N`` holds the rows that batch N changed; a batch run again replaces its
folder. ``base-M`` holds the newest version of everything up to batch M: it replaces the
changes it was made of, so folders do not pile up. A reader takes the newest finished base
and the changes after it, and of each key the row of the highest batch.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.sources.folders import Folder

#: Batches after which changes are folded into a new base.
FOLD_AFTER = 16


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, schema, keys):
        self.spark, self.root, self.schema, self.keys = spark, root, schema, list(keys)

    def _changes(self, after: int, upto: int | None = None) -> DataFrame:
        found = Folder(self.spark, f"{self.root}/changes").numbers("batch=")
        parts = [n for n in found if n > after and (upto is None or n <= upto)]
        rows = None
        if parts:
            # The folder's own number is read as a column, so a version needs no further bytes.
            rows = (self.spark.read.option("basePath", f"{self.root}/changes").schema(self._versioned())
                    .parquet(*[f"{self.root}/changes/batch={n}" for n in parts]))
        return rows if rows is not None else self.spark.createDataFrame([], self._versioned())

    def _versioned(self):
        names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        return self.spark.createDataFrame([], f"{names}, batch bigint").schema

    def _state(self, upto: int | None = None) -> DataFrame:
        """Newest version of every key, with its batch."""
        bases = [n for n in Folder(self.spark, self.root).numbers("base-") if upto is None or n <= upto]
        last = bases[-1] if bases else -1
        rows = self._changes(last, upto)
        if bases:
            rows = rows.unionByName(self.spark.read.schema(self._versioned()).parquet(f"{self.root}/base-{last}"))
        rest = [c for c in self._versioned().names if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
        return newest.select(*self.keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(self._versioned().names)

    def read(self, upto: int | None = None) -> DataFrame:
        """Newest row of each key, or the newest that batches up to ``upto`` wrote: what a replay of the next one saw."""
        return self._state(upto).drop("batch")

    def put(self, rows: DataFrame, batch: int) -> None:
        """Rows that ``batch`` changed, one for each key. Replaces what an earlier run of the batch wrote."""
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.root}/changes/batch={batch}")
        if batch % FOLD_AFTER == FOLD_AFTER - 1:
            self.fold(batch)

    def fold(self, batch: int) -> None:
        """Make the newest versions up to ``batch`` the base, and drop what the base before that already held.

        One older base stays for readers that have begun with it.
        """
        folder, changes = Folder(self.spark, self.root), Folder(self.spark, f"{self.root}/changes")
        if not folder.has(f"base-{batch}/_SUCCESS"):
            self._state(batch).write.mode("overwrite").parquet(f"{self.root}/base-{batch}")
        kept = [n for n in folder.numbers("base-") if n <= batch][-2:]
        for n in folder.numbers("base-", finished=False):
            if n < kept[0]:
                folder.remove(f"base-{n}")
        for n in changes.numbers("batch=", finished=False):
            if n <= kept[0] and len(kept) > 1:
                changes.remove(f"batch={n}")
