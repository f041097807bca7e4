"""From an uploaded CSV of any shape to rows of the store."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.contracts import UPLOAD_DEFAULTS, UPLOAD_TEXT_COLUMN_HINTS
from tidewatch.functions.linear import LinearScorer
from tidewatch.operators import enrich
from tidewatch.sources import files, store


def comments_of_upload(df: DataFrame, name: str, wanted: str | None = None, order=None,
                       sentiment: LinearScorer | None = None, toxicity: LinearScorer | None = None) -> DataFrame:
    """Comment rows, without ids, of a table with a text column somewhere.

    The text column is ``wanted`` or the first whose name hints at text; without one the job ends with
    ValueError. Blank texts, texts that clean to nothing and repeats go: of equal texts
    stays the first by ``order`` (by default by all columns in turn, as files have no
    order). ``platform`` and ``author`` are taken over where the upload has them, and
    ``name`` is the source of all rows. Every row is read; nothing is capped.
    """
    column = files.pick_text_column(df, wanted, UPLOAD_TEXT_COLUMN_HINTS)
    others = [c for c in df.columns if c != column]
    # Only what the store keeps, and what decides between copies, is carried along.
    rank = F.struct(*(order or others)) if order or others else F.lit(0)
    given = {c: F.col(c).cast("string") if c in others else F.lit(None).cast("string") for c in UPLOAD_DEFAULTS}
    rows = df.select(F.col(column).cast("string").alias("raw_text"), rank.alias("_rank"),
                     *[F.coalesce(value, F.lit(UPLOAD_DEFAULTS[c])).alias(c) for c, value in given.items()])
    scored = enrich.score_texts(enrich.clean_table(rows, "raw_text", "_rank"), sentiment=sentiment, toxicity=toxicity)
    return scored.select("platform", F.lit(name).alias("source_target"), "author", "raw_text", "clean_text",
                         "sentiment", "sentiment_score", "is_toxic", "toxicity_score")


def import_csv(spark: SparkSession, path: str, root: str, schema=None, name: str | None = None, wanted: str | None = None,
               order=None, writer: str | None = None, batch: int | None = None, **models) -> None:
    """Read a CSV, clean and score its texts, and append them to the store below ``root``.

    Rows are numbered from the store's ledger. With ``writer`` and ``batch`` an
    upload that is run again replaces its own rows. See :func:`comments_of_upload`.
    """
    rows = files.read_csv(spark, path, schema)
    name = path.rstrip("/").rsplit("/", 1)[-1] if name is None else name
    store.append_comments(comments_of_upload(rows, name, wanted, order, **models), root, writer, batch)
