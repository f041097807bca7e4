"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each class is a Gaussian over transformed counts and shares of the text. Its
covariance is shrunk towards the pooled one and towards the pooled diagonal, and its
Cholesky factor is computed once; a score is the difference of two Mahalanobis log
densities. Moments are one aggregation over all labelled rows: no sample is drawn.
"""

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import ASCII_SPACE, map_rows, row_key, utf8
from tidewatch.session import materialize

TO_POOLED, TO_DIAGONAL = 0.1, 0.05
HELD_OUT_PARTS, HELD_OUT_PART = 3, 1
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"
SYMBOLS = b"#*$%&|<>@^~_=+/\\{}[]"
STOPS = b".,;:?!"
FEATURES = ("words", "word_length", "upper", "digits", "symbols", "stops", "bangs", "distinct_words", "repeats",
            "distinct_pairs", "top_word", "repeated_lines", "line_words", "marked_words")


def share(part: float, whole: float) -> float:
    """Log odds of a share, half a case added on either side."""
    return math.log((part + 0.5) / (max(whole - part, 0) + 0.5))


def statistics(text: str | None) -> list[float]:
    """FEATURES of a text; null is empty. Linear in its length, but for one sort of its word pairs."""
    raw = utf8(text)
    words = raw.split()
    n, chars = len(words), len(raw) - sum(map(raw.count, (b" ", b"\n", b"\t", b"\r")))
    count = lambda wanted: len(raw) - len(raw.translate(None, wanted))
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    pairs = len(np.unique(ids[:-1] * len(seen) + ids[1:])) if n > 1 else 0
    top = int(np.bincount(ids).max()) if n else 0
    lines = [line for line in raw.split(b"\n") if line.strip(ASCII_SPACE)]
    marked = sum(1 for w in words if w[-1] in SYMBOLS)
    return [
        math.log1p(n), math.log1p(chars / max(n, 1)), share(count(UPPER), chars), share(count(DIGITS), chars),
        share(count(SYMBOLS), chars), share(count(STOPS), chars), share(raw.count(b"!"), chars), share(len(seen), n),
        share(int((ids[1:] == ids[:-1]).sum()), n), share(pairs, max(n - 1, 0)), share(top, n),
        share(len(lines) - len(set(lines)), len(lines)), math.log1p(n / max(len(lines), 1)), share(marked, n)]


def features(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, _id, _hash, x) of every row, as a written table: x are its FEATURES."""
    id_key, hash_key = row_key(id, text)
    narrow = docs.select(F.col(id).alias("doc_id"), id_key, hash_key, F.col(text).alias("text"))
    return materialize(map_rows(
        narrow, lambda rows: ((i, k, h, statistics(t)) for i, k, h, t in rows),
        f"doc_id {docs.schema[id].dataType.simpleString()}, _id string, _hash long, x array<double>"), "statistics")


def held_out(id: str = "doc_id"):
    """Rows whose label is never learned: crc32 of the id as text, modulo HELD_OUT_PARTS."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % HELD_OUT_PARTS == HELD_OUT_PART, F.lit(False))


class Discriminant:
    """Log-density difference of two Gaussians, label 1 over label 0."""

    def __init__(self, counts, means, covariances, to_pooled=TO_POOLED, to_diagonal=TO_DIAGONAL):
        pooled = sum(n * c for n, c in zip(counts, covariances)) / sum(counts)
        diagonal = np.diag(np.diag(pooled) + 1e-6)
        self.classes = []
        for n, mean, own in zip(counts, means, covariances):
            shrunk = (1 - to_diagonal) * ((1 - to_pooled) * own + to_pooled * pooled) + to_diagonal * diagonal
            factor = np.linalg.cholesky(shrunk)
            constant = math.log(n / sum(counts)) - np.log(np.diag(factor)).sum()
            self.classes.append((mean, np.linalg.inv(factor), constant))

    def difference(self, x: np.ndarray) -> np.ndarray:
        zero, one = (constant - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1)
                     for mean, inverse, constant in self.classes)
        return one - zero


def fit(table: DataFrame, labels: DataFrame, label: str = "quality", id: str = "doc_id") -> Discriminant | int | None:
    """Model from all labelled rows that are not held out; the only class where there is but one, None without any.

    ``table`` is a result of :func:`features`, ``labels`` has the id and the label 0/1.
    Null labels and ids are not learned from; a label given twice counts twice.
    """
    d = len(FEATURES)
    known = labels.select(F.col(id).alias("doc_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    rows = table.where(~held_out()).join(known, "doc_id")
    cells = [(i, j) for i in range(d) for j in range(i + 1)]
    x = [F.col("x")[i].alias(f"x{i}") for i in range(d)]
    sums = rows.select("label", *x).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(f"x{i}") for i in range(d)]).alias("s"),
        F.array(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in cells]).alias("ss")).collect()
    if len(sums) < 2:
        return sums[0]["label"] if sums else None
    counts, means, covariances = [], [], []
    for row in sorted(sums, key=lambda r: r["label"]):
        mean, square = np.array(row["s"]) / row["n"], np.zeros((d, d))
        for (i, j), value in zip(cells, row["ss"]):
            square[i, j] = square[j, i] = value / row["n"]
        counts.append(row["n"])
        means.append(mean)
        covariances.append(square - np.outer(mean, mean))
    return Discriminant(counts, means, covariances)


def score(table: DataFrame, model) -> DataFrame:
    """``table`` with score (0 to 1) and predicted in place of x.

    The log-density difference is divided by the number of features before the logistic
    curve, so that clear cases do not all round to 1. Without a model every score is 0.5.
    """
    if model is None or isinstance(model, int):
        value = F.lit(0.5 if model is None else float(model))
        return table.withColumn("score", value).withColumn("predicted", (value >= 0.5).cast("int")).drop("x")

    def rows(batch):
        for doc_id, key, mark, x in batch:
            gap = float(model.difference(np.array([x]))[0]) / len(FEATURES)
            yield doc_id, key, mark, 1 / (1 + math.exp(-max(min(gap, 700.0), -700.0)))

    kind = table.schema["doc_id"].dataType.simpleString()
    scored = map_rows(table, rows, f"doc_id {kind}, _id string, _hash long, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, _id, _hash, score, predicted) of every row of ``docs``.

    Only the text is an input. Null and empty texts get a score like any other;
    repeated rows get equal scores. An empty table gives an empty one.
    """
    table = features(docs)
    return score(table, fit(table, labels))
