"""Language identification with a string kernel.

Two texts are as alike as the n-grams that occur in both, for every length of the blend:
the kernel is the mean over n of |G(x) and G(y)| / sqrt(|G(x)| |G(y)|), G being the set of
a text's n-grams (present or not, however often). Landmark texts span the Nyström
approximation: a text is represented by its kernel values to them, whitened by their
own kernel matrix, and a ridge regression for each language against the rest is solved on
these. As the kernel is linear in a text's presence vector, landmarks and weights multiply
out to one matrix of n-grams by languages, and a batch is scored by one product with it.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.session import materialize

#: Lengths of the blend. Three code points of 21 bits are one whole number: no n-gram is hashed.
GRAMS = (1, 2, 3)
#: Landmarks over all languages (one for each at least), and characters of the longest text that may be one.
LANDMARKS, LANDMARK_CHARACTERS = 192, 20_000
#: Labelled rows of each language that the regression is fitted on, and characters of the longest of them.
FIT_ROWS, FIT_CHARACTERS = 400, 200_000
RIDGE, JITTER = 1e-2, 1e-6
HELD_OUT_PARTS = 5
UNKNOWN = "und"
SPACE = 32
BATCH_CHARACTERS = 1 << 21

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters; built once in a process."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def grams(text: str) -> list[np.ndarray]:
    """For each n of GRAMS the sorted distinct n-grams of a text, with n in the top bits.

    Letters in lower case; whatever lies between words, and either end, is one space.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    codes = np.concatenate(([SPACE], np.where(letters()[codes], codes, SPACE), [SPACE]))
    gap = codes == SPACE
    codes = codes[~(gap & np.concatenate(([False], gap[:-1])))]
    out = []
    for n in GRAMS:
        whole = np.zeros(max(len(codes) - n + 1, 0), dtype=np.int64)
        for k in range(n):
            whole = (whole << 21) | codes[k:k + len(whole)]
        # No code point fills 21 bits, so three of them stay below 2^63, and n-grams of different lengths below each other's range.
        out.append(np.unique(whole))
    return out


class Kernel:
    """The n-grams of landmark texts, each with its weight for every landmark."""

    def __init__(self, landmarks: list[list[np.ndarray]]):
        self.known, self.weights = [], []
        for k, _ in enumerate(GRAMS):
            sets = [mark[k] for mark in landmarks]
            known = np.unique(np.concatenate(sets)) if sets else np.zeros(0, dtype=np.int64)
            weight = np.zeros((len(known), len(sets)), dtype=np.float32)
            for column, found in enumerate(sets):
                weight[np.searchsorted(known, found), column] = 1 / np.sqrt(max(len(found), 1)) / len(GRAMS)
            self.known.append(known)
            self.weights.append(weight)

    def times(self, right: np.ndarray) -> "Kernel":
        """The same n-grams with weights for the columns of ``right``."""
        out = Kernel([])
        out.known = self.known
        out.weights = [(w.astype(np.float64) @ right) for w in self.weights]
        return out

    def values(self, batch: list[list[np.ndarray]]) -> np.ndarray:
        """One row for each text: its presence vector over the root of its size, times the weights."""
        total = np.zeros((len(batch), self.weights[0].shape[1]))
        for k, (known, weight) in enumerate(zip(self.known, self.weights)):
            if not len(known):
                continue
            sizes = np.array([len(text[k]) for text in batch])
            found = np.concatenate([text[k] for text in batch])
            row = np.repeat(np.arange(len(batch)), sizes)
            place = np.minimum(np.searchsorted(known, found), len(known) - 1)
            hit = known[place] == found
            row, place = row[hit], place[hit]
            # Rows are consecutive: the product with the 0/1 matrix is a sum over runs of picked rows.
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            if len(starts):
                total[row[starts]] += np.add.reduceat(weight[place], starts, axis=0) / np.sqrt(sizes[row[starts]])[:, None]
        return total


class Model:
    """Languages, and the n-grams' weights for each."""

    def __init__(self, languages: list[str], kernel: Kernel, bias: np.ndarray):
        self.languages, self.kernel, self.bias = languages, kernel, bias

    def scores(self, batch: list[list[np.ndarray]]) -> np.ndarray:
        return self.kernel.values(batch) + self.bias


def held_out(id: str = "doc_id"):
    """Rows that nothing is learned from: crc32 of the id as text divides by HELD_OUT_PARTS. Null ids are learned from."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % HELD_OUT_PARTS == 0, F.lit(False))


def _in_batches(rows, texts_at: int):
    """Runs of rows that hold BATCH_CHARACTERS of texts, one row at least."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[texts_at] or "") + 64
        if size >= BATCH_CHARACTERS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _rows(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(start, 256).columns))


def _chosen(docs: DataFrame, text: str, lang: str, id: str, rows: int) -> DataFrame:
    """(lang, text, rank): the first ``rows`` distinct texts of each language by hash, as a written table.

    Hashes alone are ranked, and of a large language only those in the lowest part that holds about
    twice as many as wanted; the chosen rows fetch their texts afterwards.
    """
    usable = docs.where(~held_out(id)).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.length("text") <= FIT_CHARACTERS))
    # Copies of a text merge first, so that they take one place.
    marks = materialize(usable.groupBy("lang", F.md5("text").alias("mark")).agg(F.lit(1).alias("one")).drop("one"), "language-marks")
    sizes = materialize(marks.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language-sizes")
    share = F.conv(F.substring("mark", 1, 8), 16, 10).cast("double") / 2 ** 32
    low = marks.join(sizes, "lang").where(share * F.col("n") < 2 * rows)
    ranked = low.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("mark"))).where(F.col("rank") <= rows)
    ranked = materialize(ranked, "language-ranks")
    texts = usable.withColumn("mark", F.md5("text")).join(ranked.select("lang", "mark", "rank"), ["lang", "mark"])
    one = texts.groupBy("lang", "rank").agg(F.first("text").alias("text"))
    return materialize(one, "language-texts")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id",
        landmarks: int = LANDMARKS, rows: int = FIT_ROWS) -> Model | None:
    """Model of the languages of ``lang``, from rows that are not held out; None without any.

    Landmarks and fit rows are bounded samples: the first by hash among the distinct texts
    of a language, ``rows`` of them at most (fewer only if a hash splits very unevenly), those without a letter or of more than
    FIT_CHARACTERS left out, and of these the first ones up to LANDMARK_CHARACTERS as
    landmarks. To the driver come the landmarks and one square matrix for each of a
    fixed number of tasks.
    """
    chosen = _chosen(docs, text, lang, id, rows)
    languages = sorted(r["lang"] for r in chosen.select("lang").distinct().collect())
    if not languages:
        return None
    quota = -(-landmarks // len(languages))
    short = chosen.where(F.length("text") <= LANDMARK_CHARACTERS).withColumn(
        "place", F.row_number().over(Window.partitionBy("lang").orderBy("rank")))
    marks = short.where(F.col("place") <= quota).orderBy("lang", "rank").collect()
    kernel = Kernel([grams(r["text"]) for r in marks])
    own = kernel.values([grams(r["text"]) for r in marks])
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    kept = values > JITTER * max(values.max(initial=0), 1e-300)
    white = vectors[:, kept] / np.sqrt(values[kept])
    column = {name: k for k, name in enumerate(languages)}
    width = white.shape[1] + 1

    def sums(batches):
        gram, target = np.zeros((width, width)), np.zeros((width, len(column)))
        for batch in _in_batches(_rows(batches), 1):
            features = kernel.values([grams(t) for _, t in batch]) @ white
            features = np.column_stack((features, np.ones(len(features))))
            goal = -np.ones((len(batch), len(column)))
            goal[np.arange(len(batch)), [column[name] for name, _ in batch]] = 1
            gram += features.T @ features
            target += features.T @ goal
        yield pa.RecordBatch.from_pydict({"gram": [gram.ravel().tolist()], "target": [target.ravel().tolist()]})

    tasks = chosen.select("lang", "text").repartition(8).mapInArrow(sums, "gram array<double>, target array<double>").collect()
    gram = sum(np.array(r["gram"]) for r in tasks).reshape(width, width)
    target = sum(np.array(r["target"]) for r in tasks).reshape(width, -1)
    penalty = RIDGE * np.eye(width)
    penalty[-1, -1] = 1e-9
    solved = np.linalg.solve(gram + penalty, target)
    return Model(languages, kernel.times(white @ solved[:-1]), solved[-1])


def identify(docs: DataFrame, model: Model | None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from its whole text alone.

    The language of the largest regression value (of ties, the first by name); score is
    that value, 1 for the language and -1 for any other, moved to 0 to 1. Null texts and
    texts without a letter are 'und' with score 0, and so is everything without a model.
    Repeated rows get equal answers, an empty table gives an empty one, other columns are not looked at.
    """
    kind = docs.schema[id].dataType.simpleString()
    told = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    narrow = docs.select(F.col(id).alias("doc_id"), F.when(told, F.col(text)).alias("text"))
    if model is None:
        return narrow.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = docs.sparkSession.createDataFrame([], f"doc_id {kind}, lang_pred string, score double").schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        for batch in _in_batches(_rows(batches), 1):
            told = [k for k, (_, t) in enumerate(batch) if t is not None]
            names, marks = [UNKNOWN] * len(batch), [0.0] * len(batch)
            if told:
                values = model.scores([grams(batch[k][1]) for k in told])
                best = values.argmax(axis=1)
                for k, which, value in zip(told, best.tolist(), values[np.arange(len(best)), best].tolist()):
                    names[k], marks[k] = model.languages[which], min(max((value + 1) / 2, 0.0), 1.0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in batch], type=arrow.field(0).type), pa.array(names), pa.array(marks)], schema=arrow)

    return narrow.mapInArrow(run, schema)
