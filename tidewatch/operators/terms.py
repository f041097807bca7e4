"""TF-IDF term mining: words split once, pairs counted as numbers in Arrow batches, weights inside each document's row."""

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.contracts import MAX_TERMS, STOP_WORDS
from tidewatch.functions.text import bigrams, bind, constant, content_tokens, terms
from tidewatch.functions.vectors import sorted_terms, term_counts, tfidf_vector
from tidewatch.operators.profile import attach, with_stats
from tidewatch.session import materialize

MAX_BROADCAST_TERMS = 1 << 18

# Executors need not have this package: functions of tasks travel whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def term_rows(df: DataFrame, text: str, id: str = "id", keys=(),
              stop_words=STOP_WORDS) -> DataFrame:
    """One row per term occurrence."""
    return df.select(*keys, id, F.explode(terms(F.col(text), stop_words)).alias("term"))


def vocabulary(rows: DataFrame, max_terms: int = MAX_TERMS, keys=()) -> DataFrame:
    """Most frequent terms, ties in term order."""
    keys = list(keys)
    counts = rows.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("term_count"))
    if not keys:
        return counts.orderBy(F.desc("term_count"), "term").limit(max_terms)
    order = Window.partitionBy(*keys).orderBy(F.desc("term_count"), "term")
    return (counts.withColumn("_rn", F.row_number().over(order))
            .where(F.col("_rn") <= max_terms).drop("_rn"))


def counted_vocabulary(df: DataFrame, text: str, max_terms: int = MAX_TERMS, keys=(), stop_words=STOP_WORDS) -> DataFrame:
    """(keys, term, term_count, df) of the most frequent terms, ties in term order.

    A document's terms are sorted in its row, so that one pass counts occurrences and documents; the
    shuffle carries what is left of them after each task has merged its own.
    """
    keys = list(keys)
    occurrences = (df.select(*keys, F.explode(sorted_terms(F.col(text), stop_words)).alias("_o"))
                   .select(*keys, "_o.term", F.col("_o.first").cast("int").alias("_first")))
    counts = occurrences.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("term_count"), F.sum("_first").alias("df"))
    if not keys:
        return counts.orderBy(F.desc("term_count"), "term").limit(max_terms)
    order = Window.partitionBy(*keys).orderBy(F.desc("term_count"), "term")
    return counts.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= max_terms).drop("_rn")


def _idf(documents, df):
    return F.ln((1 + documents) / (1 + df)) + 1


def _stored_words(df: DataFrame, columns, text: str, stop_words) -> DataFrame:
    """``columns`` and ``_words``, the content words of each text: read by several passes, so split once."""
    return materialize(df.select(*columns, content_tokens(F.col(text), stop_words).alias("_words")), "words")


def _numbers(words: pa.ListArray, known: pa.Array):
    """Row of every word of a batch, and its number in ``known`` or -1."""
    numbers = pc.fill_null(pc.index_in(words.flatten(), value_set=known), -1)
    return pc.list_parent_indices(words).to_numpy(), numbers.to_numpy().astype(np.int64)


def _pairs(rows, numbers, size: int):
    """Row and code of every two neighbours that have numbers."""
    fits = (rows[1:] == rows[:-1]) & (numbers[1:] >= 0) & (numbers[:-1] >= 0)
    return rows[1:][fits], (numbers[:-1] * size + numbers[1:])[fits]


def _pair_counts(words: DataFrame, listed: list[str]) -> DataFrame:
    """(code, term_count) of neighbours that are both in ``listed``: left number * size + right number."""
    size = len(listed)

    def count(batches):
        known = pa.array(listed, pa.string())
        for batch in batches:
            codes, n = np.unique(_pairs(*_numbers(batch.column(0), known), size)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n, pa.int64())], ["code", "n"])

    return words.select("_words").mapInArrow(count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("term_count"))


def frequent_terms(words: DataFrame, max_terms: int = MAX_TERMS) -> list[str]:
    """The most frequent terms of :func:`_stored_words`, ties in term order, as a list in term order.

    A pair is no more frequent than either of its words. Words are counted first; with the count of the
    ``max_terms``-th of them as a floor, only pairs of words at or above it need counting, as numbers.
    """
    counts = materialize(words.select(F.explode("_words").alias("term")).groupBy("term")
                         .agg(F.count(F.lit(1)).alias("term_count")), "counts")
    best = counts.orderBy(F.desc("term_count"), "term").limit(max_terms).collect()
    floor = best[-1].term_count if best and len(best) == max_terms else 1
    common = counts.where(F.col("term_count") >= floor)
    # Ties at the floor are not bounded by max_terms.
    listed = [r.term for r in common.select("term").limit(MAX_BROADCAST_TERMS + 1).collect()]
    if len(listed) > MAX_BROADCAST_TERMS:
        rows = words.select(F.explode(F.concat("_words", bigrams(F.col("_words")))).alias("term"))
        return sorted(r.term for r in vocabulary(rows, max_terms).collect())
    names, size = constant(listed, "array<string>"), max(len(listed), 1)
    named = lambda code: F.element_at(names, (code + 1).cast("int"))
    frequent = _pair_counts(words, listed).where(F.col("term_count") >= floor)
    left, right = F.floor(F.col("code") / size), F.col("code") % size
    pairs = frequent.select(F.concat_ws(" ", named(left), named(right)).alias("term"), "term_count")
    chosen = common.unionByName(pairs).orderBy(F.desc("term_count"), "term").limit(max_terms)
    return sorted(r.term for r in chosen.collect())


def _counter(vocabulary: list[str]):
    """Function from the words of a batch's texts to (place, n) of the terms found, in the order of their 1-based places."""
    places = {term: place for place, term in enumerate(vocabulary, start=1)}
    singles = sorted({part for term in vocabulary for part in term.split(" ")})
    number, size, step = {word: i for i, word in enumerate(singles)}, len(singles), len(vocabulary) + 1
    coded = sorted((number[left] * size + number[right], places[term]) for term in vocabulary
                   for left, pair, right in [term.partition(" ")] if pair)
    known = pa.array(singles, pa.string())
    place = np.array([places.get(word, 0) for word in singles], np.int64)
    codes = np.array([code for code, _ in coded], np.int64)
    paired = np.array([found for _, found in coded], np.int64)

    def count(words: pa.ListArray) -> pa.ListArray:
        rows, numbers = _numbers(words, known)
        pair_rows, pairs = _pairs(rows, numbers, size)
        fits = np.isin(pairs, codes)
        rows, found = rows[numbers >= 0], place[numbers[numbers >= 0]]
        cells, n = np.unique(np.concatenate([
            rows[found > 0] * step + found[found > 0],
            pair_rows[fits] * step + paired[np.searchsorted(codes, pairs[fits])]]), return_counts=True)
        ends = np.searchsorted(cells, np.arange(len(words) + 1) * step)
        held = pa.StructArray.from_arrays([pa.array(cells % step, pa.int32()), pa.array(n, pa.int32())], ["place", "n"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held)

    return count


def _vocabulary_counts(words: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``_counts`` in place of ``_words``: (place, n) of the terms found, in the order of their 1-based places."""
    count, kept = _counter(vocabulary), [c for c in words.columns if c != "_words"]

    def counted(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), count(batch.column("_words"))], [*kept, "_counts"])

    schema = words.select(*kept, F.lit(None).cast("array<struct<place:int,n:int>>").alias("_counts")).schema
    return words.mapInArrow(counted, schema)


def _weigher(idf: list[float], sublinear: bool):
    """Function from the (place, n) of a batch's texts to the fields of their sparse, L2-normalised TF-IDF vectors."""
    weight_of = np.array(idf, np.float64)

    def weigh(counts: pa.ListArray) -> pa.StructArray:
        rows, cells, texts = pc.list_parent_indices(counts).to_numpy(), counts.flatten(), len(counts)
        places, n = (pc.struct_field(cells, name).to_numpy() for name in ("place", "n"))
        weights = (1 + np.log(n) if sublinear else n) * weight_of[places - 1]
        values = weights / np.sqrt(np.bincount(rows, weights * weights, texts))[rows]
        ends = pa.array(np.searchsorted(rows, np.arange(texts + 1)), pa.int32())
        return pa.StructArray.from_arrays(
            [pa.array(np.zeros(texts), pa.int8()), pa.array(np.full(texts, len(weight_of)), pa.int32()),
             pa.ListArray.from_arrays(ends, pa.array(places - 1, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(values))],
            ["type", "size", "indices", "values"])

    return weigh


def count_vectors(counts: Column, idf: list[float], sublinear: bool = False) -> Column:
    """Sparse TF-IDF vectors of the ``_counts`` of texts."""
    weigh = _weigher(idf, sublinear)

    @F.arrow_udf(VectorUDT())
    def vectors(counts: pa.Array) -> pa.Array:
        return weigh(counts)

    return vectors(counts)


def text_vectors(text: Column, vocabulary: list[str], idf: list[float], sublinear: bool = False, stop_words=STOP_WORDS) -> Column:
    """Sparse TF-IDF vectors of texts: Spark splits the words, which are counted and weighted in Arrow batches."""
    count, weigh = _counter(vocabulary), _weigher(idf, sublinear)

    @F.arrow_udf(VectorUDT())
    def vectors(words: pa.Array) -> pa.Array:
        return weigh(count(words))

    return vectors(content_tokens(text, stop_words))


def _inverse_frequencies(counted: DataFrame, found: list[str], documents: int) -> list[float]:
    """idf of each term, from the ``_counts`` of every document."""
    sizes = (counted.select(F.explode("_counts.place").alias("place")).groupBy("place")
             .agg(_idf(F.lit(documents), F.count(F.lit(1))).alias("idf")).collect())
    held = {r.place: r.idf for r in sizes}
    return [held[place] for place in range(1, len(found) + 1)]


def counted_terms(df: DataFrame, columns, text: str, max_terms: int = MAX_TERMS, stop_words=STOP_WORDS):
    """``columns`` and ``_counts`` of each document as a stored table, the terms in order, their idf, and the number of documents.

    To the driver come ``max_terms`` rows, and the words tied with the last of them, up to MAX_BROADCAST_TERMS.
    """
    words = _stored_words(df, columns, text, stop_words)
    documents, found = words.count(), frequent_terms(words, max_terms)
    counted = materialize(_vocabulary_counts(words, found), "counted")
    return counted, found, _inverse_frequencies(counted, found, documents), documents


def tfidf(df: DataFrame, text: str = "clean_text", id: str = "id", keys=(),
          max_terms: int = MAX_TERMS, sublinear: bool = False,
          stop_words=STOP_WORDS) -> DataFrame:
    """L2-normalised TF-IDF weights of vocabulary terms, one row per document and term.

    idf = ln((1 + n) / (1 + df)) + 1. The vocabulary is a literal of the plan, or with keys
    one small row for each key, and a document is counted and weighted inside its row: nothing but
    the counts of terms is shuffled. Vocabularies beyond MAX_BROADCAST_TERMS are joined.
    """
    keys = list(keys)
    if max_terms > MAX_BROADCAST_TERMS:
        return _tfidf_joined(df, text, id, keys, max_terms, sublinear, stop_words)
    narrow = df.select(*keys, id, F.col(text).alias("_text"))
    if keys:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("documents"))
        held = counted_vocabulary(df, text, max_terms, keys, stop_words).groupBy(*keys).agg(
            F.array_sort(F.collect_list(F.struct("term", "df"))).alias("_v")).join(sizes, keys)
        numbers = F.map_from_arrays(F.col("_v.term"), F.sequence(F.lit(1), F.size("_v")))
        held = held.select(*keys, "documents", F.col("_v.term").alias("_terms"), numbers.alias("_places"),
                           F.transform("_v", lambda v: _idf(F.col("documents"), v["df"])).alias("_idf"))
        narrow = attach(narrow, held, keys, "inner")
        counted = narrow.withColumn("_counts", term_counts(
            F.col("_text"), lambda term: F.element_at(F.col("_places"), term), stop_words))
        idf, names, documents = F.col("_idf"), F.col("_terms"), F.col("documents")
    else:
        counted, found, held, size = counted_terms(narrow, [id], "_text", max_terms, stop_words)
        names, documents, idf = constant(found, "array<string>"), F.lit(size), constant(held, "array<double>")
    cells = counted.select(*keys, id, documents.alias("documents"), idf.alias("_weights"), names.alias("_words"),
                           F.explode(tfidf_vector(F.col("_counts"), idf, sublinear)).alias("_c"))
    return cells.select(*keys, id, F.element_at("_words", F.col("_c.place")).alias("term"), F.col("_c.n").cast("bigint").alias("tf"),
                        F.element_at("_weights", F.col("_c.place")).alias("idf"), F.col("documents").cast("bigint").alias("documents"),
                        F.col("_c.weight").alias("tfidf"))


def _tfidf_joined(df, text, id, keys, max_terms, sublinear, stop_words) -> DataFrame:
    """The same for vocabularies too large for a plan: joins on the long (document, term) table."""
    rows = term_rows(df, text, id, keys, stop_words)
    vocab = vocabulary(rows, max_terms, keys).select(*keys, "term")
    tf = (rows.join(vocab, [*keys, "term"]).groupBy(*keys, id, "term")
          .agg(F.count(F.lit(1)).alias("tf")))
    # Counting on ``tf`` keeps its column in this branch, so both share one shuffle.
    document_frequency = tf.groupBy(*keys, "term").agg(F.count("tf").alias("_df"))
    sized = with_stats(document_frequency, [F.count(F.lit(1)).alias("documents")], keys, of=df)
    idf = sized.withColumn("idf", _idf(F.col("documents"), F.col("_df"))).drop("_df")
    weight = (1 + F.ln("tf") if sublinear else F.col("tf")) * F.col("idf")
    document = Window.partitionBy(*keys, id)
    return (tf.join(idf, [*keys, "term"]).withColumn("_w", weight)
            .withColumn("tfidf", F.col("_w") / F.sqrt(F.sum(F.col("_w") * F.col("_w"))
                                                      .over(document)))
            .select(*keys, id, "term", "tf", "idf", "documents", "tfidf"))


def top_culprits(df: DataFrame, text: str = "clean_text", id: str = "id", n: int = 8, keys=(),
                 max_terms: int = MAX_TERMS) -> DataFrame:
    """Terms with the largest summed weight; nothing for fewer than two texts."""
    keys = list(keys)
    scores = (tfidf(df, text, id, keys, max_terms).groupBy(*keys, "term")
              .agg(F.sum("tfidf").alias("_score"), F.max("documents").alias("_documents"))
              .where(F.col("_documents") >= 2))
    if keys:
        order = Window.partitionBy(*keys).orderBy(F.desc("_score"), "term")
        best = scores.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n)
    else:
        best = scores.orderBy(F.desc("_score"), "term").limit(n)
    return best.where(F.col("_score") > 0.01).select(
        *keys, "term", F.round("_score", 3).alias("tfidf_score"),
        F.col("term").contains(" ").alias("is_bigram"))


def bigram_counts(df: DataFrame, text: str = "clean_text") -> DataFrame:
    pairs = df.select(F.explode(bind(content_tokens(F.col(text)), bigrams)).alias("term"))
    return pairs.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
