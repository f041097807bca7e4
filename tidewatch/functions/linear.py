"""Trained linear text classifiers as column expressions.

A multinomial logistic regression and a multinomial naive Bayes model both score a
normalised TF-IDF vector by one weight for each term and label plus a constant for each
label. :class:`LinearScorer` holds these numbers as literals of the plan, so a text is
scored inside its row, in a batch and on a stream alike: no vectors, no join, no Python.
"""

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from tidewatch.contracts import ENGLISH_STOP_WORDS
from tidewatch.functions.scoring import consensus, lexicon_sentiment, neutral_result, softmax
from tidewatch.functions.text import bind, is_blank
from tidewatch.functions.vectors import constant, damped, places, term_counts

#: The literals travel with every task: some 20 MB of numbers for two labels.
MAX_SCORER_TERMS = 1 << 18


@dataclass(frozen=True)
class LinearScorer:
    """``weights[i][c]`` of term i for label c, ``idf[i]``, ``bias[c]``; ``sublinear`` damps counts to 1 + ln(count)."""

    labels: tuple[str, ...]
    bias: tuple[float, ...]
    terms: tuple[str, ...]
    idf: tuple[float, ...]
    weights: tuple[tuple[float, ...], ...]
    sublinear: bool = False
    stop_words: tuple[str, ...] = ENGLISH_STOP_WORDS

    def __post_init__(self):
        if len(self.terms) > MAX_SCORER_TERMS:
            raise ValueError(f"more than {MAX_SCORER_TERMS} terms")

    def counts(self, text: Column) -> Column:
        """(place, n) of the model's terms in a text: the same for all models of the same terms."""
        return term_counts(text, places(self.terms), self.stop_words)

    def margins(self, text: Column, counts: Column | None = None) -> Column:
        """One number for each label: the bias plus the weights of the normalised TF-IDF vector."""
        idf, weights = constant(self.idf, "array<double>"), constant(self.weights, "array<array<double>>")
        start = F.struct(F.lit(0.0).alias("square"), constant([0.0] * len(self.labels), "array<double>").alias("sums"))

        def add(held, term):
            return bind(damped(term["n"], self.sublinear) * F.element_at(idf, term["place"]), lambda x: F.struct(
                (held["square"] + x * x).alias("square"),
                F.zip_with(held["sums"], F.element_at(weights, term["place"]), lambda s, w: s + x * w).alias("sums")))

        def finish(held):
            size = F.when(held["square"] > 0, F.sqrt(held["square"])).otherwise(1.0)
            return F.zip_with(held["sums"], constant(self.bias, "array<double>"), lambda s, b: s / size + b)

        return F.aggregate(self.counts(text) if counts is None else counts, start, add, finish)

    def probabilities(self, text: Column, counts: Column | None = None) -> Column:
        return softmax(self.margins(text, counts))

    def probability(self, text: Column, label: str, counts: Column | None = None) -> Column:
        return F.element_at(self.probabilities(text, counts), self.labels.index(label) + 1)

    def prediction(self, text: Column, counts: Column | None = None) -> Column:
        """(label, score): the most likely label, the first of equals, and its probability."""
        names = F.array(*[F.lit(x) for x in self.labels])
        return bind(self.probabilities(text, counts), lambda p: bind(F.array_max(p), lambda best: F.struct(
            F.element_at(names, F.array_position(p, best).cast("int")).alias("label"), best.alias("score"))))


def model_sentiment(text: Column, scorer: LinearScorer | None, counts: Column | None = None) -> Column:
    """Label, score and compound of the trained model and the lexicon in consensus.

    Blank and missing texts are neutral; without a model the lexicon alone decides.
    """
    polarity = lexicon_sentiment(text)
    if scorer is None:
        return polarity
    both = F.struct(scorer.prediction(text, counts).alias("model"), polarity["compound"].alias("compound"))
    blended = bind(both, lambda x: consensus(x["model"]["label"], x["model"]["score"], x["compound"]))
    return F.when(is_blank(text), neutral_result()).otherwise(blended)
