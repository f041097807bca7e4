"""Cleaning and scoring of whole comment tables."""

from pyspark.sql import DataFrame, functions as F

from tidewatch.functions.linear import LinearScorer, model_sentiment
from tidewatch.functions.scoring import has_word, neutral_result, sentiment_from_sums, toxicity_rules
from tidewatch.functions.text import clean_text, is_blank, tokens, word_count
from tidewatch.operators.ordering import keep_first


def with_text_features(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Add the clean text and its two length features."""
    return (df.withColumn("clean_text", clean_text(F.col(text)))
            .withColumn("char_length", F.char_length(text))
            .withColumn("word_count", word_count(F.col("clean_text"))))


def clean_table(df: DataFrame, text: str = "raw_text", order: str = "id") -> DataFrame:
    """Drop missing and blank texts and repeats, add features, drop what cleans to nothing."""
    first = keep_first(df.where(~is_blank(F.col(text))), text, order)
    # Exploding the non-empty result cleans once; a filter on it would clean twice.
    kept = F.filter(F.array(clean_text(F.col(text))), lambda clean: clean != "")
    return (first.select("*", F.explode(kept).alias("clean_text"))
            .withColumn("char_length", F.char_length(text))
            .withColumn("word_count", word_count(F.col("clean_text"))))


def score_texts(df: DataFrame, text: str = "clean_text", sentiment: LinearScorer | None = None,
                toxicity: LinearScorer | None = None, toxic_label: str = "1") -> DataFrame:
    """Add sentiment and toxicity columns for an already cleaned text.

    Trained models blend with the lexicon and the word rules; without them, those alone decide.
    """
    # Models of the same terms share one count of them; a column of its own, so that it is made once.
    shared = sentiment and toxicity and (sentiment.terms, sentiment.stop_words) == (toxicity.terms, toxicity.stop_words)
    counted = df.withColumn("_counts", sentiment.counts(F.col(text))) if shared else df
    counts = F.col("_counts") if shared else None
    ml = toxicity.probability(F.col(text), toxic_label, counts) if toxicity else None
    scored = counted.withColumns({"_sentiment": model_sentiment(F.col(text), sentiment, counts),
                                  "_toxicity": toxicity_rules(F.col(text), ml)})
    return (scored.withColumn("sentiment", F.col("_sentiment.label"))
            .withColumn("sentiment_score", F.col("_sentiment.score"))
            .withColumn("is_toxic", F.col("_toxicity.is_toxic").cast("int"))
            .withColumn("toxicity_score", F.col("_toxicity.toxicity_score"))
            .drop("_sentiment", "_toxicity", "_counts"))


def enrich_comments(df: DataFrame, text: str = "raw_text", sentiment: LinearScorer | None = None,
                    toxicity: LinearScorer | None = None) -> DataFrame:
    """Raw posts to comment rows: clean, score, keep every other column."""
    return score_texts(df.withColumn("clean_text", clean_text(F.col(text))), sentiment=sentiment, toxicity=toxicity)


def lexicon_sentiment_join(df: DataFrame, lexicon: DataFrame, text: str = "clean_text",
                           id: str = "id") -> DataFrame:
    """Lexicon sentiment from a table (word, weight) of any size.

    Words of one document are summed in the task that reads it, so the shuffle
    carries one row per document.
    """
    # Two steps: expressions next to a generator would run once per word.
    listed = df.select(id, is_blank(F.col(text)).alias("_blank"), tokens(F.col(text)).alias("_words"))
    words = listed.select(id, "_blank", F.explode_outer("_words").alias("word"))
    weight = F.col("weight")
    sums = (words.join(lexicon, "word", "left").groupBy(id).agg(
        F.max("_blank").alias("_blank"),
        F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total"),
        F.coalesce(F.sum(F.when(weight > 0, weight + 1)), F.lit(0.0)).alias("positive"),
        F.coalesce(F.sum(F.when(weight < 0, weight - 1)), F.lit(0.0)).alias("negative"),
        F.count_if(weight.isNull() & F.col("word").isNotNull()).cast("double").alias("neutral")))
    scored = sentiment_from_sums(*[F.col(c) for c in ("total", "positive", "negative", "neutral")])
    return (sums.withColumn("_s", F.when(F.col("_blank"), neutral_result()).otherwise(scored))
            .select(id, "_s.*"))


def containing(df: DataFrame, words, text: str = "clean_text") -> DataFrame:
    """Documents that share a word with ``words``."""
    return df.where(has_word(F.col(text), words))


def not_containing(df: DataFrame, words, text: str = "clean_text") -> DataFrame:
    """Documents that share no word with ``words``."""
    return df.where(~F.coalesce(has_word(F.col(text), words), F.lit(False)))
