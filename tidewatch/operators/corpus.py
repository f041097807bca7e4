"""Labelled corpora: per-source frames, union, filters, splits, chat examples."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.contracts import CHAT_EXPLANATION, CHAT_SYSTEM_PROMPT, SEED, SENTIMENTS
from tidewatch.functions.text import clean_text, strip
from tidewatch.operators.ordering import keep_first, sample_capped, seeded_shuffle, union_all

MIN_LENGTH = 3


def source_frame(df: DataFrame, source: str, id: Column, text: Column, **labels) -> DataFrame:
    """One labelled source in corpus shape; rows with any missing value are dropped."""
    return df.select(
        id.cast("bigint").alias("id"), text.cast("string").alias("text"),
        *[value.alias(name) for name, value in labels.items()],
        F.lit(source).alias("source")).dropna()


def known_sentiments(df: DataFrame, column: str = "sentiment") -> DataFrame:
    return df.where(F.col(column).isin(*SENTIMENTS))


def long_enough(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(F.char_length(strip(F.col(text))) > MIN_LENGTH)


def build_corpus(frames, cap: int | None = None, capped=(), seed: int = SEED,
                 deduplicate: bool = True) -> DataFrame:
    """Merge sources in order: optional cap, union, filters, keep-first, seeded shuffle.

    The cap applies to the sources named in ``capped``; ``pos`` is the row's
    place in the shuffled corpus.
    """
    ranked = []
    for rank, frame in enumerate(frames):
        name, data = frame
        if cap is not None and name in capped:
            data = sample_capped(data, cap, "id", seed).drop("sample_rank")
        ranked.append(data.withColumn("_rank", F.lit(rank)))
    merged = union_all(ranked)
    if "sentiment" in merged.columns:
        merged = known_sentiments(merged)
    merged = long_enough(merged)
    if deduplicate:
        merged = keep_first(merged, "text", ["_rank", "id"])
    keyed = merged.withColumn("_key", F.concat_ws("-", "_rank", "id"))
    return seeded_shuffle(keyed, "_key", seed).drop("_rank", "_key")


def master_corpus(frames) -> DataFrame:
    """Union of sentiment sources with clean text of more than three characters."""
    merged = known_sentiments(union_all(frames))
    # Exploding what is long enough cleans once; a filter would clean twice.
    kept = F.filter(F.array(clean_text(F.col("text"))),
                    lambda clean: F.char_length(clean) > MIN_LENGTH)
    return merged.select("*", F.explode(kept).alias("clean_text"))


def source_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def label_index(df: DataFrame, label: str) -> DataFrame:
    """Dense ids of the distinct labels, in sorted order."""
    distinct = df.where(F.col(label).isNotNull()).select(label).distinct()
    return distinct.withColumn(
        "label_id", (F.row_number().over(Window.orderBy(label)) - 1).cast("int"))


def with_label_id(df: DataFrame, label: str, index: DataFrame | None = None) -> DataFrame:
    """Attach label ids; rows whose label is not in the index are dropped."""
    return df.join(label_index(df, label) if index is None else index, label)


def train_guard(df: DataFrame, label: str = "sentiment", min_rows: int = 20,
                min_classes: int = 2) -> DataFrame:
    """Whether a table is fit for training: row count, class count, status."""
    known = F.when(F.col(label).isin(*SENTIMENTS), F.col(label))
    n, classes = F.col("rows_in"), F.col("classes")
    return (df.agg(F.count(F.lit(1)).alias("rows_in"), F.countDistinct(known).alias("classes"))
            .withColumn("status", F.when(n < min_rows, "Insufficient data for ML training")
                        .when(classes < min_classes, "Requires at least 2 distinct classes")
                        .otherwise("OK")))


# -- chat examples -------------------------------------------------------------

def _json_string(value: Column) -> Column:
    packed = F.to_json(F.array(value))
    return F.substr(packed, F.lit(2), F.length(packed) - 2)


def chat_answer(sentiment: Column, is_toxic: Column, toxicity_type: Column, sarcasm: Column,
                explanation: Column) -> Column:
    """The five answer fields as JSON text, spaced the way Python's ``json`` prints it."""
    fields = (("sentiment", _json_string(sentiment)), ("is_toxic", is_toxic.cast("string")),
              ("toxicity_type", _json_string(toxicity_type)),
              ("sarcasm", sarcasm.cast("string")), ("explanation", _json_string(explanation)))
    parts = []
    for i, (name, value) in enumerate(fields):
        parts += [F.lit(f'{", " if i else "{"}"{name}": '), value]
    return F.concat(*parts, F.lit("}"))


def chat_messages(text: Column, sentiment: Column, is_toxic: Column | None = None,
                  system_prompt: str = CHAT_SYSTEM_PROMPT) -> Column:
    """System, user and assistant message of one instruction example.

    With ``is_toxic`` toxic posts answer NEGATIVE / HARASSMENT and others NEUTRAL.
    """
    toxic = F.lit(False) if is_toxic is None else is_toxic
    mood = sentiment if is_toxic is None else F.when(toxic, "NEGATIVE").otherwise("NEUTRAL")
    kind = F.when(toxic, "HARASSMENT").otherwise("NONE")
    answer = chat_answer(mood, toxic, kind, F.lit(False), F.lit(CHAT_EXPLANATION))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(system_prompt)),
                   message("user", F.concat(F.lit("Post: "), text)),
                   message("assistant", answer))


def chat_examples(frames) -> DataFrame:
    """Instruction examples of several sources, one row per post.

    Each frame has ``id``, ``text``, ``source`` and either ``sentiment`` or ``is_toxic``.
    """
    built = []
    for frame in frames:
        if "is_toxic" in frame.columns:
            messages = chat_messages(F.col("text"), None, F.col("is_toxic").cast("boolean"))
        else:
            messages = chat_messages(F.col("text"), F.coalesce("sentiment", F.lit("NEUTRAL")))
        built.append(frame.select("source", "id", messages.alias("messages")))
    return union_all(built)
