"""Label normalisation rules of the labelled sources."""

from pyspark.sql import Column, functions as F

# ---------------------------------------------------------------- fixed values
BINARY = {0: "NEGATIVE", 1: "POSITIVE"}
TERNARY = {0: "NEGATIVE", 1: "NEUTRAL", 2: "POSITIVE"}
FIVE_POINT = {0: "NEGATIVE", 2: "NEUTRAL", 4: "POSITIVE"}
BY_NAME = {"positive": "POSITIVE", "negative": "NEGATIVE",
           "neutral": "NEUTRAL", "irrelevant": "NEUTRAL"}
# ------------------------------------------------------------ end fixed values


def map_label(label: Column, mapping: dict, default: str | None = None) -> Column:
    """Mapped label; unmapped values give ``default`` (NULL unless set)."""
    cases = None
    for key, name in mapping.items():
        cases = F.when(label == key, name) if cases is None else cases.when(label == key, name)
    return cases if default is None else cases.otherwise(default)


def map_name(label: Column, mapping: dict = BY_NAME) -> Column:
    return map_label(F.lower(label), mapping, "NEUTRAL")


def stars_to_sentiment(stars: Column) -> Column:
    return (F.when(stars <= 1, "NEGATIVE").when(stars == 2, "NEUTRAL").otherwise("POSITIVE"))


def score_to_sentiment(score: Column) -> Column:
    """15 and up is positive, 2 and below negative; anything unreadable is neutral."""
    value = score.try_cast("bigint")
    return F.when(value >= 15, "POSITIVE").when(value <= 2, "NEGATIVE").otherwise("NEUTRAL")


def flag_from_class(label: Column, clean_class: int = 2) -> Column:
    return (label != clean_class).cast("int")


def flag_from_score(score: Column, threshold: float = 0.5) -> Column:
    return (score >= threshold).cast("int")
