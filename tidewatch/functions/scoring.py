"""Sentiment and toxicity decision rules on columns."""

from pyspark.sql import Column, functions as F

from tidewatch.contracts import (
    AFTER_BUT, BEFORE_BUT, BOOST, BOOST_BY_DISTANCE, CAPITALS, DIMINISHERS, EXCLAMATION, INTENSIFIERS, MANY_QUESTIONS, NEGATED,
    NEGATIONS, PROFANE_WORDS, QUESTION, SENTIMENT_WEIGHTS, SEVERE_WORDS,
)
from tidewatch.functions.text import TOKEN, WORD, bind, is_blank, whole_word

SPOKEN_WORD = rf"[{WORD}]+(?:'[{WORD}]+)*"

# ---------------------------------------------------------------- fixed values
LABEL_CUT = 0.05
CONSENSUS_CUT = 0.20
SEVERE_SCORE, PROFANE_SCORE, RULE_CUT = 0.70, 0.45, 0.40
MODEL_CUT = 0.65
MODEL_PROFILE_SEVERE, MODEL_PROFILE_CUT, MODEL_PROFILE_HIGH = 0.90, 0.50, 0.80
ALPHA = 15.0  # normalisation constant of Hutto & Gilbert (2014)
# ------------------------------------------------------------ end fixed values


def sentiment_from_sums(total: Column, positive: Column, negative: Column,
                        neutral: Column) -> Column:
    """Label, score and compound from the valence sums of one text.

    ``positive`` and ``negative`` sum the valences shifted by one away from
    zero, ``neutral`` counts words without valence.
    """
    compound = total / F.sqrt(total * total + F.lit(ALPHA))
    size = positive + F.abs(negative) + neutral
    share = lambda part: F.round(F.coalesce(F.try_divide(F.abs(part), size), F.lit(0.0)), 3)
    label = (F.when(compound >= LABEL_CUT, "POSITIVE")
             .when(compound <= -LABEL_CUT, "NEGATIVE").otherwise("NEUTRAL"))
    raw = (F.when(compound >= LABEL_CUT, share(positive) + 0.1)
           .when(compound <= -LABEL_CUT, share(negative) + 0.1).otherwise(share(neutral)))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.round(raw, 4)))
    return F.struct(label.alias("label"), score.alias("score"),
                    F.round(compound, 4).alias("compound"))


def lexicon_sentiment(text: Column, weights: dict = SENTIMENT_WEIGHTS) -> Column:
    """Lexicon sentiment inside the row: no explode, no shuffle.

    Meant for small word lists; ``operators.enrich.lexicon_sentiment_join``
    takes a lexicon table of any size.
    """
    hits = F.regexp_extract_all(F.lower(text), F.lit(f"({whole_word(weights)})"), F.lit(1))
    valence = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])

    def add(acc, word):
        value = F.element_at(valence, word)
        return F.struct(
            (acc["total"] + value).alias("total"),
            (acc["positive"] + F.when(value > 0, value + 1).otherwise(0.0)).alias("positive"),
            (acc["negative"] + F.when(value < 0, value - 1).otherwise(0.0)).alias("negative"),
            (acc["hits"] + 1.0).alias("hits"))

    names = ("total", "positive", "negative", "hits")
    sums = F.aggregate(hits, F.struct(*[F.lit(0.0).alias(n) for n in names]), add)
    words = F.regexp_count(text, F.lit(TOKEN)).cast("double")
    scored = bind(F.struct(sums.alias("s"), words.alias("n")), lambda x: sentiment_from_sums(
        x["s"]["total"], x["s"]["positive"], x["s"]["negative"], x["n"] - x["s"]["hits"]))
    return F.when(is_blank(text), neutral_result()).otherwise(scored)


def _constants(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def valences(text: Column, weights: dict = SENTIMENT_WEIGHTS) -> Column:
    """(word, v) along a text: v is the weight of a lexicon word after the words around it, NULL for others.

    Capitals in a text that is not all capitals push a weight outwards; up to three words
    back, intensifiers and diminishers add to it, less with distance, unless they are
    lexicon words themselves, and a negation turns it around. Before "but" weights count half, after it
    half as much again.
    """
    lexicon, boosts = _constants(weights), _constants({w: BOOST for w in INTENSIFIERS} | {w: -BOOST for w in DIMINISHERS})

    def along(said):
        spoken, lowered, mixed = said["spoken"], said["lowered"], said["mixed"]
        butted = F.array_position(lowered, F.lit("but"))

        def loud(word, size):
            capital = (F.upper(word) == word) & (F.lower(word) != word)
            return F.when(mixed & capital, size).otherwise(0.0)

        def at(i, distance):
            """The word ``distance`` before the 0-based ``i``."""
            place = F.greatest(i - distance + 1, F.lit(1))
            return F.element_at(spoken, place), F.element_at(lowered, place)

        def one(word, i):
            base = F.element_at(lexicon, F.element_at(lowered, i + 1))
            away = F.signum(base)
            value, negated = base + away * loud(word, CAPITALS), F.lit(False)
            for distance, reach in enumerate(BOOST_BY_DISTANCE, start=1):
                before, low = at(i, distance)
                there = i >= distance
                boost = F.element_at(boosts, low)
                shout = F.signum(boost) * loud(before, CAPITALS)
                heard = there & boost.isNotNull() & F.element_at(lexicon, low).isNull()
                value = value + F.when(heard, away * (boost + shout) * reach).otherwise(0.0)
                negated = negated | (there & low.isin(*NEGATIONS))
            turned = value * F.when(negated, NEGATED).otherwise(1.0)
            side = F.when((butted == 0) | (butted == i + 1), 1.0).when(i + 1 < butted, BEFORE_BUT).otherwise(AFTER_BUT)
            return F.struct(word.alias("word"), (turned * side).alias("v"))

        return F.transform(spoken, one)

    words = F.regexp_extract_all(text, F.lit(SPOKEN_WORD), F.lit(0))
    prepared = bind(words, lambda spoken: F.struct(
        spoken.alias("spoken"), F.transform(spoken, F.lower).alias("lowered"),
        F.exists(spoken, lambda w: F.upper(w) != w).alias("mixed")))
    return bind(prepared, along)


def lexicon_sentiment_rules(text: Column, weights: dict = SENTIMENT_WEIGHTS) -> Column:
    """Lexicon sentiment with the rules of :func:`valences` and the emphasis of ``!`` and ``?``, inside the row."""
    bangs, asked = F.length(text) - F.length(F.replace(text, F.lit("!"))), F.length(text) - F.length(F.replace(text, F.lit("?")))
    emphasis = F.least(bangs, F.lit(4)) * EXCLAMATION + F.when(asked > 3, MANY_QUESTIONS).when(asked > 1, asked * QUESTION).otherwise(0.0)

    def add(held, cell):
        v = F.coalesce(cell["v"], F.lit(0.0))
        return F.struct((held["total"] + v).alias("total"),
                        (held["positive"] + F.when(v > 0, v + 1).otherwise(0.0)).alias("positive"),
                        (held["negative"] + F.when(v < 0, v - 1).otherwise(0.0)).alias("negative"),
                        (held["neutral"] + F.when(v == 0, 1.0).otherwise(0.0)).alias("neutral"))

    start = F.struct(*[F.lit(0.0).alias(n) for n in ("total", "positive", "negative", "neutral")])
    sums = F.aggregate(valences(text, weights), start, add)

    def scored(x):
        s, e = x["sums"], x["emphasis"]
        strong = F.signum(s["positive"] + s["negative"])
        return sentiment_from_sums(
            s["total"] + F.signum(s["total"]) * e, s["positive"] + F.when(strong > 0, e).otherwise(0.0),
            s["negative"] - F.when(strong < 0, e).otherwise(0.0), s["neutral"])

    both = F.struct(sums.alias("sums"), emphasis.alias("emphasis"))
    return F.when(is_blank(text), neutral_result()).otherwise(bind(both, scored))


def neutral_result() -> Column:
    return F.struct(F.lit("NEUTRAL").alias("label"), F.lit(0.5).alias("score"),
                    F.lit(0.0).alias("compound"))


def consensus(label: Column, confidence: Column, compound: Column | None = None) -> Column:
    """Blend a model's label with lexicon polarity.

    Without a lexicon the polarity is the signed confidence of the model.
    """
    if compound is None:
        compound = (F.when(label == "POSITIVE", confidence)
                    .when(label == "NEGATIVE", -confidence).otherwise(0.0))
    final = (F.when(F.abs(compound) <= LABEL_CUT, "NEUTRAL")
             .when((compound >= CONSENSUS_CUT) & (label != "POSITIVE"), "POSITIVE")
             .when((compound <= -CONSENSUS_CUT) & (label != "NEGATIVE"), "NEGATIVE")
             .otherwise(label))
    return F.struct(final.alias("label"), F.round(confidence, 4).alias("score"),
                    F.round(compound, 4).alias("compound"))


def has_word(text: Column, words) -> Column:
    """True when the word set of ``text`` meets ``words``; phrases never match."""
    return F.lower(text).rlike(whole_word([w for w in words if " " not in w]))


def has_phrase(text: Column, words) -> Column:
    """Phrase mode: entries of several words match consecutive words too."""
    return F.lower(text).rlike(whole_word(words))


def _toxicity(text, ml, severe, profane, severe_score, model_cut, high_cut):
    flags = F.struct(severe.alias("severe"), profane.alias("profane"),
                     F.coalesce(ml, F.lit(0.0)).alias("model"))
    empty = F.struct(F.lit(False).alias("is_toxic"), F.lit(0.0).alias("toxicity_score"),
                     F.array().cast("array<string>").alias("categories"))
    scored = bind(flags, lambda x: _toxicity_result(
        x["severe"], x["profane"], x["model"], severe_score, model_cut, high_cut))
    return F.when(is_blank(text), empty).otherwise(scored)


def _toxicity_result(severe, profane, model, severe_score, model_cut, high_cut):
    rule = (F.when(severe, severe_score).otherwise(0.0)
            + F.when(profane, PROFANE_SCORE).otherwise(0.0))
    toxic = (rule >= RULE_CUT) | (model >= model_cut)
    fallback = F.lit("TOXIC_LANGUAGE")
    if high_cut is not None:
        fallback = F.when(model >= high_cut, "TOXIC_HIGH_CONFIDENCE").otherwise(fallback)
    named = F.array_compact(F.array(F.when(profane, "PROFANITY"), F.when(severe, "THREAT_SEVERE")))
    categories = F.when(toxic & ~severe & ~profane, F.array(fallback)).otherwise(named)
    score = F.least(F.lit(1.0), F.round(F.greatest(rule, model), 4))
    return F.struct(toxic.alias("is_toxic"), score.alias("toxicity_score"),
                    categories.alias("categories"))


def toxicity_rules(text: Column, ml: Column | None = None, phrases: bool = False) -> Column:
    """Threat and profanity word rules, joined with an optional model score."""
    match = has_phrase if phrases else has_word
    return _toxicity(text, F.lit(0.0) if ml is None else ml, match(text, SEVERE_WORDS),
                     match(text, PROFANE_WORDS), SEVERE_SCORE, MODEL_CUT, None)


def toxicity_model_profile(text: Column, ml: Column) -> Column:
    """The stricter profile for transformer scores: threats only, no profanity list."""
    return _toxicity(text, ml, has_word(text, SEVERE_WORDS), F.lit(False),
                     MODEL_PROFILE_SEVERE, MODEL_PROFILE_CUT, MODEL_PROFILE_HIGH)


def softmax(logits: Column) -> Column:
    powers = bind(F.array_max(logits),
                  lambda top: F.transform(logits, lambda x: F.exp((x - top).cast("double"))))
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x)
    return bind(powers, lambda p: bind(total(p), lambda t: F.transform(p, lambda x: x / t)))


def label_from_probabilities(probabilities: Column, labels) -> Column:
    """Most likely label, its probability, and P(positive) - P(negative)."""
    labels = list(labels)
    best = F.array_max(probabilities)
    index = F.array_position(probabilities, best).cast("int")
    names = F.array(*[F.lit(x) for x in labels])
    at = lambda name, missing: F.element_at(
        probabilities, (labels.index(name) if name in labels else missing) + 1)
    return F.struct(
        (index - 1).alias("label_id"), F.element_at(names, index).alias("label"),
        F.round(best, 4).alias("score"),
        F.round(at("POSITIVE", 2) - at("NEGATIVE", 0), 4).alias("compound"))
