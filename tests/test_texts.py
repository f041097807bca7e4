import math
import random
import re
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidewatch.contracts import SENTIMENT_WEIGHTS, STOP_WORDS
from tidewatch.functions import scoring
from tidewatch.functions.linear import LinearScorer
from tidewatch.operators import enrich, terms

TEXTS = ["battery drain is terrible battery drain again", "refund refused after battery drain",
         "the screen flickers and the screen breaks", "support refused my refund", "", "I a of"]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, "hot" if i % 3 else "b", t) for i, t in enumerate(texts)],
                                 "id bigint, platform string, clean_text string")


def brute_tfidf(texts, size, sublinear=False):
    docs = []
    for text in texts:
        words = [w for w in text.lower().split() if len(w) > 1 and w not in STOP_WORDS]
        docs.append(Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])]))
    total = sum(docs, Counter())
    vocab = sorted(total, key=lambda t: (-total[t], t))[:size]
    idf = {t: math.log((1 + len(docs)) / (1 + sum(t in d for d in docs))) + 1 for t in vocab}
    out = {}
    for i, d in enumerate(docs):
        w = {t: (1 + math.log(d[t]) if sublinear else d[t]) * idf[t] for t in vocab if t in d}
        norm = math.sqrt(sum(v * v for v in w.values()))
        out.update({(i, t): v / norm for t, v in w.items()})
    return out


def test_tfidf_matches_brute_force(spark):
    for sublinear in (False, True):
        got = {(r.id, r.term): r.tfidf for r in terms.tfidf(frame(spark), max_terms=9, sublinear=sublinear).collect()}
        want = brute_tfidf(TEXTS, 9, sublinear)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_tfidf_per_key(spark):
    got = {(r.id, r.term): r.tfidf for r in terms.tfidf(frame(spark), keys=["platform"], max_terms=5).collect()}
    want = {}
    for key in ("hot", "b"):
        ids = [i for i in range(len(TEXTS)) if ("hot" if i % 3 else "b") == key]
        want.update({(ids[i], t): v for (i, t), v in brute_tfidf([TEXTS[i] for i in ids], 5).items()})
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_top_culprits(spark):
    top = terms.top_culprits(frame(spark), n=3).collect()
    sums = Counter()
    for (_, t), v in brute_tfidf(TEXTS, 150).items():
        sums[t] += v
    want = sorted(sums, key=lambda t: (-sums[t], t))[:3]
    assert sorted(r.term for r in top) == sorted(want)
    assert all(r.is_bigram == (" " in r.term) and r.tfidf_score == round(sums[r.term], 3) for r in top)
    assert terms.top_culprits(frame(spark, TEXTS[:1])).count() == 0


def test_weights_need_no_shuffle_and_large_vocabularies_share_one(spark):
    rows = terms.tfidf(frame(spark).repartition(2).persist())
    rows.collect()
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    joined = terms.tfidf(frame(spark).repartition(2), max_terms=terms.MAX_BROADCAST_TERMS + 1)
    joined.collect()
    assert "ReusedExchange" in joined._jdf.queryExecution().executedPlan().toString()


def test_weights_with_keys_and_by_join(spark):
    df = frame(spark).withColumn("k", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b")).withColumn("clean_text", F.when(F.col("id") != 2, F.col("clean_text")))
    for sublinear in (False, True):
        row = {(r.k, r.id, r.term): r for r in terms.tfidf(df, keys=["k"], max_terms=9, sublinear=sublinear).collect()}
        for key in ("a", "b"):
            alone = terms.tfidf(df.where(F.col("k") == key), max_terms=9, sublinear=sublinear).collect()
            assert {(key, r.id, r.term) for r in alone} == {c for c in row if c[0] == key}
            for r in alone:
                assert row[(key, r.id, r.term)].tfidf == pytest.approx(r.tfidf) and row[(key, r.id, r.term)].tf == r.tf
        assert not any(k is None for k, _, _ in row)
        joined = {(r.id, r.term): (r.tf, r.documents, r.idf, r.tfidf) for r in terms._tfidf_joined(df, "clean_text", "id", [], 9, sublinear, terms.STOP_WORDS).collect()}
        inside = {(r.id, r.term): (r.tf, r.documents, r.idf, r.tfidf) for r in terms.tfidf(df, max_terms=9, sublinear=sublinear).collect()}
        assert joined.keys() == inside.keys() and all(joined[k] == pytest.approx(inside[k]) for k in joined)
    assert terms.tfidf(df.limit(0)).count() == 0 and terms.tfidf(df.limit(0), keys=["k"]).count() == 0


def test_valence_rules_by_hand(spark):
    def compound(total):
        return round(total / (total * total + 15) ** 0.5, 4)

    worst, smooth = SENTIMENT_WEIGHTS["worst"], SENTIMENT_WEIGHTS["smooth"]
    cases = {
        "worst": worst, "not worst": worst * -0.74, "It isn't the worst": worst * -0.74, "never so smooth": (smooth + 0.293) * -0.74,
        "very smooth": smooth + 0.293, "slightly smooth": smooth - 0.293, "very very smooth": smooth + 0.293 + 0.293 * 0.95,
        "extremely worst": worst - 0.293, "a WORST thing": worst - 0.733, "WORST THING": worst,
        "VERY smooth thing": smooth + 0.293 + 0.733, "smooth but worst": smooth * 0.5 + worst * 1.5,
        "smooth!": smooth + 0.292, "worst!!": worst - 2 * 0.292, "smooth!!!!!!": smooth + 4 * 0.292,
        "smooth??": smooth + 2 * 0.18, "smooth?????": smooth + 0.96, "smooth?": smooth, "not a b c smooth": smooth, "": 0.0, "!!": 0.0,
    }
    df = frame(spark, list(cases)).withColumn("s", scoring.lexicon_sentiment_rules(F.col("clean_text")))
    got = {r.clean_text: r.s for r in df.collect()}
    for text, total in cases.items():
        assert got[text].compound == pytest.approx(compound(total), abs=1e-4), text
    assert (got[""].label, got[""].score) == ("NEUTRAL", 0.5) and got["not worst"].label == "POSITIVE"


def test_lexicon_join_equals_inline(spark):
    texts = ["worst scam ever", "smooth and flawless but broken", "hello", "", "?!", "refund refund REFUND"]
    df = frame(spark, texts)
    lexicon = spark.createDataFrame(list(SENTIMENT_WEIGHTS.items()), "word string, weight double")
    joined = {r.id: (r.label, r.score, r.compound) for r in enrich.lexicon_sentiment_join(df, lexicon).collect()}
    inline = df.withColumn("s", scoring.lexicon_sentiment(F.col("clean_text"))).select("id", "s.*")
    assert joined == {r.id: (r.label, r.score, r.compound) for r in inline.collect()}


def test_clean_table(spark):
    rows = [(1, "Hi @x &amp; #fun 🔥"), (2, None), (3, "  "), (0, "Hi @x &amp; #fun 🔥"), (4, "@only"), (5, "Hi")]
    got = enrich.clean_table(spark.createDataFrame(rows, "id bigint, raw_text string")).orderBy("id").collect()
    assert [(r.id, r.clean_text, r.word_count, r.char_length) for r in got] == [(0, "Hi fun fire", 3, 18), (5, "Hi", 1, 2)]


def test_enrich(spark):
    df = spark.createDataFrame([(1, "This is a SCAM 💩"), (2, "fine")], "id bigint, raw_text string")
    got = enrich.enrich_comments(df).orderBy("id").collect()
    assert (got[0].clean_text, got[0].sentiment, got[0].is_toxic) == ("This is a SCAM trash", "NEGATIVE", 1)
    assert (got[1].sentiment, got[1].is_toxic, got[1].toxicity_score) == ("NEUTRAL", 0, 0.0)


def test_lexicon_filters_split_the_table(spark):
    df = frame(spark, ["you idiot", "fine", None, "dies"])
    assert [r.id for r in enrich.containing(df, ["idiot", "die"]).collect()] == [0]
    assert sorted(r.id for r in enrich.not_containing(df, ["idiot", "die"]).collect()) == [1, 2, 3]


def test_terms_are_counted_as_by_plain_python(spark, tmp_path):
    """Pairs below the floor of the words are left out, repeated words, ties and missing texts are not."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice("aa bb cc dd ee ff éé gg x the".split()) for _ in range(rng.randrange(0, 30))) for _ in range(60)]
    texts += [None, "", "aa", "zz zz zz zz", "the, the"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3)
    words = terms._stored_words(df, ["id"], "t", ("the",))
    listed = {i: [w for w in re.findall(r"\w{2,}", t or "") if w != "the"] for i, t in enumerate(texts)}
    found = {i: Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]) for i, w in listed.items()}
    total = sum(found.values(), Counter())
    ranked = sorted(total, key=lambda term: (-total[term], term))
    for size in (1, 9, 12, 40, 500):
        vocabulary = sorted(ranked[:size])
        assert terms.frequent_terms(words, size) == vocabulary
        got = {r.id: {vocabulary[c.place - 1]: c.n for c in r._counts} for r in terms._vocabulary_counts(words, vocabulary).collect()}
        assert got == {i: {term: n for term, n in counts.items() if term in vocabulary} for i, counts in found.items()}


def test_models_of_the_same_terms_share_one_count(spark):
    scorer = LinearScorer(("0", "1"), (0.1, -0.1), ("bad", "bad day", "day"), (1.0, 2.0, 1.5), ((0.1, 0.2), (0.3, -0.4), (0.5, 0.6)))
    df = spark.createDataFrame([(1, "bad day bad"), (2, ""), (3, None)], "id int, clean_text string")
    both = enrich.score_texts(df, sentiment=scorer, toxicity=scorer)
    assert both._jdf.queryExecution().optimizedPlan().toString().count("AS _counts") == 1
    alone = enrich.score_texts(df, sentiment=scorer, toxicity=replace(scorer, stop_words=scorer.stop_words + ("unused",)))
    assert both.orderBy("id").collect() == alone.orderBy("id").collect()
