import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidewatch.functions.linear import LinearScorer
from tidewatch.operators import enrich, terms
from tidewatch.operators import models as M
from tidewatch.session import scratch_path
from tidewatch.streaming import jobs


@pytest.fixture(scope="module")
def posts(spark):
    good, bad = ["great smooth phone", "lovely flawless screen", "smooth reliable app"], ["broken awful phone", "useless broken screen", "awful crashing app"]
    rows = [(i, f"{(good if i % 2 else bad)[i % 3]} number{i}", "POSITIVE" if i % 2 else "NEGATIVE") for i in range(60)]
    return spark.createDataFrame(rows, "id bigint, clean_text string, sentiment string").repartition(2).persist()


def test_vectorizer_equals_the_long_table(spark, posts):
    for sublinear in (False, True):
        model = M.fit_tfidf(posts, "clean_text", max_terms=12, sublinear=sublinear)
        names = M.vocabulary_of(model)
        dense = {r.id: {n: v for n, v in zip(names, r.features.toArray()) if v} for r in model.transform(posts).collect()}
        for r in terms.tfidf(posts, max_terms=12, sublinear=sublinear).collect():
            assert abs(dense[r.id][r.term] - r.tfidf) < 1e-12


def test_training_saving_and_scoring(spark, posts):
    path = scratch_path(spark, "model")
    model, report = M.train_and_report(posts, "clean_text", "sentiment", path, max_terms=40, max_iter=50)
    assert {r.label: r.f1 for r in report.collect()} == {"NEGATIVE": 1.0, "POSITIVE": 1.0}
    loaded = M.load_model(path)
    a = M.predict(model, posts).orderBy("id").collect()
    assert a == M.predict(loaded, posts).orderBy("id").collect()
    assert all(r.predicted == r.sentiment and 0.5 <= r.score <= 1 for r in a)
    probabilities = M.class_probabilities(loaded, posts).first()
    assert probabilities.label in ("POSITIVE", "NEGATIVE") and -1 <= probabilities.compound <= 1


def test_missing_model_falls_back(spark, posts):
    assert M.load_model("/nowhere/model") is None
    r = M.predict(None, posts).first()
    assert (r.predicted, r.score) == ("NEUTRAL", .5)


def test_benchmark(posts):
    rows = {r.model: r for r in M.model_benchmark(posts).collect()}
    assert rows.keys() == {"naive_bayes", "logistic_regression"}
    assert all(r.accuracy > .9 and r.train_count == 44 and r.test_count == 16 for r in rows.values())


def test_clusters(spark, posts):
    found = M.root_cause_clusters(posts.select("id", "clean_text"), starts=3).collect()
    assert sum(r.comment_count for r in found) == 60 and len(found) == 3
    assert [r.comment_count for r in found] == sorted((r.comment_count for r in found), reverse=True)
    assert all(" / " in r.theme for r in found)
    assert M.root_cause_clusters(posts.limit(2).select("id", "clean_text")).count() == 0


ODD = ["great great smooth phone", "Broken, AWFUL: broken awful phone!", "nothing known here", "", "   ", None,
       "the of and", "phone " * 3000 + "useless screen", "great smooth phone", "великий phone ünïcode"]


def odd_texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "id bigint, clean_text string")


@pytest.mark.parametrize("kind,sublinear", [("naive_bayes", True), ("naive_bayes", False), ("logistic_regression", True)])
def test_scorer_equals_the_pipeline(spark, posts, kind, sublinear):
    model = M.fit_classifier(posts, "clean_text", "sentiment", kind, max_terms=40, sublinear=sublinear, max_iter=50)
    scorer = M.linear_scorer(model)
    path = scratch_path(spark, "scorer")
    M.save_scorer(spark, scorer, path)
    M.save_scorer(spark, scorer, path)
    loaded = M.load_scorer(spark, path)
    told = odd_texts(spark).where("clean_text is not null")
    rows = posts.select("id", "clean_text").unionByName(told)
    both = model.transform(rows).select(
        vector_to_array("probability").alias("p"), "predicted", scorer.probabilities(F.col("clean_text")).alias("q"),
        loaded.probabilities(F.col("clean_text")).alias("r"), scorer.prediction(F.col("clean_text")).alias("s")).collect()
    assert len(both) == 69
    for r in both:
        assert r.p == pytest.approx(r.q, abs=1e-12) and r.p == pytest.approx(r.r, abs=1e-12)
        assert r.s.label == r.predicted or max(r.p) - min(r.p) < 1e-12


def test_scorer_by_hand(spark):
    scorer = LinearScorer(("a", "b"), (0.5, -0.25), ("alpha", "alpha beta", "beta"), (2.0, 1.5, 1.0),
                          ((1.0, -1.0), (0.0, 3.0), (-2.0, 0.5)), True, ("stop",))
    x = np.array([(1 + math.log(2)) * 2.0, 1.5, 1.0])
    want = (x / np.sqrt((x * x).sum())) @ np.array(scorer.weights) + np.array(scorer.bias)
    rows = spark.createDataFrame([("Alpha stop beta; gamma alpha",), ("stop",), ("",)], "t string")
    got = [r[0] for r in rows.select(scorer.margins(F.col("t"))).collect()]
    assert got[0] == pytest.approx(want.tolist()) and got[1] == got[2] == list(scorer.bias)
    with pytest.raises(ValueError):
        LinearScorer(("a",), (0.0,), ("t",) * ((1 << 18) + 1), (), ())


@pytest.mark.parametrize("sublinear", [True, False])
def test_features_equal_the_stages_of_the_pipeline(spark, posts, sublinear):
    vectorizer = M.fit_tfidf(posts, "clean_text", max_terms=30, sublinear=sublinear, stop_words=("the", "of"))
    rows = posts.select("id", "clean_text").unionByName(odd_texts(spark).where("clean_text is not null")).drop("id")
    _, fitted = M._fit_features(posts, ["id"], "clean_text", 30, sublinear, ("the", "of"))
    for df, key, got in ((rows, "clean_text", M.with_features(rows, vectorizer)), (posts, "id", fitted)):
        found = {r[key]: r.features for r in got.collect()}
        for r in vectorizer.transform(df).collect():
            assert found[r[key]].size == r.features.size == 30
            assert found[r[key]].toArray() == pytest.approx(r.features.toArray(), abs=1e-15)


def test_training_and_scoring_skip_the_row_stages(spark, posts, monkeypatch):
    """Neither makes a dense array of the vocabulary for each row."""
    def never(self, dataset):
        raise AssertionError("dense")

    monkeypatch.setattr(M.SublinearTf, "_transform", never)
    vectorizer = M.fit_tfidf(posts, "clean_text", max_terms=40, sublinear=True, stop_words=M.ENGLISH_STOP_WORDS)
    fresh, shared = (M.fit_classifier(posts, "clean_text", "sentiment", "naive_bayes", max_terms=40, vectorizer=v) for v in (None, vectorizer))
    assert M.linear_scorer(fresh).weights == pytest.approx(np.array(M.linear_scorer(shared).weights), abs=1e-12)
    told = M.predict(fresh, posts).collect()
    assert [r.predicted for r in told] == [r.sentiment for r in told]
    both = M.class_probabilities(fresh, posts).join(M.predict(fresh, posts).select("id", F.col("score").alias("best")), "id").collect()
    assert len(both) == 60 and all(r.score == pytest.approx(r.best, abs=1e-4) for r in both)


def test_logistic_weights_are_the_optimum(spark, posts):
    """The gradient of the penalised log-likelihood vanishes at the fitted weights."""
    c = 1.5
    model = M.fit_classifier(posts, "clean_text", "sentiment", max_terms=40, c=c, max_iter=500)
    scorer = M.linear_scorer(model)
    rows = model.transform(posts).select("sentiment", vector_to_array("features").alias("x")).collect()
    x = np.array([r.x for r in rows])
    y = np.array([[float(r.sentiment == label) for label in scorer.labels] for r in rows])
    w, b = np.array(scorer.weights), np.array(scorer.bias)
    scores = np.exp(x @ w + b)
    p = scores / scores.sum(axis=1, keepdims=True)
    assert np.abs(x.T @ (p - y) / len(x) + w / (c * len(x))).max() < 1e-4
    assert np.abs((p - y).mean(axis=0)).max() < 1e-4


def test_enrichment_with_and_without_models(spark, posts):
    sentiment = M.linear_scorer(M.fit_classifier(posts, "clean_text", "sentiment", "naive_bayes", max_terms=40))
    toxic = posts.withColumn("toxic", (F.col("sentiment") == "NEGATIVE").cast("int"))
    toxicity = M.linear_scorer(M.fit_classifier(toxic, "clean_text", "toxic", "naive_bayes", max_terms=40))
    plain = enrich.score_texts(odd_texts(spark)).orderBy("id").collect()
    assert M.load_scorer(spark, "/nowhere/scorer") is None and M.linear_scorer(None) is None
    assert plain == enrich.score_texts(odd_texts(spark), sentiment=M.load_scorer(spark, "/nowhere/scorer")).orderBy("id").collect()
    scored = {r.id: r for r in enrich.score_texts(odd_texts(spark), "clean_text", sentiment, toxicity).collect()}
    for i in (3, 4, 5):
        assert (scored[i].sentiment, scored[i].sentiment_score, scored[i].is_toxic, scored[i].toxicity_score) == ("NEUTRAL", 0.5, 0, 0.0)
    # "broken" weighs -2.9, "smooth" 2.5: the lexicon agrees with the model here; without a lexicon word the text is neutral.
    assert (scored[1].sentiment, scored[0].sentiment, scored[2].sentiment) == ("NEGATIVE", "POSITIVE", "NEUTRAL")
    assert scored[1].is_toxic == 1 and scored[1].toxicity_score > 0.65 and scored[0].is_toxic == 0
    assert scored[0].sentiment_score > 0.5 and scored[7].sentiment == "NEGATIVE"
    folder, out = scratch_path(spark, "posts"), scratch_path(spark, "out")
    odd_texts(spark).withColumnRenamed("clean_text", "raw_text").repartition(3).write.parquet(folder)
    stream = jobs.read_folder(spark, folder, "id bigint, raw_text string", files_per_trigger=1)
    jobs.append_to(jobs.enrich(stream, sentiment, toxicity), out, f"{out}-cp").awaitTermination()
    batch = enrich.enrich_comments(spark.read.parquet(folder), "raw_text", sentiment, toxicity)
    assert sorted(map(str, spark.read.parquet(out).collect())) == sorted(map(str, batch.collect()))
