"""Model queries. Naive Bayes has a closed form, which the SQL recomputes from the texts; the results of
iterative solvers depend on the solver and are tested on small data instead."""

from pyspark.sql import functions as F

from tidewatch.contracts import ENGLISH_STOP_WORDS
from tidewatch.operators import enrich, models
from tidewatch.plans.registry import CDOC, comment_documents, query, table
from tidewatch.plans.sql import clean_sql, naive_bayes_cte
from tidewatch.plans.streams import documents_as_posts, drained
from tidewatch.plans.texts import TOXIC, sentiment_sql, spiced_sql, with_spice
from tidewatch.session import materialize, scratch_path
from tidewatch.streaming import jobs

LABELLED = f"""lab AS (SELECT id, clean_text, sentiment, toxic FROM (
  SELECT d.doc_id AS id, {clean_sql('d.text')} AS clean_text, toxic, CASE l.quality WHEN 1 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS sentiment,
    row_number() OVER (PARTITION BY d.text ORDER BY d.doc_id) AS rn
  FROM documents d JOIN labels l USING (doc_id) WHERE trim(d.text) <> '') WHERE rn = 1 AND clean_text <> '')"""


def _labelled(spark, folder):
    """Distinct labelled documents with clean text."""
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    named = docs.select(F.col("doc_id").alias("id"), "text", "toxic",
                        F.when(F.col("quality") == 1, "POSITIVE").otherwise("NEGATIVE").alias("sentiment"))
    cleaned = enrich.clean_table(named, "text", "id").select("id", "clean_text", "sentiment", "toxic")
    return materialize(cleaned, "labelled")


@query("train_naive_bayes", f"""WITH {LABELLED}, {naive_bayes_cte('lab', 'sentiment', 'lab', 'clean_text', 's_')}
SELECT id, sentiment, b.label AS predicted, round(prob, 4) AS score FROM lab JOIN s_best b USING (id)""")
def train_naive_bayes(spark, folder):
    rows = _labelled(spark, folder)
    model = models.fit_classifier(rows, "clean_text", "sentiment", "naive_bayes")
    return models.predict(model, rows).select("id", "sentiment", "predicted", "score")


@query("train_logistic")
def train_logistic(spark, folder):
    rows = _labelled(spark, folder)
    model = models.fit_classifier(rows, "clean_text", "sentiment", "logistic_regression", c=2.0, max_iter=600)
    return models.predict(model, rows).select("id", "sentiment", "predicted", "score")


@query("model_benchmark")
def model_benchmark(spark, folder):
    return models.model_benchmark(_labelled(spark, folder))


@query("model_predict", f"""WITH {LABELLED}, {naive_bayes_cte('lab', 'sentiment', 'lab', 'clean_text', 's_', max_terms=500)},
pos AS (SELECT id, prob AS up FROM s_prob WHERE label = 'POSITIVE'), neg AS (SELECT id, prob AS down FROM s_prob WHERE label = 'NEGATIVE')
SELECT id, CASE label WHEN 'NEGATIVE' THEN 0 ELSE 1 END AS label_id, label, round(prob, 4) AS score, round(up - down, 4) AS compound
FROM s_best JOIN pos USING (id) JOIN neg USING (id)""")
def model_predict(spark, folder):
    rows = _labelled(spark, folder)
    model = models.fit_classifier(rows, "clean_text", "sentiment", "naive_bayes", max_terms=500)
    return models.class_probabilities(model, rows.select("id", "clean_text")).drop("clean_text")


@query("train_and_report")
def train_and_report(spark, folder):
    path = scratch_path(spark, "model")
    _, report = models.train_and_report(_labelled(spark, folder), "clean_text", "sentiment", path)
    return report


@query("master_toxicity")
def master_toxicity(spark, folder):
    _, report = models.train_and_report(_labelled(spark, folder), "clean_text", "toxic", test_percent=15,
                                        max_terms=4000, c=2.5)
    return report


@query("model_save_load_score")
def model_save_load_score(spark, folder):
    rows, path = _labelled(spark, folder), scratch_path(spark, "model")
    models.save_model(models.fit_classifier(rows, "clean_text", "sentiment", max_terms=2500), path)
    return models.predict(models.load_model(path), rows).select("id", "predicted", "score")


@query("root_cause_clusters")
def root_cause_clusters(spark, folder):
    posts = enrich.with_text_features(comment_documents(spark, folder))
    negatives = posts.where("sentiment = 'NEGATIVE'").select("id", "clean_text")
    return models.root_cause_clusters(materialize(negatives, "negatives"))


# -- enrichment with trained models ------------------------------------------------

ENRICHED = f"""WITH {CDOC}, {LABELLED},
clean AS (SELECT id, {clean_sql(spiced_sql('raw_text', 'id'))} AS clean_text FROM cdoc),
{naive_bayes_cte('lab', 'sentiment', 'clean', 'clean_text', 's_', max_terms=500)},
{naive_bayes_cte('lab', 'toxic', 'clean', 'clean_text', 't_', max_terms=500)},
{sentiment_sql('clean', 'clean_text')}, {TOXIC},
joint AS (SELECT id, clean_text, b.label, b.prob, s.compound AS c, t.is_toxic AS rule, t.toxicity_score, m.prob AS ml
  FROM clean JOIN s_best b USING (id) JOIN scored s USING (id) JOIN toxic t USING (id, clean_text)
  JOIN (SELECT id, prob FROM t_prob WHERE label = '1') m USING (id))
SELECT id, md5(clean_text) AS clean_md5, CASE WHEN abs(c) <= 0.05 THEN 'NEUTRAL' WHEN c >= 0.20 AND label <> 'POSITIVE' THEN 'POSITIVE'
  WHEN c <= -0.20 AND label <> 'NEGATIVE' THEN 'NEGATIVE' ELSE label END AS sentiment, round(prob, 4) AS sentiment_score,
  (rule OR ml >= 0.65)::INT AS is_toxic, least(1.0::DOUBLE, round(greatest(toxicity_score, ml), 4)) AS toxicity_score FROM joint"""


def _scorers(spark, folder):
    """Sentiment and toxicity models of the labelled documents, saved and loaded as a job would do."""
    rows, path = _labelled(spark, folder), scratch_path(spark, "scorers")
    vectorizer = models.fit_tfidf(rows, "clean_text", max_terms=500, sublinear=True, stop_words=ENGLISH_STOP_WORDS)
    for label in ("sentiment", "toxic"):
        fitted = models.fit_classifier(rows, "clean_text", label, "naive_bayes", max_terms=500, vectorizer=vectorizer)
        models.save_scorer(spark, models.linear_scorer(fitted), f"{path}/{label}")
    return [models.load_scorer(spark, f"{path}/{label}") for label in ("sentiment", "toxic")]


def _result(rows):
    return rows.select("id", F.md5("clean_text").alias("clean_md5"), "sentiment", "sentiment_score", "is_toxic", "toxicity_score")


@query("enrich_with_models", ENRICHED)
def enrich_with_models(spark, folder):
    posts = comment_documents(spark, folder).select("id", with_spice("raw_text").alias("raw_text"))
    return _result(enrich.enrich_comments(posts, "raw_text", *_scorers(spark, folder)))


@query("stream_enrich_with_models", ENRICHED)
def stream_enrich_with_models(spark, folder):
    posts = documents_as_posts(spark, folder).select("id", with_spice("raw_text").alias("raw_text"))
    return _result(drained(spark, jobs.enrich(posts, *_scorers(spark, folder)), "enriched"))
