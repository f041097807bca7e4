"""Text classifiers and clusters on Spark ML, with scikit-learn style TF-IDF features."""

from pyspark import StorageLevel
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, NaiveBayes, NaiveBayesModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import (
    CountVectorizerModel, ElementwiseProduct, IndexToString, NGram, Normalizer, RegexTokenizer,
    SQLTransformer, StopWordsRemover, StringIndexer, VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from tidewatch.contracts import CLUSTERS, ENGLISH_STOP_WORDS, MAX_TERMS, SEED, STOP_WORDS
from tidewatch.functions.linear import LinearScorer
from tidewatch.functions.scoring import label_from_probabilities
from tidewatch.functions.text import LONG_TOKEN, title_case_theme
from tidewatch.operators.evaluation import accuracy, class_scores, weighted_scores
from tidewatch.operators.ordering import stratified_split, union_all
from tidewatch.operators.profile import beside
from tidewatch.operators.terms import count_vectors, counted_terms, text_vectors
from tidewatch.session import materialize

MAX_VOCABULARY = 1 << 18


class SublinearTf(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable,
                  DefaultParamsWritable):
    """Replace term counts by 1 + ln(count)."""

    def __init__(self, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**{k: v for k, v in (("inputCol", inputCol), ("outputCol", outputCol)) if v})

    def _transform(self, dataset):
        damped = F.transform(vector_to_array(self.getInputCol()),
                             lambda x: F.when(x > 0, 1 + F.ln(x)).otherwise(0.0))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(damped))


def fit_tfidf(df: DataFrame, text: str, id: str = "id", max_terms: int = MAX_TERMS,
              sublinear: bool = False, stop_words=STOP_WORDS) -> PipelineModel:
    """Fit a vectorizer: vocabulary and idf are counted by Spark and kept as stages.

    Only the vocabulary comes back to the driver; ``max_terms`` bounds it.
    """
    return _fit_features(df, [], text, max_terms, sublinear, stop_words)[0]


def _fit_features(df: DataFrame, columns, text: str, max_terms: int, sublinear: bool,
                  stop_words) -> tuple[PipelineModel, DataFrame]:
    """A vectorizer fitted to ``df``, and ``columns`` with its ``features``: texts are split and counted once for both."""
    if max_terms > MAX_VOCABULARY:
        raise ValueError(f"max_terms above {MAX_VOCABULARY}")
    counted, found, idf, _ = counted_terms(df, columns, text, max_terms, stop_words)
    if not found:
        raise ValueError("empty vocabulary")
    counts = CountVectorizerModel.from_vocabulary(found, inputCol="_terms", outputCol="_tf")
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=LONG_TOKEN, gaps=False),
        StopWordsRemover(inputCol="_words", outputCol="_kept", stopWords=list(stop_words),
                         locale="en_US"),
        NGram(n=2, inputCol="_kept", outputCol="_pairs"),
        SQLTransformer(statement="SELECT *, concat(_kept, _pairs) AS _terms FROM __THIS__"),
        counts,
    ]
    tf = "_tf"
    if sublinear:
        stages += [SublinearTf(inputCol="_tf", outputCol="_damped"),
                   VectorAssembler(inputCols=["_damped"], outputCol="_sparse")]
        tf = "_sparse"
    stages += [
        ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol=tf,
                           outputCol="_weighted"),
        Normalizer(p=2.0, inputCol="_weighted", outputCol="features"),
    ]
    return PipelineModel(stages), counted.select(*columns, count_vectors(F.col("_counts"), idf, sublinear).alias("features"))


def _stage(model: PipelineModel, kind):
    return next((s for s in model.stages if isinstance(s, kind)), None)


def vocabulary_of(vectorizer: PipelineModel) -> list[str]:
    return _stage(vectorizer, CountVectorizerModel).vocabulary


def with_features(df: DataFrame, vectorizer: PipelineModel) -> DataFrame:
    """Add the ``features`` of the vectorizer's stages, without their row by row work on lists and dense vectors."""
    idf = _stage(vectorizer, ElementwiseProduct).getScalingVec().toArray().tolist()
    return df.withColumn("features", text_vectors(
        F.col(_stage(vectorizer, RegexTokenizer).getInputCol()), vocabulary_of(vectorizer), idf,
        _stage(vectorizer, SublinearTf) is not None, _stage(vectorizer, StopWordsRemover).getStopWords()))


def _transform(model: PipelineModel, df: DataFrame) -> DataFrame:
    """What the classifier and the label names of a :func:`fit_classifier` pipeline add to ``df``."""
    return PipelineModel(model.stages[-2:]).transform(with_features(df, model))


def naive_bayes(smoothing: float = 1.0) -> NaiveBayes:
    return NaiveBayes(modelType="multinomial", smoothing=smoothing, labelCol="_label")


def logistic_regression(rows: int, c: float = 1.0, max_iter: int = 200) -> LogisticRegression:
    """L2 logistic regression; scikit-learn's C is 1 / (regParam * rows)."""
    return LogisticRegression(regParam=1.0 / (c * max(rows, 1)), elasticNetParam=0.0,
                              maxIter=max_iter, standardization=False, family="multinomial",
                              labelCol="_label")


def fit_classifier(train: DataFrame, text: str, label: str, kind: str = "logistic_regression",
                   id: str = "id", max_terms: int = 2500, sublinear: bool = True, c: float = 1.5,
                   smoothing: float = 0.1, max_iter: int = 500,
                   stop_words=ENGLISH_STOP_WORDS, vectorizer: PipelineModel | None = None) -> PipelineModel:
    """Vectorizer, label index, classifier and label names as one saved pipeline.

    A vectorizer already fitted to ``train`` serves several labels.
    """
    named = train.select(F.col(label).cast("string").alias(label), text)
    if vectorizer:
        features = with_features(named, vectorizer).select(label, "features")
    else:
        vectorizer, features = _fit_features(named, [label], text, max_terms, sublinear, stop_words)
    features = features.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = features.count()
        indexer = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc",
                                handleInvalid="error").fit(features)
        estimator = (naive_bayes(smoothing) if kind == "naive_bayes"
                     else logistic_regression(rows, c, max_iter))
        model = estimator.fit(indexer.transform(features))
    finally:
        features.unpersist()
    names = IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels)
    return PipelineModel([*vectorizer.stages, model, names])


def predict(model: PipelineModel | None, df: DataFrame) -> DataFrame:
    """Add ``predicted`` and its probability ``score``; no model means NEUTRAL at one half."""
    if model is None:
        return df.withColumn("predicted", F.lit("NEUTRAL")).withColumn("score", F.lit(0.5))
    best = F.array_max(vector_to_array("probability"))
    return (_transform(model, df).withColumn("score", F.round(best, 4))
            .select(*df.columns, "predicted", "score"))


def class_probabilities(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add the label, score and compound derived from the class probabilities."""
    labels = model.stages[-1].getLabels()
    return (_transform(model, df)
            .withColumn("result", label_from_probabilities(vector_to_array("probability"), labels))
            .select(*df.columns, "result.*"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | None:
    """The saved model, or None when there is none."""
    try:
        return PipelineModel.load(path)
    except Exception as error:  # Hadoop reports a missing path through Py4J
        if "does not exist" in str(error) or "PATH_NOT_FOUND" in str(error):
            return None
        raise


def linear_scorer(model: PipelineModel | None) -> LinearScorer | None:
    """The numbers of a :func:`fit_classifier` pipeline as column expressions; None without a model.

    Probabilities are those of ``model.transform``, for rows of any table or stream.
    """
    if model is None:
        return None
    naive, logistic = _stage(model, NaiveBayesModel), _stage(model, LogisticRegressionModel)
    if naive:
        matrix, bias = naive.theta, naive.pi
    else:
        matrix, bias = logistic.coefficientMatrix, logistic.interceptVector
    return LinearScorer(
        tuple(_stage(model, IndexToString).getLabels()), tuple(bias.toArray().tolist()), tuple(vocabulary_of(model)),
        tuple(_stage(model, ElementwiseProduct).getScalingVec().toArray().tolist()),
        tuple(map(tuple, matrix.toArray().T.tolist())), _stage(model, SublinearTf) is not None,
        tuple(_stage(model, StopWordsRemover).getStopWords()))


def scorer_table(spark, scorer: LinearScorer) -> DataFrame:
    """The weights as rows (term, label, idf, weight); the constants of the labels have a null term."""
    cells = [(None, label, None, b) for label, b in zip(scorer.labels, scorer.bias)]
    cells += [(term, label, idf, w) for term, idf, row in zip(scorer.terms, scorer.idf, scorer.weights)
              for label, w in zip(scorer.labels, row)]
    return spark.createDataFrame(cells, "term string, label string, idf double, weight double")


def save_scorer(spark, scorer: LinearScorer, path: str) -> None:
    """Weights as Parquet below ``path``, with the settings beside them; replaces what is there."""
    scorer_table(spark, scorer).coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")
    spark.createDataFrame([(list(scorer.labels), scorer.sublinear, list(scorer.stop_words))],
                          "labels array<string>, sublinear boolean, stop_words array<string>").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/settings")


def load_scorer(spark, path: str) -> LinearScorer | None:
    """A saved scorer, or None when there is none: enrichment then falls back to the word rules."""
    try:
        settings = spark.read.parquet(f"{path}/settings").first()
        cells = spark.read.parquet(f"{path}/weights").orderBy("term", "label").collect()
    except Exception as error:  # the reader's error carries its condition in the text
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    column = {label: k for k, label in enumerate(settings.labels)}
    rows, idf = {}, {}
    for cell in cells:
        rows.setdefault(cell.term, [0.0] * len(column))[column[cell.label]] = cell.weight
        idf[cell.term] = cell.idf
    bias = rows.pop(None)
    return LinearScorer(tuple(settings.labels), tuple(bias), tuple(rows), tuple(idf[t] for t in rows),
                        tuple(map(tuple, rows.values())), settings.sublinear, tuple(settings.stop_words))


def _evaluate(name: str, scored: DataFrame, label: str, train_rows) -> DataFrame:
    scored = scored.select(F.col(label).cast("string").alias("actual"), "predicted")
    return beside(accuracy(scored), weighted_scores(scored).drop("support")).select(
        F.lit(name).alias("model"), F.lit(train_rows).alias("train_count"),
        F.col("n").alias("test_count"), "accuracy", "precision", "recall", "f1")


def model_benchmark(df: DataFrame, text: str = "clean_text", label: str = "sentiment",
                    id: str = "id", test_percent: int = 25) -> DataFrame:
    """Naive Bayes against logistic regression on one stratified split."""
    # Read many times by the fits below, so it is written once.
    parts = materialize(stratified_split(df.select(id, text, label), id, test_percent, SEED, label),
                        "split")
    train, test = (parts.where(F.col("split") == side) for side in ("train", "test"))
    rows = train.count()
    results = []
    for name in ("naive_bayes", "logistic_regression"):
        model = fit_classifier(train, text, label, name, id, max_terms=500, sublinear=False,
                               c=1.0, smoothing=1.0, max_iter=200)
        results.append(_evaluate(name, predict(model, test), label, rows))
    return union_all(results)


def train_and_report(df: DataFrame, text: str, label: str, path: str | None = None,
                     id: str = "id", test_percent: int = 20, **options):
    """Split, fit, score the held-out part, save; returns the model and its class report."""
    # Read many times by the fits below, so it is written once.
    parts = materialize(stratified_split(df.select(id, text, label), id, test_percent, SEED, label),
                        "split")
    train, test = (parts.where(F.col("split") == side) for side in ("train", "test"))
    model = fit_classifier(train, text, label, id=id, **options)
    if path:
        save_model(model, path)
    scored = predict(model, test).select(F.col(label).cast("string").alias("actual"), "predicted")
    return model, class_scores(scored)


def root_cause_clusters(df: DataFrame, text: str = "clean_text", id: str = "id",
                        k: int = CLUSTERS, starts: int = 10,
                        max_terms: int = MAX_TERMS) -> DataFrame:
    """Themes of negative texts: the best of ``starts`` k-means runs on TF-IDF vectors."""
    spark = df.sparkSession
    schema = "cluster_id int, theme string, comment_count bigint, top_keywords string"
    if df.limit(k).count() < k:
        return spark.createDataFrame([], schema)
    vectorizer = fit_tfidf(df, text, id, max_terms)
    terms = vocabulary_of(vectorizer)
    # The random starts depend on the order of rows: features are made of ``df``, not of the stored counts.
    features = with_features(df, vectorizer).select("features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        runs = [KMeans(k=k, seed=SEED + start, maxIter=300).fit(features)
                for start in range(starts)]
        best = min(runs, key=lambda run: run.summary.trainingCost)
        sizes = best.summary.clusterSizes
    finally:
        features.unpersist()
    rows = []
    for number, (center, size) in enumerate(zip(best.clusterCenters(), sizes), start=1):
        order = sorted(range(len(terms)), key=lambda i: (-center[i], terms[i]))
        rows.append((number, int(size), [terms[i] for i in order[:4]]))
    found = spark.createDataFrame(rows, "cluster_id int, comment_count bigint, words array<string>")
    return (found.select("cluster_id", title_case_theme(F.col("words")).alias("theme"),
                         "comment_count", F.array_join("words", ", ").alias("top_keywords"))
            .orderBy(F.desc("comment_count"), "cluster_id"))
