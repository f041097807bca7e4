"""Label normalisation, corpus building, splits and evaluation queries."""

from pyspark.sql import functions as F

from tidewatch.contracts import CHAT_EXPLANATION, CHAT_SYSTEM_PROMPT, PROFANE_WORDS, SEVERE_WORDS
from tidewatch.functions import labels as L, scoring
from tidewatch.functions.text import clean_text
from tidewatch.operators import corpus, evaluation, ordering
from tidewatch.plans.registry import CDOC, CEV, comment_documents, comment_events, query, table
from tidewatch.plans.sql import clean_sql, has_word_sql, strip_sql

# -- label maps ------------------------------------------------------------------


@query("label_map_binary", """SELECT doc_id, CASE quality WHEN 0 THEN 'NEGATIVE' WHEN 1 THEN 'POSITIVE' END AS sentiment FROM labels""")
def label_map_binary(spark, folder):
    return table(spark, folder, "labels").select("doc_id", L.map_label(F.col("quality"), L.BINARY).alias("sentiment"))


@query("label_map_ternary", """SELECT vec_id, CASE label WHEN 0 THEN 'NEGATIVE' WHEN 1 THEN 'NEUTRAL' WHEN 2 THEN 'POSITIVE' END AS sentiment FROM embeddings""")
def label_map_ternary(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", L.map_label(F.col("label"), L.TERNARY).alias("sentiment"))


@query("label_map_sent140", """SELECT l_orderkey, l_linenumber, l_partkey,
  CASE l_linenumber WHEN 0 THEN 'NEGATIVE' WHEN 2 THEN 'NEUTRAL' WHEN 4 THEN 'POSITIVE' END AS mapped,
  CASE l_linenumber WHEN 0 THEN 'NEGATIVE' WHEN 2 THEN 'NEUTRAL' WHEN 4 THEN 'POSITIVE' ELSE 'NEUTRAL' END AS defaulted
FROM lineitem""")
def label_map_sent140(spark, folder):
    number = F.col("l_linenumber")
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", L.map_label(number, L.FIVE_POINT).alias("mapped"),
        L.map_label(number, L.FIVE_POINT, "NEUTRAL").alias("defaulted"))


@query("label_bucket_stars", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 5 <= 1 THEN 'NEGATIVE'
  WHEN l_linenumber % 5 = 2 THEN 'NEUTRAL' ELSE 'POSITIVE' END AS sentiment FROM lineitem""")
def label_bucket_stars(spark, folder):
    stars = F.col("l_linenumber") % 5
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", L.stars_to_sentiment(stars).alias("sentiment"))


@query("label_bucket_score", """WITH s AS (SELECT event_id, CASE WHEN event_type = 'signup' THEN 'n/a'
  ELSE json_extract_string(props, '$.k') END AS k FROM events)
SELECT event_id, CASE WHEN try_cast(k AS BIGINT) >= 15 THEN 'POSITIVE' WHEN try_cast(k AS BIGINT) <= 2 THEN 'NEGATIVE'
  ELSE 'NEUTRAL' END AS sentiment FROM s""")
def label_bucket_score(spark, folder):
    score = F.when(F.col("event_type") == "signup", "n/a").otherwise(F.get_json_object("props", "$.k"))
    return table(spark, folder, "events").select("event_id", L.score_to_sentiment(score).alias("sentiment"))


@query("label_map_casefold", """WITH s AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'Positive' WHEN 'error' THEN 'NEGATIVE'
  WHEN 'view' THEN 'irrelevant' WHEN 'click' THEN 'neutral' ELSE event_type END AS l FROM events)
SELECT event_id, CASE lower(l) WHEN 'positive' THEN 'POSITIVE' WHEN 'negative' THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS sentiment FROM s""")
def label_map_casefold(spark, folder):
    kind = F.col("event_type")
    label = (F.when(kind == "purchase", "Positive").when(kind == "error", "NEGATIVE")
             .when(kind == "view", "irrelevant").when(kind == "click", "neutral").otherwise(kind))
    return table(spark, folder, "events").select("event_id", L.map_name(label).alias("sentiment"))


@query("label_index", f"""WITH {CEV},
i AS (SELECT sentiment, (row_number() OVER (ORDER BY sentiment) - 1)::INT AS label_id FROM (SELECT DISTINCT sentiment FROM cev))
SELECT id, sentiment, label_id FROM cev JOIN i USING (sentiment)""")
def label_index(spark, folder):
    rows = comment_events(spark, folder).select("id", "sentiment")
    return corpus.with_label_id(rows, "sentiment").select("id", "sentiment", "label_id")


@query("train_guard", f"""WITH {CDOC}
SELECT count(*) AS rows_in, count(DISTINCT sentiment) AS classes, CASE WHEN count(*) < 20 THEN 'Insufficient data for ML training'
  WHEN count(DISTINCT sentiment) < 2 THEN 'Requires at least 2 distinct classes' ELSE 'OK' END AS status FROM cdoc""")
def train_guard(spark, folder):
    return corpus.train_guard(comment_documents(spark, folder))


# -- unions ----------------------------------------------------------------------

UNION_SQL = """u AS (
  SELECT 0 AS rank, 'documents' AS source, d.doc_id AS id, d.text,
    CASE l.quality WHEN 0 THEN 'NEGATIVE' WHEN 1 THEN 'POSITIVE' END AS sentiment
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  UNION ALL SELECT 1, 'conversations', conv_id * 1000 + turn, text,
    CASE WHEN turn % 5 <= 1 THEN 'NEGATIVE' WHEN turn % 5 = 2 THEN 'NEUTRAL' ELSE 'POSITIVE' END FROM conversations
  UNION ALL SELECT 2, 'benchmark', item_id, text,
    CASE WHEN item_id >= 15 THEN 'POSITIVE' WHEN item_id <= 2 THEN 'NEGATIVE' ELSE 'NEUTRAL' END FROM benchmark),
kept AS (SELECT * FROM u WHERE text IS NOT NULL AND sentiment IN ('POSITIVE', 'NEGATIVE', 'NEUTRAL'))"""


def _sentiment_sources(spark, folder):
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    talk, items = table(spark, folder, "conversations"), table(spark, folder, "benchmark")
    return [
        corpus.source_frame(docs, "documents", F.col("doc_id"), F.col("text"),
                            sentiment=L.map_label(F.col("quality"), L.BINARY)),
        corpus.source_frame(talk, "conversations", F.col("conv_id") * 1000 + F.col("turn"), F.col("text"),
                            sentiment=L.stars_to_sentiment(F.col("turn") % 5)),
        corpus.source_frame(items, "benchmark", F.col("item_id"), F.col("text"),
                            sentiment=L.score_to_sentiment(F.col("item_id").cast("string"))),
    ]


def _digest(df):
    return df.withColumn("text_md5", F.md5("text")).drop("text")


@query("corpus_union", f"WITH {UNION_SQL} SELECT source, id, sentiment, md5(text) AS text_md5 FROM kept WHERE length({strip_sql('text')}) > 3")
def corpus_union(spark, folder):
    merged = ordering.union_all(_sentiment_sources(spark, folder))
    kept = corpus.long_enough(corpus.known_sentiments(merged))
    return _digest(kept).select("source", "id", "sentiment", "text_md5")


@query("corpus_union_distinct", f"""WITH {UNION_SQL},
d AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY rank, id) AS rn FROM kept WHERE length({strip_sql('text')}) > 3)
SELECT source, id, sentiment, md5(text) AS text_md5 FROM d WHERE rn = 1""")
def corpus_union_distinct(spark, folder):
    ranked = [f.withColumn("rank", F.lit(i)) for i, f in enumerate(_sentiment_sources(spark, folder))]
    kept = corpus.long_enough(corpus.known_sentiments(ordering.union_all(ranked)))
    first = ordering.keep_first(kept, "text", ["rank", "id"])
    return _digest(first).select("source", "id", "sentiment", "text_md5")


@query("corpus_source_counts", f"""WITH {UNION_SQL} SELECT source, count(*) AS n FROM kept GROUP BY source""")
def corpus_source_counts(spark, folder):
    return corpus.source_counts(ordering.union_all(_sentiment_sources(spark, folder)))


@query("corpus_sentiment_build", f"""WITH {UNION_SQL},
d AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY rank, id) AS rn FROM kept WHERE length({strip_sql('text')}) > 3)
SELECT source, id, sentiment, md5(text) AS text_md5,
  row_number() OVER (ORDER BY md5('42-' || rank || '-' || id), rank || '-' || id) AS pos FROM d WHERE rn = 1""")
def corpus_sentiment_build(spark, folder):
    names = ("documents", "conversations", "benchmark")
    frames = list(zip(names, _sentiment_sources(spark, folder)))
    built = corpus.build_corpus(frames)
    return _digest(built).select("source", "id", "sentiment", "text_md5", "pos")


TOXIC_SQL = """t AS (
  SELECT 0 AS rank, 'documents' AS source, d.doc_id AS id, d.text, (l.toxic::DOUBLE >= 0.5)::INT AS is_toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  UNION ALL SELECT 1, 'conversations', conv_id * 1000 + turn, text, (turn % 3 <> 2)::INT FROM conversations
  UNION ALL SELECT 2, 'benchmark', item_id, text, (item_id % 2)::INT FROM benchmark)"""


def _toxicity_sources(spark, folder):
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    talk, items = table(spark, folder, "conversations"), table(spark, folder, "benchmark")
    return [
        corpus.source_frame(docs, "documents", F.col("doc_id"), F.col("text"),
                            is_toxic=L.flag_from_score(F.col("toxic").cast("double"))),
        corpus.source_frame(talk, "conversations", F.col("conv_id") * 1000 + F.col("turn"), F.col("text"),
                            is_toxic=L.flag_from_class(F.col("turn") % 3)),
        corpus.source_frame(items, "benchmark", F.col("item_id"), F.col("text"),
                            is_toxic=(F.col("item_id") % 2).cast("int")),
    ]


@query("corpus_toxicity_union", f"""WITH {TOXIC_SQL},
d AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY rank, id) AS rn FROM t WHERE length({strip_sql('text')}) > 3)
SELECT source, id, is_toxic, md5(text) AS text_md5,
  row_number() OVER (ORDER BY md5('42-' || rank || '-' || id), rank || '-' || id) AS pos FROM d WHERE rn = 1""")
def corpus_toxicity_union(spark, folder):
    names = ("documents", "conversations", "benchmark")
    built = corpus.build_corpus(list(zip(names, _toxicity_sources(spark, folder))))
    return _digest(built).select("source", "id", "is_toxic", "text_md5", "pos")


@query("master_corpus", f"""WITH {UNION_SQL}, c AS (SELECT source, id, sentiment, {clean_sql('text')} AS clean_text FROM kept)
SELECT source, id, sentiment, md5(clean_text) AS clean_md5 FROM c WHERE length(clean_text) > 3""")
def master_corpus(spark, folder):
    built = corpus.master_corpus(_sentiment_sources(spark, folder))
    return built.select("source", "id", "sentiment", F.md5("clean_text").alias("clean_md5"))


# -- sampling and splits -----------------------------------------------------------

@query("sample_capped", """SELECT doc_id, source, rn AS sample_rank FROM (SELECT doc_id, source, row_number()
  OVER (PARTITION BY source ORDER BY md5('42-' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 30""")
def sample_capped(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return ordering.sample_capped(docs, 30, "doc_id", 42, ["source"])


@query("seeded_shuffle", "SELECT doc_id, row_number() OVER (ORDER BY md5('42-' || doc_id), doc_id) AS pos FROM labels")
def seeded_shuffle(spark, folder):
    return ordering.seeded_shuffle(table(spark, folder, "labels").select("doc_id"), "doc_id", 42)


SPLIT_SQL = """ranked AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42-' || doc_id), doc_id) AS rn,
  count(*) OVER (PARTITION BY quality) AS n FROM labels)"""


@query("stratified_split", f"""WITH {SPLIT_SQL}
SELECT doc_id, quality, CASE WHEN rn <= (n * 25 + 99) // 100 THEN 'test' ELSE 'train' END AS split FROM ranked""")
def stratified_split(spark, folder):
    rows = table(spark, folder, "labels").select("doc_id", "quality")
    return ordering.stratified_split(rows, "doc_id", 25, 42, "quality")


@query("split_disjoint", f"""WITH {SPLIT_SQL}, s AS (SELECT *, rn <= (n * 15 + 99) // 100 AS is_test FROM ranked)
SELECT quality, count(*) AS n, count(*) FILTER (is_test) AS n_test, count(*) FILTER (NOT is_test) AS n_train,
  0::BIGINT AS n_both FROM s GROUP BY quality""")
def split_disjoint(spark, folder):
    """Per stratum: part sizes, and ids that landed in both parts (none)."""
    rows = table(spark, folder, "labels").select("doc_id", "quality")
    split = ordering.stratified_split(rows, "doc_id", 15, 42, "quality")
    sides = split.groupBy("quality", "doc_id").agg(
        F.count_if(F.col("split") == "test").alias("t"), F.count_if(F.col("split") == "train").alias("r"))
    return sides.groupBy("quality").agg(
        F.sum(F.col("t") + F.col("r")).alias("n"), F.sum("t").alias("n_test"), F.sum("r").alias("n_train"),
        F.count_if((F.col("t") > 0) & (F.col("r") > 0)).alias("n_both"))


# -- chat examples -----------------------------------------------------------------

_PROMPT = CHAT_SYSTEM_PROMPT.replace("'", "''")


def _answer_sql(sentiment: str, toxic: str, kind: str) -> str:
    return (f"""'{{"sentiment": "' || {sentiment} || '", "is_toxic": ' || {toxic} || ', "toxicity_type": "' || {kind} || """
            f"""'", "sarcasm": false, "explanation": "{CHAT_EXPLANATION}"}}'""")


@query("chat_examples", f"""WITH {UNION_SQL}, {TOXIC_SQL},
m AS (SELECT source || '/mood' AS source, id, text, {_answer_sql('sentiment', "'false'", "'NONE'")} AS answer FROM kept
  UNION ALL SELECT source || '/toxic', id, text, {_answer_sql("CASE is_toxic WHEN 1 THEN 'NEGATIVE' ELSE 'NEUTRAL' END",
    "CASE is_toxic WHEN 1 THEN 'true' ELSE 'false' END", "CASE is_toxic WHEN 1 THEN 'HARASSMENT' ELSE 'NONE' END")} FROM t)
SELECT source, id, '{_PROMPT}' AS system_content, md5('Post: ' || text) AS user_md5, answer FROM m""")
def chat_examples(spark, folder):
    frames = [f.withColumn("source", F.concat("source", F.lit("/mood"))) for f in _sentiment_sources(spark, folder)]
    frames += [f.withColumn("source", F.concat("source", F.lit("/toxic"))) for f in _toxicity_sources(spark, folder)]
    rows = corpus.chat_examples(frames)
    content = lambda i: F.col("messages")[i]["content"]
    return rows.select("source", "id", content(0).alias("system_content"),
                       F.md5(content(1)).alias("user_md5"), content(2).alias("answer"))


# -- evaluation --------------------------------------------------------------------

_RULE = f"({has_word_sql('clean_text', SEVERE_WORDS)} OR {has_word_sql('clean_text', PROFANE_WORDS)})::INT"
PREDICTED = f"""pred AS (SELECT l.toxic AS actual, {_RULE} AS predicted
  FROM (SELECT doc_id, {clean_sql('text')} AS clean_text FROM documents) d JOIN labels l USING (doc_id))"""


def _predictions(spark, folder):
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    flagged = docs.withColumn("t", scoring.toxicity_rules(clean_text(F.col("text"))))
    return flagged.select(F.col("toxic").alias("actual"), F.col("t.is_toxic").cast("int").alias("predicted"))


@query("classification_accuracy", f"WITH {PREDICTED} SELECT count(*) AS n, round(avg((actual = predicted)::INT), 4) AS accuracy FROM pred")
def classification_accuracy(spark, folder):
    return evaluation.accuracy(_predictions(spark, folder))


CLASS_SQL = f"""{PREDICTED},
cls AS (SELECT actual AS label FROM pred UNION SELECT predicted FROM pred),
sc AS (SELECT label, (SELECT count(*) FROM pred WHERE actual = label) AS support,
  (SELECT count(*) FROM pred WHERE predicted = label) AS np,
  (SELECT count(*) FROM pred WHERE actual = label AND predicted = label) AS tp FROM cls),
pr AS (SELECT label, support, coalesce(tp / nullif(np, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r FROM sc),
f AS (SELECT label, support, p, r, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM pr)"""


@query("classification_weighted_prf", f"""WITH {CLASS_SQL}
SELECT round(sum(p * support) / sum(support), 4) AS precision, round(sum(r * support) / sum(support), 4) AS recall,
  round(sum(f1 * support) / sum(support), 4) AS f1, sum(support)::BIGINT AS support FROM f""")
def classification_weighted_prf(spark, folder):
    return evaluation.weighted_scores(_predictions(spark, folder))


@query("classification_report", f"""WITH {CLASS_SQL}
SELECT label::VARCHAR AS label, round(p, 4) AS precision, round(r, 4) AS recall, round(f1, 4) AS f1, support FROM f
UNION ALL SELECT 'macro avg', round(avg(p), 4), round(avg(r), 4), round(avg(f1), 4), sum(support)::BIGINT FROM f
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 4), round(sum(r * support) / sum(support), 4),
  round(sum(f1 * support) / sum(support), 4), sum(support)::BIGINT FROM f""")
def classification_report(spark, folder):
    return evaluation.classification_report(_predictions(spark, folder))


@query("confusion_matrix", f"""WITH {PREDICTED}, cls AS (SELECT actual AS label FROM pred UNION SELECT predicted FROM pred)
SELECT a.label AS actual, p.label AS predicted,
  (SELECT count(*) FROM pred WHERE actual = a.label AND predicted = p.label) AS n FROM cls a CROSS JOIN cls p""")
def confusion_matrix(spark, folder):
    return evaluation.confusion_matrix(_predictions(spark, folder))


@query("best_run", """WITH runs AS (SELECT l_linenumber AS run, avg(l_discount) AS loss, avg(l_tax) AS f1 FROM lineitem GROUP BY l_linenumber)
SELECT (SELECT run FROM runs ORDER BY f1 DESC, run LIMIT 1) AS best_run, round(max(f1), 4) AS best_f1,
  round(avg(loss), 4) AS mean_loss FROM runs""")
def best_run(spark, folder):
    """Line numbers stand for runs, with their mean discount as loss and mean tax as F1."""
    runs = (table(spark, folder, "lineitem").groupBy(F.col("l_linenumber").alias("run"))
            .agg(F.avg("l_discount").alias("loss"), F.avg("l_tax").alias("f1")))
    return evaluation.best_run(runs)
