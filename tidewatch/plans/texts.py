"""Cleaning, extraction, scoring and term-mining queries."""

from pyspark.sql import functions as F

from tidewatch.contracts import (
    AFTER_BUT, BEFORE_BUT, BOOST, BOOST_BY_DISTANCE, CAPITALS, CRISIS_KEYWORDS, DIMINISHERS, EMOJI_WORDS, EXCLAMATION,
    INTENSIFIERS, MANY_QUESTIONS, NEGATED, NEGATIONS, PROFANE_WORDS, QUESTION, SENTIMENT_WEIGHTS, SEVERE_WORDS,
)
from tidewatch.functions import scoring, text as X
from tidewatch.operators import enrich, ordering, rollup, terms
from tidewatch.plans.registry import (
    CDOC, CEV, comment_documents, comment_events, query, stamp, stamp_sql, table, words_sql,
)
from tidewatch.plans.sql import (
    clean_sql, content_tokens_sql, has_word_sql, regex_remove, strip_sql, terms_cte, tfidf_cte,
    tokens_sql, unescape_sql,
)
from tidewatch.session import materialize, scratch_path
from tidewatch.sources import files, store, upload

PLATFORM = ["platform"]
CLEAN = f"{CDOC},\nclean AS (SELECT *, {clean_sql('raw_text')} AS clean_text FROM cdoc)"


def _clean_documents(spark, folder):
    return enrich.with_text_features(comment_documents(spark, folder))


def _stored(rows, *columns):
    """Clean texts as an ingest job would have stored them: mining reads them more than once."""
    return materialize(rows.select("id", *columns, "clean_text"), "clean")


# -- cleaning --------------------------------------------------------------------

@query("clean_text", f"WITH {CLEAN} SELECT id, clean_text FROM clean")
def clean_text(spark, folder):
    return _clean_documents(spark, folder).select("id", "clean_text")


@query("html_unescape", f"""SELECT page_id, md5({unescape_sql('html')}) AS text_md5,
  length({unescape_sql('html')}) AS n_chars FROM pages""")
def html_unescape(spark, folder):
    text = X.html_unescape(F.col("html"))
    return (table(spark, folder, "pages").withColumn("t", text)
            .select("page_id", F.md5("t").alias("text_md5"),
                    F.char_length("t").cast("bigint").alias("n_chars")))


def _emoji_sql(expression: str) -> str:
    for emoji, word in EMOJI_WORDS:
        expression = f"replace({expression}, '{emoji}', '{word}')"
    return expression


_MARKS = [emoji for emoji, _ in EMOJI_WORDS]


@query("emoji_to_word", f"""SELECT event_id, {_emoji_sql("event_type || ([" + words_sql(_MARKS) + "])[(event_id % 13 + 1)::INT] || '!'")} AS text
FROM events""")
def emoji_to_word(spark, folder):
    """Every event's type followed by one of the mapped emoji."""
    marks = F.array(*[F.lit(m) for m in _MARKS])
    mark = F.element_at(marks, (F.col("event_id") % 13 + 1).cast("int"))
    text = X.emoji_to_words(F.concat("event_type", mark, F.lit("!")))
    return table(spark, folder, "events").select("event_id", text.alias("text"))


@query("strip_urls", f"""SELECT page_id, {regex_remove("'see ' || url || ' and www.' || split_part(url, '/', 3) || ' now'", X.URL)} AS text
FROM pages""")
def strip_urls(spark, folder):
    host = F.split_part("url", F.lit("/"), F.lit(3))
    text = F.concat(F.lit("see "), "url", F.lit(" and www."), host, F.lit(" now"))
    return table(spark, folder, "pages").select("page_id", X.strip_urls(text).alias("text"))


@query("text_features", f"""WITH {CLEAN}
SELECT id, length(raw_text)::INT AS char_length,
  CASE WHEN clean_text = '' THEN 0 ELSE len(string_split(clean_text, ' ')) END::INT AS word_count FROM clean""")
def text_features(spark, folder):
    return _clean_documents(spark, folder).select("id", "char_length", "word_count")


@query("clean_table", f"""WITH first AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn
  FROM documents WHERE text IS NOT NULL AND {strip_sql('text')} <> ''),
c AS (SELECT doc_id, lang, text, {clean_sql('text')} AS clean_text FROM first WHERE rn = 1)
SELECT doc_id, lang, md5(clean_text) AS clean_md5, length(text)::INT AS char_length,
  len(string_split(clean_text, ' '))::INT AS word_count FROM c WHERE clean_text <> ''""")
def clean_table(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    return enrich.clean_table(docs, "text", "doc_id").select(
        "doc_id", "lang", F.md5("clean_text").alias("clean_md5"), "char_length", "word_count")


@query("dedup_keep_first", """SELECT doc_id, source, md5(text) AS text_md5 FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def dedup_keep_first(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return ordering.keep_first(docs, "text", "doc_id").select(
        "doc_id", "source", F.md5("text").alias("text_md5"))


@query("duplicate_count", """SELECT count(*) AS rows_in, count(DISTINCT text) AS distinct_rows,
  count(*) - count(DISTINCT text) AS duplicates FROM documents""")
def duplicate_count(spark, folder):
    return ordering.duplicate_count(table(spark, folder, "documents"), "text")


@query("negative_pool", f"""WITH {CLEAN}
SELECT id, md5(clean_text) AS clean_md5 FROM clean WHERE sentiment = 'NEGATIVE'""")
def negative_pool(spark, folder):
    pool = rollup.negative_texts(_clean_documents(spark, folder))
    return pool.select("id", F.md5("clean_text").alias("clean_md5"))


# -- extraction and links --------------------------------------------------------

@query("feed_excerpt", f"""WITH {CLEAN}
SELECT id, substr(raw_text, 1, 500) AS post, substr(raw_text, 1, 300) AS content,
  substr(clean_text, 1, 70) || '...' AS feed_line FROM clean""")
def feed_excerpt(spark, folder):
    return _clean_documents(spark, folder).select(
        "id", X.excerpt(F.col("raw_text"), 500).alias("post"),
        X.excerpt(F.col("raw_text"), 300).alias("content"),
        X.excerpt(F.col("clean_text"), 70, "...").alias("feed_line"))


@query("concat_title_body", f"""SELECT page_id, doc_id, md5({strip_sql("coalesce(CASE WHEN page_id % 2 = 0 THEN url END, '') || ' ' || coalesce(text, '')")}) AS text_md5
FROM pages JOIN documents ON page_id = doc_id""")
def concat_title_body(spark, folder):
    pages, docs = table(spark, folder, "pages"), table(spark, folder, "documents")
    title = F.when(F.col("page_id") % 2 == 0, F.col("url"))
    joined = pages.select("page_id", "url").join(docs, F.col("page_id") == F.col("doc_id"))
    return joined.select("page_id", "doc_id",
                         F.md5(X.join_title_body(title, F.col("text"))).alias("text_md5"))


@query("word_set", f"""WITH {CLEAN}
SELECT id, len(list_distinct({tokens_sql('clean_text')}))::INT AS n_words,
  md5(array_to_string(list_sort(list_distinct({tokens_sql('clean_text')})), ' ')) AS words_md5 FROM clean""")
def word_set(spark, folder):
    words = F.array_sort(X.word_set(F.col("clean_text")))
    return (_clean_documents(spark, folder).withColumn("w", words)
            .select("id", F.size("w").alias("n_words"),
                    F.md5(F.array_join("w", " ")).alias("words_md5")))


# Links of every known shape, made from each page's number.
_ID_SQL = "substr(md5(page_id::VARCHAR), 1, 11)"


@query("extract_video_id", f"""WITH l AS (SELECT page_id, url, {_ID_SQL} AS v FROM pages),
links AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN v WHEN 1 THEN 'https://www.youtube.com/watch?v=' || v || '&t=4'
  WHEN 2 THEN 'https://youtu.be/' || v WHEN 3 THEN 'https://www.youtube.com/embed/' || v
  WHEN 4 THEN 'https://www.youtube.com/shorts/' || v || '?x=1' ELSE url END AS link FROM l)
SELECT page_id, CASE WHEN regexp_full_match(link, '[a-zA-Z0-9_-]{{11}}') THEN link
  ELSE coalesce(nullif(regexp_extract(link, '(?:v=|/)([0-9A-Za-z_-]{{11}})', 1), ''), link) END AS video_id FROM links""")
def extract_video_id(spark, folder):
    number, v = F.col("page_id") % 6, F.substring(F.md5(F.col("page_id").cast("string")), 1, 11)
    link = (F.when(number == 0, v)
            .when(number == 1, F.concat(F.lit("https://www.youtube.com/watch?v="), v, F.lit("&t=4")))
            .when(number == 2, F.concat(F.lit("https://youtu.be/"), v))
            .when(number == 3, F.concat(F.lit("https://www.youtube.com/embed/"), v))
            .when(number == 4, F.concat(F.lit("https://www.youtube.com/shorts/"), v, F.lit("?x=1")))
            .otherwise(F.col("url")))
    return table(spark, folder, "pages").select("page_id", X.extract_video_id(link).alias("video_id"))


@query("canonical_url", """SELECT page_id, rtrim(split_part(url, '?', 1), '/') AS url,
  rtrim(split_part(url || '/reddit.com/?s=1', '?', 1), '/') || '.rss' AS feed,
  'https://www.youtube.com/watch?v=' || page_id AS watch FROM pages""")
def canonical_url(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", X.canonical_url(F.col("url")).alias("url"),
        X.feed_url(F.concat("url", F.lit("/reddit.com/?s=1"))).alias("feed"),
        X.watch_url(F.col("page_id").cast("string")).alias("watch"))


@query("normalize_handle", f"""WITH {CEV}
SELECT id, author AS handle, CASE id % 3 WHEN 0 THEN '#' || author ELSE '@' || author END AS target FROM cev""")
def normalize_handle(spark, folder):
    number, author = F.col("id") % 4, F.col("author")
    raw = (F.when(number == 0, F.concat(F.lit(" @"), author))
           .when(number == 1, F.concat(F.lit("https://t.me/"), author, F.lit("/12")))
           .when(number == 2, F.concat(F.lit("t.me/"), author)).otherwise(author))
    query_text = (F.when(F.col("id") % 3 == 0, F.concat(F.lit("#"), author))
                  .when(F.col("id") % 3 == 1, F.concat(F.lit("@"), author))
                  .otherwise(F.concat(author, F.lit(" "))))
    return comment_events(spark, folder).select(
        "id", X.normalize_handle(raw).alias("handle"), X.normalize_target(query_text).alias("target"))


@query("crisis_keyword_flag", f"""WITH t AS (SELECT event_id, event_type || ' of @Acme' ||
  ([{words_sql([w.title() for w in CRISIS_KEYWORDS] + ['fine', 'ok'])}])[(event_id % 10 + 1)::INT] AS text FROM events)
SELECT event_id, {" OR ".join(f"contains(lower(text), '{w}')" for w in CRISIS_KEYWORDS)} AS is_crisis FROM t""")
def crisis_keyword_flag(spark, folder):
    words = F.array(*[F.lit(w) for w in [w.title() for w in CRISIS_KEYWORDS] + ["fine", "ok"]])
    word = F.element_at(words, (F.col("event_id") % 10 + 1).cast("int"))
    text = F.concat("event_type", F.lit(" of @Acme"), word)
    return table(spark, folder, "events").select("event_id", X.crisis_keyword_flag(text).alias("is_crisis"))


@query("crisis_keyword_documents", f"""SELECT doc_id, {" OR ".join(f"contains(lower(text), '{w}')" for w in CRISIS_KEYWORDS)} AS is_crisis
FROM documents""")
def crisis_keyword_documents(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", X.crisis_keyword_flag(F.col("text")).alias("is_crisis"))


@query("event_time_offset", f"""WITH {CEV}
SELECT id, {stamp_sql("TIMESTAMP '2024-01-01 00:00:00' + to_seconds(id * 25)")} AS created_at FROM cev""")
def event_time_offset(spark, folder):
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    time = F.timestamp_add("SECOND", F.col("id") * 25, base)
    return comment_events(spark, folder).select("id", stamp(time).alias("created_at"))


@query("last_n_per_source", """SELECT conv_id, turn, role FROM (SELECT *, row_number()
  OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 2""")
def last_n_per_source(spark, folder):
    rows = ordering.latest(table(spark, folder, "conversations"), 2, ["conv_id"], "turn")
    return rows.select("conv_id", "turn", "role")


# -- sentiment and toxicity ------------------------------------------------------

_W = SENTIMENT_WEIGHTS
_VALENCE = ("CASE w " + " ".join(f"WHEN '{w}' THEN {v}::DOUBLE" for w, v in _W.items()) + " END")
# Spiced texts: every document is followed by two lexicon words chosen by its number.
_SPICE = list(_W) + ["fine", "service", "again"]


def spiced_sql(text: str, id: str) -> str:
    return (f"{text} || ' ' || ([{words_sql(_SPICE)}])[({id} % 20 + 1)::INT] || ' ' || "
            f"([{words_sql(_SPICE)}])[({id} // 20 % 20 + 1)::INT]")


def with_spice(text: str, id: str = "id") -> F.Column:
    spice = F.array(*[F.lit(w) for w in _SPICE])
    pick = lambda n: F.element_at(spice, (n % 20 + 1).cast("int"))
    return F.concat_ws(" ", text, pick(F.col(id)), pick(F.floor(F.col(id) / 20)))



def sentiment_sql(source: str, text: str) -> str:
    return f"""tok AS (SELECT id, unnest({tokens_sql(text)}) AS w FROM {source}),
val AS (SELECT id, {_VALENCE} AS v FROM tok),
sums AS (SELECT id, coalesce(sum(v), 0) AS total, coalesce(sum(v + 1) FILTER (v > 0), 0) AS pos,
  coalesce(sum(v - 1) FILTER (v < 0), 0) AS neg, count(*) FILTER (v IS NULL) AS neu FROM val GROUP BY id),
polar AS (SELECT id, total / sqrt(total * total + 15) AS c, pos, neg, neu, nullif(pos + abs(neg) + neu, 0) AS size FROM sums),
scored AS (SELECT id, CASE WHEN c >= 0.05 THEN 'POSITIVE' WHEN c <= -0.05 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS label,
  least(1.0::DOUBLE, greatest(0.1::DOUBLE, round(CASE WHEN c >= 0.05 THEN round(coalesce(pos / size, 0), 3) + 0.1::DOUBLE
    WHEN c <= -0.05 THEN round(coalesce(abs(neg) / size, 0), 3) + 0.1::DOUBLE
    ELSE round(coalesce(neu / size, 0), 3) END, 4))) AS score,
  round(c, 4) AS compound FROM polar)"""


SPICED = f"{CLEAN},\nspiced AS (SELECT id, {spiced_sql('clean_text', 'id')} AS t FROM clean)"


def _spiced(spark, folder):
    return _clean_documents(spark, folder).select("id", with_spice("clean_text").alias("t"))


@query("lexicon_sentiment", f"WITH {SPICED}, {sentiment_sql('spiced', 't')} SELECT id, label, score, compound FROM scored")
def lexicon_sentiment(spark, folder):
    rows = _spiced(spark, folder).withColumn("s", scoring.lexicon_sentiment(F.col("t")))
    return rows.select("id", "s.*")


# Talk around lexicon words, chosen by the number of the document: negation, degree, capitals, contrast, emphasis.
_LEADS = ["not", "very", "never so", "VERY", "slightly", "it", "isn't really", "extremely", "smooth but", "hardly a"]
_ENDS = ["", "!", "!!", "?", "???", "?????", "!!!!!!", " but refund", " BUT never flawless!"]


def _talk_sql() -> str:
    words = words_sql([w.upper() if k % 4 == 3 else w for k, w in enumerate(_W)])
    leads, ends = words_sql(_LEADS), words_sql(_ENDS)
    return (f"clean_text || ' ' || ([{leads}])[(id % {len(_LEADS)} + 1)::INT] || ' ' || ([{words}])[(id // 3 % {len(_W)} + 1)::INT] || "
            f"([{ends}])[(id // 7 % {len(_ENDS)} + 1)::INT]")


def _talk():
    pick = lambda items, n: F.element_at(F.array(*[F.lit(x) for x in items]), (F.floor(n) % len(items) + 1).cast("int"))
    words = [w.upper() if k % 4 == 3 else w for k, w in enumerate(_W)]
    return F.concat("clean_text", F.lit(" "), pick(_LEADS, F.col("id")), F.lit(" "), pick(words, F.col("id") / 3), pick(_ENDS, F.col("id") / 7))


_VALENCE_OF = lambda w: "CASE " + w + " " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in _W.items()) + " END"
_BOOST_OF = lambda w: (f"CASE WHEN {w} IN ({words_sql(INTENSIFIERS)}) THEN {BOOST}::DOUBLE "  # noqa: E731
                       f"WHEN {w} IN ({words_sql(DIMINISHERS)}) THEN -{BOOST}::DOUBLE END")
_LOUD = lambda w: f"(mixed AND upper({w}) = {w} AND lower({w}) <> {w})::INT * {CAPITALS}::DOUBLE"


def rules_sql(source: str, text: str) -> str:
    """``scored`` (id, label, score, compound) by windows over word positions."""
    lags = ", ".join(f"lag(w, {k}) OVER p AS w{k}" for k in (1, 2, 3))
    boosts = " + ".join(
        f"coalesce(CASE WHEN {_VALENCE_OF(f'lower(w{k})')} IS NULL THEN sign(v) * {reach}::DOUBLE * ({_BOOST_OF(f'lower(w{k})')} "
        f"+ sign({_BOOST_OF(f'lower(w{k})')}) * {_LOUD(f'w{k}')}) END, 0)" for k, reach in enumerate(BOOST_BY_DISTANCE, start=1))
    negated = " OR ".join(f"coalesce(lower(w{k}) IN ({words_sql(NEGATIONS)}), false)" for k in (1, 2, 3))
    return f"""said AS (SELECT id, {text} AS t, regexp_extract_all({text}, '{scoring.SPOKEN_WORD.replace("'", "''")}') AS ws FROM {source}),
tok AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, list_position(list_transform(ws, lambda x: lower(x)), 'but') AS b,
  len(list_filter(ws, lambda x: upper(x) <> x)) > 0 AS mixed FROM said),
near AS (SELECT *, {_VALENCE_OF('lower(w)')} AS v, {lags} FROM tok WINDOW p AS (PARTITION BY id ORDER BY i)),
val AS (SELECT id, coalesce((v + sign(v) * {_LOUD('w')} + {boosts}) * CASE WHEN {negated} THEN {NEGATED}::DOUBLE ELSE 1 END
  * CASE WHEN coalesce(b, 0) = 0 OR b = i THEN 1 WHEN i < b THEN {BEFORE_BUT}::DOUBLE ELSE {AFTER_BUT}::DOUBLE END, 0) AS v FROM near),
raw AS (SELECT id, sum(v) AS total, coalesce(sum(v + 1) FILTER (v > 0), 0) AS pos, coalesce(sum(v - 1) FILTER (v < 0), 0) AS neg,
  count(*) FILTER (v = 0) AS neu FROM val GROUP BY id),
mark AS (SELECT id, length(t) - length(replace(t, '!', '')) AS x, length(t) - length(replace(t, '?', '')) AS q FROM said),
sums AS (SELECT id, pos, neg, neu, total, least(x, 4) * {EXCLAMATION}::DOUBLE
  + CASE WHEN q > 3 THEN {MANY_QUESTIONS}::DOUBLE WHEN q > 1 THEN q * {QUESTION}::DOUBLE ELSE 0 END AS e FROM raw JOIN mark USING (id)),
moved AS (SELECT id, total + sign(total) * e AS total, pos + (pos + neg > 0)::INT * e AS pos, neg - (pos + neg < 0)::INT * e AS neg, neu FROM sums),
polar AS (SELECT id, total / sqrt(total * total + 15) AS c, pos, neg, neu, nullif(pos + abs(neg) + neu, 0) AS size FROM moved),
scored AS (SELECT id, CASE WHEN c >= 0.05 THEN 'POSITIVE' WHEN c <= -0.05 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS label,
  least(1.0::DOUBLE, greatest(0.1::DOUBLE, round(CASE WHEN c >= 0.05 THEN round(coalesce(pos / size, 0), 3) + 0.1::DOUBLE
    WHEN c <= -0.05 THEN round(coalesce(abs(neg) / size, 0), 3) + 0.1::DOUBLE
    ELSE round(coalesce(neu / size, 0), 3) END, 4))) AS score, round(c, 4) AS compound FROM polar)"""


@query("lexicon_sentiment_rules", f"""WITH {CLEAN}, talk AS (SELECT id, {_talk_sql()} AS t FROM clean), {rules_sql('talk', 't')}
SELECT id, label, score, compound FROM scored""")
def lexicon_sentiment_rules(spark, folder):
    rows = _clean_documents(spark, folder).select("id", _talk().alias("t"))
    return rows.withColumn("s", scoring.lexicon_sentiment_rules(F.col("t"))).select("id", "s.*")


@query("lexicon_sentiment_join", f"WITH {SPICED}, {sentiment_sql('spiced', 't')} SELECT id, label, score, compound FROM scored")
def lexicon_sentiment_join(spark, folder):
    lexicon = spark.createDataFrame(list(SENTIMENT_WEIGHTS.items()), "word string, weight double")
    return enrich.lexicon_sentiment_join(_spiced(spark, folder), F.broadcast(lexicon), "t")


@query("sentiment_consensus", f"""WITH {CEV},
m AS (SELECT id, sentiment AS label, is_toxic * 0.3::DOUBLE + 0.6::DOUBLE AS p, (sentiment_score - 50) / 50 AS c FROM cev)
SELECT id, CASE WHEN abs(c) <= 0.05 THEN 'NEUTRAL' WHEN c >= 0.20 AND label <> 'POSITIVE' THEN 'POSITIVE'
  WHEN c <= -0.20 AND label <> 'NEGATIVE' THEN 'NEGATIVE' ELSE label END AS label,
  round(p, 4) AS score, round(c, 4) AS compound FROM m""")
def sentiment_consensus(spark, folder):
    confidence = F.col("is_toxic") * 0.3 + 0.6
    blended = scoring.consensus(F.col("sentiment"), confidence, (F.col("sentiment_score") - 50) / 50)
    return comment_events(spark, folder).withColumn("s", blended).select("id", "s.*")


_SEVERE, _PROFANE = has_word_sql("clean_text", SEVERE_WORDS), has_word_sql("clean_text", PROFANE_WORDS)
TOXIC = f"""flags AS (SELECT id, clean_text, {_SEVERE} AS sev, {_PROFANE} AS pro FROM clean),
toxic AS (SELECT id, clean_text, sev OR pro AS is_toxic,
  least(1.0::DOUBLE, round(CASE WHEN sev THEN 0.7::DOUBLE ELSE 0 END + CASE WHEN pro THEN 0.45::DOUBLE ELSE 0 END, 4)) AS toxicity_score,
  concat_ws(',', CASE WHEN pro THEN 'PROFANITY' END, CASE WHEN sev THEN 'THREAT_SEVERE' END) AS categories FROM flags)"""


@query("toxicity_rules", f"WITH {CLEAN}, {TOXIC} SELECT id, is_toxic, toxicity_score, categories FROM toxic")
def toxicity_rules(spark, folder):
    rows = _clean_documents(spark, folder).withColumn("t", scoring.toxicity_rules(F.col("clean_text")))
    return rows.select("id", "t.is_toxic", "t.toxicity_score",
                       F.array_join("t.categories", ",").alias("categories"))


@query("toxicity_rules_en", f"""WITH {CDOC},
clean AS (SELECT doc_id AS id, {clean_sql('text')} AS clean_text FROM documents WHERE lang = 'en'), {TOXIC}
SELECT id, is_toxic, toxicity_score, categories FROM toxic""")
def toxicity_rules_en(spark, folder):
    """English word lists on English posts only."""
    docs = table(spark, folder, "documents").where("lang = 'en'")
    rows = docs.select(F.col("doc_id").alias("id"), X.clean_text(F.col("text")).alias("clean_text"))
    scored = rows.withColumn("t", scoring.toxicity_rules(F.col("clean_text")))
    return scored.select("id", "t.is_toxic", "t.toxicity_score",
                         F.array_join("t.categories", ",").alias("categories"))


@query("toxicity_profile_ml", f"""WITH {CLEAN},
f AS (SELECT id, {_SEVERE} AS sev, (n_chars % 100) / 100 AS ml FROM clean)
SELECT id, sev OR ml >= 0.5 AS is_toxic, least(1.0::DOUBLE, round(greatest(CASE WHEN sev THEN 0.9::DOUBLE ELSE 0 END, ml), 4)) AS toxicity_score,
  CASE WHEN sev THEN 'THREAT_SEVERE' WHEN ml >= 0.8 THEN 'TOXIC_HIGH_CONFIDENCE' WHEN ml >= 0.5 THEN 'TOXIC_LANGUAGE' ELSE '' END AS categories FROM f""")
def toxicity_profile_ml(spark, folder):
    ml = F.col("n_chars") % 100 / 100
    scored = _clean_documents(spark, folder).withColumn(
        "t", scoring.toxicity_model_profile(F.col("clean_text"), ml))
    return scored.select("id", "t.is_toxic", "t.toxicity_score",
                         F.array_join("t.categories", ",").alias("categories"))


ALL_WORDS = [w for w in SEVERE_WORDS + PROFANE_WORDS if " " not in w]


@query("toxic_docs_semi", f"WITH {CLEAN} SELECT id FROM clean WHERE {has_word_sql('clean_text', ALL_WORDS)}")
def toxic_docs_semi(spark, folder):
    return enrich.containing(_stored(_clean_documents(spark, folder)), ALL_WORDS).select("id")


@query("clean_docs_anti", f"WITH {CLEAN} SELECT id FROM clean WHERE NOT {has_word_sql('clean_text', ALL_WORDS)}")
def clean_docs_anti(spark, folder):
    return enrich.not_containing(_stored(_clean_documents(spark, folder)), ALL_WORDS).select("id")


@query("prob_vector_label", """WITH v AS (SELECT vec_id, generate_subscripts(embedding, 1) AS place, round(abs(unnest(embedding))::DOUBLE, 6)::DECIMAL(18, 6) AS x FROM embeddings),
p AS (SELECT vec_id, [sum(x) FILTER (place % 3 = 1)::DOUBLE, sum(x) FILTER (place % 3 = 2)::DOUBLE, sum(x) FILTER (place % 3 = 0)::DOUBLE] AS a FROM v GROUP BY vec_id),
q AS (SELECT vec_id, list_transform(a, lambda x: x / list_sum(a)) AS p FROM p)
SELECT vec_id, (list_position(p, list_max(p)) - 1)::INT AS label_id,
  (['NEGATIVE', 'NEUTRAL', 'POSITIVE'])[list_position(p, list_max(p))] AS label,
  round(list_max(p), 4) AS score, round(p[3] - p[1], 4) AS compound FROM q""")
def prob_vector_label(spark, folder):
    """Three scores from all dimensions: every third one is summed, in exact decimals."""
    sizes = F.transform("embedding", lambda x: F.round(F.abs(x).cast("double"), 6).cast("decimal(18,6)"))
    zero = F.lit(0).cast("decimal(38,6)")

    def every_third(k):
        mine = F.filter(sizes, lambda x, i: i % 3 == k)
        return F.aggregate(mine, zero, lambda acc, x: (acc + x).cast("decimal(38,6)")).cast("double")

    first = F.array(*[every_third(k) for k in range(3)])
    total = F.aggregate("a", F.lit(0.0), lambda acc, x: acc + x)
    rows = (table(spark, folder, "embeddings").select("vec_id", first.alias("a"))
            .select("vec_id", F.transform("a", lambda x: x / total).alias("p")))
    result = scoring.label_from_probabilities(F.col("p"), ["NEGATIVE", "NEUTRAL", "POSITIVE"])
    return rows.select("vec_id", result.alias("r")).select("vec_id", "r.*")


@query("softmax_array", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: exp((x - list_max(embedding))::DOUBLE)) AS p FROM embeddings)
SELECT vec_id, generate_subscripts(p, 1)::INT AS position, round(unnest(p) / list_sum(p), 6) AS probability FROM e""")
def softmax_array(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", scoring.softmax(F.col("embedding")).alias("p"))
    return (rows.select("vec_id", F.posexplode("p").alias("at", "v"))
            .select("vec_id", (F.col("at") + 1).alias("position"), F.round("v", 6).alias("probability")))


@query("enrich_comments", f"""WITH {CLEAN}, {sentiment_sql('clean', 'clean_text')}, {TOXIC}
SELECT c.id, c.platform, c.source_target, md5(c.clean_text) AS clean_md5,
  CASE WHEN c.clean_text = '' THEN 'NEUTRAL' ELSE coalesce(s.label, 'NEUTRAL') END AS sentiment,
  CASE WHEN c.clean_text = '' THEN 0.5 ELSE coalesce(s.score, 0.1) END AS sentiment_score,
  t.is_toxic::INT AS is_toxic, t.toxicity_score
FROM clean c JOIN toxic t USING (id) LEFT JOIN scored s USING (id)""")
def enrich_comments(spark, folder):
    posts = comment_documents(spark, folder).drop("sentiment", "is_toxic")
    return enrich.enrich_comments(posts).select(
        "id", "platform", "source_target", F.md5("clean_text").alias("clean_md5"), "sentiment",
        "sentiment_score", "is_toxic", "toxicity_score")


# -- term mining -----------------------------------------------------------------

@query("stopword_filter", f"""WITH {CLEAN}
SELECT id, array_to_string({content_tokens_sql('clean_text')}, ' ') AS kept FROM clean""")
def stopword_filter(spark, folder):
    kept = F.array_join(X.content_tokens(F.col("clean_text")), " ")
    return _clean_documents(spark, folder).select("id", kept.alias("kept"))


@query("bigram_counts", f"""WITH {CLEAN}, {terms_cte('clean', 'clean_text')}
SELECT term, count(*) AS n FROM occ WHERE contains(term, ' ') GROUP BY term""")
def bigram_counts(spark, folder):
    return terms.bigram_counts(_clean_documents(spark, folder))


@query("tfidf_terms", f"""WITH {CLEAN}, {tfidf_cte('clean', 'clean_text')}
SELECT id, term, tf, round(idf, 6) AS idf, round(tfidf, 6) AS tfidf FROM weights""")
def tfidf_terms(spark, folder):
    rows = terms.tfidf(_stored(_clean_documents(spark, folder)))
    return rows.select("id", "term", "tf", F.round("idf", 6).alias("idf"), F.round("tfidf", 6).alias("tfidf"))


@query("tfidf_sublinear", f"""WITH {CLEAN}, {tfidf_cte('clean', 'clean_text', max_terms=2500, sublinear=True)}
SELECT id, term, round(tfidf, 6) AS tfidf FROM weights""")
def tfidf_sublinear(spark, folder):
    rows = terms.tfidf(_stored(_clean_documents(spark, folder)), max_terms=2500, sublinear=True)
    return rows.select("id", "term", F.round("tfidf", 6).alias("tfidf"))


NEGATIVES = f"{CLEAN},\nneg AS (SELECT * FROM clean WHERE sentiment = 'NEGATIVE')"


@query("top_culprits", f"""WITH {NEGATIVES}, {tfidf_cte('neg', 'clean_text')},
s AS (SELECT term, sum(tfidf) AS score FROM weights WHERE documents >= 2 GROUP BY term ORDER BY score DESC, term LIMIT 8)
SELECT term, round(score, 3) AS tfidf_score, contains(term, ' ') AS is_bigram FROM s WHERE score > 0.01""")
def top_culprits(spark, folder):
    return terms.top_culprits(_stored(rollup.negative_texts(_clean_documents(spark, folder))), n=8)


@query("top_culprits_by_platform", f"""WITH {NEGATIVES}, {tfidf_cte('neg', 'clean_text', keys=PLATFORM)},
s AS (SELECT platform, term, sum(tfidf) AS score FROM weights WHERE documents >= 2 GROUP BY platform, term),
r AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY score DESC, term) AS rn FROM s)
SELECT platform, term, round(score, 3) AS tfidf_score, contains(term, ' ') AS is_bigram FROM r WHERE rn <= 5 AND score > 0.01""")
def top_culprits_by_platform(spark, folder):
    negatives = _clean_documents(spark, folder).where("sentiment = 'NEGATIVE'")
    return terms.top_culprits(_stored(negatives, "platform"), n=5, keys=PLATFORM)


@query("upload_import", f"""WITH first AS (SELECT text, min(doc_id) AS id, arg_min(lang, doc_id) AS platform FROM documents
  WHERE text IS NOT NULL AND {strip_sql('text')} <> '' GROUP BY text),
clean AS (SELECT id, text, platform, {clean_sql('text')} AS clean_text FROM first), {sentiment_sql('clean', 'clean_text')}, {TOXIC}
SELECT 'upload.csv' AS source_target, coalesce(c.platform, 'External CSV') AS platform, 'User' AS author, md5(c.text) AS text_md5,
  md5(c.clean_text) AS clean_md5, coalesce(s.label, 'NEUTRAL') AS sentiment, coalesce(s.score, 0.1) AS sentiment_score,
  t.is_toxic::INT AS is_toxic, t.toxicity_score, (SELECT count(*) FROM clean WHERE clean_text <> '') AS ids
FROM clean c JOIN toxic t USING (id) LEFT JOIN scored s USING (id) WHERE c.clean_text <> ''""")
def upload_import(spark, folder):
    """Documents as an uploaded file: found text column, cleaned, scored and appended with consecutive ids."""
    docs = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("platform"), F.col("text").alias("Post_Body"))
    root = scratch_path(spark, "upload")
    path = f"{root}/upload.csv"
    files.write_csv(docs, path)
    upload.import_csv(spark, path, root, docs.schema, order=["doc_id"])
    stored = store.read_table(spark, root, "comments")
    ids = stored.agg((F.max("id") - F.min("id") + 1).alias("ids")).scalar()
    return stored.select("source_target", "platform", "author", F.md5("raw_text").alias("text_md5"), F.md5("clean_text").alias("clean_md5"),
                         "sentiment", "sentiment_score", "is_toxic", "toxicity_score", ids.alias("ids"))
