"""Scan, sink, store and payload queries."""

from pyspark.sql import functions as F, types as T

from tidewatch.contracts import UPLOAD_TEXT_COLUMN_HINTS
from tidewatch.operators import anomaly, ordering
from tidewatch.operators.ordering import union_all
from tidewatch.plans.dashboard import DAILY, DAILY_SOURCE, evaluate_sql
from tidewatch.plans.registry import (
    CDOC, CEV, CSURGE, comment_documents, comment_events, query, stamp, stamp_sql, surge_events,
    table,
)
from tidewatch.plans.sql import unescape_sql
from tidewatch.session import materialize, scratch_path
from tidewatch.sources import files, payloads, store


@query("scan_csv_roundtrip", f"""WITH {CEV}
SELECT id, platform, author, sentiment, sentiment_score, is_toxic, {stamp_sql('created_at')} AS created_at FROM cev""")
def scan_csv_roundtrip(spark, folder):
    rows = comment_events(spark, folder).withColumn("created_at", stamp("created_at"))
    path = scratch_path(spark, "csv")
    files.write_csv(rows, path)
    return files.read_csv(spark, path, rows.schema)


@query("scan_csv_headerless", r"""SELECT doc_id, lang, md5(regexp_replace(text, '[^\x{00}-\x{FF}]', '?', 'g')) AS text_md5, n_chars FROM documents""")
def scan_csv_headerless(spark, folder):
    """Latin-1 texts, whole, with their quoted line breaks and without a header; letters outside Latin-1 are marked."""
    latin = F.regexp_replace("text", r"[^\x00-\xFF]", "?")
    rows = table(spark, folder, "documents").select("doc_id", "lang", latin.alias("text"), "n_chars")
    path = scratch_path(spark, "latin1")
    files.write_csv(rows, path, header=False, encoding="ISO-8859-1")
    back = files.read_headerless(spark, path, rows.schema, encoding="ISO-8859-1")
    return back.select("doc_id", "lang", F.md5("text").alias("text_md5"), "n_chars")


@query("scan_csv_split", "SELECT doc_id, lang, md5(text) AS text_md5, n_chars FROM documents")
def scan_csv_split(spark, folder):
    """The reader of large files: splits are cut into records, whatever their texts hold between quotes."""
    rows = table(spark, folder, "documents").select("doc_id", "lang", "text", "n_chars")
    path = scratch_path(spark, "csv")
    files.write_csv(rows, path)
    back = files.read_csv(spark, path, rows.schema, split=True)
    return back.select("doc_id", "lang", F.md5("text").alias("text_md5"), "n_chars")


@query("scan_tsv", "SELECT doc_id, quality, toxic FROM labels")
def scan_tsv(spark, folder):
    rows = table(spark, folder, "labels")
    path = scratch_path(spark, "tsv")
    files.write_csv(rows, path, header=False, sep="\t")
    return files.read_headerless(spark, path, rows.schema, sep="\t")


@query("scan_dispatch", """SELECT 'parquet' AS kind, doc_id, quality, toxic FROM labels
UNION ALL SELECT 'csv', doc_id, quality, toxic FROM labels""")
def scan_dispatch(spark, folder):
    rows = table(spark, folder, "labels")
    path = scratch_path(spark, "dispatch")
    files.write_csv(rows, path)
    loaded = {"parquet": files.read_any(spark, f"{folder}/labels.parquet"),
              "csv": files.read_any(spark, path, rows.schema)}
    return union_all([df.select(F.lit(kind).alias("kind"), *rows.columns) for kind, df in loaded.items()])


@query("scan_capped", "SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 500")
def scan_capped(spark, folder):
    """The row-capped scan of the training jobs."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return files.first_rows(docs, 500, "doc_id")


@query("sink_parquet_roundtrip", f"""WITH {CDOC} SELECT id, platform, source_target, md5(raw_text) AS text_md5, sentiment, is_toxic FROM cdoc""")
def sink_parquet_roundtrip(spark, folder):
    path = scratch_path(spark, "corpus") + ".parquet"
    files.write_parquet(comment_documents(spark, folder), path)
    return files.read_any(spark, path).select(
        "id", "platform", "source_target", F.md5("raw_text").alias("text_md5"), "sentiment", "is_toxic")


@query("sink_jsonl_roundtrip", "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations")
def sink_jsonl_roundtrip(spark, folder):
    rows = table(spark, folder, "conversations")
    path = scratch_path(spark, "jsonl")
    files.write_jsonl(rows, path)
    return spark.read.schema(rows.schema).json(path).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


# -- store -----------------------------------------------------------------------

@query("schema_contract", f"""WITH {CEV}
SELECT count(*) AS n_rows, count(id) AS n_id, count(DISTINCT platform) AS n_platforms,
  count(*) FILTER (is_toxic IN (0, 1)) AS n_flags, count(*) AS n_raw_text, count(*) AS n_source_target,
  11 AS n_columns FROM cev""")
def schema_contract(spark, folder):
    """Append to a fresh store and count what its contract promises."""
    root = scratch_path(spark, "store")
    store.create_tables(spark, root)
    store.append_comments(comment_events(spark, folder), root)
    rows = store.read_table(spark, root, "comments")
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("id").alias("n_id"),
        F.countDistinct("platform").alias("n_platforms"),
        F.count_if(F.col("is_toxic").isin(0, 1)).alias("n_flags"), F.count("raw_text").alias("n_raw_text"),
        F.count("source_target").alias("n_source_target"), F.lit(len(rows.columns)).alias("n_columns"))


@query("append_with_defaults", f"""WITH {CEV}
SELECT id, CASE WHEN id % 7 = 0 THEN 'Unknown' ELSE platform END AS platform, 'Stream' AS source_target,
  CASE WHEN id % 5 = 0 THEN 'User' ELSE author END AS author, '' AS raw_text, '' AS clean_text,
  CASE WHEN id % 3 = 0 THEN 'NEUTRAL' ELSE sentiment END AS sentiment,
  CASE WHEN id % 4 = 0 THEN 0.0::DOUBLE ELSE sentiment_score END AS sentiment_score,
  CASE WHEN id % 2 = 0 THEN 0 ELSE is_toxic END AS is_toxic, 0.0::DOUBLE AS toxicity_score,
  {stamp_sql('created_at')} AS created_at FROM cev""")
def append_with_defaults(spark, folder):
    drop = lambda c, n: F.when(F.col("id") % n != 0, F.col(c)).alias(c)
    rows = comment_events(spark, folder).select(
        "id", drop("platform", 7), drop("author", 5), drop("sentiment", 3), drop("sentiment_score", 4),
        drop("is_toxic", 2), "created_at")
    root = scratch_path(spark, "store")
    store.create_tables(spark, root)
    store.append_comments(rows, root)
    return store.read_table(spark, root, "comments").withColumn("created_at", stamp("created_at"))


@query("alert_append_defaults", f"""WITH {CSURGE}, {DAILY_SOURCE}, {evaluate_sql('daily', DAILY)}
SELECT CASE WHEN day LIKE '%-25' THEN 'All' ELSE platform END AS platform, alert_level, z_score, p_value,
  negative_velocity AS negative_ratio, total_comments::INT AS sample_size, '' AS root_causes, day >= '2024-01-27' AS later,
  true AS in_order
FROM evaluated WHERE alert_level <> 'SAFE'""")
def alert_append_defaults(spark, folder):
    """Two appends without ids: every id of the second must be above those of the first."""
    days = surge_events(spark, folder).withColumn("day", F.date_format("created_at", "yyyy-MM-dd"))
    alerts = materialize(store.alert_rows(anomaly.evaluate_window(days, keys=DAILY)), "alerts")
    alerts = alerts.withColumn("platform", F.when(~F.col("day").endswith("-25"), F.col("platform")))
    later = F.col("day") >= "2024-01-27"
    root = scratch_path(spark, "store")
    store.create_tables(spark, root)
    for batch in (~later, later):
        store.append_alerts(alerts.where(batch).withColumn("triggered_at", F.to_timestamp("day")), root)
    stored = store.read_table(spark, root, "crisis_alerts").withColumn(
        "later", F.col("triggered_at") >= F.to_timestamp(F.lit("2024-01-27")))
    first_end = stored.where("not later").select(F.max("id")).scalar()
    return (stored.withColumn("in_order", F.coalesce((F.col("id") > first_end) == F.col("later"), F.lit(True)))
            .drop("id", "triggered_at"))


@query("auto_text_column", """SELECT 'benchmark' AS source, item_id AS id, md5(text) AS text_md5 FROM benchmark
UNION ALL SELECT 'conversations', conv_id * 1000 + turn, md5(text) FROM conversations
UNION ALL SELECT 'pages', page_id, md5(html) FROM pages""")
def auto_text_column(spark, folder):
    sources = {"benchmark": table(spark, folder, "benchmark").withColumnRenamed("text", "TweetText"),
               "conversations": table(spark, folder, "conversations"),
               "pages": table(spark, folder, "pages").withColumnRenamed("html", "Body")}
    ids = {"benchmark": F.col("item_id"), "conversations": F.col("conv_id") * 1000 + F.col("turn"),
           "pages": F.col("page_id")}
    return union_all([
        files.with_text_column(df, hints=UPLOAD_TEXT_COLUMN_HINTS).select(
            F.lit(name).alias("source"), ids[name].alias("id"), F.md5("text").alias("text_md5"))
        for name, df in sources.items()])


# -- payloads --------------------------------------------------------------------

@query("json_payload_flatten", """SELECT event_id, 'YouTube' AS platform, 'video ' || user_id AS source_target,
  CASE WHEN user_id % 5 = 0 THEN 'User' ELSE 'user_' || user_id END AS author, event_type AS text,
  coalesce(CASE WHEN user_id % 3 > 0 THEN json_extract_string(props, '$.k')::BIGINT END, 0) AS likes,
  '' AS published_at FROM events""")
def json_payload_flatten(spark, folder):
    """Events wrapped as API responses with some fields missing, then flattened."""
    user = F.col("user_id")
    snippet = F.struct(
        F.when(user % 5 != 0, F.concat(F.lit("user_"), user.cast("string"))).alias("authorDisplayName"),
        F.concat(F.lit(" "), F.col("event_type"), F.lit("\n")).alias("textDisplay"),
        F.when(user % 3 > 0, F.get_json_object("props", "$.k").cast("bigint")).alias("likeCount"))
    wrapped = F.to_json(F.struct(F.array(F.struct(F.struct(F.struct(
        snippet.alias("snippet")).alias("topLevelComment")).alias("snippet"))).alias("items")))
    rows = table(spark, folder, "events").select(
        "event_id", wrapped.alias("payload"), F.concat(F.lit("video "), user.cast("string")).alias("video"))
    return payloads.flatten_comment_threads(rows, "payload", "video")


def _text_sql(expression: str) -> str:
    """Text of an HTML fragment with single spaces."""
    bare = unescape_sql(f"regexp_replace({expression}, '(?s)(?:<[^>]*>)+', ' ', 'g')")
    return (f"trim(regexp_replace({bare}, "
            f"'[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))")


@query("page_text_extract", f"""WITH n AS (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS nodes FROM pages),
k AS (SELECT page_id, unnest(range(0, len(nodes))) AS node_no, unnest(nodes) AS node, len(nodes) AS total FROM n),
t AS (SELECT page_id, node_no, {_text_sql('node')} AS text FROM k)
SELECT page_id, node_no::INT AS node_no, text FROM t WHERE text <> ''""")
def page_text_extract(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "html")
    return payloads.page_paragraphs(pages, "html")


@query("page_title_body", f"""WITH t AS (SELECT page_id, url,
  {_text_sql("regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)")} AS title,
  {_text_sql("regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1)")} AS body FROM pages)
SELECT page_id, url, CASE WHEN length(body) > length(title) THEN title || ' - ' || body ELSE title END AS text FROM t""")
def page_title_body(spark, folder):
    return payloads.page_title_body(table(spark, folder, "pages"), "html")


def _pages_of_events(spark, folder, item):
    """Twenty events a page, in order of their ids: (page, html)."""
    items = F.array_sort(F.collect_list(F.struct("event_id", item.alias("html"))))
    return (table(spark, folder, "events").groupBy(F.floor(F.col("event_id") / 20).alias("page"))
            .agg(F.array_join(F.transform(items, lambda i: i["html"]), "").alias("html")))


_NUMBERED = """e AS (SELECT *, event_id // 20 AS page, row_number() OVER (PARTITION BY event_id // 20 ORDER BY event_id) - 1 AS nth FROM events)"""


@query("message_pages_parse", f"""WITH {_NUMBERED}
SELECT page, nth::INT AS node_no, 'Telegram' AS platform, '@channel' || page % 10 AS source_target,
  CASE WHEN user_id % 3 = 0 THEN '@channel' || page % 10 ELSE 'User & ' || user_id END AS author,
  event_type || ' <' || props || '>' AS text, 100 AS views,
  CASE WHEN user_id % 4 = 0 THEN 'Recent' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') END AS published_at
FROM e WHERE event_id % 7 > 0""")
def message_pages_parse(spark, folder):
    """Channel pages made of events; some messages lack a text, an author or a time."""
    user = F.col("user_id")
    message = F.concat(
        F.lit('<div class="tgme_widget_message_wrap js-widget">'),
        F.when(user % 3 == 0, "").otherwise(F.concat(
            F.lit('<a class="tgme_widget_message_owner_name" href="#"><span>User &amp; '), user.cast("string"), F.lit("</span></a>"))),
        F.when(F.col("event_id") % 7 == 0, "").otherwise(F.concat(
            F.lit('<div class="tgme_widget_message_text js">'), "event_type", F.lit("<br/>&lt;"), "props", F.lit("&gt;</div>"))),
        F.when(user % 4 == 0, "").otherwise(F.concat(
            F.lit('<time datetime="'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('+00:00">x</time>'))),
        F.lit("</div>"))
    pages = _pages_of_events(spark, folder, message).withColumn(
        "handle", F.concat(F.lit("https://t.me/channel"), (F.col("page") % 10).cast("string")))
    return payloads.parse_message_pages(pages, "html", "handle")


@query("feeds_parse", f"""WITH {_NUMBERED}
SELECT page, nth::INT AS entry_no, 'Reddit' AS platform, 'r/feed' || page % 5 AS source_target,
  CASE WHEN user_id % 3 = 0 THEN 'Reddit User' ELSE '/u/' || user_id END AS author,
  CASE WHEN user_id % 4 = 0 THEN event_type || ' &' ELSE event_type || ' & - ' || props || ' & more' END AS text,
  10 AS score, 'Live Feed' AS published_at FROM e""")
def feeds_parse(spark, folder):
    """Syndication feeds made of events; some entries lack an author or have a content shorter than the title."""
    user = F.col("user_id")
    entry = F.concat(
        F.lit("<entry>"),
        F.when(user % 3 == 0, "").otherwise(F.concat(F.lit("<author><name>/u/"), user.cast("string"), F.lit("</name></author>"))),
        F.lit("<title>"), "event_type", F.lit(' &amp;</title><content type="html">'),
        F.when(user % 4 == 0, "x").otherwise(F.concat(F.lit("&lt;p&gt;"), "props", F.lit(" &amp;amp; more&lt;/p&gt;"))),
        F.lit("</content></entry>"))
    feeds = _pages_of_events(spark, folder, entry).withColumn(
        "target", F.concat(F.lit("r/feed"), (F.col("page") % 5).cast("string")))
    return payloads.parse_feeds(feeds, "html", "target")
