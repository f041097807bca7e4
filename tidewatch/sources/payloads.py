"""Landed platform payloads (API JSON, message pages, feeds) to flat post rows."""

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.text import html_unescape, normalize_handle, squeeze_spaces, strip


def head(text: Column, n: int | None) -> Column:
    """The first ``n`` characters; all without a limit."""
    return text if n is None else F.substring(text, 1, n)


COMMENT_THREADS = """
struct<items: array<struct<snippet: struct<topLevelComment: struct<snippet: struct<
  authorDisplayName: string, textDisplay: string, likeCount: bigint, publishedAt: string>>>>>>
"""


def flatten_comment_threads(df: DataFrame, payload: str, target: str) -> DataFrame:
    """Comment-thread API responses to one row per comment, missing fields defaulted."""
    items = F.from_json(F.col(payload), COMMENT_THREADS)["items"]
    snippet = "item.snippet.topLevelComment.snippet"
    value = lambda name, default: F.coalesce(F.col(f"{snippet}.{name}"), F.lit(default))
    return (df.withColumn("item", F.explode(items))
            .select(*[c for c in df.columns if c not in (payload, target)],
                    F.lit("YouTube").alias("platform"), F.col(target).alias("source_target"),
                    value("authorDisplayName", "User").alias("author"),
                    strip(value("textDisplay", "")).alias("text"),
                    value("likeCount", 0).alias("likes"),
                    value("publishedAt", "").alias("published_at")))


def element_text(html: Column, separator: str = " ") -> Column:
    """Text nodes of an HTML fragment, joined by ``separator``."""
    return html_unescape(F.regexp_replace(html, r"(?s)(?:<[^>]*>)+", separator))


def attribute_of(html: Column, tag: str, attribute: str) -> Column:
    found = F.regexp_extract(html, rf"(?s)<{tag}\b[^>]*\b{attribute}=\"([^\"]*)\"", 1)
    return F.nullif(found, F.lit(""))


def inner_html(html: Column, tag: str, css_class: str | None = None) -> Column:
    """Content of the first ``tag`` (with a class) that does not nest itself; NULL without one."""
    mark = rf"[^>]*class=\"[^\"]*\b{css_class}\b[^\"]*\"" if css_class else ""
    pattern = rf"(?s)<{tag}\b{mark}[^>]*>(.*?)</{tag}>"
    return F.when(html.rlike(pattern), F.regexp_extract(html, pattern, 1))


def last_nodes(df: DataFrame, nodes: Column, n: int | None = None) -> DataFrame:
    """One row per node of each page, or of its last ``n``, in page order.

    Node lists live inside one row, so the cut needs no shuffle.
    """
    kept, skipped = F.col("_nodes"), F.lit(0)
    if n is not None:
        kept = F.slice(kept, F.greatest(F.size("_nodes") - n + 1, F.lit(1)), F.lit(n))
        skipped = F.greatest(F.size("_nodes") - n, F.lit(0))
    return (df.withColumn("_nodes", nodes)
            .select(*df.columns, skipped.alias("_skipped"),
                    F.posexplode(kept).alias("_at", "node"))
            .withColumn("node_no", F.col("_skipped") + F.col("_at"))
            .drop("_skipped", "_at"))


def parse_message_pages(df: DataFrame, html: str, handle: str, n: int | None = None,
                        max_text: int | None = None) -> DataFrame:
    """Public channel pages to one row per message with text."""
    blocks = F.split(F.col(html), r'<div class="[^"]*\btgme_widget_message_wrap\b')
    name = normalize_handle(F.col(handle))
    node = F.col("node")
    author = strip(element_text(inner_html(node, "a", "tgme_widget_message_owner_name"), ""))
    rows = last_nodes(df, F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0))), n)
    text = strip(element_text(inner_html(node, "div", "tgme_widget_message_text")))
    return rows.select(
        *[c for c in df.columns if c not in (html, handle)], "node_no",
        F.lit("Telegram").alias("platform"), F.concat(F.lit("@"), name).alias("source_target"),
        F.coalesce(author, F.concat(F.lit("@"), name)).alias("author"),
        head(text, max_text).alias("text"), F.lit(100).alias("views"),
        F.coalesce(attribute_of(node, "time", "datetime"), F.lit("Recent")).alias("published_at"),
    ).where("text <> ''")


def title_and_content(title: Column, content: Column, max_content: int | None = None,
                      max_text: int | None = None) -> Column:
    """Title, followed by the content when the content is longer."""
    longer = F.char_length(content) > F.char_length(title)
    joined = F.concat(title, F.lit(" - "), head(content, max_content))
    return head(F.when(longer, joined).otherwise(title), max_text)


def parse_feeds(df: DataFrame, xml: str, target: str, n: int | None = None) -> DataFrame:
    """Syndication feeds to one row per entry with text."""
    entries = F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<entry\b[^>]*>(.*?)</entry>"), F.lit(1))
    entry = F.col("entry")
    kept = [c for c in df.columns if c not in (xml, target)]
    # Each step is a projection of its own, so that no step is worked out again for every use of it.
    rows = df.select(*df.columns, F.posexplode(entries if n is None else F.slice(entries, 1, n)).alias("entry_no", "entry"))
    parts = rows.select(*kept, F.col(target).alias("source_target"), "entry_no", inner_html(entry, "title").alias("_title"),
                        inner_html(entry, "content").alias("_content"), inner_html(entry, "author").alias("_author"))
    plain = parts.withColumns({"_title": html_unescape(F.col("_title")), "_content": html_unescape(F.col("_content")),
                               "_author": inner_html(F.col("_author"), "name")})
    texts = plain.withColumns({"_title": F.coalesce(strip(F.col("_title")), F.lit("")),
                               "_content": F.coalesce(element_text(F.col("_content"), ""), F.lit("")),
                               "_author": html_unescape(F.col("_author"))})
    return (texts.select(*kept, "entry_no", F.lit("Reddit").alias("platform"), "source_target",
                         F.coalesce("_author", F.lit("Reddit User")).alias("author"),
                         title_and_content(F.col("_title"), F.col("_content")).alias("text"),
                         F.lit(10).alias("score"), F.lit("Live Feed").alias("published_at"))
            .where("text <> ''"))


def page_paragraphs(df: DataFrame, html: str, n: int | None = None, max_text: int | None = None) -> DataFrame:
    """Paragraphs of web pages, or the last ``n``, as message rows."""
    nodes = F.regexp_extract_all(F.col(html), F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1))
    text = squeeze_spaces(element_text(F.col("node")))
    return (last_nodes(df, nodes, n)
            .withColumn("text", head(text, max_text)).drop("node", html)
            .where("text <> ''"))


def page_title_body(df: DataFrame, html: str) -> DataFrame:
    """Title and article body of web pages, joined like feed entries."""
    title = squeeze_spaces(element_text(inner_html(F.col(html), "title")))
    body = squeeze_spaces(element_text(inner_html(F.col(html), "article")))
    text = title_and_content(F.coalesce(title, F.lit("")), F.coalesce(body, F.lit("")))
    return df.withColumn("text", text).drop(html).where("text <> ''")


def published_time(text: Column) -> Column:
    """Timestamp of an ISO text; free text such as ``Recent`` gives NULL."""
    return F.try_to_timestamp(text)
