import json
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidewatch.session import scratch_path, scratch_root
from tidewatch.sources import files, ledger, payloads, store, upload


def test_csv_keeps_odd_text(spark):
    rows = [(1, 'quote " and, comma'), (2, "line\nbreak"), (3, " spaced "), (4, None), (5, "back\\slash"), (6, "é😍")]
    df = spark.createDataFrame(rows, "id int, text string")
    path = scratch_path(spark, "csv")
    files.write_csv(df, path)
    assert sorted(map(tuple, files.read_csv(spark, path, df.schema).collect())) == rows
    assert files.read_csv(spark, path).schema["id"].dataType.simpleString() == "int"


def csv_text(rows, header, newline):
    quoted = lambda v: "" if v is None else '"' + v.replace('"', '""') + '"' if any(c in v for c in '",\r\n') or v == "" else v
    lines = [",".join([str(i), quoted(t), quoted(u)]) for i, t, u in rows]
    return newline.join((["id,text,more"] if header else []) + lines) + newline


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
@pytest.mark.parametrize("header", [True, False])
def test_large_csv_is_split_between_tasks(spark, tmp_path, header, newline):
    rng = random.Random(3)
    pieces = ["plain", 'quote " and, comma', "line\nbreak", "\n\n", 'ends with "', '"', "windows\r\nbreak", "é😍", "a,b\n\"c\"\n,,d"]
    everything = []
    for seed in range(3):
        rows = []
        for i in range(300):
            text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 6)))
            if i % 97 == 50:
                text = "long\n" * 900 + '""' * 50  # spans several splits
            rows.append((1000 * seed + i, text, rng.choice([None, "x", 'y "\n'])))
        everything += rows
        (tmp_path / f"part{seed}.csv").write_bytes((csv_text(rows, header, newline) + newline).encode())
    path, schema = str(tmp_path), "id int, text string, more string"
    read = (lambda **k: files.read_csv(spark, path, schema, **k)) if header else (lambda **k: files.read_headerless(spark, path, schema, **k))
    want = sorted(map(str, spark.createDataFrame(everything, schema).collect()))
    if newline == "\n":  # the reader of whole files rewrites the quoted line breaks of Windows files
        assert sorted(map(str, read(split=False).collect())) == want
    assert len(want) == 900 and sorted(map(str, read(split=True).collect())) == want
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (997, 4001, 20011):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            df = read()
            assert df.rdd.getNumPartitions() > 3
            assert sorted(map(str, df.collect())) == want
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_split_csv_without_rows_and_with_bad_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    assert files.read_headerless(spark, str(tmp_path), "id int, t string", split=True).count() == 0
    (tmp_path / "b.csv").write_text("id,t\n")
    assert files.read_csv(spark, str(tmp_path / "b.csv"), "id int, t string", split=True).count() == 0
    (tmp_path / "c.csv").write_text('1,"x\ny"\nnone,z\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_headerless(spark, str(tmp_path / "c.csv"), "id int, t string", split=True).collect()


def test_headerless_and_dispatch(spark):
    df = spark.createDataFrame([(1, "naïve"), (2, "b")], "id int, text string")
    for sep, encoding, cut in ((",", "ISO-8859-1", None), ("\t", "UTF-8", None), (",", "ISO-8859-1", True), ("\t", "UTF-8", True)):
        path = scratch_path(spark, "plain")
        files.write_csv(df, path, header=False, sep=sep, encoding=encoding)
        assert sorted(map(tuple, files.read_headerless(spark, path, df.schema, sep, encoding, split=cut).collect())) == [(1, "naïve"), (2, "b")]
    path = scratch_path(spark, "t") + ".parquet"
    files.write_parquet(df, path)
    assert files.read_any(spark, path).count() == 2
    assert files.read_if_present(spark, path + "-absent") is None
    assert files.first_present(spark, "/nowhere/x.csv", path).count() == 2
    assert files.first_present(spark, "/nowhere/x.csv") is None
    assert [r.id for r in files.first_rows(df, 1, F.desc("id")).collect()] == [2]
    assert files.first_rows(df, None).count() == 2


def test_text_column_pick(spark):
    df = spark.createDataFrame([(1, "x", "y")], "id int, MyTweetText string, body string")
    assert files.pick_text_column(df) == "MyTweetText" and files.pick_text_column(df, "body") == "body"
    assert files.with_text_column(df).columns == ["id", "text", "body"]
    with pytest.raises(ValueError):
        files.pick_text_column(df.select("id", "body"))
    assert files.pick_text_column(df.select("id", "body"), hints=files.TEXT_COLUMN_HINTS + ("body",)) == "body"


def test_jsonl(spark):
    df = spark.createDataFrame([(1, [("user", "é")])], "id int, messages array<struct<role:string,content:string>>")
    path = scratch_path(spark, "jsonl")
    files.write_jsonl(df, path, "messages")
    line = spark.read.text(path).first().value
    assert json.loads(line) == {"messages": [{"role": "user", "content": "é"}]}


def test_comment_threads(spark):
    snippet = lambda **kw: {"snippet": {"topLevelComment": {"snippet": kw}}}
    payload = json.dumps({"items": [
        snippet(authorDisplayName="Ann", textDisplay=" hi ", likeCount=3, publishedAt="2024-01-01T00:00:00Z"),
        snippet(textDisplay="bare")]})
    df = spark.createDataFrame([(payload, "u"), ("{}", "v")], "p string, t string")
    got = payloads.flatten_comment_threads(df, "p", "t").collect()
    assert [(r.author, r.text, r.likes, r.published_at) for r in got] == [
        ("Ann", "hi", 3, "2024-01-01T00:00:00Z"), ("User", "bare", 0, "")]


MESSAGE = ('<div class="tgme_widget_message_wrap js-x"><div class="inner">{owner}{text}'
           '<a class="d"><time datetime="2024-05-0{n}T10:00:00+00:00">x</time></a></div></div>')


def test_message_pages(spark):
    owner = '<a class="tgme_widget_message_owner_name" href="#"><span dir="auto">News &amp; Co</span></a>'
    body = '<div class="tgme_widget_message_text js" dir="auto">{}</div>'
    page = "<html>" + "".join([
        MESSAGE.format(owner=owner, text=body.format("old"), n=1),
        MESSAGE.format(owner=owner, text=body.format("One<br/>two <b>three</b> &lt;ok&gt;"), n=2),
        MESSAGE.format(owner="", text=body.format("x" * 600), n=3),
        MESSAGE.format(owner=owner, text="", n=4)]) + "</html>"
    df = spark.createDataFrame([(7, page, "https://t.me/chan/5"), (8, "<html></html>", "@none")], "page int, html string, handle string")
    got = payloads.parse_message_pages(df, "html", "handle", 3, max_text=500).orderBy("node_no").collect()
    assert [(r.page, r.node_no, r.author, r.source_target) for r in got] == [(7, 1, "News & Co", "@chan"), (7, 2, "@chan", "@chan")]
    assert got[0].text == "One two  three  <ok>" and len(got[1].text) == 500
    assert got[0].published_at == "2024-05-02T10:00:00+00:00"


def test_feeds(spark):
    entry = "<entry><author><name>/u/a</name></author><title>{}</title><content type=\"html\">{}</content></entry>"
    feed = "<feed>" + entry.format("Short", "&lt;p&gt;A much longer &amp;amp; body&lt;/p&gt;") + \
        entry.format("A long title indeed", "x") + "<entry><title>Lonely</title></entry></feed>"
    df = spark.createDataFrame([(feed, "r/x")], "xml string, target string")
    got = payloads.parse_feeds(df, "xml", "target").orderBy("entry_no").collect()
    assert [r.text for r in got] == ["Short - A much longer & body", "A long title indeed", "Lonely"]
    assert [r.author for r in got] == ["/u/a", "/u/a", "Reddit User"]


def test_published_time(spark):
    df = spark.createDataFrame([("2024-05-02T10:00:00+00:00",), ("Recent",)], "t string")
    got = [r.o for r in df.select(payloads.published_time(F.col("t")).alias("o")).collect()]
    assert got[0] is not None and got[1] is None


def test_store(spark):
    root = scratch_path(spark, "store")
    store.create_tables(spark, root)
    assert store.read_table(spark, root, "comments").count() == 0
    df = spark.createDataFrame([(1, "Reddit", None), (2, "YouTube", True), (3, "Reddit", False)], "id int, platform string, is_toxic boolean")
    store.append_comments(df, root)
    rows = store.read_table(spark, root, "comments")
    assert rows.columns == store.TABLES["comments"].fieldNames()
    assert [(r.id, r.is_toxic, r.sentiment, r.author) for r in rows.orderBy("id").collect()] == [
        (1, 0, "NEUTRAL", "User"), (2, 1, "NEUTRAL", "User"), (3, 0, "NEUTRAL", "User")]
    assert rows.where("created_at is null").count() == 0
    assert [r.id for r in store.recent_comments(rows, 1, "Reddit").collect()] == [3]
    store.append_alerts(spark.createDataFrame([(9, "CRITICAL")], "id int, alert_level string"), root)
    alert = store.recent_alerts(store.read_table(spark, root, "crisis_alerts")).first()
    assert (alert.platform, alert.p_value, alert.root_causes) == ("All", 1.0, "")
    store.register_tables(spark, root)
    assert spark.sql("select count(*) n from comments").first().n == 3
    store.clear_all(spark, root)
    assert store.read_table(spark, root, "comments").count() == 0


def test_ids_are_dense_and_never_given_twice(spark):
    root = scratch_path(spark, "store")
    store.create_tables(spark, root)
    ids = lambda: sorted(r.id for r in store.read_table(spark, root, "comments").select("id").collect())
    make = lambda n, parts=3: spark.range(n).select(F.lit("Reddit").alias("platform"), F.col("id").cast("double").alias("sentiment_score")).repartition(parts)
    store.append_comments(make(10), root)
    store.append_comments(make(7), root, "a", 0)
    store.append_comments(make(5), root, "b", 0)
    store.append_comments(make(7), root, "a", 0)
    assert ids() == list(range(22))
    store.append_comments(make(0), root, "a", 1)
    store.append_comments(spark.createDataFrame([(40, "x"), (31, "y")], "id int, platform string"), root)
    store.append_comments(make(3, 1), root, "b", 1)
    store.append_comments(make(3, 1), root, "b", 1)
    assert ids() == [*range(22), 31, 40, 41, 42, 43]
    # A batch that is run again with other rows takes new numbers; those of its first run stay unused.
    store.append_comments(make(4, 1), root, "b", 1)
    assert ids() == [*range(22), 31, 40, 44, 45, 46, 47]
    rows = store.read_table(spark, root, "comments").where("id >= 44").orderBy("id").collect()
    assert [r.sentiment_score for r in rows] == [0.0, 1.0, 2.0, 3.0]
    store.clear_all(spark, root)
    store.append_comments(make(2), root)
    assert ids() == [0, 1]


def test_tables_older_than_their_ledger_go_on_above_their_ids(spark):
    for first in ("numbered", "unnumbered"):
        root = scratch_path(spark, "store")
        rows = spark.createDataFrame([(5, "x"), (900, "y")], "id bigint, platform string")
        store.conform_comments(rows).write.parquet(f"{root}/comments")
        if first == "numbered":
            store.append_comments(rows.where("id = 5").withColumn("id", F.lit(7)), root)
        store.append_comments(rows.drop("id"), root)
        assert {r.id for r in store.read_table(spark, root, "comments").collect()} >= {900, 901, 902}


def test_many_writers_get_ranges_of_their_own(spark):
    path = scratch_path(spark, "ledger")
    with ThreadPoolExecutor(6) as pool:
        starts = list(pool.map(lambda k: (ledger.reserve(spark, path, 1 + k % 4), 1 + k % 4), range(24)))
    taken = sorted(n for first, size in starts for n in range(first, first + size))
    assert taken == list(range(sum(size for _, size in starts)))


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, key, default=None):
            return self.value or default

    class Cluster:
        class sparkContext:
            master, applicationId = "yarn", "app"

    session = Cluster()
    session.conf = Conf("hdfs:///shared/")
    assert scratch_root(session) == "hdfs:///shared"
    session.conf = Conf(None)
    with pytest.raises(ValueError):
        scratch_root(session)


def test_upload_is_cleaned_scored_and_appended(spark):
    """Copies, blanks and what cleans to nothing go; absent fields take defaults; a repeated run adds nothing; all rows are read."""
    root = scratch_path(spark, "upload")
    path = f"{root}/mine.csv"
    rows = [(9, "same, \"text\"", "Forum", "a"), (3, "same, \"text\"", "Blog", None), (1, "", "Blog", "b"), (2, None, "Blog", "b"),
            (4, "http://only.link", "Blog", "b"), (5, "a terrible\nscam", None, "c")]
    rows += [(100 + i, f"post number {i}", "Forum", "d") for i in range(300)]
    df = spark.createDataFrame(rows, "nr int, Tweet_Text string, platform string, author string")
    files.write_csv(df, path)
    for _ in range(2):
        upload.import_csv(spark, path, root, df.schema, order=["nr"], writer="import", batch=0)
    upload.import_csv(spark, path, root, name="again")
    stored = store.read_table(spark, root, "comments").collect()
    first = {r.raw_text: r for r in stored if r.source_target == "mine.csv"}
    assert len(stored) == 604 and len(first) == 302 and sorted(r.id for r in stored) == list(range(604))
    copy, scam = first["same, \"text\""], first["a terrible\nscam"]
    assert (copy.platform, copy.author) == ("Blog", "User") and (scam.platform, scam.author) == ("External CSV", "c")
    assert scam.clean_text == "a terrible scam" and scam.sentiment == "NEGATIVE" and scam.created_at is not None
    with pytest.raises(ValueError):
        upload.comments_of_upload(df.select("nr", "author"), "none")
    only = upload.comments_of_upload(df.select("Tweet_Text"), "texts").collect()
    assert len(only) == 302 and {r.platform for r in only} == {"External CSV"}
