import json

from pyspark.sql import functions as F

from tidewatch.contracts import CHAT_EXPLANATION, CHAT_SYSTEM_PROMPT
from tidewatch.functions import labels as L
from tidewatch.operators import corpus as C
from tidewatch.operators import evaluation as E


def labelled(spark, expression, values, kind):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", expression.alias("o")).orderBy("i").collect()]


def test_label_rules(spark):
    v = F.col("v")
    assert labelled(spark, L.map_label(v, L.BINARY), [0, 1, 2, None], "int") == ["NEGATIVE", "POSITIVE", None, None]
    assert labelled(spark, L.map_label(v, L.FIVE_POINT, "NEUTRAL"), [0, 2, 4, 3], "int") == [
        "NEGATIVE", "NEUTRAL", "POSITIVE", "NEUTRAL"]
    assert labelled(spark, L.stars_to_sentiment(v), [0, 1, 2, 3, 4], "int") == ["NEGATIVE"] * 2 + ["NEUTRAL"] + ["POSITIVE"] * 2
    assert labelled(spark, L.score_to_sentiment(v), ["15", "3", "2", "x", None], "string") == [
        "POSITIVE", "NEUTRAL", "NEGATIVE", "NEUTRAL", "NEUTRAL"]
    assert labelled(spark, L.map_name(v), ["Positive", "IRRELEVANT", "odd", None], "string") == [
        "POSITIVE", "NEUTRAL", "NEUTRAL", "NEUTRAL"]
    assert labelled(spark, L.flag_from_class(v), [0, 1, 2], "int") == [1, 1, 0]
    assert labelled(spark, L.flag_from_score(v), [.49, .5], "double") == [0, 1]


def sources(spark):
    a = spark.createDataFrame([(1, "good one", "POSITIVE"), (2, "shared text", "NEGATIVE"), (3, "hm", "NEUTRAL"),
                               (4, None, "NEUTRAL"), (5, "odd label", "OTHER")], "id int, text string, s string")
    b = spark.createDataFrame([(1, "shared text", "POSITIVE"), (2, "another text", "NEUTRAL")], "id int, text string, s string")
    return [(n, C.source_frame(d, n, F.col("id"), F.col("text"), sentiment=F.col("s"))) for n, d in (("a", a), ("b", b))]


def test_build_corpus(spark):
    rows = C.build_corpus(sources(spark)).orderBy("pos").collect()
    assert [r.pos for r in rows] == [1, 2, 3]
    assert {(r.source, r.id, r.sentiment) for r in rows} == {("a", 1, "POSITIVE"), ("a", 2, "NEGATIVE"), ("b", 2, "NEUTRAL")}
    again = C.build_corpus([(n, d.repartition(5)) for n, d in sources(spark)]).orderBy("pos").collect()
    assert [(r.source, r.id) for r in again] == [(r.source, r.id) for r in rows]
    capped = C.build_corpus(sources(spark), cap=1, capped=("b",))
    assert capped.where("source = 'b'").count() <= 1


def test_hot_text_is_merged_before_the_shuffle(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, "hot text").otherwise(
        F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    frame = [("s", C.source_frame(df, "s", F.col("id"), F.col("text"), sentiment=F.lit("NEUTRAL")))]
    rows = C.build_corpus(frame)
    assert rows.count() == 1 + sum(i % 3 != 0 for i in range(4000))
    assert rows.where("text = 'hot text'").first().id == 0


def test_label_index_and_guard(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "l string")
    assert sorted((r.l, r.label_id) for r in C.with_label_id(df, "l").collect()) == [("a", 0), ("a", 0), ("b", 1), ("c", 2)]
    guard = lambda n, names: C.train_guard(spark.createDataFrame(
        [(names[i % len(names)],) for i in range(n)], "sentiment string")).first().status
    assert guard(19, ["POSITIVE", "NEGATIVE"]) == "Insufficient data for ML training"
    assert guard(20, ["POSITIVE", "other"]) == "Requires at least 2 distinct classes"
    assert guard(20, ["POSITIVE", "NEGATIVE"]) == "OK"


def test_chat_examples_print_like_python_json(spark):
    text = 'He said "no"\n\\ é 😍'
    mood = spark.createDataFrame([(1, text, None, "a")], "id int, text string, sentiment string, source string")
    toxic = spark.createDataFrame([(1, text, 1, "b"), (2, text, 0, "b")], "id int, text string, is_toxic int, source string")
    got = {(r.source, r.id): r.messages for r in C.chat_examples([mood, toxic]).collect()}
    expect = lambda s, t, k: json.dumps({"sentiment": s, "is_toxic": t, "toxicity_type": k, "sarcasm": False,
                                         "explanation": CHAT_EXPLANATION}, ensure_ascii=False)
    assert [m.role for m in got[("a", 1)]] == ["system", "user", "assistant"]
    assert got[("a", 1)][0].content == CHAT_SYSTEM_PROMPT and got[("a", 1)][1].content == f"Post: {text}"
    assert got[("a", 1)][2].content == expect("NEUTRAL", False, "NONE")
    assert got[("b", 1)][2].content == expect("NEGATIVE", True, "HARASSMENT")
    assert got[("b", 2)][2].content == expect("NEUTRAL", False, "NONE")
    odd = spark.createDataFrame([(text,)], "t string").select(C._json_string(F.col("t")).alias("j")).first().j
    assert json.loads(odd) == text and odd == json.dumps(text, ensure_ascii=False)


def test_evaluation(spark):
    pairs = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("c", "a")]
    df = spark.createDataFrame(pairs, "actual string, predicted string")
    cells = {(r.actual, r.predicted): r.n for r in E.confusion_matrix(df).collect()}
    assert len(cells) == 9 and cells[("a", "b")] == 2 and cells[("b", "c")] == 0
    report = {r.label: r for r in E.classification_report(df).collect()}
    assert (report["a"].precision, report["a"].recall, report["a"].support) == (round(5 / 6, 4), round(5 / 7, 4), 7)
    assert (report["c"].precision, report["c"].recall, report["c"].f1) == (0.0, 0.0, 0.0)
    assert report["macro avg"].precision == round((5 / 6 + 3 / 5 + 0) / 3, 4)
    assert report["weighted avg"].recall == round(8 / 11, 4) and report["weighted avg"].support == 11
    w = E.weighted_scores(df).first()
    assert w.precision == round((7 * 5 / 6 + 3 * 3 / 5) / 11, 4)
    assert tuple(E.accuracy(df).first()) == (11, round(8 / 11, 4))
    runs = spark.createDataFrame([(1, .5, .7), (2, .3, .9), (3, .1, .9)], "run int, loss double, f1 double")
    assert tuple(E.best_run(runs).first()) == (2, .9, .3)
