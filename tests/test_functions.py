import html
import math
import random
import re
import time

from pyspark.sql import Row, functions as F

from tidewatch.functions import distributions as D
from tidewatch.functions import scoring as S
from tidewatch.functions import text as X


def one(spark, expression, **values):
    return spark.createDataFrame([Row(**values)]).select(expression.alias("out")).first().out


def column(spark, expression, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.o for r in rows.select("i", expression.alias("o")).orderBy("i").collect()]


HTML_SAMPLES = [
    "a &amp; b", "&lt;b&gt;", "&amp;amp;", "&notit; x", "&nosuch; y", "&#65;&#x42;&#X43", "&#128512;",
    "&#0;", "&#x80;&#x81;", "&#xD800;", "&#99999999999;", "&#1;z", "&#13;", "x&", "&;", "&&&",
    "plain", "", "&copy 2020 &frac12", "&NotEqualTilde;", "&#x1F4A9; &eacute;", "&hellip;&nbsp;q",
    "&ampx", "&#xFFFE;", "&lta&gtb", "&#000000000065;", "&#x;", "&#;",
]


def test_html_unescape_matches_the_standard_library(spark):
    got = column(spark, X.html_unescape(F.col("t")), HTML_SAMPLES)
    assert got == [html.unescape(s) for s in HTML_SAMPLES]


def test_html_unescape_looks_names_up_without_scanning_them(spark):
    """Some 120,000 references: a scan of all names for each took minutes."""
    refs = "&amp;&lt;p&gt;&notit;&unknown;&zwnj;&#x41;"
    texts = spark.range(20000).select(F.concat(F.lit(refs), F.col("id").cast("string")).alias("t"), "id")
    start = time.time()
    got = texts.where(X.html_unescape(F.col("t")) == F.concat(F.lit(html.unescape(refs)), F.col("id").cast("string"))).count()
    assert got == 20000 and time.time() - start < 15


def python_clean(text):
    if text is None or not text.strip():
        return ""
    out = html.unescape(text)
    for emoji, word in X.EMOJI_WORDS:
        out = out.replace(emoji, word)
    for pattern, new in ((r"https?://\S+|www\.\S+", ""), (r"@\w+", ""), (r"#(\w+)", r"\1"),
                         (r"[^\w\s\.\,\!\?\-\'\"]", " "), (r"([!?.]){2,}", r"\1")):
        out = re.sub(pattern, new, out)
    return re.sub(r"\s+", " ", out).strip()


def test_clean_text_matches_plain_python(spark):
    samples = [None, "", " \t\u00a0", "Worst!!! @Acme #Fail https://x.co/a?b &amp; 💩🔥",
               "a?!...b!!", "été #naïve_tag — “quoted”", "x\u2003y\u00a0z\x1cw", "www.foo.com bar",
               "love ❤️ heart", "semi;colon/slash (paren)", "日本語 テスト!!", "@@double ##tag", "½ cup²"]
    rng = random.Random(7)
    alphabet = "ab@#!?. \n\u00a0é_-'\"&;💀x:/"
    samples += ["".join(rng.choice(alphabet) for _ in range(30)) for _ in range(200)]
    assert column(spark, X.clean_text(F.col("t")), samples) == [python_clean(s) for s in samples]


def test_word_count_and_terms(spark):
    assert column(spark, X.word_count(F.col("t")), ["", "a", "a b c"]) == [0, 1, 3]
    got = column(spark, X.terms(F.col("t")), ["The screen flickers really badly", "x", ""])
    assert got == [["screen", "flickers", "badly", "screen flickers", "flickers badly"], [], []]


def test_video_ids_and_handles(spark):
    links = ["dQw4w9WgXcQ", "https://www.youtube.com/watch?v=dQw4w9WgXcQ&t=1", "https://youtu.be/dQw4w9WgXcQ",
             "https://www.youtube.com/embed/dQw4w9WgXcQ", "youtube.com/shorts/dQw4w9WgXcQ", "nothing"]
    assert column(spark, X.extract_video_id(F.col("t")), links) == ["dQw4w9WgXcQ"] * 5 + ["nothing"]
    assert column(spark, X.normalize_handle(F.col("t")),
                  ["@durov", " https://t.me/durov/12", "t.me/x", "plain"]) == ["durov", "durov", "x", "plain"]
    assert column(spark, X.normalize_target(F.col("t")), ["#a", "@b", " c "]) == ["#a", "@b", "@c"]
    assert column(spark, X.feed_url(F.col("t")), ["r/spark", "https://www.reddit.com/r/a/?x=1"]) == [
        "https://www.reddit.com/r/spark.rss", "https://www.reddit.com/r/a.rss"]


def test_toxicity_rules(spark):
    got = column(spark, S.toxicity_rules(F.col("t")),
                 ["I will KILL you, idiot", "what a moron", "nice", "", "destroy you now"])
    assert [(r.is_toxic, r.toxicity_score, r.categories) for r in got] == [
        (True, 1.0, ["PROFANITY", "THREAT_SEVERE"]), (True, 0.45, ["PROFANITY"]), (False, 0.0, []),
        (False, 0.0, []), (False, 0.0, [])]
    phrase = column(spark, S.toxicity_rules(F.col("t"), phrases=True), ["I will destroy you now"])
    assert phrase[0].categories == ["THREAT_SEVERE"]
    scored = spark.createDataFrame([("fine", 0.7), ("fine", 0.85), ("die", 0.1)], "t string, p double")
    rows = scored.select(S.toxicity_rules(F.col("t"), F.col("p")).alias("a"),
                         S.toxicity_model_profile(F.col("t"), F.col("p")).alias("b")).collect()
    assert [r.a.categories for r in rows] == [["TOXIC_LANGUAGE"], ["TOXIC_LANGUAGE"], ["THREAT_SEVERE"]]
    assert [(r.b.categories, r.b.toxicity_score) for r in rows] == [
        (["TOXIC_LANGUAGE"], 0.7), (["TOXIC_HIGH_CONFIDENCE"], 0.85), (["THREAT_SEVERE"], 0.9)]


def test_lexicon_sentiment(spark):
    got = column(spark, S.lexicon_sentiment(F.col("t")), ["worst scam ever", "smooth and flawless", "hello", "", None])
    total = -3.1 - 3.5
    assert got[0].label == "NEGATIVE" and got[0].compound == round(total / math.sqrt(total**2 + 15), 4)
    assert got[0].score == round(round(8.6 / 9.6, 3) + 0.1, 4)
    assert got[1].label == "POSITIVE" and got[2].label == "NEUTRAL" and got[2].score == 1.0
    assert [(r.label, r.score, r.compound) for r in got[3:]] == [("NEUTRAL", 0.5, 0.0)] * 2


def test_consensus(spark):
    rows = spark.createDataFrame(
        [("POSITIVE", .9, .0), ("NEGATIVE", .6, .3), ("POSITIVE", .6, -.3), ("NEUTRAL", .5, .1)],
        "l string, c double, k double")
    got = [r.o.label for r in rows.select(S.consensus(F.col("l"), F.col("c"), F.col("k")).alias("o")).collect()]
    assert got == ["NEUTRAL", "POSITIVE", "NEGATIVE", "NEUTRAL"]


def test_probability_vector(spark):
    rows = spark.createDataFrame([([0.2, 0.3, 0.5],)], "p array<double>")
    r = rows.select(S.label_from_probabilities(F.col("p"), ["NEGATIVE", "NEUTRAL", "POSITIVE"]).alias("o"),
                    S.softmax(F.col("p")).alias("s")).first()
    assert (r.o.label_id, r.o.label, r.o.score, r.o.compound) == (2, "POSITIVE", 0.5, 0.3)
    assert abs(sum(r.s) - 1) < 1e-12


def test_normal_and_gamma(spark):
    xs = [-9.0, -3.3, -1.0, 0.0, 0.4, 2.0, 7.5]
    rows = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in rows.select("x", D.normal_cdf(F.col("x")).alias("c")).collect():
        exact = 0.5 * math.erfc(-r.x / math.sqrt(2))
        assert abs(r.c - exact) < 1e-14 + 1e-7 * exact
    rows = spark.createDataFrame([(x,) for x in (1.0, 2.0, 5.5, 40.0, 1e5)], "x double")
    for r in rows.select("x", D.log_gamma(F.col("x")).alias("g")).collect():
        assert math.isclose(r.g, math.lgamma(r.x), rel_tol=1e-12, abs_tol=1e-12)


def test_poisson_and_binomial(spark):
    rows = spark.createDataFrame([(k,) for k in range(10)], "k bigint")
    lam = F.lit(3.5)
    got = rows.select("k", D.poisson_pmf(F.col("k"), lam).alias("p"), D.poisson_cdf(F.col("k"), lam).alias("c"),
                      D.poisson_upper_tail(F.col("k"), lam).alias("u"),
                      D.binomial_pmf(F.col("k"), F.lit(9), 0.12).alias("b"),
                      D.binomial_cdf(F.col("k"), F.lit(9), 0.12).alias("bc"),
                      D.binomial_upper_tail(F.col("k"), F.lit(9), 0.12).alias("bu")).orderBy("k").collect()
    pmf = [math.exp(-3.5) * 3.5**k / math.factorial(k) for k in range(200 - 60)]
    binom = [math.comb(9, k) * .12**k * .88**(9 - k) for k in range(10)]
    assert round(got[3].p, 6) == 0.215785
    for r in got:
        assert abs(r.p - pmf[r.k]) < 1e-13 and abs(r.c - sum(pmf[:r.k + 1])) < 1e-13
        assert abs(r.u - sum(pmf[r.k:])) < 1e-13
        assert abs(r.b - binom[r.k]) < 1e-13 and abs(r.bc - sum(binom[:r.k + 1])) < 1e-13
        assert abs(r.bu - sum(binom[r.k:])) < 1e-13
    big = one(spark, D.poisson_cdf(F.col("k"), F.col("m")), k=1_000_000, m=1_000_000.0)
    assert abs(big - 0.500266) < 1e-5


def test_student_t(spark):
    assert abs(one(spark, D.student_t_quantile(0.99, F.col("d")), d=4) - 3.7469473880) < 1e-9
    assert abs(one(spark, D.student_t_quantile(0.975, F.col("d")), d=1000) - 1.962339) < 1e-6
    assert abs(D.t_quantile(0.975, 1) - 12.7062047) < 1e-6
    for t, df, expect in ((1.0, 1, 0.75), (0.0, 5, 0.5), (2.015048, 5, 0.95), (-2.015048, 5, 0.05),
                          (1.372184, 10, 0.9), (float("inf"), 4, 1.0)):
        assert abs(one(spark, D.student_t_cdf(F.col("t"), F.col("d")), t=t, d=df) - expect) < 1e-6
    # Both sides of the limits at which the form changes.
    cases = [(t, n) for t in (-4.5, 0.3, 1.7, 6.0) for n in (1999, 2000, 2001, 5000)]
    for r in spark.createDataFrame(cases, "t double, d int").withColumn("p", D.student_t_cdf(F.col("t"), F.col("d"))).collect():
        assert abs(r.p - D._t_cdf(r.t, r.d)) < 1e-13
    degrees = spark.createDataFrame([(n,) for n in (64, 65, 100, 1999, 2001)], "d int")
    for r in degrees.withColumn("q", D.student_t_quantile(0.975, F.col("d"))).collect():
        assert abs(r.q - D.t_quantile(0.975, r.d)) < 1e-8
    assert abs(1 - one(spark, D.student_t_cdf(F.col("t"), F.col("d")), t=14.8797, d=4) - 5.94e-5) < 1e-7
