"""SQL fragments for the checks: text cleaning, distribution functions, term mining."""

from tidewatch.contracts import EMOJI_WORDS, ENGLISH_STOP_WORDS, STOP_WORDS
from tidewatch.functions import text as X
from tidewatch.functions.distributions import normal_quantile, t_quantile
from tidewatch.plans.registry import words_sql


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def regex_remove(expression: str, pattern: str, new: str = "") -> str:
    return f"regexp_replace({expression}, {_quoted(pattern)}, {_quoted(new)}, 'g')"


def clean_sql(expression: str) -> str:
    """The cleaning chain; the given documents hold no character references."""
    for emoji, word in EMOJI_WORDS:
        expression = f"replace({expression}, '{emoji}', '{word}')"
    for pattern, new in ((X.URL, ""), (X.MENTION, ""), (X.HASHTAG, r"\1"), (X.SYMBOL, " "),
                         (X.PUNCTUATION_RUN, r"\1"), (X.SPACES, " ")):
        expression = regex_remove(expression, pattern, new)
    return f"coalesce(trim({expression}), '')"


def strip_sql(expression: str) -> str:
    return regex_remove(expression, X.EDGE_SPACE)


def unescape_sql(expression: str) -> str:
    """The four character references that occur in the given pages."""
    for name, character in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        expression = f"regexp_replace({expression}, '&{name};?', '{character}', 'g')"
    return expression


def tokens_sql(expression: str) -> str:
    return f"regexp_extract_all(lower({expression}), {_quoted(X.TOKEN)})"


def content_tokens_sql(expression: str, stop_words=STOP_WORDS) -> str:
    found = f"regexp_extract_all(lower({expression}), {_quoted(X.LONG_TOKEN)})"
    return f"list_filter({found}, lambda w: w NOT IN ({words_sql(stop_words)}))"


def has_word_sql(expression: str, words) -> str:
    return f"list_has_any({tokens_sql(expression)}, [{words_sql(words)}])"


def erf_sql(x: str) -> str:
    """Power series of erf with positive terms only."""
    series = f"list_sum(list_transform(range(0, 110), lambda n: pow(abs({x}), 2 * n + 1) / gamma(n + 1.5)))"
    return f"(sign({x}) * CASE WHEN abs({x}) > 6 THEN 1 ELSE exp(-({x}) * ({x})) * {series} END)"


def t_cdf_sql(t: str, nu: str) -> str:
    """Student's t for whole degrees of freedom, closed products through lgamma."""
    odd = (f"0.5 + (atan({t} / sqrt({nu})) + {t} / sqrt({nu}) * ({nu} / ({nu} + {t} * {t})) * "
           f"coalesce(list_sum(list_transform(range(0, (({nu} - 1) // 2)::BIGINT), lambda k: "
           f"pow({nu} / ({nu} + {t} * {t}), k) * sqrt(pi()) / 2 * exp(lgamma(k + 1.0) - lgamma(k + 1.5)))), 0)) / pi()")
    even = (f"0.5 + 0.5 * {t} / sqrt({nu} + {t} * {t}) * "
            f"coalesce(list_sum(list_transform(range(0, ({nu} // 2)::BIGINT), lambda k: "
            f"pow({nu} / ({nu} + {t} * {t}), k) / sqrt(pi()) * exp(lgamma(k + 0.5) - lgamma(k + 1.0)))), 0)")
    y = f"(({nu} - 0.5) * ln(1 + {t} * {t} / {nu}))"
    b = f"(48 * pow({nu} - 0.5, 2))"
    z = (f"(sign({t}) * sqrt({y}) / sqrt(2) * (1 + ({y} + 3 + (((-0.4 * {y} - 3.3) * {y} - 24) * {y} - 85.5) / "
         f"(0.8 * {y} * {y} + 100 + {b})) / {b}))")
    large = f"0.5 + 0.5 * {erf_sql(z)}"
    return (f"CASE WHEN {nu} > 2000 THEN {large} WHEN {nu}::BIGINT % 2 = 1 THEN {odd} "
            f"ELSE {even} END")


def t_quantile_sql(probability: float, nu: str, limit: int = 64) -> str:
    z = normal_quantile(probability)
    values = ", ".join(repr(t_quantile(probability, n)) for n in range(1, limit + 1))
    tail = (f"{z!r} + {(z**3 + z) / 4!r} / {nu} + {(5 * z**5 + 16 * z**3 + 3 * z) / 96!r} / pow({nu}, 2)"
            f" + {(3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384!r} / pow({nu}, 3)"
            f" + {(79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160!r} / pow({nu}, 4)")
    return f"CASE WHEN {nu} <= {limit} THEN ([{values}])[{nu}::INT] ELSE {tail} END"


def terms_cte(source: str, text: str, id: str = "id", keys=(), stop_words=STOP_WORDS, prefix: str = "") -> str:
    """``words`` per document and ``occ``, one row per term occurrence."""
    head = "".join(f"{k}, " for k in keys)
    return f"""
{prefix}words AS (SELECT {head}{id}, {content_tokens_sql(text, stop_words)} AS w FROM {source}),
{prefix}occ AS (SELECT {head}{id}, unnest(list_concat(w, list_transform(range(1, len(w)),
  lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM {prefix}words)"""


def tfidf_cte(source: str, text: str, id: str = "id", keys=(), max_terms: int = 150,
              sublinear: bool = False) -> str:
    """Adds ``weights``: normalised TF-IDF per document and term."""
    head = "".join(f"{k}, " for k in keys)
    using = ", ".join([*keys, "term"])
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    document = ", ".join([*keys, id])
    total = (f"JOIN (SELECT {head}count(*) AS documents FROM {source} GROUP BY {', '.join(keys)}) USING ({', '.join(keys)})"
             if keys else f"CROSS JOIN (SELECT count(*) AS documents FROM {source})")
    weight = "1 + ln(tf)" if sublinear else "tf"
    return f"""{terms_cte(source, text, id, keys)},
vocab AS (SELECT {using} FROM (SELECT {using}, row_number() OVER ({part}ORDER BY count(*) DESC, term) AS rn
  FROM occ GROUP BY {using}) WHERE rn <= {max_terms}),
tf AS (SELECT {document}, term, count(*) AS tf FROM occ JOIN vocab USING ({using}) GROUP BY {document}, term),
idf AS (SELECT {using}, ln((1 + documents) / (1 + df)) + 1 AS idf, documents
  FROM (SELECT {using}, count(*) AS df FROM tf GROUP BY {using}) {total}),
raw AS (SELECT {document}, term, tf, idf, documents, ({weight}) * idf AS w FROM tf JOIN idf USING ({using})),
weights AS (SELECT {document}, term, tf, idf, documents,
  w / sqrt(sum(w * w) OVER (PARTITION BY {document})) AS tfidf FROM raw)"""


def naive_bayes_cte(train: str, label: str, target: str, text: str, p: str, max_terms: int = 2500,
                    smoothing: float = 0.1, sublinear: bool = True) -> str:
    """Adds ``{p}prob`` (id, label, prob): multinomial naive Bayes on TF-IDF weights, learned from ``train``
    (id, clean_text, ``label``) and applied to every row of ``target`` (id, ``text``)."""
    damped = "1 + ln(tf)" if sublinear else "tf"

    def weights(name, words):
        return f"""
{p}{name}tf AS (SELECT id, term, count(*) AS tf FROM {p}{words}occ JOIN {p}vocab USING (term) GROUP BY id, term),
{p}{name}raw AS (SELECT id, term, ({damped}) * idf AS w FROM {p}{name}tf JOIN {p}idf USING (term)),
{p}{name} AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS x FROM {p}{name}raw)"""

    return f"""{terms_cte(train, 'clean_text', stop_words=ENGLISH_STOP_WORDS, prefix=f'{p}l')},
{terms_cte(target, text, stop_words=ENGLISH_STOP_WORDS, prefix=f'{p}t')},
{p}vocab AS (SELECT term FROM {p}locc GROUP BY term ORDER BY count(*) DESC, term LIMIT {max_terms}),
{p}idf AS (SELECT term, ln((1 + (SELECT count(*) FROM {train})) / (1 + count(DISTINCT id))) + 1 AS idf
  FROM {p}locc JOIN {p}vocab USING (term) GROUP BY term),{weights('learned', 'l')},{weights('asked', 't')},
{p}class AS (SELECT {label}::VARCHAR AS label, count(*) AS n FROM {train} GROUP BY 1),
{p}cell AS (SELECT label, term, coalesce(f, 0) AS f FROM {p}class CROSS JOIN {p}vocab
  LEFT JOIN (SELECT {label}::VARCHAR AS label, term, sum(x) AS f FROM {p}learned JOIN {train} USING (id) GROUP BY 1, 2) USING (label, term)),
{p}theta AS (SELECT label, term, ln(f + {smoothing}::DOUBLE) - ln(sum(f + {smoothing}::DOUBLE) OVER (PARTITION BY label)) AS w FROM {p}cell),
{p}pi AS (SELECT label, ln(n + {smoothing}::DOUBLE) - ln(sum(n + {smoothing}::DOUBLE) OVER ()) AS b FROM {p}class),
{p}margin AS (SELECT id, label, b + coalesce(s, 0) AS m FROM {target} CROSS JOIN {p}pi
  LEFT JOIN (SELECT id, label, sum(x * w) AS s FROM {p}asked JOIN {p}theta USING (term) GROUP BY id, label) USING (id, label)),
{p}prob AS (SELECT id, label, e / sum(e) OVER (PARTITION BY id) AS prob
  FROM (SELECT id, label, exp(m - max(m) OVER (PARTITION BY id)) AS e FROM {p}margin)),
{p}best AS (SELECT id, max(prob) AS prob, min(label) FILTER (prob = top) AS label
  FROM (SELECT *, max(prob) OVER (PARTITION BY id) AS top FROM {p}prob) GROUP BY id)"""


def shown_sql(value: str, digits: int) -> str:
    """A number to ``digits`` places, ties towards zero."""
    scale = 10**digits
    return f"(sign({value}) * floor(abs({value}) * {scale}.0::DOUBLE + (0.5::DOUBLE - 1e-6::DOUBLE)) / {scale}.0::DOUBLE)"
