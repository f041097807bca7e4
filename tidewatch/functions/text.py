"""Text cleaning and extraction as built-in column expressions.

Patterns spell out Unicode word and whitespace classes, because ``\\w`` and
``\\s`` cover ASCII only in Java.
"""

from functools import reduce
from html.entities import html5
import json
import string
import zlib

from pyspark.sql import Column, functions as F

from tidewatch.contracts import CRISIS_KEYWORDS, EMOJI_WORDS, STOP_WORDS

WORD = r"\p{L}\p{N}_"
SPACE = (
    r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
URL = rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+"
MENTION = rf"@[{WORD}]+"
HASHTAG = rf"#([{WORD}]+)"
SYMBOL = rf"[^{WORD}{SPACE}.,!?\-'\"]"
PUNCTUATION_RUN = r"([!?.]){2,}"
SPACES = rf"[{SPACE}]+"
EDGE_SPACE = rf"^[{SPACE}]+|[{SPACE}]+$"
TOKEN = rf"[{WORD}]+"
LONG_TOKEN = rf"[{WORD}]{{2,}}"
# Java looks listed ASCII characters up in one table, but tries Unicode classes one by one: the forms for
# the scans of whole texts name the common characters first. They match the same.
_ASCII_WORD = string.ascii_letters + string.digits + "_"
_FAST_LONG_TOKEN = rf"[{_ASCII_WORD}{WORD}]{{2,}}+"
_SYMBOL_OR_SPACE = rf"(?![{_ASCII_WORD} .,!?\-'\"])[^{WORD} .,!?\-'\"]"
CHARACTER_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"

_EMOJI = f"[{''.join(sorted({emoji[0] for emoji, _ in EMOJI_WORDS}))}]"  # one of these starts each
_MAX_LEGACY_NAME = max(len(name) for name in html5 if not name.endswith(";"))
# What browsers show for numeric references into the C1 range.
_C1 = {0: "�", 13: "\r"} | {
    code: bytes([code]).decode("cp1252", "ignore") or chr(code) for code in range(0x80, 0xA0)
}


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def constant(value, kind: str) -> Column:
    """A nested constant that is one node in the plan and folded before tasks start."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def lookup(entries: dict, kind: str):
    """Function from a text to its value of SQL type ``kind`` in ``entries``, NULL for others.

    Keys lie in buckets by CRC-32: a map looks its keys up one by one, a bucket holds about one.
    """
    size = 1 << max(len(entries) - 1, 1).bit_length()
    buckets: list[dict] = [{} for _ in range(size)]
    for key, value in entries.items():
        buckets[zlib.crc32(key.encode()) % size][key] = value
    held = constant(buckets, f"array<map<string,{kind}>>")
    return lambda key: F.element_at(F.element_at(held, (F.crc32(key) % size + 1).cast("int")), key)


def _code_point(ref: Column) -> Column:
    """The number in ``&#65;`` or ``&#x41;``; out of range counts as too large."""
    digits = F.regexp_extract(ref, "([0-9a-fA-F]+);?$", 1)
    is_hex = F.lower(F.substring(ref, 3, 1)) == "x"
    significant = F.regexp_replace(digits, "^0+", "")
    decimal = F.when(F.length(significant) <= 9,
                     F.coalesce(significant.try_cast("long"), F.lit(0)))
    hexadecimal = F.when(F.length(significant) <= 9,
                         F.coalesce(F.conv(significant, 16, 10).try_cast("long"), F.lit(0)))
    return F.coalesce(F.when(is_hex, hexadecimal).otherwise(decimal), F.lit(0x110000))


def _numeric_reference(ref: Column) -> Column:
    special = lookup({str(k): v for k, v in _C1.items()}, "string")

    def character(code):
        surrogate = code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
        control = (
            code.between(1, 8) | (code == 0x0B) | code.between(0x0E, 0x1F) | (code == 0x7F)
            | code.between(0xFDD0, 0xFDEF) | (code % 0x10000 >= 0xFFFE)
        )
        plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.coalesce(special(code.cast("string")),
                          F.when(surrogate, "�").when(control, "").otherwise(plain))

    return bind(_code_point(ref), character)


def _named_reference(ref: Column) -> Column:
    """The whole name, else its longest known prefix, else the reference itself."""
    meaning = lookup(html5, "string")
    name = F.substr(ref, F.lit(2))
    prefixes = [F.substr(name, F.lit(1), F.lit(n)) for n in range(_MAX_LEGACY_NAME, 1, -1)]
    cut = bind(
        F.try_element_at(F.filter(F.array(*prefixes), lambda key: meaning(key).isNotNull()), F.lit(1)),
        lambda key: F.when(key.isNull(), ref).otherwise(
            F.concat(meaning(key), F.substr(name, F.length(key) + 1))))
    return F.coalesce(meaning(name), cut)


def html_unescape(text: Column) -> Column:
    """Decode HTML character references; rows without ``&`` skip the work."""
    refs = F.regexp_extract_all(text, F.lit(f"({CHARACTER_REFERENCE})"), F.lit(1))
    gaps = F.split(text, CHARACTER_REFERENCE, -1)

    def joined(found):
        decoded = F.transform(
            found["refs"],
            lambda ref: F.when(ref.startswith("&#"), _numeric_reference(ref))
            .otherwise(_named_reference(ref)),
        )
        tail = F.zip_with(decoded, F.slice(found["gaps"], F.lit(2), F.size(found["refs"])), lambda d, g: F.concat(d, g))
        return F.concat(F.element_at(found["gaps"], 1), F.array_join(tail, ""))

    found = F.struct(refs.alias("refs"), gaps.alias("gaps"))
    return F.when(text.contains("&"), bind(found, joined)).otherwise(text)


def emoji_to_words(text: Column) -> Column:
    """Emoji as words; texts of ASCII characters alone skip the work."""
    replaced = lambda t: reduce(lambda acc, pair: F.replace(acc, F.lit(pair[0]), F.lit(pair[1])), EMOJI_WORDS, t)
    return bind(text, lambda t: F.when(F.octet_length(t) == F.char_length(t), t).when(~t.rlike(_EMOJI), t).otherwise(replaced(t)))


def _remove(text: Column, marks, pattern: str, new: str = "") -> Column:
    """Replace a pattern, each match of which holds one of ``marks``; texts without them are not scanned."""
    return bind(text, lambda t: F.when(reduce(lambda a, b: a | b, [t.contains(mark) for mark in marks]),
                                       F.regexp_replace(t, pattern, new)).otherwise(t))


def strip_urls(text: Column) -> Column:
    return _remove(text, ("://", "www."), URL)


def strip_mentions(text: Column) -> Column:
    return _remove(text, ("@",), MENTION)


def unwrap_hashtags(text: Column) -> Column:
    return _remove(text, ("#",), HASHTAG, "$1")


def drop_symbols(text: Column) -> Column:
    return F.regexp_replace(text, SYMBOL, " ")


def squeeze_punctuation(text: Column) -> Column:
    """Runs of ``! ? .`` keep their last character."""
    return F.regexp_replace(text, PUNCTUATION_RUN, "$1")


def squeeze_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def _blank_symbols_and_spaces(text: Column) -> Column:
    """Symbols and every kind of whitespace as plain spaces, in one scan."""
    return F.regexp_replace(text, _SYMBOL_OR_SPACE, " ")


def _squeeze_plain_spaces(text: Column) -> Column:
    """:func:`squeeze_spaces` for texts without other whitespace: a pattern only for runs that replacing leaves."""
    short = reduce(lambda acc, run: F.replace(acc, F.lit(" " * run), F.lit(" ")), (4, 2, 2), text)
    return F.trim(bind(short, lambda t: F.when(t.contains("  "), F.regexp_replace(t, " {2,}", " ")).otherwise(t)))


def strip(text: Column) -> Column:
    """Trim every kind of Unicode whitespace."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(rf"[^{SPACE}]")


CLEANING_STEPS = (
    html_unescape, emoji_to_words, strip_urls, strip_mentions,
    unwrap_hashtags, _blank_symbols_and_spaces, squeeze_punctuation, _squeeze_plain_spaces,
)


def clean_text(text: Column) -> Column:
    """The full cleaning chain; NULL and blank become the empty string."""
    return F.coalesce(reduce(lambda acc, step: step(acc), CLEANING_STEPS, text), F.lit(""))


def word_count(clean: Column) -> Column:
    """Whitespace tokens of an already cleaned text."""
    return F.when(clean == "", 0).otherwise(F.size(F.split(clean, " ")))


def tokens(text: Column) -> Column:
    """Lower-cased words, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def word_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def whole_word(words) -> str:
    """Pattern for any of ``words`` as whole words of a lower-cased text.

    The words of a phrase may be separated by anything that is not a word.
    """
    alternatives = "|".join(word.replace(" ", rf"[^{WORD}]+") for word in words)
    firsts = "".join(sorted({word[:1] for word in words}))
    ahead = f"(?=[{firsts}])" if firsts.isalnum() and all(words) else ""
    return rf"{ahead}(?<![{WORD}])(?:{alternatives})(?![{WORD}])"


def content_tokens(text: Column, stop_words=STOP_WORDS) -> Column:
    """Lower-cased words of two or more characters that are not stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(_FAST_LONG_TOKEN), F.lit(0))
    return F.filter(words, lambda word: ~word.isin(*stop_words))


def bigrams(words: Column) -> Column:
    pairs = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), pairs), F.slice(words, F.lit(2), pairs),
                      lambda left, right: F.concat_ws(" ", left, right))


def terms(text: Column, stop_words=STOP_WORDS) -> Column:
    """Unigrams followed by the bigrams of what is left after stop-word removal."""
    return bind(content_tokens(text, stop_words),
                lambda words: F.concat(words, bigrams(words)))


def crisis_keyword_flag(text: Column) -> Column:
    lowered = F.lower(text)
    return reduce(lambda a, b: a | b, [lowered.contains(word) for word in CRISIS_KEYWORDS])


def excerpt(text: Column, size: int, ellipsis: str = "") -> Column:
    head = F.substring(text, 1, size)
    return F.concat(head, F.lit(ellipsis)) if ellipsis else head


def join_title_body(title: Column, body: Column) -> Column:
    return strip(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(body, F.lit(""))))


def title_case_theme(words: Column) -> Column:
    return F.initcap(F.array_join(F.slice(words, 1, 2), " / "))


# -- links and handles --------------------------------------------------------

BARE_VIDEO_ID = r"^[a-zA-Z0-9_-]{11}$"
VIDEO_ID_IN_LINK = r"(?:/|v=)([\w-]{11})"


def extract_video_id(link: Column) -> Column:
    """A bare 11-character id, else the first 11 such characters after a slash or ``v=``, else the input."""
    link = strip(link)
    found = F.nullif(F.regexp_extract(link, VIDEO_ID_IN_LINK, 1), F.lit(""))
    return F.when(link.rlike(BARE_VIDEO_ID), link).otherwise(F.coalesce(found, link))


def watch_url(video_id: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), video_id)


def feed_url(target: Column) -> Column:
    """Feed address of a thread link or of a community name."""
    target = strip(target)
    thread = F.concat(F.rtrim(F.split_part(target, F.lit("?"), F.lit(1)), F.lit("/")),
                      F.lit(".rss"))
    name = strip(F.replace(target, F.lit("r/"), F.lit("")))
    community = F.concat(F.lit("https://www.reddit.com/r/"), name, F.lit(".rss"))
    return F.when(target.contains("reddit.com"), thread).otherwise(community)


def canonical_url(url: Column) -> Column:
    """Address without query string and trailing slashes."""
    return F.rtrim(F.split_part(strip(url), F.lit("?"), F.lit(1)), F.lit("/"))


def normalize_handle(handle: Column) -> Column:
    bare = F.ltrim(strip(handle), F.lit("@"))
    for prefix in ("https://t.me/", "t.me/"):
        bare = F.replace(bare, F.lit(prefix), F.lit(""))
    return F.split_part(bare, F.lit("/"), F.lit(1))


def normalize_target(query: Column) -> Column:
    query = strip(query)
    marked = query.startswith("#") | query.startswith("@")
    return F.when(marked, query).otherwise(F.concat(F.lit("@"), query))
