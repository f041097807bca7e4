"""Quality rules on repetition: how much of a text lies in repeated n-grams and lines.

Words become whole numbers, n-grams of every length one rolling polynomial
hash in 64 bits, computed for all positions at once; equal hashes next to each
other after a sort are repeats. Characters are counted once however many repeated
n-grams cover them. Work and memory of a document grow with its own length only.
"""

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import ASCII_SPACE, map_rows, utf8

SYMBOLS = b"#*$%&|<>"
#: Base rules: fewest words, window length in words, greatest percentage of words in repeated windows.
MIN_WORDS, WINDOW_WORDS, MAX_REPEAT_PERCENT = 20, 8, 30
#: Percent of word characters: the most frequent n-gram may cover so much (published web-corpus rules) ...
TOP_PERCENT = {2: 20, 3: 18, 4: 16}
#: ... and all repeated n-grams together: a short clean text framed by one boilerplate line reaches 28.
REPEATED_PERCENT = {5: 30, 6: 30, 7: 30, 8: 30, 9: 30, 10: 30}
LINE_PERCENT, LINE_CHARACTER_PERCENT = 30, 20

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(ids: np.ndarray) -> np.ndarray:
    """Whole numbers to well-spread 64-bit words (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (ids.astype(np.uint64) + np.uint64(1)) * MULTIPLIER
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RollingHashes:
    """Hashes of all n-grams of a word sequence, for growing n: h(n) = h(n-1) * m + next word."""

    def __init__(self, ids: np.ndarray):
        self.words = mixed(ids)
        self.n, self.hashes = 1, self.words

    def grams(self, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            while self.n < n and len(self.hashes):
                self.hashes = self.hashes[:-1] * MULTIPLIER + self.words[self.n:]
                self.n += 1
        return self.hashes


def groups(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions sorted by hash, start of each run of equal hashes, and its length."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.array([], int)
    return order, first, np.diff(np.append(first, len(ranked)))


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` words lie in an n-gram that begins at one of ``starts``."""
    edge = np.zeros(total + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str | None) -> dict:
    """All counts of one text. Empty and null texts count zero everywhere."""
    raw = utf8(text)
    words = raw.split()
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    chars = np.array([len(w) for w in words], dtype=np.int64)
    if not raw.isascii():
        chars = np.array([len(w.decode("utf-8", "surrogatepass")) for w in words], dtype=np.int64)
    total, n_words = int(chars.sum()), len(words)
    lines = Counter(line for line in raw.split(b"\n") if line.strip(ASCII_SPACE))
    repeated_lines = {line: count - 1 for line, count in lines.items() if count > 1}
    out = {
        "n_words": n_words, "word_chars": total,
        "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)),
        "n_lines": sum(lines.values()), "n_dup_lines": sum(repeated_lines.values()),
        "dup_line_chars": sum(
            extra * len(line.translate(None, ASCII_SPACE).decode("utf-8", "surrogatepass"))
            for line, extra in repeated_lines.items()),
    }
    rolling = RollingHashes(ids)
    # An n-gram can only be repeated where the shorter one before it was: the sorts shrink fast.
    positions = np.arange(n_words)
    for n in sorted({*TOP_PERCENT, *REPEATED_PERCENT, WINDOW_WORDS}):
        positions = positions[positions <= n_words - n]
        hashes = rolling.grams(n)[positions] if len(positions) else np.array([], dtype=np.uint64)
        order, first, counts = groups(hashes)
        again = np.repeat(counts > 1, counts)
        ranked = positions[order]
        if n in TOP_PERCENT:
            top = int(counts.max()) if len(counts) else 0
            chars_top = 0
            if top > 1:
                # Of the most frequent, the n-gram that comes first in the text.
                candidates = first[counts == top]
                at = candidates[np.argmin(ranked[candidates])]
                chars_top = int(chars[covered(ranked[at:at + top], n, n_words)].sum())
            out[f"top_{n}gram_chars"] = chars_top
        positions = np.sort(ranked[again])
        inside = covered(positions, n, n_words)
        if n in REPEATED_PERCENT:
            out[f"dup_{n}gram_chars"] = int(chars[inside].sum())
        if n == WINDOW_WORDS:
            out["n_repeat_words"] = int(inside.sum())
    return out


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "dup_line_chars",
          *(f"top_{n}gram_chars" for n in TOP_PERCENT), *(f"dup_{n}gram_chars" for n in REPEATED_PERCENT)]


def over(part: str, whole: str, percent: int):
    return 100 * F.col(part) > percent * F.col(whole)


def repetition(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and verdicts for every row: doc_id, COUNTS, base_failed, repetition_failed, kept.

    ``base_failed``: under MIN_WORDS words, or too many words in repeated windows.
    ``repetition_failed``: a share above one of the limits at the top of this module.
    Null and empty texts count zero and fail the base rules; repeated rows are judged
    one by one; other columns are not read. An empty table gives an empty one.
    """
    id_type = docs.schema[id].dataType.simpleString()
    narrow = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))

    def rows(batch):
        for doc_id, value in batch:
            found = measure(value)
            yield (doc_id, *(found[name] for name in COUNTS))

    counted = map_rows(narrow, rows, f"doc_id {id_type}, " + ", ".join(f"{name} long" for name in COUNTS))
    failed = over("n_dup_lines", "n_lines", LINE_PERCENT) | over("dup_line_chars", "word_chars", LINE_CHARACTER_PERCENT)
    for n, percent in TOP_PERCENT.items():
        failed = failed | over(f"top_{n}gram_chars", "word_chars", percent)
    for n, percent in REPEATED_PERCENT.items():
        failed = failed | over(f"dup_{n}gram_chars", "word_chars", percent)
    base = (F.col("n_words") < MIN_WORDS) | over("n_repeat_words", "n_words", MAX_REPEAT_PERCENT)
    return (counted.withColumn("base_failed", base).withColumn("repetition_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & ~F.col("repetition_failed")))
