"""Document fingerprints by randomised edit embedding.

A text is read by a random walk: time goes on, and at each tick a shared random bit
for (time, character) says whether the reader moves to the next character. Texts
at a small edit distance fall into step again soon after each edit, so the strings of
symbols read over time are close in Hamming distance. A fingerprint samples SAMPLES
ticks, the same for all texts of like length; the likeness of two fingerprints is their
share of equal samples, corrected for chance. Samples form BANDS: texts that share a
band are candidates (:func:`lookup`), and the likeness verifies them.
"""

import bisect
import hashlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import map_rows
from tidewatch.session import materialize

SAMPLES = 128
BAND_SAMPLES = 8
GRAM = 4
PERIOD = 1 << 12
CLASSES = 256
CHUNK = 1 << 16
CHANCE = 1 / 16
#: Fingerprints of one band that a block of the lookup holds.
BLOCK_PRINTS = 4096
SEED = 42


class Embedding:
    """The shared randomness: dwell times of the walk and the sampled ticks."""

    def __init__(self, seed: int = SEED):
        draw = np.random.default_rng(seed)
        moves = draw.integers(0, 2, size=(CLASSES, PERIOD), dtype=np.int64)
        moves[:, -1] = 1
        # dwell[c][t]: ticks spent on a character of class c that is reached at tick t (modulo PERIOD).
        twice = np.concatenate([moves, moves], axis=1)
        at = np.where(twice == 1, np.arange(2 * PERIOD), 2 * PERIOD)
        following = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :PERIOD]
        dwell = following - np.arange(PERIOD) + 1
        self.dwell = [bytes(row.astype(np.uint8)) for row in np.minimum(dwell, 255)]
        # The sampled tick below T must be uniform over [0, T) and rarely change with T: the last
        # record of a random permutation. Records follow r' = floor((r + 1) / u).
        records = np.zeros((SAMPLES, 64))
        for k in range(1, 64):
            u = 1 - draw.random(SAMPLES)
            records[:, k] = np.minimum(np.floor((records[:, k - 1] + 1) / u), 2.0**62)
        self.records = records
        self.salt = draw.integers(1, 1 << 32, size=SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def read(self, codes: np.ndarray, start: int = 0) -> np.ndarray:
        """Tick at which each character is left, from tick ``start`` on."""
        dwell, mask, t, out = self.dwell, PERIOD - 1, start, []
        classes = ((codes * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8).tobytes()
        for low in range(0, len(classes), CHUNK):
            ticks = [t := t + dwell[c][t & mask] for c in classes[low:low + CHUNK]]
            out.append(np.array(ticks, dtype=np.uint32 if t < 1 << 32 else np.int64))
        return np.concatenate(out) if out else np.array([], dtype=np.uint32)

    def fingerprint(self, codes: np.ndarray, ticks: np.ndarray) -> str:
        """One hexadecimal digit for each sample: a hash of the GRAM characters read at its tick."""
        if not len(codes):
            return "0" * SAMPLES
        total = float(ticks[-1])
        which = (self.records < total).sum(axis=1) - 1
        sampled = self.records[np.arange(SAMPLES), which].astype(np.int64)
        at = np.searchsorted(ticks, sampled.astype(ticks.dtype), side="right")
        with np.errstate(over="ignore"):
            value = np.zeros(SAMPLES, dtype=np.uint64)
            for k in range(GRAM):
                there = np.minimum(at + k, len(codes) - 1)
                symbol = np.where(at + k < len(codes), codes[there].astype(np.uint64) + np.uint64(1), np.uint64(0))
                value = (value ^ symbol) * np.uint64(0x9E3779B97F4A7C15)
                value ^= value >> np.uint64(29)
            value = (value * self.salt) >> np.uint64(60)
        return "".join(map("0123456789abcdef".__getitem__, value.tolist()))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def likeness(a: str, b: str) -> float:
    """Share of equal samples, less what chance gives: 1 for equal texts, near 0 for unrelated ones."""
    same = sum(map(str.__eq__, a, b)) / SAMPLES
    return max(0.0, (same - CHANCE) / (1 - CHANCE))


def shared_bands(a: str, b: str) -> int:
    """Bands of BAND_SAMPLES samples that are equal: any makes two texts candidates."""
    cuts = range(0, SAMPLES, BAND_SAMPLES)
    return sum(a[c:c + BAND_SAMPLES] == b[c:c + BAND_SAMPLES] for c in cuts)


def edited(text: str, following: str) -> tuple[str, int]:
    """``text`` with its last third replaced by the start of ``following``, and the length they share."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third], len(text) - third


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row; null is empty."""
    narrow = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))

    def rows(batch):
        walk = Embedding()
        for doc_id, value in batch:
            codes = code_points(value or "")
            yield doc_id, walk.fingerprint(codes, walk.read(codes))

    return map_rows(narrow, rows, f"doc_id {docs.schema[id].dataType.simpleString()}, fingerprint string")


def _with_bands(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints, a row for each of their bands: (fingerprint, band)."""
    bands = [F.concat(F.lit(f"{k}:"), F.substring("fingerprint", k * BAND_SAMPLES + 1, BAND_SAMPLES))
             for k in range(SAMPLES // BAND_SAMPLES)]
    return prints.select("fingerprint").distinct().select("fingerprint", F.explode(F.array(*bands)).alias("band"))


def lookup(queries: DataFrame, prints: DataFrame, least: float = 0.8, block: int = BLOCK_PRINTS) -> DataFrame:
    """Pairs (fingerprint, other, likeness) of distinct fingerprints of ``queries`` and ``prints`` at ``least`` alike.

    Both have a column fingerprint; equal fingerprints are one, so copies cost nothing, and a
    fingerprint is no partner of itself: join the pairs with the tables for documents. Candidates share a
    band, and every candidate is verified. Frequent bands are cut into blocks of about ``block``
    fingerprints, to which only the queries of that band are sent. Pairs that share no band are missed:
    by independent samples 3 % of those with a likeness of 0.8, fewer above.
    """
    mine, theirs = _with_bands(queries), _with_bands(prints)
    wanted = materialize(theirs.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
                         .join(mine, "band"), "bands")
    sent = wanted.select("fingerprint", "band", F.explode(F.sequence(F.lit(1).cast("long"), "blocks")).alias("_block"))
    blocks = wanted.select("band", "blocks").distinct()
    held = theirs.join(blocks, "band").select(
        F.col("fingerprint").alias("other"), "band", (F.pmod(F.xxhash64("fingerprint"), "blocks") + 1).alias("_block"))
    digits = [F.split(c, "") for c in ("fingerprint", "other")]
    same = F.size(F.filter(F.zip_with(*digits, lambda x, y: x == y), lambda hit: hit)) / F.lit(SAMPLES)
    near = F.greatest(F.lit(0.0), (same - CHANCE) / (1 - CHANCE))
    # A pair may meet in several bands: it is named by the first that they share.
    first = F.coalesce(*[F.when(F.substring("fingerprint", c + 1, BAND_SAMPLES) == F.substring("other", c + 1, BAND_SAMPLES),
                                F.lit(f"{c // BAND_SAMPLES}:")) for c in range(0, SAMPLES, BAND_SAMPLES)])
    met = sent.join(held, ["band", "_block"]).where(
        (F.col("fingerprint") != F.col("other")) & (F.concat(F.substring_index("band", ":", 1), F.lit(":")) == first))
    return met.select("fingerprint", "other", near.alias("likeness")).where(F.col("likeness") >= least)


def _bucket_of(bounds: list[int]):
    """Range number of an id, in whole numbers at any size; null ids come with the smallest."""
    return lambda doc_id: 0 if doc_id is None else bisect.bisect_left(bounds, doc_id)


def with_next(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Rows (bucket, ghost, doc_id, packed text) in ranges of the id.

    Each range also holds, as a ghost, the row that follows its last in descending order. The
    range bounds and first ids are as many numbers as there are ranges; texts move
    once, compressed.
    """
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(id).alias("doc_id"))
    cuts = ids.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], max(10000, 20 * ranges))).first()[0]
    number, kind = _bucket_of(sorted(set(cuts or []))), docs.schema[id].dataType.simpleString()
    # The same rule numbers the ranges here and deals out the rows below.
    dealt = map_rows(ids, lambda rows: ((number(doc_id), doc_id) for doc_id, in rows), f"bucket int, doc_id {kind}")
    firsts = dealt.groupBy("bucket").agg(F.max("doc_id").alias("first")).orderBy(F.desc("bucket")).collect()
    # In descending order the row after the last of a range is the first of the next lower one.
    goes = {row["first"]: firsts[k - 1]["bucket"] for k, row in enumerate(firsts)}
    narrow = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))

    def rows(batch):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for doc_id, value in batch:
            packed = squeeze((value or "").encode("utf-8", "surrogatepass"))
            yield number(doc_id), False, doc_id, packed
            if doc_id in goes:
                yield goes[doc_id], True, doc_id, packed

    moved = map_rows(narrow, rows, f"bucket int, ghost boolean, doc_id {kind}, packed binary")
    return moved.repartition("bucket").sortWithinPartitions(
        "bucket", "ghost", F.col("doc_id").desc_nulls_last(), F.xxhash64("packed"), "packed")


def compare_edits(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they are.

    The edited form has its last third replaced by the start of the next text by
    descending id (after the last comes the first; null ids are last, ties go by text
    hash). Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, bands_edited, bands_next. Null texts are empty. Repeated rows
    follow one another. A lone row is its own next. An empty table gives none.
    """
    placed = with_next(docs, id, text)

    def rows(batch):
        walk, expand = Embedding(), zstandard.ZstdDecompressor().decompress
        before = None
        for bucket, ghost, doc_id, packed in batch:
            value = expand(packed).decode("utf-8", "surrogatepass")
            codes = code_points(value)
            ticks = walk.read(codes)
            mine = walk.fingerprint(codes, ticks)
            if before and before[0] == bucket:
                yield finish(walk, before, value, mine)
            before = None if ghost else (bucket, doc_id, value, codes, ticks, mine)

    def finish(walk, before, following, next_print):
        _, doc_id, value, codes, ticks, mine = before
        changed, same = edited(value, following)
        new = code_points(changed)
        # The walk over the part that both share is the same: go on from its end.
        tail = walk.read(new[same:], int(ticks[same - 1]) if same else 0)
        other = walk.fingerprint(new, np.concatenate([ticks[:same].astype(np.int64), tail.astype(np.int64)]))
        sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        return (doc_id, len(value), sha, mine, other, likeness(mine, other), likeness(mine, next_print),
                shared_bands(mine, other), shared_bands(mine, next_print))

    return map_rows(placed, rows, f"doc_id {docs.schema[id].dataType.simpleString()}, n_chars long, edited_sha256 string, "
                    "fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
                    "bands_edited int, bands_next int")
