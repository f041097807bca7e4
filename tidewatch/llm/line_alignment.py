"""Line deduplication by pairwise alignment.

Documents that share a *rare line run* overlap: a run is the shortest sequence of lines
from some line on with MIN_BLOCK_WORDS words or more, so that it does not recur by
chance and every common block that long begins with one. Each document is paired with
the first that holds each of its runs (by id), never with all others, so pairs grow
with the lines; runs that thousands share need no cap. Pairs are aligned by patience
diff (lines unique on both sides, longest increasing subsequence, recursion between
anchors, then equal neighbours), and aligned blocks of MIN_BLOCK_WORDS words or more are
deleted from the later document. The first document with a block keeps it.
"""

from bisect import bisect_left

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import ASCII_SPACE, map_rows, row_key, utf8
from tidewatch.session import materialize

MIN_BLOCK_WORDS = 25


def line_table(text: str | None, min_words: int = MIN_BLOCK_WORDS) -> tuple[list, list, list]:
    """Line hashes, words of each line, and the run hashes of a text. White space at line ends does not count."""
    if not text:
        return [], [], []
    lines = [line.strip(ASCII_SPACE) for line in utf8(text).split(b"\n")]
    hashes = np.array([xxhash.xxh64_intdigest(line) for line in lines], dtype="<u8")
    words = [len(line.split()) for line in lines]
    total = np.concatenate(([0], np.cumsum(words)))
    ends = np.searchsorted(total, total[:-1] + min_words, side="left")
    raw = hashes.tobytes()
    runs = {xxhash.xxh64_intdigest(raw[8 * i:8 * int(end)]) for i, end in enumerate(ends)
            if end < len(total) and words[i]}
    return hashes.view("<i8").tolist(), words, np.array(sorted(runs), dtype="<u8").view("<i8").tolist()


def anchors(a: list, b: list, low_a: int, high_a: int, low_b: int, high_b: int) -> list[tuple[int, int]]:
    """Lines unique in both ranges, in the longest order-keeping selection (patience sorting)."""
    def unique(lines, low, high):
        seen = {}
        for position in range(low, high):
            seen[lines[position]] = -1 if lines[position] in seen else position
        return seen

    left, right = unique(a, low_a, high_a), unique(b, low_b, high_b)
    pairs = [(left[line], position) for line, position in right.items() if position >= 0 and left.get(line, -1) >= 0]
    pairs.sort(key=lambda p: p[1])
    tops, piles, back = [], [], [None] * len(pairs)
    for k, (in_a, _) in enumerate(pairs):
        pile = bisect_left(tops, in_a)
        back[k] = piles[pile - 1] if pile else None
        if pile == len(tops):
            tops.append(in_a)
            piles.append(k)
        else:
            tops[pile], piles[pile] = in_a, k
    chain, at = [], piles[-1] if piles else None
    while at is not None:
        chain.append(pairs[at])
        at = back[at]
    return chain[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Matched (line of a, line of b), increasing in both."""
    matched, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        low_a, high_a, low_b, high_b = todo.pop()
        while low_a < high_a and low_b < high_b and a[low_a] == b[low_b]:
            matched.append((low_a, low_b))
            low_a, low_b = low_a + 1, low_b + 1
        while low_a < high_a and low_b < high_b and a[high_a - 1] == b[high_b - 1]:
            high_a, high_b = high_a - 1, high_b - 1
            matched.append((high_a, high_b))
        if low_a >= high_a or low_b >= high_b:
            continue
        chain = anchors(a, b, low_a, high_a, low_b, high_b)
        if not chain:
            continue
        previous_a, previous_b = low_a, low_b
        for in_a, in_b in chain:
            todo.append((previous_a, in_a, previous_b, in_b))
            matched.append((in_a, in_b))
            previous_a, previous_b = in_a + 1, in_b + 1
        todo.append((previous_a, high_a, previous_b, high_b))
    return sorted(matched, key=lambda m: m[1])


def common_blocks(a: list, b: list, words: list, min_words: int) -> list[int]:
    """Lines of ``b`` in aligned blocks (consecutive on both sides) of ``min_words`` words or more.

    A run that patience diff cannot place, because its lines repeat or the texts are
    reordered, is found by its shortest run of ``min_words`` words, wherever ``a`` holds that, and extended from there.
    """
    found, block = set(), []

    def close():
        if sum(words[j] for _, j in block) >= min_words:
            found.update(j for _, j in block)

    for i, j in align(a, b):
        if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
            close()
            block = []
        block.append((i, j))
    close()
    # Blocks out of order: walk b once; from each line not found yet, extend from where a holds the run that starts there.
    size = dict(zip(b, words))

    def run(lines, at):
        """The shortest run of ``min_words`` words from a line on; None where there is none, or a line is not in b."""
        total, end = 0, at
        while total < min_words:
            if end == len(lines) or lines[end] not in size:
                return None
            total, end = total + size[lines[end]], end + 1
        return tuple(lines[at:end])

    first: dict = {}
    for i, line in enumerate(a):
        held = run(a, i) if size.get(line) else None
        if held is not None:
            first.setdefault(held, i)
    j = 0
    while j < len(b):
        i = first.get(run(b, j)) if words[j] and j not in found else None
        if i is None:
            j += 1
            continue
        length = 0
        while i + length < len(a) and j + length < len(b) and a[i + length] == b[j + length]:
            length += 1
        found.update(range(j, j + length))
        j += length
    return sorted(found)


def repeated_lines(docs: DataFrame, min_words: int = MIN_BLOCK_WORDS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _hash, deleted, keep, partners) of each document with lines to delete: one entry of ``keep`` a line; a written table."""
    id_key, hash_key = row_key(id, text)
    kind = docs.schema[id].dataType.simpleString()
    narrow = docs.select(F.col(id).alias("doc_id"), id_key, hash_key, F.col(text).alias("text"))
    lines = materialize(map_rows(
        narrow, lambda rows: ((i, k, h, *line_table(t, min_words)) for i, k, h, t in rows),
        f"doc_id {kind}, _id string, _hash long, lines array<long>, words array<int>, runs array<long>"), "lines")
    # Rows equal in id and text are one document. Order: by id, null last, then by text hash.
    key = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "_id", "_hash").alias("doc")
    runs = lines.select(key, F.explode("runs").alias("run"))
    first = (runs.groupBy("run").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
             .where(~F.col("first").eqNullSafe(F.col("last"))).select("run", "first"))
    # Copies of one passage give one pair for each of their runs: merge these inside tasks.
    pairs = (runs.join(first, "run").where(~F.col("doc").eqNullSafe(F.col("first")))
             .groupBy(F.col("doc._id").alias("_id"), F.col("doc._hash").alias("_hash"),
                      F.col("first._id").alias("first_id"), F.col("first._hash").alias("first_hash"))
             .agg(F.count(F.lit(1)).alias("shared")))
    pairs = materialize(pairs, "pairs")
    one = lines.groupBy("_id", "_hash").agg(F.first("lines").alias("lines"), F.first("words").alias("words"))
    later = pairs.select("_id", "_hash").distinct()
    sides = materialize(one.join(later.union(pairs.select("first_id", "first_hash")).distinct(), ["_id", "_hash"], "left_semi"), "sides")
    mine = pairs.join(sides, ["_id", "_hash"])
    theirs = sides.select(F.col("_id").alias("first_id"), F.col("_hash").alias("first_hash"), F.col("lines").alias("first_lines"))
    # A first document may have very many partners: nothing is grouped above this join, so AQE may split it.
    both = mine.join(theirs, ["first_id", "first_hash"]).select("_id", "_hash", "first_lines", "lines", "words")

    def aligned(rows):
        for row_id, mark, a, b, words in rows:
            yield row_id, mark, common_blocks(a, b, words, min_words), len(b)

    found = map_rows(both, aligned, "_id string, _hash long, positions array<int>, n_lines int")
    merged = found.groupBy("_id", "_hash", "n_lines").agg(
        F.array_distinct(F.flatten(F.collect_set("positions"))).alias("positions"),
        F.count(F.lit(1)).alias("partners")).where(F.size("positions") > 0)

    def masks(rows):
        for row_id, mark, count, positions, partners in rows:
            keep = np.ones(count, dtype=bool)
            keep[positions] = False
            yield row_id, mark, len(positions), keep.tolist(), partners

    return materialize(map_rows(
        merged, masks, "_id string, _hash long, deleted long, keep array<boolean>, partners long"), "repeated-lines")


def kept_lines(text: str, keep: str):
    """The lines of ``text`` whose entry in ``keep`` is true, as a column."""
    lines = F.split(F.col(text), "\n", -1)
    return F.array_join(F.filter(lines, lambda line, i: F.element_at(keep, i + 1)), "\n")


def dedup_lines(docs: DataFrame, min_words: int = MIN_BLOCK_WORDS, id: str = "doc_id", text: str = "text",
                n_chars: str | None = None) -> DataFrame:
    """``docs`` with repeated blocks deleted from later documents; no row goes.

    Copies of a whole document lose all lines and stay as empty texts. Repeats inside
    one document, null and empty texts are left alone; repeated rows count as one
    document and change alike. ``n_chars`` names a column to hold the new length.
    """
    edits = repeated_lines(docs, min_words, id, text)
    id_key, hash_key = row_key(id, text)
    rows = docs.select(F.struct("*").alias("_row"), id_key, hash_key)
    joined = rows.join(edits.select("_id", "_hash", "keep").hint("merge"), ["_id", "_hash"], "left")
    new = F.when(F.col("keep").isNull(), F.col("_text")).otherwise(kept_lines("_text", "keep"))
    out = joined.withColumn("_text", F.col(f"_row.{text}")).withColumn("_new", new)
    columns = []
    for name in docs.columns:
        value = F.col("_row").getField(name)
        if name == text:
            value = F.col("_new")
        elif name == n_chars:
            value = F.when(F.col("keep").isNull(), value).otherwise(
                F.char_length("_new")).cast(docs.schema[name].dataType)
        columns.append(value.alias(name))
    return out.select(*columns)


def report(docs: DataFrame, min_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """For every row: doc_id, n_lines, deleted_lines, partners, clean_sha256, clean_chars."""
    edits = repeated_lines(docs, min_words)
    id_key, hash_key = row_key()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"), id_key, hash_key)
    joined = rows.join(edits.hint("merge"), ["_id", "_hash"], "left")
    clean = F.when(F.col("keep").isNull(), F.col("_text")).otherwise(kept_lines("_text", "keep"))
    cut = joined.withColumn("_clean", clean)
    return cut.select(
        "doc_id", F.when(F.col("_text") == "", 0).otherwise(F.size(F.split("_text", "\n", -1))).cast("long").alias("n_lines"),
        F.coalesce("deleted", F.lit(0)).cast("long").alias("deleted_lines"),
        F.coalesce("partners", F.lit(0)).alias("partners"),
        F.sha2("_clean", 256).alias("clean_sha256"), F.char_length("_clean").cast("long").alias("clean_chars"))
