"""SimHash near-duplicates: word-shingle fingerprints linked through Burkhard-Keller trees.

Fingerprints within RADIUS bits agree, by the pigeonhole principle, on at least
one of RADIUS + 1 bit ranges. A *shard* holds the distinct fingerprints that agree on
one range, and has its own tree, whose children are keyed by their integer
distance to the parent; a search follows only the edges within the radius.

A tree is shipped to the fingerprints that may match it by the shuffle that deals
out the shards: the forest grows with the data, so no part of it is broadcast.
Shards of more than SHARD_LIMIT fingerprints are cut again by the same principle
over the bits still free, which is exact; at the last level free bits bound them.
A shard sends on its connected parts (one edge for each member), never its pairs.
"""

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import connected_components, map_rows, row_key, utf8
from tidewatch.session import materialize

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
SHARD_LIMIT = 1024
LEVELS = 4
ALL_BITS = (1 << 64) - 1


def fingerprint(text: str | None, words_each: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included; 0 without words."""
    words = utf8(text).lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts, ends = [0, *(ends + 1).tolist()], ends.tolist()
    n, width = max(len(words) - words_each, 0) + 1, min(words_each, len(words)) - 1
    counts, offsets = np.zeros(64, dtype=np.int64), np.arange(8, dtype=np.int64) * 256
    for low in range(0, n, 1 << 16):
        raw = b"".join(xxhash.xxh64_digest(joined[starts[i]:ends[i + width]], SEED)[::-1]
                       for i in range(low, min(low + (1 << 16), n)))
        block = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8)
        counts += (np.bincount((block + offsets).ravel(), minlength=256 * 8).reshape(8, 256) @ BITS_OF_BYTE).ravel()
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


class BKTree:
    """Values by Hamming distance: a child hangs below its parent under their distance."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        """Add a value that the tree does not hold yet."""
        self.values.append(value)
        self.children.append({})
        if len(self.values) == 1:
            return
        at, new = 0, len(self.values) - 1
        while True:
            distance = (self.values[at] ^ value).bit_count()
            below = self.children[at].get(distance)
            if below is None:
                self.children[at][distance] = new
                return
            at = below

    def near(self, value: int, radius: int) -> Iterator[int]:
        """Positions of the values within ``radius``."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                yield at
            todo.extend(child for edge, child in self.children[at].items()
                        if distance - radius <= edge <= distance + radius)


def shard_parts(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges (member, first member of its connected part) among distinct values."""
    tree = BKTree()
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for position, value in enumerate(values):
        for other in tree.near(value, radius):
            a, b = find(position), find(other)
            parent[max(a, b)] = min(a, b)
        tree.add(value)
    return [(value, values[root]) for position, value in enumerate(values)
            if (root := find(position)) != position]


def sub_masks(mask: int, parts: int) -> list[int]:
    """``mask`` with one of ``parts`` even shares of its free bits added, for each share."""
    free = [bit for bit in range(64) if not mask >> bit & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << bit for bit in free[low:high]) for low, high in zip(cuts, cuts[1:])]


def _link_shards(rows: Iterator[tuple], radius: int) -> Iterator[tuple]:
    """Rows (mask, value, fp) sorted by shard to the edges of each shard."""
    key, held = None, []
    for mask, value, fp in rows:
        if (mask, value) != key:
            yield from ((signed(a), signed(b)) for a, b in shard_parts(held, radius))
            key, held = (mask, value), []
        held.append(fp & ALL_BITS)
    yield from ((signed(a), signed(b)) for a, b in shard_parts(held, radius))


def links(fingerprints: DataFrame, radius: int = RADIUS, limit: int = SHARD_LIMIT) -> DataFrame:
    """Edges (a, b) that connect all distinct ``fp`` at ``radius`` or fewer bits, directly or in steps."""
    masks = {0: sub_masks(0, radius + 1)}
    todo = fingerprints.select("fp", F.explode(F.array(*[F.lit(signed(m)) for m in masks[0]])).alias("mask"))
    level_masks, found = masks[0], None
    for level in range(LEVELS):
        keyed = materialize(todo.withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))), "shards")
        sizes = keyed.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
        members = keyed.join(sizes, ["mask", "value"])
        last = level == LEVELS - 1
        ready = members if last else members.where(F.col("_n") <= limit)
        dealt = ready.select("mask", "value", "fp").repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")
        edges = materialize(map_rows(dealt, lambda rows: _link_shards(rows, radius), "a long, b long"), "links")
        found = edges if found is None else found.union(edges)
        if last:
            break
        large = materialize(members.where(F.col("_n") > limit).select("mask", "fp"), "large-shards")
        if large.isEmpty():
            break
        finer = {m: sub_masks(m, radius + 1) for m in level_masks}
        pairs = [F.struct(F.lit(signed(m)).alias("of"), F.lit(signed(s)).alias("sub")) for m in finer for s in finer[m]]
        table = fingerprints.sparkSession.range(1).select(F.explode(F.array(*pairs)).alias("p")).select(
            F.col("p.of").alias("mask"), F.col("p.sub").alias("sub"))
        todo = large.join(F.broadcast(table), "mask").select("fp", F.col("sub").alias("mask"))
        level_masks = [s for m in finer for s in finer[m]]
    return found


def with_fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, _hash, fp): one row for each row of ``docs``; the texts are not carried on."""
    id_type = docs.schema[id].dataType.simpleString()
    narrow = docs.select(F.col(id).alias("doc_id"), F.xxhash64(text).alias("_hash"), F.col(text).alias("text"))
    return map_rows(narrow, lambda rows: ((i, h, signed(fingerprint(t))) for i, h, t in rows),
                    f"doc_id {id_type}, _hash long, fp long")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """Fingerprint and component of every row: (doc_id, _hash, fp, component_id, component).

    ``component_id`` is the smallest id of the connected component (rows with a null
    id take part, and an all-null component has a null id), ``component`` its smallest
    fingerprint. Null and empty texts have fingerprint zero, linked like any other.
    Copies meet as one fingerprint; repeated rows are kept. An empty table gives none.
    """
    rows = materialize(with_fingerprints(docs, id, text), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = connected_components(links(classes.select("fp"), radius))
    joined = (classes.join(roots, classes.fp == roots.node, "left")
              .select("fp", "least", F.coalesce("root", "fp").alias("component")))
    joined = materialize(joined, "members")
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    members = materialize(joined.select("fp", "component").join(least, "component"), "components")
    return rows.join(members, "fp").select("doc_id", "_hash", "fp", "component_id", "component")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each component of :func:`near_duplicates`: that with its smallest id.

    Ties (the id on several texts, repeated rows, all ids null) keep the least
    (text hash, row). Null and empty texts are one component. Columns stay as they are.
    """
    found = materialize(near_duplicates(docs, id, text, radius), "near-duplicates")
    # Rows are merged inside tasks before both shuffles, so a component of any size sends one row a task.
    each = found.groupBy("component", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), "_hash").agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("_copies"))
    stays = each.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_hash", "_id", "_copies")).alias("_s"))
    kept = materialize(stays.select("_s._id", "_s._hash", "_s._copies"), "kept-documents")
    id_key, hash_key = row_key(id, text)
    rows = docs.select(F.struct("*").alias("_row"), id_key, hash_key).join(kept.hint("merge"), ["_id", "_hash"])
    single = rows.where(F.col("_copies") == 1).select("_row.*")
    if kept.where(F.col("_copies") > 1).isEmpty():
        return single
    repeated = (rows.where(F.col("_copies") > 1).groupBy("_id", "_hash").agg(F.min("_row").alias("_row")))
    return single.unionByName(repeated.select("_row.*"))
