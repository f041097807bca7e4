"""Merkle manifest of a dataset: a tree of digests for each group, and one over the groups' roots.

Leaves are numbered along their order within their tree by a range shuffle and prefix
sums over the partitions. The tree is climbed LEVELS levels at a time: ``fanout ** LEVELS``
consecutive nodes are a block, blocks are dealt out by one shuffle, and inside a block
each level pivots the children of a parent into ``fanout`` slot columns by conditional
aggregates. The slots put together are hashed to the parent; without the own slot they
are the siblings that a proof needs. A hot tree is many blocks, each of bounded size.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.session import materialize

FANOUT, LEVELS = 2, 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_WIDE = "decimal(38,0)"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of texts put together."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """'-' for null, else byte count, ':' and the value, so that no two rows write alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """Digest of a row's COLUMNS; ``changed`` replaces some of them."""
    return digest(*[field(changed.get(name, F.col(name))) for name in COLUMNS])


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` (tree, ...) with i, the number of a row along ``order`` within its tree from 0, and nodes, its tree's rows.

    Partitions of the range shuffle hold consecutive rows; a row's number is its place in the
    partition plus the rows of its tree in the ones before. Equal rows stay apart by their
    place in the input, so that a large group of them is split as well.
    """
    placed = (nodes.withColumn("_seq", F.monotonically_increasing_id())
              .repartitionByRange("tree", *order, "_seq").sortWithinPartitions("tree", *order, "_seq").drop("_seq")
              .withColumn("_at", F.monotonically_increasing_id()))
    placed = materialize(placed.withColumn("_part", F.shiftright("_at", 33)), "merkle-order")
    runs = placed.groupBy("_part", "tree").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # One row for each partition and tree in it.
    earlier = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_part", "tree", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
                       F.sum("_n").over(Window.partitionBy("tree")).alias("nodes"))
    runs = materialize(runs, "merkle-runs")
    return (placed.join(runs, ["_part", "tree"])
            .withColumn("i", F.col("_before") + F.col("_at") - F.col("_first"))
            .drop("_part", "_at", "_first", "_before"))


def _block_levels(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``nodes`` (tree, i, nodes, h, ...) with block, top (the block's digest) and path (the siblings of each level)."""
    size = fanout ** levels
    parents = [f"_p{level}" for level in range(levels, 0, -1)]
    placed = nodes.withColumn("block", F.floor(F.col("i") / F.lit(size))).withColumns(
        {f"_p{level}": F.floor(F.col("i") / F.lit(fanout ** level)) for level in range(1, levels + 1)})
    at = (placed.repartition("tree", "block")
          .withColumns({"top": F.col("h"), "path": F.array().cast("array<struct<left:binary,right:binary>>")}))
    for level in range(1, levels + 1):
        # Each level's order is a prefix of the first one's: the rows are sorted once.
        family = Window.partitionBy("tree", "block", *parents[:levels - level + 1])
        own = F.pmod(F.floor(F.col("i") / F.lit(fanout ** (level - 1))), F.lit(fanout))
        slots = [f"_s{k}" for k in range(fanout)]
        at = at.withColumn("_own", own).withColumns(
            {slot: F.coalesce(F.max(F.when(F.col("_own") == k, F.col("top"))).over(family), F.lit(""))
             for k, slot in enumerate(slots)})
        beside = [F.concat(*[F.when(after(F.col("_own"), k), F.col(slot)).otherwise("") for k, slot in enumerate(slots)])
                  for after in (lambda own, k: own > k, lambda own, k: own < k)]
        step = F.struct(F.unhex(beside[0]).alias("left"), F.unhex(beside[1]).alias("right"))
        # A tree of one node at this level is done.
        going = F.col("nodes") > F.lit(fanout ** (level - 1))
        at = at.withColumns({
            "path": F.when(going, F.concat("path", F.array(step))).otherwise(F.col("path")),
            "top": F.when(going, digest(*[F.col(slot) for slot in slots])).otherwise(F.col("top"))})
        at = at.drop("_own", *slots)
    return at.drop(*parents)


def climb(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """``nodes`` (tree, i, nodes, h, ...) with root, their tree's last digest, and path, the siblings up to it.

    Rounds go on until no tree has more than one node; a written table of each is kept.
    """
    now, rounds, size = nodes, [], fanout ** levels
    while True:
        now = materialize(_block_levels(now, fanout, levels), "merkle-level")
        rounds.append(now)
        most = now.agg(F.max("nodes")).first()[0]
        if most is None or most <= size:
            break
        now = now.where(F.col("i") % size == 0).select(
            "tree", F.col("block").alias("i"), F.ceil(F.col("nodes") / F.lit(size)).alias("nodes"), F.col("top").alias("h"))
    above = rounds.pop().withColumnRenamed("top", "root")
    while rounds:
        upper = above.select("tree", F.col("i").alias("block"), F.col("path").alias("_path"), "root")
        above = (rounds.pop().drop("top").join(upper, ["tree", "block"])
                 .withColumn("path", F.concat("path", "_path")).drop("_path"))
    return above.drop("block")


def manifest(docs: DataFrame, carry: tuple[str, ...] = (), fanout: int = FANOUT, levels: int = LEVELS,
             id: str = "doc_id", group: str = "lang") -> DataFrame:
    """doc_id, leaf, subroot, root, proof, and the columns ``carry``, of every row of ``docs``.

    One tree for each ``group`` over its leaves by ``id``, and one over their subroots by
    group: a missing group is one of its own and comes first, as do missing ids; rows of
    one id go by their leaf, equal rows are a leaf each. Every ``fanout`` consecutive nodes
    become the digest of their digests put together (the last run: fewer, even one), until one is
    left. proof holds (left, right) of each level, the siblings before and after, as raw
    digests. Any COLUMNS may be null; texts are hashed whole. An empty table gives an empty
    one. Other columns are not looked at. ``carry`` must not name leaf, subroot, root or proof.
    """
    # A null group must not meet an empty one; '0' sorts before '1'.
    tree = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    kept = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("int")
    leaves = docs.select(tree.alias("tree"), F.col(id).alias("doc_id"), leaf().alias("h"), kept.alias("_carried"))
    below = climb(numbered(leaves, ["doc_id", "h"]), fanout, levels)
    below = materialize(below.select("tree", "doc_id", "h", "_carried", F.col("root").alias("subroot"), "path"), "merkle-trees")
    tops = below.groupBy("tree").agg(F.first("subroot").alias("h"))
    above = climb(numbered(tops.select(F.lit("").alias("tree"), F.col("tree").alias("_group"), "h"), ["_group"]), fanout, levels)
    above = materialize(above.select(F.col("_group").alias("tree"), "root", F.col("path").alias("_path")), "merkle-tops")
    return below.join(above, "tree").select(
        "doc_id", F.col("h").alias("leaf"), "subroot", "root", F.concat("path", "_path").alias("proof"),
        *[F.col("_carried")[c].alias(c) for c in carry])


def _hex(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def fold(start: Column, proof: str = "proof") -> Column:
    """The root that ``start`` and the siblings of a proof lead to."""
    return F.aggregate(proof, start, lambda below, step: digest(_hex(step["left"]), below, _hex(step["right"])))


def proof_digest(proof: str = "proof") -> Column:
    """Digest of all siblings, level by level, left to right; of nothing where there are none."""
    beside = F.transform(proof, lambda step: F.concat(_hex(step["left"]), _hex(step["right"])))
    return F.sha2(F.array_join(beside, ""), 256)


def audit(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Every row's proof against a tampered leaf: n_chars plus 1 where 7 divides the CRC-32 of the id."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    other = leaf(n_chars=F.col("n_chars").cast(_WIDE) + 1)
    marked = docs.withColumn("_other", F.when(tampered, other))
    found = manifest(marked, ("_other",), fanout, levels).withColumn("folded_root", fold(F.coalesce("_other", "leaf")))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))
