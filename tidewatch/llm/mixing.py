"""Mix sources to target weights by balanced sampling with the cube method.

A source that may take r times its words takes every document floor(r) times and
once more with probability r - floor(r). The *flight* moves these fractions: of three
undecided documents it shifts the probabilities along the null space of their
(document, token) columns, which keeps both expected totals, until one is 0 or 1.
Blocks of one source fly apart and leave at most two undecided documents each, which
fly on together, level by level. The last two of a source *land* on the outcome
nearest to its token total, and one exchange between a taken and a left document
takes up what the landing missed.
"""

import bisect
import hashlib

from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.llm.common import WORD, map_rows, row_key
from tidewatch.session import materialize

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST_TIMES = 2
BLOCK_UNITS = 2048
NEARLY = 1e-9


def word_count(text: str = "text"):
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, percent: int = SHARE_PERCENT,
                   most: int = MOST_TIMES) -> DataFrame:
    """(source, _source, source_size, units, target): shares by weight, capped at ``most`` times the size.

    ``sizes`` has source, size. What a capped source cannot take is shared again by
    weight until none is above its cap. One row per source is ordered and looped over;
    documents are not.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    named = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    weight = F.array(*[F.lit(float(w)) for w in weights])
    table = materialize(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("units"))
        .withColumn("_rank", F.row_number().over(order) - 1)
        .select("source", named.alias("_source"), "source_size", "units",
                F.element_at(weight, (F.col("_rank") % len(weights) + 1).cast("int")).alias("weight"))
        .withColumn("cap", most * F.col("source_size").cast("double")), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    budget = total * percent / 100.0
    # The level (words per unit of weight) rises as capped sources drop out; each round caps at least one more.
    level = 0.0
    while True:
        full = F.col("cap") <= level * F.col("weight")
        taken, weight_left = table.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)),
                                       F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not weight_left:
            break
        new = (budget - taken) / weight_left
        if new <= level:
            break
        level = new
    target = F.least(F.col("cap"), F.lit(float(level)) * F.col("weight"))
    return table.withColumn("target", target).drop("weight", "cap")


def draw(seed: int, key: str, turn: int) -> float:
    """A reproducible number in [0, 1)."""
    raw = hashlib.blake2b(f"{seed}|{key}|{turn}".encode(), digest_size=8).digest()
    return int.from_bytes(raw, "big") / 2**64


def fly(units, seed: int):
    """Decide units (key, size, probability) one by one; yields (key, size, 0 or 1), returns those left.

    Three undecided units and two constraints leave one direction u with
    sum(u) = 0 and sum(u * size) = 0. Of the two ends of that line one is chosen so
    that each probability keeps its expectation.
    """
    pool = []
    for turn, unit in enumerate(units):
        pool.append(list(unit))
        while len(pool) == 3 or len(pool) == 2 and pool[0][1] == pool[1][1]:
            sizes = [u[1] for u in pool]
            if len(pool) == 2:
                way = [1.0, -1.0]
            else:
                a, b, c = sizes
                way = [float(b - c), float(c - a), float(a - b)]
                if not any(way):
                    way = [1.0, -1.0, 0.0]
            ahead = min(((1 - u[2]) / w if w > 0 else u[2] / -w) for u, w in zip(pool, way) if w)
            back = min((u[2] / w if w > 0 else (1 - u[2]) / -w) for u, w in zip(pool, way) if w)
            step = ahead if draw(seed, pool[-1][0], turn) * (ahead + back) < back else -back
            undecided = []
            for u, w in zip(pool, way):
                p = u[2] + step * w
                if p < NEARLY or p > 1 - NEARLY:
                    yield u[0], u[1], int(p > 0.5)
                else:
                    u[2] = p
                    undecided.append(u)
            pool = undecided
    return pool


def land(pool, decided, goal: float):
    """Decide the last units of a source, then exchange one pair, to come nearest to ``goal`` tokens."""
    have = sum(size for _, size, taken in decided if taken)
    choices = [[]]
    for unit in pool:
        choices = [c + [taken] for c in choices for taken in (0, 1)]
    best = min(choices, key=lambda c: (abs(have + sum(u[1] * t for u, t in zip(pool, c)) - goal), c))
    decided = decided + [(u[0], u[1], t) for u, t in zip(pool, best)]
    gap = goal - sum(size for _, size, taken in decided if taken)
    inside = sorted((size, key) for key, size, taken in decided if taken)
    outside = sorted((size, key) for key, size, taken in decided if not taken)
    best_gap, swap = abs(gap), None
    for size, key in inside:
        at = bisect.bisect_left(outside, (size + gap,))
        for other in outside[max(at - 1, 0):at + 1]:
            left = abs(gap - (other[0] - size))
            if left < best_gap:
                best_gap, swap = left, (key, other[1])
    flips = set(swap or ())
    return [(key, size, 1 - taken if key in flips else taken) for key, size, taken in decided]


def _decide(rows, seed: int, last: bool):
    """Rows (source, block, goal, key, size, p) sorted by block, smallest hash first, to decisions."""
    def finish(block, units):
        source, number, goal = block
        flight, decided = fly(units, seed), []
        while True:
            try:
                decided.append(next(flight))
            except StopIteration as end:
                pool = end.value
                break
        if last:
            decided, pool = land(pool, decided, goal), []
        for key, size, taken in decided:
            yield source, key, size, float(taken), True
        for key, size, p in pool:
            yield source, key, size, float(p), False

    held, units = None, []
    for source, number, goal, key, size, p in rows:
        if held is None or (source, number) != held[:2]:
            if held:
                yield from finish(held, units)
            held, units = (source, number, goal), []
        units.append((key, size, p))
    if held:
        yield from finish(held, units)


def balanced_sample(units: DataFrame, seed: int = 0, block_units: int = BLOCK_UNITS) -> DataFrame:
    """``units`` (_source, key, size, p) to (key, taken 0 or 1), near each source's sum(p * size) and sum(p).

    Blocks follow a hash of the key, so that any partitioning gives the same sample.
    The goal of the landing is what the units still undecided at its level expect.
    """
    done, todo = None, units
    while True:
        # Summed as decimals: the order in which tasks report must not move the goal, and with it a landing.
        expected = (F.col("p") * F.col("size")).cast("decimal(28,9)")
        sums = todo.groupBy("_source").agg(F.count(F.lit(1)).alias("_n"), F.sum(expected).cast("double").alias("goal"))
        blocks = materialize(sums.select("_source", "goal", F.ceil(F.col("_n") / block_units).alias("blocks")), "blocks")
        most = blocks.agg(F.max("blocks")).first()[0]
        if most is None:
            break
        # Hot sources are many blocks: the join has one row per source, and the shuffle goes by block.
        tagged = todo.join(blocks, "_source").withColumn("_mark", F.xxhash64("key", F.lit(seed)))
        dealt = (tagged.withColumn("block", F.pmod("_mark", "blocks")).repartition("_source", "block")
                 .sortWithinPartitions("_source", "block", "_mark", "key"))
        last = most == 1
        out = materialize(map_rows(
            dealt.select("_source", "block", "goal", "key", "size", "p"),
            lambda rows: _decide(rows, seed, last), "_source string, key string, size long, p double, decided boolean"),
            "flight")
        decided = out.where("decided").select("key", F.col("p").cast("int").alias("taken"))
        done = decided if done is None else done.union(decided)
        if last:
            break
        todo = out.where(~F.col("decided")).drop("decided")
    return done if done is not None else units.select("key", F.lit(0).alias("taken")).limit(0)


def numbered(rows: DataFrame, key: str, place: str) -> DataFrame:
    """Number the rows of each key from 0 on (``_copy``); ``place`` is a written monotonically_increasing_id.

    A key's rows are numbered inside the partition that wrote them, beyond the rows of the partitions
    before it, so that no task gets all rows of a frequent key.
    """
    parts = rows.withColumn("_part", F.shiftright(place, 33))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (parts.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
              .select(key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    inside = F.row_number().over(Window.partitionBy(key, "_part").orderBy(place))
    return (parts.withColumn("_inside", inside).join(starts, [key, "_part"])
            .withColumn("_copy", F.col("_start") + F.col("_inside") - 1).drop("_part", "_inside", "_start"))


def plan(docs: DataFrame, weights=WEIGHTS, percent: int = SHARE_PERCENT, most: int = MOST_TIMES, seed: int = 0,
         id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` without texts, and how often each *unit* is taken, as written tables.

    A unit holds the rows that are equal in id, text and source: (key, _id, _hash, source, source_size, target,
    copies, whole, extra). Each of its copies is taken ``whole`` times and ``extra`` of them once more:
    of the copies' expected number the whole part is certain, and only the fraction flies.
    """
    id_key, hash_key = row_key(id, text)
    named = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    rows = materialize(
        docs.select(F.col(id).alias("doc_id"), id_key, hash_key, F.col(source).alias("source"),
                    word_count(text).alias("size"), F.monotonically_increasing_id().alias("_place"))
        .withColumn("_source", named)
        .withColumn("key", F.concat_ws("|", "_source", F.col("_hash").cast("string"), "_id")), "sizes")
    targets = materialize(source_targets(rows, weights, percent, most), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    expected = F.col("copies") * F.greatest(F.col("_ratio") - F.col("whole"), F.lit(0.0))
    units = materialize(
        rows.groupBy("_source", "key").agg(*[F.first(c).alias(c) for c in ("_id", "_hash", "source")],
                                           F.max("size").alias("size"), F.count(F.lit(1)).alias("copies"))
        .join(targets.select("_source", "source_size", "target"), "_source")
        .withColumn("_ratio", ratio).withColumn("whole", F.floor(F.col("_ratio") + NEARLY))
        .withColumn("_sure", F.floor(expected + NEARLY)).withColumn("p", expected - F.col("_sure")).drop("_ratio"), "units")
    flying = units.where(F.col("p") > NEARLY).select("_source", "key", "size", "p")
    sample = balanced_sample(flying, seed).where(F.col("taken") == 1)
    extra = F.col("_sure") + F.coalesce("taken", F.lit(0))
    return rows, materialize(units.join(sample, "key", "left").select(
        "key", "_id", "_hash", "source", "source_size", "target", "copies", "whole", extra.alias("extra")), "plan")


def mix(docs: DataFrame, weights=WEIGHTS, percent: int = SHARE_PERCENT, most: int = MOST_TIMES, seed: int = 0,
        id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How often each row is taken: (doc_id, _id, _hash, source, size, source_size, target, times), as a written table.

    Rows equal in id, text and source are told apart by their place only: as many of them
    are taken as their expected number says, so that a source of mostly one row meets its target too. A null
    source is a source of its own, after the others. Texts without words have size zero and are
    taken like others. No words at all: every target is zero. An empty table gives none.
    """
    rows, units = plan(docs, weights, percent, most, seed, id, text, source)
    fate = units.select("key", "source_size", "target", "whole", "extra", "copies")
    torn = (F.col("extra") > 0) & (F.col("extra") < F.col("copies"))
    even = rows.join(fate.where(~torn), "key").withColumn("times", F.col("whole") + F.col("extra").cast("boolean").cast("int"))
    uneven = numbered(rows.join(fate.where(torn), "key"), "key", "_place").withColumn(
        "times", F.col("whole") + (F.col("_copy") < F.col("extra")).cast("int"))
    columns = ["doc_id", "_id", "_hash", "source", "size", "source_size", "target", F.col("times").cast("long").alias("times")]
    return materialize(even.select(*columns).unionByName(uneven.select(*columns)), "mixed")


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; columns stay as they are.

    Of rows equal in id, text and source, the first in the table are those taken once more.
    """
    units = plan(docs, **options)[1].withColumnRenamed("source", "_of")
    id_key, hash_key = row_key(*[options.get(name, name_of) for name, name_of in (("id", "doc_id"), ("text", "text"))])
    rows = docs.select(F.struct("*").alias("_row"), id_key, hash_key,
                       F.col(options.get("source", "source")).alias("_source"))

    def meet(part):
        same = ((rows["_id"] == part["_id"]) & (rows["_hash"] == part["_hash"]) & rows["_source"].eqNullSafe(part["_of"]))
        return rows.join(part.hint("merge"), same)

    torn = (F.col("extra") > 0) & (F.col("extra") < F.col("copies"))
    even = meet(units.where(~torn & (F.col("whole") + F.col("extra") > 0))).select(
        "_row", (F.col("whole") + F.col("extra").cast("boolean").cast("int")).alias("_times"))
    few = units.where(torn)
    if not few.isEmpty():
        # Written before they are numbered: a task that runs again must find every copy at its place.
        copies = materialize(meet(few).select("_row", "key", "whole", "extra", F.monotonically_increasing_id().alias("_place")), "copies")
        even = even.union(numbered(copies, "key", "_place").select(
            "_row", F.col("whole") + (F.col("_copy") < F.col("extra")).cast("int")))
    return (even.where("_times > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times").cast("long"))).alias("_time"))
            .select("_row.*"))
