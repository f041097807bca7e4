"""Shards of bounded size by extendible hashing.

A directory is indexed by the leading bits of a row's hash. A bucket above the byte
limit splits on one more bit, others stay as they are, until every shard fits. All
bucket sizes down to ROUND_BITS more bits come from one pre-aggregated histogram; only
buckets that are still too large get another, finer one.
"""

from pyspark.sql import DataFrame, functions as F

from tidewatch.session import materialize

SHARD_BYTES = 1 << 20
ROUND_BITS = 16
HASH_BITS = 60


def row_bits(id: str = "doc_id", text: str = "text"):
    """The hash as a string of HASH_BITS bits, of id and text, so that a repeated id can still be split."""
    value = F.md5(F.concat_ws("|", F.coalesce(F.col(id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))))
    bits = F.conv(F.substring(value, 1, HASH_BITS // 4), 16, 2)
    return F.lpad(bits, HASH_BITS, "0")


def sized(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, bits, bytes) of every row."""
    return docs.select(F.col(id).alias("doc_id"), row_bits(id, text).alias("bits"),
                       F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"))


def directory(rows: DataFrame, limit: int = SHARD_BYTES, round_bits: int = ROUND_BITS) -> DataFrame:
    """Shards of ``rows`` (bits, bytes): (shard, depth, shard_bytes, shard_rows, oversize).

    A shard is named by the bits that all its rows begin with. Rows with equal hashes
    cannot be parted: a shard of them above the limit is marked ``oversize``. No rows
    give an empty directory.
    """
    found, top, todo = None, 0, rows.select("bits", "bytes")
    while True:
        bottom = min(top + round_bits, HASH_BITS)
        fine = materialize(todo.groupBy(F.substring("bits", 1, bottom).alias("bits"))
                           .agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")), "histogram")
        depths = F.explode(F.sequence(F.lit(top), F.lit(bottom))).alias("depth")
        # Sizes of all buckets on the way down; a bucket stays at the first depth where it fits.
        sizes = (fine.select("bits", "bytes", "n", depths)
                 .groupBy("depth", F.expr("substring(bits, 1, depth)").alias("shard"))
                 .agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows")))
        parent = F.expr("substring(shard, 1, depth - 1)")
        large = sizes.where(F.col("shard_bytes") > limit).select(
            (F.col("depth") + 1).alias("depth"), F.col("shard").alias("_parent"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("depth") == HASH_BITS)
        roots = sizes.where((F.col("depth") == top) & fits)
        below = (sizes.where(fits & (F.col("depth") > top)).withColumn("_parent", parent)
                 .join(large, ["depth", "_parent"]).drop("_parent"))
        shards = materialize(roots.unionByName(below), "shards")
        found = shards if found is None else found.unionByName(shards)
        rest = sizes.where((F.col("depth") == bottom) & (F.col("shard_bytes") > limit)).select(F.col("shard").alias("_large"))
        rest = materialize(rest, "large-buckets")
        if bottom == HASH_BITS or rest.isEmpty():
            return found.withColumn("oversize", F.col("shard_bytes") > limit)
        todo = todo.join(rest, F.substring("bits", 1, bottom) == F.col("_large"), "left_semi")
        top = bottom


def assign(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """``rows`` with the columns of their shard.

    A row looks itself up under each depth that occurs (a few), so the join is on
    equal prefixes.
    """
    shards = materialize(shards, "directory")
    depths = [r[0] for r in shards.select("depth").distinct().collect()]
    if not depths:
        return rows.join(shards.limit(0), rows.bits == shards.shard)
    prefixes = F.array(*[F.expr(f"substring(bits, 1, {d})") for d in sorted(depths)])
    keyed = rows.withColumn("_prefix", F.explode(prefixes))
    return keyed.join(shards, keyed["_prefix"] == shards["shard"]).drop("_prefix")


def shard_documents(docs: DataFrame, limit: int = SHARD_BYTES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard of every row: doc_id, bytes, shard, depth, shard_bytes, shard_rows, oversize.

    Null texts and ids hash as empty; repeated rows share a shard.
    """
    rows = materialize(sized(docs, id, text), "sized")
    return assign(rows, directory(rows, limit)).drop("bits")


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES, id: str = "doc_id", text: str = "text") -> None:
    """Write ``docs`` as one Parquet folder for each shard, each by one task."""
    narrow = materialize(sized(docs, id, text), "sized")
    shards = materialize(assign(narrow, directory(narrow, limit)).select("bits", "shard").distinct(), "placed")
    named = F.concat(F.lit("b"), F.col("shard")).alias("shard_bits")
    (docs.select(F.struct("*").alias("_row"), row_bits(id, text).alias("bits")).join(shards, "bits")
     .select("_row.*", named).repartition("shard_bits").write.partitionBy("shard_bits").parquet(path))
