"""Sharding by extendible hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Bits of the hash of the keys, and of all: the text's follow, so that rows with one key or none split too.
KEY_BITS, BITS = 60, 120


def _bits(text: Column) -> Column:
    return F.lpad(F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 2), KEY_BITS, "0")


def hash_bits(*keys: str, text: str = "text") -> Column:
    """60 bits of an MD5 over the keys' text and 60 of one over the text, as a string of 0 and 1."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat(_bits(F.concat_ws("|", *map(told, keys))), _bits(told(text)))


def shard_directory(sized: DataFrame, limit: int, step: int = 10) -> DataFrame:
    """The directory: (shard, depth, shard_bytes, shard_rows) for `sized` (bits, n_bytes, n_rows).

    A bucket is a hash prefix. Starting from the whole table, only a bucket over `limit` bytes
    splits on one more bit. Sums are made once per `step` bits in a histogram of prefixes (whose
    size follows the number of shards, not of rows); rows are looked at again only inside
    buckets that are still too large after these bits. A bucket whose rows all have one hash
    can't split and stays as it is (a single row over the limit, or equal rows).
    """
    open_rows, done, depth = sized, None, 0
    while True:
        deep = min(depth + step, BITS)
        cells = open_rows.groupBy(F.substring("bits", 1, deep).alias("cell")).agg(
            F.sum("n_bytes").alias("b"), F.sum("n_rows").alias("n"), F.min("bits").alias("low"), F.max("bits").alias("high")
        )
        tree = saved(
            cells.select(F.explode(F.sequence(F.lit(depth), F.lit(deep))).alias("d"), "*")
            .groupBy("d", F.expr("substring(cell, 1, d)").alias("shard"))
            .agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"), F.min("low").alias("low"), F.max("high").alias("high"))
            .withColumn("fits", (F.col("shard_bytes") <= limit) | (F.col("low") == F.col("high")))
        )
        # A bucket is in the directory if it fits and its parent does not.
        parents = tree.where("not fits").select((F.col("d") + 1).alias("d"), F.col("shard").alias("parent"))
        inner = tree.where(F.col("d") > depth).withColumn("parent", F.expr("substring(shard, 1, d - 1)")).join(parents, ["d", "parent"], "left_semi")
        leaves = tree.where((F.col("d") == depth) & F.col("fits")).unionByName(inner.where("fits").drop("parent"))
        leaves = leaves.select("shard", F.col("d").alias("depth"), "shard_bytes", "shard_rows")
        done = leaves if done is None else done.unionByName(leaves)
        still = tree.where((F.col("d") == deep) & ~F.col("fits")).select(F.col("shard").alias("cell"))
        if deep == BITS or still.isEmpty():
            return done
        open_rows = open_rows.withColumn("cell", F.substring("bits", 1, deep)).join(still, "cell", "left_semi").drop("cell")
        depth = deep


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """`rows` with `__number`, from 0 for each value of `by`, without a task that has all rows of one value:
    rows are numbered within the partitions that they were saved from, and what lies before is added."""
    kept = saved(rows.withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", PART_BITS))
    parts = kept.groupBy(by, "__part").agg(F.count("*").alias("__n"))  # a row for each partition that has some
    before = parts.select(by, "__part", (F.sum("__n").over(Window.partitionBy(by).orderBy("__part")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(by, "__part").orderBy("__at")) - 1
    return kept.join(before, [by, "__part"]).withColumn("__number", F.col("__before") + inside).drop("__at", "__part", "__before")


#: Bits of a row's number that tell it apart within its partition.
PART_BITS = 33


def shard_rows(df: DataFrame, limit: int, keys: tuple[str, ...] = ("doc_id",), size: Column | None = None) -> DataFrame:
    """`df` with `shard` (hash prefix, '' if one shard holds all), `shard_depth`, `shard_bytes`
    and `shard_rows`; columns of these names are replaced.

    Null keys hash as empty text, null text has 0 bytes, an empty table gives an empty result; other
    columns are kept. Rows with one key, or none, split by their texts; equal rows, which no hash
    tells apart, are dealt out by number where they exceed the limit together (`shard` is then the hash, #
    and a number). So every shard fits but that of a single row of more than `limit` bytes.
    """
    names = ("shard", "shard_depth", "shard_bytes", "shard_rows")
    kept = df.drop(*names)
    size = F.coalesce(F.octet_length("text"), F.lit(0)) if size is None else size
    keyed = kept.withColumn("__bits", hash_bits(*keys)).withColumn("__bytes", size.cast("long"))
    sized = saved(keyed.groupBy(F.col("__bits").alias("bits")).agg(F.sum("__bytes").alias("n_bytes"), F.count("*").alias("n_rows")))
    directory = saved(shard_directory(sized, limit))
    depths = sorted(r[0] for r in directory.select("depth").distinct().collect())  # BITS + 1 values at most
    # The shard of a hash: its only prefix that is in the directory.
    of_bits = sized.select("bits", F.explode(F.array(*map(F.lit, depths or [0]))).alias("depth")).withColumn("shard", F.expr("substring(bits, 1, depth)"))
    of_bits = of_bits.join(directory, ["shard", "depth"]).select(F.col("bits").alias("__bits"), "shard", F.col("depth").alias("shard_depth"), "shard_bytes", "shard_rows")
    equal = (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)
    out = keyed.join(of_bits.where(~equal), "__bits").drop("__bits", "__bytes")
    hot = saved(of_bits.where(equal).select("__bits", "shard", "shard_depth", "shard_bytes", F.col("shard_rows").alias("__rows")))
    if hot.isEmpty():
        return out
    each = F.col("__bytes")
    room = F.greatest(F.floor(F.lit(limit) / each), F.lit(1))
    dealt = numbered(keyed.join(hot.drop("shard_bytes"), "__bits"), "__bits").withColumn("__slot", F.floor(F.col("__number") / room))
    rows = F.least(room, F.col("__rows") - F.col("__slot") * room)
    dealt = dealt.withColumns({"shard": F.concat("shard", F.lit("#"), F.col("__slot").cast("string")), "shard_bytes": each * rows, "shard_rows": rows})
    return out.unionByName(dealt.select(*out.columns))
