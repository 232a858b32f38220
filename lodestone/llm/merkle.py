"""A Merkle manifest of a table: a hash tree for each group of rows and one over the groups.

Leaves get their places by rank queries on bitmaps of their ids, never by a sort of the leaves; then
arrays of slots, keyed by place, are reduced level by level.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved

#: Nodes of a run, and the levels that one array of slots takes at once: 4,096 slots.
FAN, LEVELS = 16, 3
SLOTS = FAN**LEVELS
#: Bits of a word of the bitmap, and of a word's number that one step of the directory covers.
WORD_BITS, STEP_BITS = 6, 20
#: Rows of a batch that is handed back to Spark: each holds a whole proof.
BATCH_ROWS = 512
PROOF = "array<struct<left:string,right:string>>"


def field_text(value: Column) -> Column:
    """A value as it enters a leaf: `-` for null, else its bytes in UTF-8, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field_text, values)), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, start, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a proof in one text, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda p: F.concat(p["left"], p["right"])), "")


# --- places ------------------------------------------------------------------------------------


def directory(rows: DataFrame) -> DataFrame:
    """(g, z, w, word, n, first, total) of rows (g, z, w, bit): a word of the bitmap of each group's ids
    for every 64 ids of which one is there, how many rows have them, how many rows of the group come
    before, and how many it has. Words are merged before they are shuffled. Counts are summed up
    in steps of 2**20 words, so no sum runs over more, however many rows a group has."""
    words = rows.groupBy("g", "z", "w").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("word"), F.count("*").alias("n"))
    words = saved(words).withColumn("up", F.shiftright("w", STEP_BITS))
    mid = words.groupBy("g", "z", "up").agg(F.sum("n").alias("n")).withColumn("top", F.shiftright("up", STEP_BITS))
    top = mid.groupBy("g", "z", "top").agg(F.sum("n").alias("n"))
    before = lambda by, order: F.sum("n").over(Window.partitionBy(*by).orderBy(*order)) - F.col("n")
    top = top.select("g", "z", "top", before(["g"], ["z", "top"]).alias("first"), F.sum("n").over(Window.partitionBy("g")).alias("total"))
    mid = mid.join(top, ["g", "z", "top"]).select("g", "z", "up", (F.col("first") + before(["g", "z", "top"], ["up"])).alias("first"), "total")
    return words.join(mid, ["g", "z", "up"]).select("g", "z", "w", "word", "n", (F.col("first") + before(["g", "z", "up"], ["w"])).alias("first"), "total")


def placed(leaves: DataFrame, key: str, carried: list[str]) -> DataFrame:
    """`leaves` (g, hash, key, carried ...) with `place`, from 0 in each group by ascending key, and the
    group's `total`. Null keys come first; rows with one key are in the order of their hashes.

    A place is the count of ids in the words before and of the lower bits in the id's own word. Only
    words of repeated ids are looked at further, with equal rows counted together; a key that many rows
    share is ranked by parts of the hashes.
    """
    rows = leaves.withColumn("z", F.col(key).isNotNull().cast("int")).withColumn("id", F.coalesce(F.col(key), F.lit(0)).cast("long"))
    rows = rows.withColumn("w", F.shiftright("id", WORD_BITS)).withColumn("bit", F.col("id").bitwiseAND(63).cast("int"))
    rows = rows.join(directory(rows), ["g", "z", "w"])
    kept = ["g", "hash", key, *[c for c in carried if c != key]]
    single = F.col("n") == F.expr("bit_count(word)")
    alone = rows.where(single).select(*kept, (F.col("first") + F.expr("bit_count(shiftleft(word, 63 - bit))") - 1).alias("place"), "total")

    copies = rows.where(~single).groupBy("z", "w", "id", "first", "total", *kept).agg(F.count("*").alias("m"))
    copies = copies.withColumn("part", F.substring("hash", 1, 3))
    parts = copies.groupBy("g", "z", "w", "id", "part").agg(F.sum("m").alias("n"))
    parts = parts.select("g", "z", "w", "id", "part", (F.sum("n").over(Window.partitionBy("g", "z", "w").orderBy("id", "part")) - F.col("n")).alias("before"))
    inside = F.sum("m").over(Window.partitionBy("g", "z", "w", "id", "part").orderBy("hash", *carried).rowsBetween(Window.unboundedPreceding, -1))
    copies = copies.join(parts, ["g", "z", "w", "id", "part"]).withColumn("at", F.col("first") + F.col("before") + F.coalesce(inside, F.lit(0)))
    # Many equal rows are written out again in two steps, so that no task makes them all.
    runs = copies.withColumn("run", F.explode(F.expr(f"sequence(0L, m - 1, {SLOTS}L)"))).repartition("g", "id", "hash", "run")
    again = runs.select(*kept, "total", F.explode(F.expr(f"sequence(at + run, at + least(run + {SLOTS - 1}L, m - 1))")).alias("place"))
    return alone.unionByName(again)


# --- trees -------------------------------------------------------------------------------------


def height(nodes: int) -> int:
    """Levels until one node is left."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // FAN), levels + 1
    return levels


def reduced(hashes: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level, from the given ones up."""
    out = [hashes]
    for _ in range(levels):
        low = out[-1]
        out.append([hashlib.sha256("".join(low[k : k + FAN]).encode()).hexdigest() for k in range(0, len(low), FAN)])
    return out


def beside(nodes: list[str]) -> tuple[list[str], list[str]]:
    """What stands left and right of each node in its run."""
    left, right = [], []
    for at in range(0, len(nodes), FAN):
        run = nodes[at : at + FAN]
        left += ["".join(run[:k]) for k in range(len(run))]
        right += ["".join(run[k + 1 :]) for k in range(len(run))]
    return left, right


def slot_arrays(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """(g, block, total, hashes, root, carried ...): nodes (g, place, hash, total ...) in arrays of up to
    4,096 slots by their places, with the node that each array is reduced to; saved."""
    kinds = [(c, nodes.schema[c].dataType) for c in carried]
    schema = T.StructType([
        T.StructField("g", T.StringType()), T.StructField("block", T.LongType()), T.StructField("total", T.LongType()),
        T.StructField("hashes", T.ArrayType(T.StringType())), T.StructField("root", T.StringType()), *[T.StructField(c, T.ArrayType(t)) for c, t in kinds],
    ])

    def run(key, table):
        slot = table.column("slot").to_numpy()
        order = [0] * len(slot)
        for k, s in enumerate(slot.tolist()):
            order[s] = k
        table = table.take(pa.array(order))
        total = table.column("total")[0].as_py()
        hashes = table.column("hash").to_pylist()
        root = reduced(hashes, min(LEVELS, height(total)))[-1][0]
        held = {"g": pa.array([key[0].as_py()]), "block": pa.array([key[1].as_py()]), "total": pa.array([total]), "hashes": pa.array([hashes]), "root": pa.array([root])}
        for c in carried:
            column = table.column(c).combine_chunks()
            held[c] = pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
        return pa.table(held)

    keyed = nodes.withColumn("block", F.floor(F.col("place") / SLOTS)).withColumn("slot", (F.col("place") % SLOTS).cast("int"))
    return saved(keyed.select("g", "block", "slot", "hash", "total", *carried).groupBy("g", "block").applyInArrow(run, schema))


def tree(nodes: DataFrame, carried: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The slot arrays of each round, from the leaves up, and (g, root) of all groups."""
    rounds, roots = [], None
    while True:
        blocks = slot_arrays(nodes, [] if rounds else carried)
        rounds.append(blocks)
        done = blocks.where(F.col("total") <= SLOTS).select("g", "root")
        roots = done if roots is None else roots.unionByName(done)
        if (blocks.agg(F.max("total")).first()[0] or 0) <= SLOTS:  # one number
            return rounds, roots
        nodes = blocks.where(F.col("total") > SLOTS).select("g", F.col("block").alias("place"), F.col("root").alias("hash"), F.ceil(F.col("total") / SLOTS).alias("total"))


def with_proofs(blocks: DataFrame, carried: list[str]) -> DataFrame:
    """(g, place, hash, proof, carried ...) of slot arrays that have the `path` from their root up."""
    kinds = {c: blocks.schema[c].dataType.elementType for c in carried}
    proof = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))
    schema = T.StructType([
        T.StructField("g", T.StringType()), T.StructField("place", T.LongType()), T.StructField("hash", T.StringType()), T.StructField("proof", proof),
        *[T.StructField(c, t) for c, t in kinds.items()],
    ])

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                hashes, total = row.column("hashes")[0].as_py(), row.column("total")[0].as_py()
                levels = reduced(hashes, min(LEVELS, height(total)))[:-1]
                sides = [beside(nodes) for nodes in levels]
                above = [(p["left"], p["right"]) for p in row.column("path")[0].as_py()]
                up = [[p[side] for p in above] for side in (0, 1)]
                first = row.column("block")[0].as_py() * SLOTS
                values = {c: row.column(c)[0].values for c in carried}
                for at in range(0, len(hashes), BATCH_ROWS):
                    slots = range(at, min(at + BATCH_ROWS, len(hashes)))
                    flat = [[x for s in slots for x in (*(pair[side][s >> 4 * k] for k, pair in enumerate(sides)), *up[side])] for side in (0, 1)]
                    deep = len(sides) + len(above)
                    pairs = pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in flat], ["left", "right"])
                    proofs = pa.ListArray.from_arrays(pa.array([deep * k for k in range(len(slots) + 1)], pa.int32()), pairs)
                    g = pa.array([row.column("g")[0].as_py()] * len(slots), pa.string())
                    columns = [g, pa.array([first + s for s in slots], pa.int64()), pa.array(hashes[at : at + len(slots)], pa.string()), proofs]
                    yield pa.RecordBatch.from_arrays([*columns, *(v.slice(at, len(slots)) for v in values.values())], names=["g", "place", "hash", "proof", *values])

    return blocks.select("g", "block", "total", "hashes", "path", *carried).mapInArrow(run, schema)


def opened(rounds: list[DataFrame], above: DataFrame, carried: list[str]) -> DataFrame:
    """The leaves of `tree` with their proofs, `above` (g, path) being what goes on from the roots."""
    paths = None
    for k in reversed(range(len(rounds))):
        blocks = rounds[k]
        joined = blocks.where(F.col("total") <= SLOTS).join(above, "g")
        if paths is not None:
            joined = joined.unionByName(blocks.where(F.col("total") > SLOTS).join(paths, ["g", "block"]))
        proofs = with_proofs(joined, carried if k == 0 else [])
        paths = proofs.select("g", F.col("place").alias("block"), F.col("proof").alias("path"))
    return proofs


def in_order(groups: DataFrame) -> DataFrame:
    """`groups` (g ...), one row each, with `place` by ascending g and `total`: ranges of g are numbered
    each by itself, and what lies before a range is added."""
    numbered = saved(groups.repartitionByRange("g").sortWithinPartitions("g").withColumn("number", F.monotonically_increasing_id()))
    numbered = numbered.withColumn("range", F.shiftright("number", 33)).withColumn("inner", F.col("number").bitwiseAND((1 << 33) - 1))
    ranges = numbered.groupBy("range").agg(F.count("*").alias("n"))  # as many rows as partitions
    ranges = ranges.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return numbered.join(ranges, "range").withColumn("place", F.col("before") + F.col("inner")).drop("number", "range", "inner", "before")


def prove(leaves: DataFrame, key: str = "doc_id", group: str = "source", hashed: str = "leaf") -> DataFrame:
    """`leaves` (key, group, hash, any others) with subroot, root and proof: the other nodes of its run
    on each level, as (left, right), from the leaf up to the root over all groups. Columns of these
    names are replaced.

    In a group, leaves ascend by `key`, a whole number; null keys come first, and rows with one key are
    in the order of their hashes, so equal rows have neighbouring places. While nodes are left, every 16
    in a row (at the end fewer, even one) become the hash of their hex digits together. The roots of the
    groups, null first, then by bytes of the name, are reduced likewise. An empty table gives none.
    """
    kept = [c for c in leaves.columns if c not in ("subroot", "root", "proof")]
    own = [F.col(c).alias(f"c{k}") for k, c in enumerate(kept)]
    carried = [f"c{k}" for k in range(len(kept))]
    g = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    rows = saved(leaves.select(*own, g.alias("g"), F.col(hashed).alias("hash")))

    rounds, roots = tree(placed(rows, f"c{kept.index(key)}", carried), carried)
    tops, root = tree(in_order(roots.withColumnRenamed("root", "hash")).select(F.lit("").alias("g"), F.col("g").alias("name"), "place", "hash", "total"), ["name"])
    last = root.first()  # one row at most
    top = opened(tops, root.select("g", F.array().cast(PROOF).alias("path")), ["name"])
    above = saved(top.select(F.col("name").alias("g"), F.col("hash").alias("subroot"), F.col("proof").alias("path")))
    proved = opened(rounds, above.select("g", "path"), carried).join(above.select("g", "subroot"), "g")
    back = [F.col(f"c{k}").alias(c) for k, c in enumerate(kept)]
    return proved.select(*back, "subroot", F.lit(last["root"] if last else None).cast("string").alias("root"), "proof")
