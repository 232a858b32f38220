"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

import heapq
import math
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, small_side

#: Slots of a period of `quotas` and `pfair_period`, which round weights; `mix_sources` doesn't.
PERIOD = 1000
#: Blocks whose slots are handed to Spark at once.
PLAN_ROWS = 500_000
#: Slots of blocks are broadcast up to so many rows.
MAX_BROADCAST_ROWS = 200_000
#: Rows of a source that are ranked within one task.
BUCKET_ROWS = 20_000


def quotas(weights: dict, period: int = PERIOD) -> dict:
    """Whole slots per period by largest remainders, one at least; their sum is the period."""
    total = sum(weights.values())
    share = {s: w / total * period for s, w in weights.items()}
    out = {s: max(1, math.floor(x)) for s, x in share.items()}
    order = sorted(share, key=lambda s: (-(share[s] - math.floor(share[s])), str(s)))
    k = 0
    while sum(out.values()) < period:
        out[order[k % len(order)]] += 1
        k += 1
    while sum(out.values()) > period:
        out[max(out, key=lambda s: (out[s], str(s)))] -= 1
    return out


def pfair_period(slots: dict, period: int = PERIOD) -> list[tuple]:
    """(slot, source, k): the schedule of one period; it repeats, since all windows end with it.

    Block k (from 0) of a source with weight w = slots / period is released at floor(k / w) and due
    at ceil((k + 1) / w). Each slot goes to the released block with the earliest deadline (ties: by
    source); with weights that sum to 1, every block keeps its window, so after any slot a source
    is less than one block away from its share.
    """
    nxt, out = dict.fromkeys(slots, 0), []
    names = sorted(slots, key=str)
    for t in range(period):
        ready = [s for s in names if nxt[s] < slots[s] and nxt[s] * period // slots[s] <= t]
        s = min(ready, key=lambda s: (-(-(nxt[s] + 1) * period // slots[s]), str(s)))
        assert t < -(-(nxt[s] + 1) * period // slots[s]), "a deadline was missed"
        out.append((t, s, nxt[s]))
        nxt[s] += 1
    return out


def pfair_slots(weights: dict, blocks: dict):
    """Yields (slot, source, k) of the first blocks[s] blocks of each source, in the order of slots.

    As in `pfair_period`, but releases and deadlines come from the exact weights (as fractions), so
    no error adds up and any number of sources may be given: after any slot, a source that is not
    used up is less than one block away from its share. A source that is used up goes on taking
    slots, which stay empty, as long as the others have half of the weight; then these alone are
    scheduled, so that the steps are in proportion to the blocks, not to the slots.
    """
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    names = sorted(exact, key=str)
    whole = [int(exact[s] * scale) for s in names]
    need = [blocks.get(s, 0) for s in names]
    total = sum(whole)
    live, left = sum(w for w, n in zip(whole, need, strict=True) if n), sum(n > 0 for n in need)
    ready = [(-(-total // w), i, 0) for i, w in enumerate(whole)]
    heapq.heapify(ready)
    later: list[tuple] = []
    t = 0
    while left:
        while later and later[0][0] <= t:
            _, i, k = heapq.heappop(later)
            heapq.heappush(ready, (-(-(k + 1) * total // whole[i]), i, k))
        if not ready:
            t = later[0][0]
            continue
        due, i, k = heapq.heappop(ready)
        if k >= need[i] and 2 * live < total:
            continue
        assert t < due, "a deadline was missed"
        if k < need[i]:
            yield t, names[i], k
            if k + 1 == need[i]:
                left, live = left - 1, live - whole[i]
        heapq.heappush(later, ((k + 1) * total // whole[i], i, k + 1))
        t += 1


def slot_table(spark: SparkSession, weights: dict, blocks: dict) -> DataFrame:
    """(mix_source, mix_block, mix_slot) of all blocks, written in portions."""
    slots, out = pfair_slots(weights, blocks), None
    while part := list(islice(slots, PLAN_ROWS)):
        t, s, k = zip(*part, strict=True)
        rows = saved(spark.createDataFrame(pa.table({"mix_source": pa.array(s, pa.string()), "mix_block": pa.array(k, pa.int64()), "mix_slot": pa.array(t, pa.int64())})))
        out = rows if out is None else out.unionByName(rows)
    return out


def target_weights(sizes: dict, power: float = 0.5) -> dict:
    """Weights in proportion to a power of the sources' bytes: large sources are tempered."""
    return {s: max(1.0, float(b)) ** power for s, b in sizes.items()}


def mix_sources(df: DataFrame, weights: dict | None = None, block_bytes: int = 1 << 20, key: str = "doc_id", source: str = "source") -> DataFrame:
    """`df` with mix_source, mix_block and mix_slot: the place of each row in the mixture.

    A source's rows, in the order of the hashes of their keys and texts, fill blocks of `block_bytes` of text; a row
    belongs to the block in which it starts. Blocks take the slots of the Pfair schedule; order the
    table by mix_slot (rows of a block are next to each other) to read the mixture. All rows are
    kept: when a source is used up its later slots stay empty, and the others keep their ratios.

    A null source is a source of its own, named ''. Null text has 0 bytes. Repeated rows lie next
    to each other; an empty table gives none; a text larger than a block belongs to the one in which it
    starts. `weights` default to `target_weights` of the sources' sizes; a source that is
    not among given weights has weight 0 and is refused. Slots are computed on the driver, in a few
    steps a block; its memory holds the sources' names and weights and a portion of the slots.
    """
    kept = df.drop("mix_source", "mix_block", "mix_slot")
    rows = kept.withColumn("mix_source", F.coalesce(F.col(source).cast("string"), F.lit("")))
    rows = rows.withColumn("__bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    # The text is part of the order, so that rows with one key or none are spread as well.
    rows = rows.withColumn("__order", F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.xxhash64("text").cast("string"))))
    sizes = rows.groupBy("mix_source").agg(F.sum("__bytes").alias("b"), F.count("*").alias("n")).collect()
    if not sizes:
        return kept.withColumns({"mix_source": F.lit(""), "mix_block": F.lit(0).cast("long"), "mix_slot": F.lit(0).cast("long")})
    weights = target_weights({r[0]: r[1] for r in sizes}) if weights is None else weights
    if missing := [r[0] for r in sizes if not weights.get(r[0])]:
        raise ValueError(f"no weight for {missing[:5]}")
    present = {r[0] for r in sizes}
    # A row of 0 bytes after the last full block starts one more.
    blocks = {r[0]: r[1] // block_bytes + 1 for r in sizes}
    plan = slot_table(df.sparkSession, {s: w for s, w in weights.items() if w and s in present}, blocks)

    # Bytes before a row in its source, without one task per source: hash ranges are summed first.
    digits = max(1, math.ceil(math.log(max(r[2] for r in sizes) / BUCKET_ROWS + 1, 16)))
    rows = rows.withColumn("__range", F.substring("__order", 1, digits))
    ranges = rows.groupBy("mix_source", "__range").agg(F.sum("__bytes").alias("b"))
    before = saved(ranges.select("mix_source", "__range", (F.sum("b").over(Window.partitionBy("mix_source").orderBy("__range")) - F.col("b")).alias("__before")))
    inside = Window.partitionBy("mix_source", "__range").orderBy("__order", "__bytes").rowsBetween(Window.unboundedPreceding, -1)
    thin = rows.select(F.col("mix_source"), "__range", "__order", "__bytes", *[c for c in kept.columns])
    placed = thin.join(before, ["mix_source", "__range"]).withColumn("__at", F.col("__before") + F.coalesce(F.sum("__bytes").over(inside), F.lit(0)))
    placed = placed.withColumn("mix_block", F.floor(F.col("__at") / block_bytes))
    placed = placed.join(small_side(plan, sum(blocks.values()), MAX_BROADCAST_ROWS), ["mix_source", "mix_block"])
    return placed.select(*kept.columns, "mix_source", "mix_block", "mix_slot")
