"""Helpers shared by the operators: checkpoints, bounded broadcasts, vectorised words."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share."""
    return shared_folder(spark)


def saved(df: DataFrame) -> DataFrame:
    """Cuts lineage: written as Parquet in the shared folder and read again, so a lost
    executor costs no recomputation of what led here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int, max_rows: int) -> DataFrame:
    """`df` with a broadcast hint if its counted `rows` are within `max_rows`."""
    return F.broadcast(df) if rows <= max_rows else df


# Random but fixed 64-bit values for bytes; odd multiplier and its inverse modulo 2**64.
BYTE = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (in place on a fresh array)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string or binary column and the offsets of its rows; null: empty."""
    import pyarrow as pa

    column = column.cast(pa.large_binary()).fill_null(b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch, column: str, max_bytes: int = 4 << 20):
    """Row ranges of a batch with at most `max_bytes` of text each (or one row), so that memory
    doesn't grow with the length of texts times the rows of a batch."""
    import pyarrow.compute as pc

    size = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), np.int64)
    at, part = 0, 0
    for k, n in enumerate(size):
        if part and part + n > max_bytes:
            yield batch.slice(at, k - at)
            at, part = k, 0
        part += int(n) + 64
    if at < batch.num_rows:
        yield batch.slice(at)


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


class Rolling:
    """Hashes of any byte ranges of a batch, A-Z lower-cased, from one pass over its bytes."""

    # Powers repeat every SPAN bytes, so their tables stay small; only a range that crosses such
    # a seam is hashed by itself.
    SPAN = 1 << 15

    def __init__(self, data: np.ndarray):
        self.values = BYTE[ASCII_LOWER[data]]
        self.down = powers(BASE_INVERSE, self.SPAN)
        self.total = np.zeros(len(data) + 1, np.uint64)
        up = np.resize(powers(BASE, self.SPAN), len(data)) if len(data) else np.zeros(0, np.uint64)
        np.cumsum(self.values * up, out=self.total[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = (self.total[end] - self.total[start]) * self.down[start & (self.SPAN - 1)]
        for k in np.flatnonzero((start // self.SPAN) != ((end - 1) // self.SPAN)):
            part = self.values[start[k] : end[k]]
            out[k] = (part * powers(BASE, len(part))).sum(dtype=np.uint64)
        return mix(out + (end - start).astype(np.uint64))


def words_of(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of every row of a batch: (hash, row, start byte, end byte), in order.

    A word is a maximal run of bytes other than ASCII white space (or of `in_word` bytes),
    A-Z lower-cased; words never cross rows.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    inside = ~IS_SPACE[data] if in_word is None else in_word[data]
    first = np.zeros(n, bool)
    cuts = offsets[:-1]
    first[cuts[cuts < n]] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    value = Rolling(data).hashes(start, end)
    row = np.searchsorted(offsets, start, side="right") - 1
    return value, row, start, end


def shingles_of(word: np.ndarray, row: np.ndarray, rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct `size`-word shingles of each row: (hash, row) sorted by row and hash. A row of
    fewer words has its whole sequence as one; a row without words has none."""
    counts = np.bincount(row, minlength=rows)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    value = np.zeros(len(word), np.uint64)
    left = firsts[row + 1] - np.arange(len(word))  # words from here to the row's end
    for j in range(size):
        ok = left > j
        at = np.flatnonzero(ok)
        value[at] = mix(value[at] * np.uint64(0xD6E8FEB86659FD93) + word[at + j] + np.uint64(j + 1))
    keep = (left >= size) | (left == counts[row])
    value, row = value[keep], row[keep]
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], row[new]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of the undirected `edges` (a, b): the least node reachable.

    Alternating large-star and small-star steps; every step is an aggregation and a join on
    edges, saved in the shared folder. Isolated nodes don't appear. Stops when nothing changes.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("b"), F.col("a"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = saved(edges.select(F.col("a"), F.col("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = mark(now)
    for _ in range(rounds):
        if not before[0]:
            break
        now = saved(star(star(now, True), False))
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
