"""Exact nearest chunks without a look at every pair: vectors in cells around pivots.

A chunk belongs to its nearest pivot; a cell's chunks lie in blocks by their distance to the pivot, so a
block is a shell between two radii. By the triangle inequality no vector of a shell is nearer to
a question than the difference of the question's distance to the pivot and the shell's radii. A block
is skipped for the questions that already have k nearer chunks; a fixed sample gives a first bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..storage import saved
from .search import CHUNK_BLOCK, MAX_BROADCAST_BLOCKS, QUERY_BLOCK, blocks, objects, top, unpacked, vectors

#: Pivots, and rows of the sample that bounds distances before any block is read; both bounded.
PIVOTS, SAMPLE = 64, 2048
#: Questions whose distances to the sample are made at once.
PART = 256
#: Room for rounding when a bound is compared with a distance.
ROOM = 1e-5


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of two matrices."""
    return np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T, 0)


def first_bounds(m: np.ndarray, known: np.ndarray, k: int, decimals: int) -> np.ndarray:
    """The k-th least squared distance of each question to the sample. The bounds alone are held, no view of the
    distances they are from, which are made for PART questions at a time."""
    out = np.full(len(m), np.inf)
    if len(known) >= k:
        for at in range(0, len(m), PART):
            near = squares(m[at : at + PART], known).round(decimals)
            out[at : at + PART] = np.partition(near, k - 1, axis=1)[:, k - 1]
    return out


def build(chunks: DataFrame, path: str, pivots: int = PIVOTS, sample: int = SAMPLE) -> None:
    """Writes chunks (id, vector), without those that have no vector, to `path` in cells. The pivots and the
    sample are the rows with the least hashes of their ids."""
    rows = chunks.where(F.col("vector").isNotNull()).select("id", "vector")
    taken = rows.orderBy(F.xxhash64("id"), "id").limit(max(pivots, sample))
    taken.coalesce(1).write.mode("overwrite").parquet(f"{path}/sample")
    centres = vectors(rows.sparkSession.read.parquet(f"{path}/sample").orderBy(F.xxhash64("id"), "id").limit(pivots).toArrow().column("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = squares(vectors(batch.column("vector")), centres)
            cell = d.argmin(axis=1)
            radius = np.sqrt(d[np.arange(len(cell)), cell])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(radius)], names=[*batch.schema.names, "cell", "radius"])

    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("radius", T.DoubleType())])
    placed = rows.mapInArrow(run, schema) if len(centres) else rows.withColumns({"cell": F.lit(0), "radius": F.lit(0.0)})
    placed.repartitionByRange("cell", "radius").sortWithinPartitions("cell", "radius").write.mode("overwrite").parquet(f"{path}/rows")


def scan(queries: DataFrame, spark: SparkSession, path: str, k: int, pivots: int = PIVOTS, decimals: int = 6) -> DataFrame:
    """(query_id, id, distance, looked, pairs): candidates of each question, at least the `k` nearest; and, with
    a null query_id, what each task looked at of its pairs of question and block."""
    first = spark.read.parquet(f"{path}/sample").orderBy(F.xxhash64("id"), "id").toArrow()  # bounded by SAMPLE
    known = vectors(first.column("vector"))
    centres = known[:pivots]
    rows = spark.read.parquet(f"{path}/rows")
    asked = saved(blocks(queries.where(F.col("vector").isNotNull()).select("query_id", "vector"), QUERY_BLOCK).withColumn("number", F.monotonically_increasing_id()), "questions")
    if asked.count() <= MAX_BROADCAST_BLOCKS:
        asked = F.broadcast(asked)
    both = blocks(rows, CHUNK_BLOCK // 8).crossJoin(asked.select(F.col("block").alias("asked"), "number"))
    query_type, id_type = to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(rows.schema["id"].dataType)
    names = ["query_id", "id", "distance", "looked", "pairs"]

    class Held:
        """Questions of a block with their distances to the pivots and their best chunks so far."""

        def __init__(self, block: pa.RecordBatch):
            self.ids, self.m = block.column("query_id"), vectors(block.column("vector"))
            self.to_pivots = np.sqrt(squares(self.m, centres)) if len(centres) else np.zeros((len(self.m), 1))
            n = len(self.m)
            self.bound = first_bounds(self.m, known, k, decimals)
            self.best = [(np.empty(0, object), np.empty(0)) for _ in range(n)]

        def active(self, cell: int, low: float, high: float) -> np.ndarray:
            d = self.to_pivots[:, cell]
            least = np.maximum(np.maximum(d - high, low - d), 0)
            return np.flatnonzero(least**2 <= self.bound + ROOM)

        def add(self, which: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
            for q, d in zip(which, squares(self.m[which], x).round(decimals), strict=True):
                near = np.flatnonzero(d <= self.bound[q])
                if not len(near):
                    continue
                all_ids, all_d = np.append(self.best[q][0], ids[near]), np.append(self.best[q][1], d[near])
                if len(all_d) > k:
                    take = np.lexsort((all_ids, all_d))[:k]
                    all_ids, all_d = all_ids[take], all_d[take]
                if len(all_d) == k:
                    self.bound[q] = min(self.bound[q], all_d.max())
                self.best[q] = (all_ids, all_d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Held] = {}
        looked = pairs = 0
        for batch in batches:
            for r in range(batch.num_rows):
                number = batch.column("number")[r].as_py()
                if number not in held:
                    held[number] = Held(unpacked(batch.column("asked")[r].as_py()))
                questions = held[number]
                block = unpacked(batch.column("block")[r].as_py())
                cells, radius = np.asarray(block.column("cell")), np.asarray(block.column("radius"))
                ids, x = objects(block.column("id")), vectors(block.column("vector"))
                for cell in np.unique(cells):
                    of = np.flatnonzero(cells == cell)
                    which = questions.active(cell, radius[of].min(), radius[of].max())
                    pairs, looked = pairs + len(questions.m), looked + len(which)
                    if len(which):
                        questions.add(which, ids[of], x[of])
        for h in held.values():
            q = np.repeat(np.arange(len(h.best)), [len(i) for i, _ in h.best])
            ids = np.concatenate([i for i, _ in h.best]) if h.best else np.empty(0, object)
            d = np.concatenate([d for _, d in h.best]) if h.best else np.empty(0)
            none = pa.nulls(len(q), pa.int64())
            yield pa.RecordBatch.from_arrays([h.ids.take(pa.array(q, pa.int64())).cast(query_type), pa.array(list(ids), id_type), pa.array(d), none, none], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, query_type), pa.nulls(1, id_type), pa.nulls(1, pa.float64()), pa.array([looked]), pa.array([pairs])], names=names)

    fields = [queries.schema["query_id"], rows.schema["id"], T.StructField("distance", T.DoubleType()), *(T.StructField(c, T.LongType()) for c in ("looked", "pairs"))]
    return both.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in fields]))


def nearest_in_cells(queries: DataFrame, spark: SparkSession, path: str, k: int, **how) -> DataFrame:
    """(query_id, id, distance, rank): what `search.nearest` gives for the chunks of `build`."""
    found = scan(queries, spark, path, k, **how).where("query_id is not null").drop("looked", "pairs")
    return top(found, k, "distance", "id")


def looked_share(queries: DataFrame, spark: SparkSession, path: str, k: int, **how) -> float:
    """The share of the pairs of question and block that a search looks at."""
    row = scan(queries, spark, path, k, **how).where("query_id is null").agg(F.sum("looked"), F.sum("pairs")).first()
    return row[0] / row[1] if row[1] else 0.0
