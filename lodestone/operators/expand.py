"""Expansion of results by neighbouring chunks of the same file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rerank import first_of_each
from .search import top

RANGE, NEIGHBOURS, FACTOR = 50, 3, 0.5


def expandable() -> Column:
    return (F.col("chunkType") == "code") & F.col("filePath").isNotNull() & F.col("startLine").isNotNull()


def neighbours(results: DataFrame, chunks: DataFrame, order: str = "lines") -> DataFrame:
    """Neighbours of expandable results (query_id, id, score, rank, filePath, startLine, chunkType):
    code chunks of the same file that start within 50 lines, three for each result.

    The three are taken before the result itself is left out, as in the reference. They are the
    nearest by line; `order="norm"` takes those with the least vector norm, as the reference does.
    The join is on the file and a band of lines: a result looks into the three bands that its range may
    touch, so a file with very many chunks is spread over its bands.
    """
    base = results.where(expandable()).select("query_id", F.col("id").alias("base_id"), F.col("score").alias("base_score"), F.col("rank").alias("base_rank"), "filePath", F.col("startLine").alias("base_line"))
    band = F.floor(F.col("base_line") / RANGE)
    base = base.withColumn("__band", F.explode(F.sequence(band - 1, band + 1)))
    code = chunks.where("chunkType = 'code'").withColumn("__band", F.floor(F.col("startLine") / RANGE))
    near = F.col("startLine").between(F.col("base_line") - RANGE, F.col("base_line") + RANGE)
    pairs = base.join(code, ["filePath", "__band"]).where(near)
    if order == "norm":
        keys = [F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), F.col("id")]
    else:
        keys = [F.abs(F.col("startLine") - F.col("base_line")), F.col("startLine"), F.col("id")]
    by = Window.partitionBy("query_id", "base_id").orderBy(*keys)
    taken = pairs.withColumn("neighbour_rank", F.row_number().over(by)).where(F.col("neighbour_rank") <= NEIGHBOURS)
    return taken.where("id <> base_id").withColumn("score", F.col("base_score") * FACTOR)


def expand(results: DataFrame, chunks: DataFrame, order: str = "lines") -> DataFrame:
    """Results followed by their neighbours, each id once (its first place), with new ranks."""
    near = neighbours(results, chunks, order)
    columns = [c for c in results.columns if c != "rank"]
    first = results.select(*columns, F.lit(0).alias("__part"), F.col("rank").alias("__a"), F.lit(0).alias("__b"))
    near = near.select(*columns, F.lit(1).alias("__part"), F.col("base_rank").alias("__a"), F.col("neighbour_rank").alias("__b"))
    order_by = ("__part", "__a", "__b")
    return top(first_of_each(first.unionByName(near), *order_by), 1 << 30, *order_by).drop(*order_by)
