"""The chunk table: append, clear, read, count, and the model that its vectors are of."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CHUNKS

KINDS = ["code", "document"]


def _rows(records: DataFrame, width: int | None) -> DataFrame:
    rows = records.select(*[F.col(f.name).cast("array<float>" if f.name == "vector" else f.dataType).alias(f.name) for f in CHUNKS])
    if width is not None:
        rows = rows.withColumn("vector", F.when(F.size("vector") == width, F.col("vector")).otherwise(F.raise_error(F.lit(f"a vector must have {width} numbers"))))
    return rows


def append_chunks(records: DataFrame, path: str, width: int | None = None, mode: str = "append") -> None:
    """Adds rows to the chunk table at `path` (made on the first write), a folder per chunkType. A
    vector of another width than `width` fails the write. With mode overwrite, only the kinds that
    are written are replaced."""
    _rows(records, width).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("chunkType").parquet(path)


def write_batch(records: DataFrame, path: str, batch: int, width: int | None = None) -> None:
    """Writes a batch of a stream as the partition of its number and replaces what stands there, so a
    batch that is written again after a crash counts once. A table is fed by batches or by
    `append_chunks`, not by both."""
    _rows(records, width).write.mode("overwrite").partitionBy("chunkType").parquet(f"{path}/batch={batch}")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table; an empty one where none has been written."""
    try:
        return spark.read.schema(CHUNKS).parquet(path).select(*[f.name for f in CHUNKS])
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CHUNKS)


MODEL = "name string, width int"


def stamp(spark: SparkSession, path: str, name: str, width: int) -> None:
    """Notes the model of the table's vectors, beside the table. A table whose chunks are of another
    model is refused: clear it first."""
    known = model_of(spark, path)
    if known is not None and known != (name, width):
        raise ValueError(f"the chunks at {path} are of the model {known[0]} with {known[1]} numbers, not of {name} with {width}")
    if known is None:
        spark.createDataFrame([(name, width)], MODEL).coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}.model")


def model_of(spark: SparkSession, path: str) -> tuple[str, int] | None:
    """(name, width) of the model that the table is stamped with, or None."""
    try:
        found = spark.read.schema(MODEL).json(f"{path.rstrip('/')}.model").first()  # one row
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return found and (found["name"], found["width"])


def check_model(spark: SparkSession, path: str, name: str, width: int) -> None:
    """Fails before anything is searched if the table's vectors are of another model, or of none known."""
    known = model_of(spark, path)
    if known != (name, width):
        said = f"{known[0]} with {known[1]} numbers" if known else "no known model"
        raise ValueError(f"the chunks at {path} are of {said}; questions must be embedded by the same, not by {name} with {width}")


def clear_chunks(spark: SparkSession, path: str, kind: str | None = None) -> None:
    """Removes one kind of chunks or both; nothing happens where there are none."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/chunkType={kind}" if kind else path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def count_chunks(chunks: DataFrame) -> DataFrame:
    """(chunkType, n) of both kinds, also where there are none."""
    kinds = chunks.sparkSession.createDataFrame([(k,) for k in KINDS], "chunkType string")
    counted = chunks.groupBy("chunkType").agg(F.count("*").alias("n"))
    return kinds.join(counted, "chunkType", "left").select("chunkType", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
