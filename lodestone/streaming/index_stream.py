"""Indexing as a stream of files, twenty to a batch; stateless, and each batch counts once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunking, embedding
from ..schema import FILES
from ..sources import files as source_files
from ..sources import tables

FILES_PER_BATCH = 20


def document_stream(spark: SparkSession, folder: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """New files of a folder as an inventory. Names that begin with `_` or a dot aren't listed."""
    return spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").load(folder)


def batch_writer(path: str, model: embedding.Model, services: DataFrame | None = None, root: str = "/", code_size: int = chunking.CODE_SIZE, size: int = chunking.DOCUMENT_SIZE, overlap: int = chunking.OVERLAP, strict: bool = False) -> Callable[[DataFrame, int], None]:
    """A function of (files, batch number) that chunks and embeds a batch of files and puts it into the
    chunk table as the partition of its number: written twice, it is there once.

    Documents go by their kind; with `services`, a table, files below their folders are code and meet
    it in a join. Files that failed are kept in `errors_of` the table, likewise by batch. Files are read once.
    """

    def write(files: DataFrame, number: int) -> None:
        for name, value in (("length", F.octet_length("content").cast("long")), ("modificationTime", F.lit(None).cast("timestamp"))):
            if name not in files.columns:
                files = files.withColumn(name, value)
        files = files.persist()  # a batch of files, read once for documents, code and errors
        texts = source_files.document_texts(source_files.list_documents(files, root, any_size=True), strict)
        chunks, errors = chunking.split_outcomes(chunking.chunk_outcomes(texts, size=size, overlap=overlap))
        records = chunking.document_records(chunks)
        if services is not None:
            listed = source_files.list_code(files, services, root)
            records = records.unionByName(chunking.code_records(chunking.chunk_code(source_files.load_code(listed), code_size, overlap)))
            bad = source_files.failures(source_files.checked(listed, source_files.MAX_CODE_BYTES, strict), F.col("path"))
            errors = errors.unionByName(bad.select(F.substring_index("name", "/", -1).alias("name"), F.col("name").alias("source"), "message"))
        tables.write_batch(model.embed(records), path, number, model.width)
        errors.write.mode("overwrite").parquet(f"{path.rstrip('/')}.errors/batch={number}")
        files.unpersist()

    return write


def errors_of(spark: SparkSession, path: str) -> DataFrame:
    """(batch, name, source, message) of the files of a stream that failed."""
    return spark.read.schema("name string, source string, message string, batch long").parquet(f"{path.rstrip('/')}.errors").select("batch", "name", "source", "message")


def index_stream(stream: DataFrame, path: str, checkpoint: str, model: embedding.Model, **how) -> StreamingQuery:
    """Chunks and embeds each batch of files (path, content, any of length and modificationTime) with
    `batch_writer` (`how` is given to it), and stamps the table with the model. Files seen before are
    not read again, as the checkpoint knows them; a batch that is run again replaces itself."""
    tables.stamp(stream.sparkSession, path, model.name, model.width)
    return stream.writeStream.foreachBatch(batch_writer(path, model, **how)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
