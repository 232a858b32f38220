"""Schemas of the stored tables."""

from pyspark.sql import types as T

STRING, INT = T.StringType(), T.IntegerType()

#: The chunk table; absent values are '' and 0. `vector` must have as many numbers as the model.
CHUNKS = T.StructType(
    [
        T.StructField("id", STRING, False),
        T.StructField("content", STRING, False),
        T.StructField("vector", T.ArrayType(T.FloatType(), False), False),
        *[T.StructField(n, STRING, False) for n in ("filePath", "relativePath", "serviceName", "fileType", "language", "symbolName", "level")],
        T.StructField("startLine", INT, False),
        T.StructField("endLine", INT, False),
        T.StructField("chunkType", STRING, False),
    ]
)
CHUNK_COLUMNS = [f.name for f in CHUNKS if f.name != "vector"]
VECTOR_WIDTH = 768

#: An inventory of files: what every source operator takes.
FILES = T.StructType([T.StructField("path", STRING), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
SERVICES = T.StructType([T.StructField(n, STRING) for n in ("name", "path", "framework", "role")])
