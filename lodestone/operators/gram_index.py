"""An inverted index of character trigrams over chunks: substring search that reads few of them.

Every chunk is posted under the distinct pieces of three (and two) characters of its lower-cased text.
A keyword can stand only in chunks that have all of its pieces; the lists of its rarest ones are
intersected, and what is left is confirmed on the text. So the meaning is that of a scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import bound, occurrences
from ..storage import saved
from .search import keyword_hits, top

#: Chunks of a block: no posting list is longer, however common a piece is.
BLOCK_BITS = 12
#: Files of the postings; a search reads only those of its pieces.
BUCKETS = 64
#: Lists that are intersected for a keyword.
LISTS = 3
#: A question whose keywords may stand in more than this share of the chunks is answered by the scan.
SHARE = 0.1


def pieces(text: str) -> set[str]:
    """The distinct pieces of three and of two characters of a text."""
    return {text[at : at + n] for n in (2, 3) for at in range(len(text) - n + 1)}


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, block, numbers) of the chunks (number, text) of each batch."""
    for batch in batches:
        lists: dict[tuple[str, int], list[int]] = {}
        for number, text in zip(batch.column("number").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for piece in pieces(text or ""):
                lists.setdefault((piece, number >> BLOCK_BITS), []).append(number)
        columns = [pa.array([p for p, _ in lists], pa.string()), pa.array([b for _, b in lists], pa.int64()), pa.array(lists.values(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["piece", "block", "numbers"])


def _bucket(piece: Column) -> Column:
    return F.pmod(F.hash(piece), F.lit(BUCKETS)).cast("int")


def build(chunks: DataFrame, path: str) -> None:
    """Writes the index of `chunks` (id, content ...) to `path`: the chunks, numbered, and the postings
    (piece, block, n, numbers) by buckets of pieces. Null contents are never found."""
    chunks.withColumn("number", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/chunks")
    rows = chunks.sparkSession.read.parquet(f"{path}/chunks")
    # Lists are begun where the chunks are read, so a row is shuffled for each list and not for each piece of a chunk.
    posted = rows.select("number", F.lower("content").alias("text")).mapInArrow(_posted, "piece string, block long, numbers array<bigint>")
    lists = posted.groupBy("piece", "block").agg(F.sum(F.size("numbers")).alias("n"), F.array_sort(F.flatten(F.collect_list("numbers"))).alias("numbers"))
    lists = lists.withColumn("bucket", _bucket(F.col("piece"))).repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "piece", "block")
    lists.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of the index, as they were given."""
    return spark.read.parquet(f"{path}/chunks").drop("number")


def rarest(words: DataFrame, postings: DataFrame) -> DataFrame:
    """(word, piece, bucket, n, taken): of each word (word) the pieces with the fewest chunks, how many
    these are, and how many pieces were taken."""
    def own(x: Column) -> Column:
        size = F.least(F.length(x), F.lit(3))
        starts = F.sequence(F.lit(1), F.greatest(F.length(x) - size + 1, F.lit(1)))
        return F.array_distinct(F.transform(starts, lambda k: F.substring(x, k, size)))

    asked = words.where(F.length("word") > 1).select("word", F.explode(bound(F.col("word"), own)).alias("piece"))
    asked = asked.withColumn("bucket", _bucket(F.col("piece")))
    sizes = postings.join(asked.select("bucket", "piece").distinct(), ["bucket", "piece"], "left_semi").groupBy("bucket", "piece").agg(F.sum("n").alias("n"))
    counted = asked.join(sizes, ["bucket", "piece"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    by = Window.partitionBy("word").orderBy("n", "piece")
    few = counted.withColumn("place", F.row_number().over(by)).where(F.col("place") <= LISTS).drop("place")
    return few.withColumn("taken", F.count("*").over(Window.partitionBy("word")))


def candidates(few: DataFrame, postings: DataFrame) -> DataFrame:
    """(word, number) of the chunks that have all pieces of `rarest`, block by block."""
    lists = few.select("word", "bucket", "piece", "taken").join(postings.select("bucket", "piece", "block", "numbers"), ["bucket", "piece"])
    met = lists.groupBy("word", "block", "taken").agg(F.collect_list("numbers").alias("lists")).where(F.size("lists") == F.col("taken"))
    common = F.aggregate(F.slice("lists", 2, LISTS), F.get("lists", F.lit(0)), lambda a, b: F.array_intersect(a, b))
    return met.select("word", F.explode(common).alias("number"))


def word_counts(words: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """(word, id, count, others ...) of the chunks that hold a word (word, lower-cased), without overlaps,
    with the chunk's other columns but its content."""
    postings, chunks = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/chunks")
    found = candidates(saved(rarest(words.distinct(), postings), "rarest"), postings)
    at = found.groupBy("number").agg(F.collect_list("word").alias("words"))
    texts = chunks.join(at, "number")
    kept = [c for c in chunks.columns if c not in ("number", "content", "vector")]
    # A text is lower-cased once, not for each of its words.
    of_text = bound(F.lower("content"), lambda low: F.transform("words", lambda w: F.struct(w.alias("word"), occurrences(low, w).alias("count"))))
    counted = texts.select(*kept, F.explode(of_text).alias("w"))
    return counted.select("w.word", *kept, "w.count").where(F.col("count") > 0)


def indexed_keyword_hits(queries: DataFrame, spark: SparkSession, path: str, k: int, filtered: bool = False, share: float = SHARE) -> DataFrame:
    """(query_id, id, occurrences, score, rank): what `search.keyword_hits` gives for the chunks of the
    index, ties included. Questions with rare keywords are answered from the index; those whose
    keywords may stand in more than `share` of the chunks are scanned for, since their rows would
    be as many as chunks."""
    total = spark.read.parquet(f"{path}/chunks").count()
    postings = spark.read.parquet(f"{path}/postings")
    asked = queries.select("query_id", F.size("keywords").alias("n"), F.explode(F.array_distinct("keywords")).alias("keyword")).withColumn("word", F.lower("keyword"))
    few = saved(rarest(asked.select("word").distinct(), postings), "rarest")
    most = few.groupBy("word").agg(F.min("n").alias("most"))
    # A keyword of one character has no pieces: the scan finds it.
    held = F.coalesce(F.col("most").cast("double"), F.lit(float("inf")))
    cost = asked.select("query_id", "word").join(most, "word", "left").groupBy("query_id").agg(F.sum(held).alias("cost"))
    cheap = saved(cost.where(F.col("cost") <= share * total).select("query_id"), "cheap")

    rare = asked.join(cheap, "query_id", "left_semi")
    counts = word_counts(rare.select("word"), spark, path)
    hits = rare.join(counts, "word")
    if filtered:
        only = queries.select("query_id", "serviceFilter", "fileTypeFilter")
        fits = (F.col("serviceFilter").isNull() | (F.col("serviceName") == F.col("serviceFilter"))) & (F.col("fileTypeFilter").isNull() | (F.col("fileType") == F.col("fileTypeFilter")))
        hits = hits.join(only, "query_id").where((F.col("chunkType") != "code") | fits)
    summed = hits.groupBy("query_id", "id").agg(F.sum("count").cast("long").alias("occurrences"), F.first("n").alias("n"))
    scored = summed.select("query_id", "id", "occurrences", F.least(F.col("occurrences") / F.greatest(5 * F.col("n"), F.lit(1)), F.lit(1.0)).alias("score"))
    from_index = top(scored, k, F.desc("score"), "id")
    dear = queries.join(cheap, "query_id", "left_anti")
    return from_index.unionByName(keyword_hits(dear, read_chunks(spark, path), k, filtered=filtered))
