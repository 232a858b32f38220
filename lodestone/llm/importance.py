"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_bytes, mix, saved, slices, words_of

#: Buckets of hashed unigrams and bigrams.
DIMS = 10_000
#: Grams of raw text that the target model starts from.
PRIOR = 10_000
#: The target model is fitted on at most so many labelled documents (those with the least hash).
MAX_TARGET = 50_000


def batch_grams(column) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every unigram and bigram of a batch of texts."""
    data, offsets = column_bytes(column)
    word, row, _, _ = words_of(data, offsets)
    pair = mix(word[:-1] * np.uint64(0xD6E8FEB86659FD93) + word[1:])
    same = row[1:] == row[:-1]
    return (np.concatenate([word, pair[same]]) % np.uint64(DIMS)).astype(np.int64), np.concatenate([row, row[1:][same]])


def models(docs: DataFrame, target_ids: DataFrame) -> np.ndarray:
    """log p_target - log p_raw of each bucket. Raw counts are over all documents; target counts
    over those whose doc_id is among `target_ids` (a bounded table), with PRIOR grams of raw text
    added: where the target has little text, the ratio stays near one."""
    flagged = docs.select("doc_id", "text").join(F.broadcast(target_ids.select("doc_id", F.lit(1).alias("target"))), "doc_id", "left")

    def count(batches):
        total = np.zeros((2, DIMS), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                target = np.asarray(part.column("target").fill_null(0)) == 1
                bucket, row = batch_grams(part.column("text"))
                total[0] += np.bincount(bucket, minlength=DIMS)
                total[1] += np.bincount(bucket[target[row]], minlength=DIMS)
        seen = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_pydict({"bucket": seen, "raw": total[0, seen], "target": total[1, seen]})

    counts = flagged.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()  # DIMS rows at most
    raw, target = np.full(DIMS, 1 / DIMS), np.zeros(DIMS)
    raw[np.asarray(counts.column("bucket"))] += np.asarray(counts.column("raw"))
    target[np.asarray(counts.column("bucket"))] += np.asarray(counts.column("target"))
    raw /= raw.sum()
    return np.log((target + PRIOR * raw) / (target.sum() + PRIOR)) - np.log(raw)


def score(docs: DataFrame, ratio: np.ndarray, seed: int = 0) -> DataFrame:
    """(doc_id, log_weight, sample_key): the sum of log ratios over a whole text, and with the
    Gumbel noise of the document's id and text added."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    noisy = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("h"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                bucket, row = batch_grams(part.column("text"))
                weight = np.bincount(row, ratio[bucket], part.num_rows).astype(np.float64).round(9)
                u = ((np.asarray(part.column("h")).view(np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(weight), pa.array(weight - np.log(-np.log(u)))], names=["doc_id", "log_weight", "sample_key"])

    return noisy.mapInArrow(run, f"doc_id {kind}, log_weight double, sample_key double")


def top_rows(df: DataFrame, order: str, tie: str, k: int, fine: int = 4096, small: int = 10_000) -> DataFrame:
    """The `k` rows with the greatest `order`, ties by least `tie`, without a global sort.

    Histograms narrow the range that holds the k-th value until it has few rows or one value; only
    these rows are ranked, and all above them are taken.
    """
    low, high = df.agg(F.min(order), F.max(order)).first()
    if low is None or k <= 0:
        return df.limit(0)
    above = 0  # rows over `high`, all taken
    while True:
        if high <= low:
            break
        width = (high - low) / fine
        inside = df.where((F.col(order) >= low) & (F.col(order) <= high))
        cell = F.least(F.floor((F.col(order) - low) / width), F.lit(fine - 1))
        cells = sorted(inside.groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min(order).alias("a"), F.max(order).alias("b")).collect(), reverse=True)  # `fine` rows at most
        for c in cells:
            if above + c["n"] >= k:
                break
            above += c["n"]
        else:
            return df
        low, high = c["a"], c["b"]
        if c["n"] <= small:
            break
    sure = df.where(F.col(order) > high)
    edge = df.where((F.col(order) >= low) & (F.col(order) <= high))
    if high > low:
        ranked = edge.withColumn("__r", F.row_number().over(Window.orderBy(F.desc(order), tie)))
        return sure.unionByName(ranked.where(F.col("__r") <= k - above).drop("__r"))
    # One value: its rows are told apart by the hash of `tie`; if that is one, too, the rows are copies
    # of each other, and any order will do, so long as it is kept.
    if edge.count() <= small:
        ranked = edge.withColumn("__r", F.row_number().over(Window.orderBy(tie)))
        return sure.unionByName(ranked.where(F.col("__r") <= k - above).drop("__r"))
    told = edge.withColumn("__t", F.xxhash64(tie).cast("double"))
    if told.select("__t").distinct().limit(2).count() == 1:
        told = saved(edge.withColumn("__t", F.xxhash64(F.monotonically_increasing_id()).cast("double")))
    return sure.unionByName(top_rows(told, "__t", tie, k - above, fine, small).drop("__t"))


def resample(docs: DataFrame, labels: DataFrame, fraction: float = 0.8, max_target: int = MAX_TARGET, seed: int = 0) -> DataFrame:
    """(doc_id, log_weight, sample_key) of the sampled `fraction` of the documents, drawn without
    replacement in proportion to their importance weights (Gumbel top-k).

    The target is text labelled quality 1. A null or empty text has weight 1 (log 0). Without
    labels the target is like the raw text and the draw is even. Repeated rows have one sample_key, and
    where the last places go to some of them, any are taken. An empty table gives none; a very long
    text is one row of a slice at a time; other columns are ignored.
    """
    good = labels.where(F.col("quality") == 1).select("doc_id").where("doc_id is not null").distinct()
    target = saved(good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_target))
    ratio = models(docs, target) if not target.isEmpty() else np.zeros(DIMS)
    scored = saved(score(docs, ratio, seed))
    return top_rows(scored, "sample_key", "doc_id", round(fraction * scored.count()))
