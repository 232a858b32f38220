"""Substring deduplication: paragraph MinHash banding.

A paragraph is a line of a text. Paragraphs are posted under `BANDS` bands of two MinHash rows each,
over five-word shingles: two with Jaccard similarity s share a band with probability
1 - (1 - s * s)**BANDS (0.994 at 0.8). Colliding paragraphs are compared by their exact Jaccard
similarity and clustered by components.

A passage that is spliced into different lines makes no similar paragraphs. So texts are also cut
into chunks of about nine words, at places that depend on the words around them alone; equal chunks
are the seeds of such passages. Where the text between two runs of seeds differs from the text that
both are copies of, the span is a copy as a whole if its exact Jaccard similarity is high enough.

In each text, unions of repeated paragraphs, chunks and spans that are long enough are reported,
and all but a cluster's first occurrence are marked for removal.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bwt_dedup import sliding_min
from .common import column_bytes, mix, saved, shingles_of, slices, words_of
from .minhash_join import ADDENDS, MULTIPLIERS, SKETCH, SKETCH_TYPE, compared, linked_components, of_items, parts_of

BANDS = 5
SHINGLE = 5
#: A cut is before a word whose pair with the word before has the least hash of so many to each side.
RADIUS = 4
#: Least words of a reported run; less is common speech.
MIN_WORDS = 24
GOLD = np.uint64(0xD6E8FEB86659FD93)
SKETCH_ARROW = pa.struct([(f"s{k}", pa.int64()) for k in range(SKETCH)])


def chunks(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, chunk of each word; row, number in its row, first word, words of each chunk)."""
    data, offsets = column_bytes(column)
    word, row, _, _ = words_of(data, offsets)
    if not len(word):
        none = np.zeros(0, np.int64)
        return word, none, none, none, none, none
    begins = np.ones(len(word), bool)
    begins[1:] = row[1:] != row[:-1]
    first = np.maximum.accumulate(np.where(begins, np.arange(len(word)), 0))  # of the row
    pair = mix(np.append(np.uint64(0), word[:-1]) * np.uint64(0xD6E8FEB86659FD93) + word)
    # Rows are kept apart by RADIUS entries that are greater than any hash.
    place = np.arange(len(word)) + RADIUS * (row + 1)
    spread = np.full(place[-1] + RADIUS + 1, np.uint64(2**64 - 1))
    spread[place] = pair >> np.uint64(1)
    to_left = sliding_min(spread, RADIUS)[place - RADIUS]
    to_right = sliding_min(spread, RADIUS + 1)[place]
    cut = begins | ((spread[place] == to_right) & (spread[place] < to_left))
    start = np.flatnonzero(cut)
    unit = np.cumsum(cut) - 1
    size = np.diff(np.append(start, len(word)))
    number = np.arange(len(start)) - np.searchsorted(row[start], row[start])
    return word, unit, row[start], number, start - first[start], size


def sequence_hashes(word: np.ndarray, unit: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of the word sequence of each unit."""
    place = (np.arange(len(word)) - start[unit]).astype(np.uint64)
    return mix(np.add.reduceat(mix(word + place * np.uint64(0xF1357AEA2E62A9C5)), start) + size.astype(np.uint64))


def lines(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same as `chunks` for lines; their numbers leave out blank ones."""
    data, offsets = column_bytes(column)
    word, row, begin, _ = words_of(data, offsets)
    if not len(word):
        none = np.zeros(0, np.int64)
        return word, none, none, none, none, none
    line = np.searchsorted(np.flatnonzero((data == 10) | (data == 13)), begin)
    new = np.ones(len(word), bool)
    new[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
    start = np.flatnonzero(new)
    number = np.arange(len(start)) - np.searchsorted(row[start], row[start])
    first = np.searchsorted(row, row[start])  # word of the row's begin
    return word, np.cumsum(new) - 1, row[start], number, start - first, np.diff(np.append(start, len(word)))


def bands_of(word: np.ndarray, unit: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bands of units of SHINGLE words or more, in rows; 0 for shorter ones. The last bit is 1."""
    value = np.zeros(len(word), np.uint64)
    left = (start + size)[unit] - np.arange(len(word))
    for j in range(SHINGLE):
        at = np.flatnonzero(left > j)
        value[at] = mix(value[at] * GOLD + word[at + j] + np.uint64(j + 1))
    tail = left < SHINGLE  # no shingle begins there
    out = np.zeros((len(start), BANDS), np.uint64)
    for k in range(2 * BANDS):
        key = value * MULTIPLIERS[k] + ADDENDS[k]
        key[tail] = np.uint64(2**64 - 1)
        out[:, k // 2] = mix(out[:, k // 2] * GOLD + np.minimum.reduceat(key, start) + np.uint64(k))
    out |= np.uint64(1)
    out[size < SHINGLE] = 0
    return out


def posted_units(column):
    """For chunks and for lines of SHINGLE words or more: (token, row, number, first word, words,
    hash); a chunk has one token, its hash with a last bit of 0, a line one for each band."""
    word, unit, row, number, first, size = chunks(column)
    none = np.zeros(0, np.int64)
    if not len(word):
        return [(none.astype(np.uint64), none, none, none, none, none.astype(np.uint64))]
    start = np.cumsum(size) - size
    cls = sequence_hashes(word, unit, start, size) & ~np.uint64(1)
    out = [(cls, row, number, first, size, cls)]
    word, unit, row, number, first, size = lines(column)
    start = np.cumsum(size) - size
    cls, bands = sequence_hashes(word, unit, start, size), bands_of(word, unit, start, size)
    long = size >= SHINGLE
    for k in range(BANDS):
        out.append(tuple(x[long] for x in (bands[:, k], row, number, first, size, cls)))
    return out


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, c): how many units have each token; counted within slices before any shuffle."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                token, count = np.unique(np.concatenate([u[0] for u in posted_units(part.column("text"))]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(count.astype(np.int32))], names=["token", "c"])

    return docs.select("text").mapInArrow(run, "token long, c int").groupBy("token").agg(F.sum("c").alias("c"))


def scan(docs: DataFrame) -> DataFrame:
    """(token, doc_id, number, first_word, n_words, cls) of every chunk and line."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                for token, row, number, first, size, cls in posted_units(part.column("text")):
                    ints = [pa.array(x.astype(np.int32)) for x in (number, first, size)]
                    arrays = [pa.array(token.view(np.int64)), part.column("doc_id").take(pa.array(row)), *ints, pa.array(cls.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["token", "doc_id", "number", "first_word", "n_words", "cls"])

    return docs.mapInArrow(run, f"token long, doc_id {kind}, number int, first_word int, n_words int, cls long")


def asked_words(docs: DataFrame, wanted: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From one pass over the texts that hold them: (cls, items, sketch), the shingle sets of the wanted lines
    (cls, doc_id, number), one of each class, and their bitmaps; and (doc_id, first, last, items, before, after), the
    words from one chunk through another of the spans (doc_id, first, last), with the chunk before
    and the one after, which have so many words."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    no = F.lit(None).cast("long")
    both = wanted.select("doc_id", "cls", F.col("number").alias("first"), F.lit(-1).alias("last")).unionByName(spans.select("doc_id", no.alias("cls"), "first", "last"))
    asked = both.groupBy("doc_id").agg(F.collect_set(F.struct("cls", "first", "last")).alias("asked"))  # as many as a text has

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                word, unit, row, _, _, _ = lines(part.column("text"))
                value, of = shingles_of(word, unit, len(row), SHINGLE)
                begin = np.searchsorted(of, np.arange(len(row) + 1))
                heads = np.searchsorted(row, np.arange(part.num_rows + 1))
                _, _, row, _, _, size = chunks(part.column("text"))
                start = np.append(0, np.cumsum(size))
                head = np.searchsorted(row, np.arange(part.num_rows + 1))
                at, items, rest, sketch = [], [], [], []
                for r, asked in enumerate(part.column("asked").to_pylist()):
                    for a in asked:
                        if a["cls"] is not None:
                            u = heads[r] + a["first"]
                            if u < heads[r + 1]:  # else of another row with the same id
                                at.append(r)
                                items.append(value[begin[u] : begin[u + 1]].tobytes())
                                sketch.append(bitmap(value[begin[u] : begin[u + 1]]))
                                rest.append((a["cls"], None, None, None, None))
                            continue
                        lo, hi = head[r] + a["first"], head[r] + a["last"] + 1
                        if hi <= head[r + 1]:
                            out, end = max(lo - 1, head[r]), min(hi + 1, head[r + 1])
                            at.append(r)
                            items.append(word[start[out] : start[end]].tobytes())
                            sketch.append(None)
                            rest.append((None, a["first"], a["last"], int(start[lo] - start[out]), int(start[end] - start[hi])))
                facts = [pa.array([x[k] for x in rest], pa.int32() if k else pa.int64()) for k in range(5)]
                arrays = [part.column("doc_id").take(pa.array(at, pa.int64())), pa.array(items, pa.binary()), *facts, pa.array(sketch, SKETCH_ARROW)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "items", "cls", "first", "last", "before", "after", "sketch"])

    types = f"doc_id {kind}, items binary, cls long, first int, last int, before int, after int, sketch {SKETCH_TYPE}"
    found = saved(docs.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(run, types))
    sets = found.where("cls is not null").select("cls", "items", "sketch").dropDuplicates(["cls"])
    return sets, found.where("cls is null").drop("cls", "sketch").dropDuplicates(["doc_id", "first", "last"])


def same_words(a: np.ndarray, b: np.ndarray) -> int:
    """How many first words are the same."""
    n = min(len(a), len(b))
    return n if (a[:n] == b[:n]).all() else int(np.argmin(a[:n] == b[:n]))


def similar_spans(both: DataFrame, percent: int) -> DataFrame:
    """The rows whose spans have a Jaccard similarity of `percent` or more; equal words next to both
    ends, which a chunk's cut in the context hides, belong to the spans."""

    def run(batches):
        for batch in batches:
            keep = []
            columns = [batch.column(f"{s}{c}") for s in ("", "k_") for c in ("items", "before", "after")]
            for k in range(batch.num_rows):
                (a, a0, a1), (b, b0, b1) = ((np.frombuffer(w[k].as_py(), np.uint64), x[k].as_py(), y[k].as_py()) for w, x, y in (columns[:3], columns[3:]))
                left = same_words(a[:a0][::-1], b[:b0][::-1])
                right = same_words(a[len(a) - a1 :], b[len(b) - b1 :])
                a, b = a[a0 - left : len(a) - a1 + right], b[b0 - left : len(b) - b1 + right]
                x, y = (shingles_of(w, np.zeros(len(w), np.int64), 1, SHINGLE)[0] for w in (a, b))
                inter = len(np.intersect1d(x, y))
                keep.append(100 * inter >= percent * (len(x) + len(y) - inter))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, both.schema)


def bridge_pairs(units: DataFrame) -> DataFrame:
    """(doc_id, first, last, k_doc, k_first, k_last): the chunks, by number, from one run of repeated
    chunks through the next, where both are copies of runs of one text, in order; and these.

    A run here is of neighbours whose clusters' first occurrences are neighbours, too.
    """
    by = Window.partitionBy("doc_id").orderBy("number", "first_word")
    k = F.struct(F.col("keeper.doc_id").alias("doc_id"), F.col("keeper.number").alias("number"))
    rows = units.where("keeper.doc_id <> doc_id or keeper.number <> number").select("doc_id", "number", "first_word", k.alias("k"))
    goes_on = (F.col("number") == F.lag("number").over(by) + 1) & (F.col("k.doc_id") == F.lag("k.doc_id").over(by)) & (F.col("k.number") == F.lag("k.number").over(by) + 1)
    rows = rows.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(by))
    runs = rows.groupBy("doc_id", "run").agg(F.min("number").alias("first"), F.max("number").alias("last"), F.min("k").alias("k0"), F.max("k").alias("k1"))
    nexts = Window.partitionBy("doc_id").orderBy("run")
    after = {c: F.lead(c).over(nexts) for c in ("first", "last", "k0", "k1")}
    pairs = runs.select("doc_id", "first", F.col("last").alias("end"), "k0", "k1", *[x.alias(f"next_{c}") for c, x in after.items()])
    pairs = pairs.where("k1.doc_id = next_k0.doc_id and k1.number < next_k0.number and end < next_first")
    ends = {"last": "next_last", "k_doc": "k0.doc_id", "k_first": "k0.number", "k_last": "next_k1.number"}
    return pairs.select("doc_id", "first", *[F.col(c).alias(name) for name, c in ends.items()])


def theirs(pairs: DataFrame) -> DataFrame:
    """The spans that those of `bridge_pairs` are copies of."""
    return pairs.select(F.col("k_doc").alias("doc_id"), F.col("k_first").alias("first"), F.col("k_last").alias("last"))


def bridges(pairs: DataFrame, words: DataFrame, percent: int) -> DataFrame:
    """(doc_id, first, last): the spans of both sides that are similar."""
    of = words.select(F.col("doc_id").alias("k_doc"), *[F.col(c).alias(f"k_{c}") for c in ("first", "last", "items", "before", "after")])
    both = pairs.join(words, ["doc_id", "first", "last"]).join(of, ["k_doc", "k_first", "k_last"])
    found = saved(similar_spans(both, percent).select("doc_id", "first", "last", "k_doc", "k_first", "k_last"))
    return found.select("doc_id", "first", "last").unionByName(theirs(found)).distinct()


def bitmap(items: np.ndarray) -> dict[str, int]:
    """A bitmap of a set of hashes, as a sketch."""
    bits = np.zeros(64 * SKETCH, bool)
    bits[(items >> np.uint64(20)) % np.uint64(64 * SKETCH)] = True
    return {f"s{k}": int(x) for k, x in enumerate(np.packbits(bits, bitorder="little").view(np.int64))}


def bitmaps_alike(n: str, sketch: str, x_n: str, x_sketch: str, percent: int) -> Column:
    """Whether two sets can be similar: what their bitmaps have apart is not in common."""

    def only(one: str, other: str) -> Column:
        return functools.reduce(lambda p, q: p + q, [F.bit_count(a.bitwiseAND(F.bitwise_not(b))) for a, b in parts_of(one, other)])

    common = F.least(F.col(n) - only(sketch, x_sketch), F.col(x_n) - only(x_sketch, sketch))
    return (100 + percent) * common >= percent * (F.col(n) + F.col(x_n))


def line_clusters(variant: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(cls, keeper): the first occurrence (doc_id, number) of the cluster of each line that has more
    than one occurrence. `variant` is (token, cls, n, one), `sets` the shingles of those that collide."""
    posted = variant.join(sets.select("cls", "sketch", (F.octet_length("items") / 8).cast("long").alias("size")), "cls")
    posted = saved(posted.select("token", "cls", F.col("n").alias("hub"), F.col("size").alias("n"), "sketch"))
    groups = linked_components(posted, compared(sets, "items", of_items, percent), percent, bitmaps_alike)
    classes = variant.groupBy("cls").agg(F.max("n").alias("n"), F.min("one").alias("one")).join(groups.withColumnRenamed("node", "cls"), "cls", "left")
    classes = classes.withColumn("comp", F.coalesce("component", "cls"))
    comps = classes.groupBy("comp").agg(F.sum("n").alias("n"), F.min("one").alias("keeper")).where("n > 1").drop("n")
    return classes.select("cls", "comp").join(comps, "comp").select("cls", "keeper")


def repeated_paragraphs(docs: DataFrame, percent: int = 80, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, first_word, n_words, n_paragraphs, n_removed, component): the runs of repeated
    paragraphs and passages of at least `min_words` words, in documents that have any.

    Runs are unions of word ranges: of repeated lines and chunks, which are counted in n_paragraphs,
    and of bridges between chunks. `component` is the first of the run's clusters, named after its
    first occurrence (doc_id:number of a line or chunk); n_removed counts the units that are not the
    first of their cluster. Null texts have no paragraphs; null ids are left out; repeated rows repeat
    each other; an empty table gives none; very long texts are one row of a batch at a time; other
    columns are ignored. Units whose 64-bit hashes are equal are taken for equal.
    """
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    common = token_counts(docs).where("c > 1").select("token")
    found = saved(scan(docs).join(common.hint("shuffle_hash"), "token", "left_semi"))
    chunk, line = found.where("token & 1 = 0"), found.where("token & 1 = 1")

    of_chunk = chunk.groupBy("cls").agg(F.min(F.struct("doc_id", "number")).alias("keeper"))
    chunk = saved(chunk.drop("token").join(of_chunk, "cls"))
    pairs = saved(bridge_pairs(chunk))

    variant = saved(line.groupBy("token", "cls").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "number")).alias("one")))
    several = variant.groupBy("token").agg(F.count("*").alias("v")).where("v > 1").drop("v")
    wanted = variant.join(several, "token", "left_semi").groupBy("cls").agg(F.min("one").alias("one")).select("cls", "one.doc_id", "one.number")
    sets, words = asked_words(docs, wanted, pairs.select("doc_id", "first", "last").unionByName(theirs(pairs)).distinct())
    sets = saved(sets)
    keepers = saved(line_clusters(variant, sets, percent))
    line = line.select("doc_id", "number", "first_word", "n_words", "cls").distinct().join(keepers, "cls")

    end = (F.col("first_word") + F.col("n_words")).alias("end")
    removed = F.when((F.col("keeper.doc_id") == F.col("doc_id")) & (F.col("keeper.number") == F.col("number")), 0).otherwise(1)
    matched = [df.select("doc_id", "first_word", end, F.lit(1).alias("one"), removed.alias("removed"), "keeper") for df in (line, chunk)]
    bridge = bridges(pairs, words, percent)
    for side, word in (("first", F.col("first_word")), ("last", F.col("first_word") + F.col("n_words"))):
        bridge = bridge.join(chunk.groupBy("doc_id", F.col("number").alias(side)).agg(F.max(word).alias(f"{side}_at")), ["doc_id", side])
    spans = matched[0].unionByName(matched[1]).unionByName(bridge.select("doc_id", F.col("first_at").alias("first_word"), F.col("last_at").alias("end")), allowMissingColumns=True)
    by = Window.partitionBy("doc_id").orderBy("first_word", F.desc("end"))
    spans = spans.withColumn("reach", F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("run", F.sum(F.when(F.col("first_word") <= F.col("reach"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = spans.groupBy("doc_id", "run").agg(
        F.min("first_word").alias("first_word"), (F.max("end") - F.min("first_word")).alias("n_words"),
        F.count("one").alias("n_paragraphs"), F.sum("removed").alias("n_removed"), F.min("keeper").alias("k"),
    ).where(F.col("n_words") >= min_words)
    return runs.select("doc_id", "first_word", "n_words", "n_paragraphs", "n_removed", F.concat_ws(":", "k.doc_id", "k.number").alias("component"))
