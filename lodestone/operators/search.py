"""Search over a table of chunks for a table of questions, and fusion of rankings."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..storage import saved

LIMIT, MULTIPLIER, FETCH = 6, 3, 3
RRF = 60
#: Rows of a block of questions and of a block of chunks, and cells of a matrix of both.
QUERY_BLOCK, CHUNK_BLOCK, CELLS = 2048, 2048, 1 << 20
#: Blocks of questions are broadcast up to so many; beyond that the blocks' product is dealt out.
MAX_BROADCAST_BLOCKS = 64
#: So few blocks of questions are handed to the tasks that read the chunks; no product is made.
FEW_BLOCKS = 4
#: Blocks of chunks are broadcast up to so many bytes, where questions are many.
MAX_BROADCAST_BYTES = 64 << 20
#: About the most bytes of a block.
BLOCK_BYTES = 4 << 20
#: Questions of which a task holds the best rows at once.
HELD_QUESTIONS = 1 << 15
#: Chunks of least ids that keyword search looks at first, and how many times more next: questions with
#: full scores enough among them are done.
FIRST_CHUNKS, GROWTH = 1024, 16


def top(df: DataFrame, k: int, *order, by: str = "query_id", rank: str = "rank") -> DataFrame:
    """The first `k` rows of each question, with their ranks from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(rank) <= k)


def metadata_matches(query_service: Column, query_type: Column, chunk_type: Column, service: Column, file_type: Column) -> Column:
    """Service and file type filters hold for code only; documents pass."""
    fits = (query_service.isNull() | (service == query_service)) & (query_type.isNull() | (file_type == query_type))
    return (chunk_type != "code") | fits


def blocks(df: DataFrame, rows: int) -> DataFrame:
    """(block): `df` in blocks of at most `rows` rows, and fewer if they are long, each as one Arrow stream."""

    def run(batches):
        for batch in batches:
            packed = []
            n = max(min(rows, BLOCK_BYTES * batch.num_rows // max(batch.nbytes, 1)), 1)
            for at in range(0, batch.num_rows, n):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as writer:
                    writer.write_batch(batch.slice(at, n))
                packed.append(sink.getvalue().to_pybytes())
                if len(packed) == 4 or len(packed[0]) > BLOCK_BYTES // 4:
                    yield pa.RecordBatch.from_pydict({"block": pa.array(packed, pa.binary())})
                    packed = []
            if packed:
                yield pa.RecordBatch.from_pydict({"block": pa.array(packed, pa.binary())})

    return df.mapInArrow(run, "block binary")


def unpacked(block: bytes) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(block)))


class Best:
    """The best `k` rows (least value, then least id) of each of `n` questions so far."""

    def __init__(self, n: int, k: int):
        self.k, self.parts, self.rows, self.kept = k, [], 0, 0
        #: No row behind these, which k rows reach, is wanted.
        self.bound, self.edge = np.full(n, np.inf), np.full(n, None, object)

    def closed(self, least) -> np.ndarray:
        """Which questions want no equal value of an id from `least` on."""
        known = self.edge != None  # noqa: E711
        known[known] = self.edge[known] < least
        return known

    def add(self, values: np.ndarray, ids, extras: list[np.ndarray], decimals: int | None) -> None:
        """Takes what is wanted of a matrix of values (infinite for no candidate) whose columns go by id."""
        room = 0 if decimals is None else 10.0**-decimals
        rows = np.flatnonzero(values.min(axis=1) <= self.bound + room)
        if not len(rows):
            return
        v = values[rows] if decimals is None else values[rows].round(decimals)
        bound, closed = self.bound[rows, None], self.closed(ids[0].as_py())[rows, None]
        want = np.isfinite(v) & ((v < bound) | (~closed & (v == bound)))
        many = np.flatnonzero(want.sum(axis=1) >= self.k)
        if len(many):
            some = np.where(want[many], v[many], np.inf)
            worst = np.partition(some, self.k - 1, axis=1)[:, self.k - 1]
            less, same = some < worst[:, None], some == worst[:, None]
            same &= np.cumsum(same, axis=1) <= self.k - less.sum(axis=1)[:, None]
            want[many] = less | same
            last = same.shape[1] - 1 - same[:, ::-1].argmax(axis=1)
            names = np.array(ids.to_pylist() + [None], object)[:-1][last]
            for q, w, edge in zip(rows[many], worst, names, strict=True):
                if w < self.bound[q] or (w == self.bound[q] and (self.edge[q] is None or edge < self.edge[q])):
                    self.bound[q], self.edge[q] = w, edge
        q, j = np.nonzero(want)
        if len(q):
            columns = [pa.array(rows[q]), pa.array(v[q, j]), ids.take(pa.array(j)), *(pa.array(x[rows[q], j]) for x in extras)]
            self.parts.append(pa.Table.from_arrays(columns, names=["q", "value", "id", *map(str, range(len(extras)))]))
            self.rows += len(q)
            if self.rows > 2 * self.kept + CELLS // 8:
                self.table()

    def table(self) -> pa.Table | None:
        """What is held, (q, value, id, extras), with no more than k rows of a question."""
        if not self.parts:
            return None
        held = pa.concat_tables(self.parts)
        held = held.take(pc.sort_indices(held, sort_keys=[("q", "ascending"), ("value", "ascending"), ("id", "ascending")]))
        q = np.asarray(held["q"])
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = np.flatnonzero(place == self.k - 1)
        self.bound[q[last]], self.edge[q[last]] = np.asarray(held["value"])[last], objects(held["id"].take(pa.array(last)))
        held = held.filter(pa.array(place < self.k)).combine_chunks()
        self.parts, self.rows, self.kept = [held], held.num_rows, held.num_rows
        return held


def best_of_blocks(queries: DataFrame, chunks: DataFrame, prepare: Callable, score: Callable, k: int, value: str, extra: dict[str, T.DataType], decimals: int | None = None, floor: float | None = None, compact: bool = False) -> DataFrame:
    """(query_id, id, value, extra ...): for each question of `queries` (query_id ...) candidates
    among `chunks` (id ...), at least the `k` with the least `value`; ties by id.

    Chunks are read once, in blocks, and meet the questions in blocks; rows of pairs are never made.
    prepare(block of questions) is called once for each task and block; score(prepared, rows of
    chunks) gives a matrix of values, infinite for what is no candidate, and a matrix of each extra, for
    CELLS pairs at most. Values are rounded to `decimals`; none is less than `floor`, so rows that only
    have greater ids are skipped where all questions have k of that. A task holds the best k of each
    question over all its blocks, of HELD_QUESTIONS at a time.

    Every task gives k rows for each question it meets. So with `compact`, for chunks without long texts or
    few of them, their blocks are saved; if they are small and the questions many, each question meets
    them all in one task, and else no more tasks are made than run at once.
    """
    asked = saved(blocks(queries, QUERY_BLOCK).withColumn("number", F.monotonically_increasing_id()), "questions")
    asked = asked.select(F.col("block").alias("asked"), "number")
    many, spread = asked.count(), queries.sparkSession.sparkContext.defaultParallelism
    rows, small = chunks, False
    if compact:
        rows = saved(blocks(chunks, CHUNK_BLOCK), "blocks")
        small = many >= spread and (rows.agg(F.sum(F.octet_length("block"))).first()[0] or 0) <= MAX_BROADCAST_BYTES  # one number
        rows = rows.coalesce(spread)
    elif many > FEW_BLOCKS:
        rows = blocks(chunks, CHUNK_BLOCK)
    # There a block of questions has met all chunks before the next one comes.
    most = 1 if small else HELD_QUESTIONS
    few = None
    if small:
        both = asked.repartition(spread).crossJoin(F.broadcast(rows))
    elif many > FEW_BLOCKS:
        both = rows.crossJoin(F.broadcast(asked) if many <= MAX_BROADCAST_BLOCKS else asked)
    else:
        both = rows
        few = queries.sparkSession.sparkContext.broadcast([(r["number"], bytes(r["asked"])) for r in asked.collect()])  # FEW_BLOCKS at most
    query_type, id_type = to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(chunks.schema["id"].dataType)
    names = ["query_id", "id", value, *extra]
    types = [query_type, id_type, pa.float64(), *map(to_arrow_type, extra.values())]

    def rows_of(query_ids, best) -> Iterator[pa.RecordBatch]:
        held = best.table()
        if held is not None:
            columns = [query_ids.take(held["q"]), held["id"], held["value"], *(held[str(n)] for n in range(len(extra)))]
            yield from pa.Table.from_arrays([c.cast(t) for c, t in zip(columns, types, strict=True)], names=names).to_batches(1 << 16)

    def meetings(batches) -> Iterator[tuple[int, bytes, pa.RecordBatch]]:
        """The blocks of questions and the chunks that they meet."""
        batches = iter(batches)
        while (batch := next(batches, None)) is not None:
            if few is None:
                for r in range(batch.num_rows):
                    yield batch.column("number")[r].as_py(), batch.column("asked")[r].as_py(), unpacked(batch.column("block")[r].as_py())
            else:
                parts = (unpacked(b.as_py()) for b in batch.column("block")) if compact else (batch.slice(at, CHUNK_BLOCK) for at in range(0, batch.num_rows, CHUNK_BLOCK))
                for part in parts:
                    for number, block in few.value:
                        yield number, block, part
                parts = part = None
            batch = None  # it isn't held while the next one is read

    def run(batches) -> Iterator[pa.RecordBatch]:
        prepared: dict[int, tuple] = {}
        for number, block, rows in meetings(batches):
            if number not in prepared:
                if sum(len(query_ids) for query_ids, _, _ in prepared.values()) >= most:
                    for query_ids, _, best in prepared.values():
                        yield from rows_of(query_ids, best)
                    # Nothing of the blocks before is held while the next one is prepared.
                    prepared, given, best = {}, None, None
                block = unpacked(block)
                prepared[number] = (block.column("query_id"), prepare(block), Best(block.num_rows, k))
            query_ids, given, best = prepared[number]
            rows = rows.take(pc.sort_indices(rows.column("id")))
            step = max(CELLS // max(len(query_ids), 1), 1)
            for at in range(0, rows.num_rows, step):
                part = rows.slice(at, step)
                ids = part.column("id")
                if floor is not None and (best.bound <= floor).all() and best.closed(ids[0].as_py()).all():
                    break
                values, extras = score(given, part)
                best.add(values, ids, extras, decimals)
            values = extras = part = ids = rows = block = None
        for query_ids, _, best in prepared.values():
            yield from rows_of(query_ids, best)

    fields = [queries.schema["query_id"], chunks.schema["id"], T.StructField(value, T.DoubleType()), *(T.StructField(c, t) for c, t in extra.items())]
    return both.mapInArrow(run, T.StructType(fields))


def objects(column) -> np.ndarray:
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def misfits(asked: pa.RecordBatch, rows: pa.RecordBatch) -> np.ndarray:
    """Which chunks a question's filters keep out; `metadata_matches` as a matrix."""
    out = np.zeros((asked.num_rows, rows.num_rows), bool)
    for want, have in (("serviceFilter", "serviceName"), ("fileTypeFilter", "fileType")):
        wants, haves = objects(asked.column(want)), objects(rows.column(have))
        for q in np.flatnonzero(wants != None):  # noqa: E711
            out[q] |= haves != wants[q]
    return out & (objects(rows.column("chunkType")) == "code")[None, :]


def vectors(column) -> np.ndarray:
    """A column of vectors as a matrix; refused if they differ in width or hold a null, which no distance
    could be told from."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("a vector holds a null")
    if len(set(column.value_lengths().to_pylist())) > 1:
        raise ValueError("vectors have different widths")
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def nearest(queries: DataFrame, chunks: DataFrame, k: int, decimals: int = 6, filtered: bool = False) -> DataFrame:
    """(query_id, id, distance, rank): for each question (query_id, vector) the `k` chunks (id,
    vector) with the least squared Euclidean distance; ties by id. Exact.

    Questions and chunks without a vector are left out; vectors of different widths, or with a null in
    them, are an error. With `filtered`, questions have serviceFilter and fileTypeFilter and chunks have
    chunkType, serviceName, fileType.
    """
    columns = ["query_id", "vector"] + (["serviceFilter", "fileTypeFilter"] if filtered else [])
    columns_c = ["id", "vector"] + (["chunkType", "serviceName", "fileType"] if filtered else [])

    def prepare(block):
        m = vectors(block.column("vector"))
        return block, m, (m**2).sum(axis=1)

    def score(given, rows):
        block, m, squares = given
        x = vectors(rows.column("vector"))
        if len(x) and x.shape[1] != m.shape[1]:
            raise ValueError(f"questions have vectors of {m.shape[1]} numbers, chunks of {x.shape[1]}")
        d = (-2 * m) @ x.T
        d += squares[:, None]
        d += (x**2).sum(axis=1)[None, :]
        np.maximum(d, 0, out=d)
        if filtered:
            d[misfits(block, rows)] = np.inf
        return d, []

    some = F.col("vector").isNotNull()
    found = best_of_blocks(queries.where(some).select(*columns), chunks.where(some).select(*columns_c), prepare, score, k, "distance", {}, decimals, compact=True)
    return top(found, k, "distance", "id")


def results(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, rank, id, content, score, metadata, filePath, serviceName, fileType, symbolName) of
    hits (query_id, id, score, rank): the chunk's other columns nested, and its main ones on top."""
    nested = ["filePath", "relativePath", "serviceName", "fileType", "language", "symbolName", "level", "startLine", "endLine", "chunkType"]
    joined = hits.select("query_id", "id", "score", "rank").join(chunks.select("id", "content", *nested), "id")
    whole = F.coalesce("content", F.lit("")).alias("content")
    return joined.select("query_id", "rank", "id", whole, "score", F.struct(*nested).alias("metadata"), "filePath", "serviceName", "fileType", "symbolName")


def semantic_score(distance: Column) -> Column:
    return 1 - F.least(F.coalesce(distance, F.lit(1.0)), F.lit(1.0))


def merged_by_distance(code: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """Code and document hits (query_id, id, distance) in one list; a missing distance is last."""
    both = code.withColumn("__from", F.lit(0)).unionByName(documents.withColumn("__from", F.lit(1)))
    return top(both.drop("rank"), k, F.coalesce("distance", F.lit(float("inf"))), "__from", "id").drop("__from")


def keyword_index(words: list[list[str]]):
    """The distinct words of lists of words, an automaton of them, which of them may overlap
    themselves, and for each word the lists that have it (as often as they do)."""
    import ahocorasick

    distinct = sorted({w for ws in words for w in ws if w})
    place = {w: k for k, w in enumerate(distinct)}
    automaton = ahocorasick.Automaton()
    for w, k in place.items():
        automaton.add_word(w, k)
    if distinct:
        automaton.make_automaton()
    looped = {k for w, k in place.items() if any(w.startswith(w[-n:]) for n in range(1, len(w)))}
    pairs = np.array(sorted((place[w], q) for q, ws in enumerate(words) for w in ws if w), np.int64).reshape(-1, 2)
    begin = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
    return distinct, automaton, looped, pairs[:, 1], begin


def word_counts(texts: list[str | None], index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, count) of the index's words in texts, without overlaps. A text's work is in
    proportion to its length and to the words found in it."""
    distinct, automaton, looped, _, _ = index
    at, word, count = [], [], []
    for k, text in enumerate(texts):
        found = Counter(map(itemgetter(1), automaton.iter(text))) if text and distinct else {}
        at.append(np.full(len(found), k))
        word.append(np.fromiter(found.keys(), np.int64, len(found)))
        # Only a word that may overlap itself has to be counted anew.
        exact = (text.count(distinct[w]) if n > 1 and w in looped else n for w, n in found.items())
        count.append(np.fromiter(exact, np.int64, len(found)))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([*x, none]) for x in (at, word, count))


def keyword_hits(queries: DataFrame, chunks: DataFrame, k: int, match: str = "literal", keyword_filter_documents: bool = True, candidate_cap: int | None = None, filtered: bool = False, kept: bool = False) -> DataFrame:
    """(query_id, id, occurrences, score, rank): chunks (id, content, chunkType) with any keyword of
    a question (query_id, keywords), best first; ties by id.

    A chunk's score needs its own counts only, so it is made where the chunk is read, once for each
    block of questions, with an automaton of the block's words; only the best `k` are shuffled.
    Questions that ask for the same are asked once. Scores end at 1, so a question with `k` full scores
    among the chunks of least ids is answered by these; only the others meet more and more of the rest.
    `match="like"` takes keywords as LIKE patterns that mind case, as the reference does;
    `keyword_filter_documents=False` lets documents without any keyword in with score 0, and
    `candidate_cap` keeps only so many chunks of least vector norm before scoring (needs `vector`),
    both as the reference does. With `filtered`, the questions' serviceFilter and fileTypeFilter hold
    for code chunks. Chunks are read several times, so they are saved first, unless they are `kept` in files.
    """
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    filters = ["serviceFilter", "fileTypeFilter"] if filtered else []
    wants = ["words", "n", *filters]
    rows_c = ["id", "content", "chunkType"] + (["serviceName", "fileType"] if filtered else []) + ([norm.alias("norm")] if candidate_cap is not None else [])
    asked = saved(queries.select("query_id", F.array_sort(F.array_distinct("keywords")).alias("words"), F.size("keywords").alias("n"), *filters), "asked")
    asks = saved(asked.groupBy(*wants).agg(F.min("query_id").alias("query_id")), "asks")
    plain = lambda w: match != "like" or not ("%" in w or "_" in w)

    def prepare(block):
        index = keyword_index([ws or [] for ws in block.column("lower").to_pylist()])
        if match != "like":
            return block, index, None, []
        words = [[w for w in ws or [] if w is not None] for ws in block.column("words").to_pylist()]
        patterns: dict[str, list[int]] = {}
        for q, ws in enumerate(words):
            for w in ws:
                if not plain(w) or not w:
                    patterns.setdefault(w, []).append(q)
        compiled = [(re.compile(re.escape(w).replace("%", "[\\s\\S]*").replace("_", "[\\s\\S]")), qs) for w, qs in patterns.items()]
        return block, index, keyword_index([[w for w in ws if plain(w)] for ws in words]), compiled

    def cells(texts, index, width):
        """The cells of the words of `index` that stand in texts, and how often they do: a word that many questions
        ask for has many, so no more than half of CELLS are made at once, or those of a word."""
        at, word, count = word_counts(texts, index)
        _, _, _, lists, begin = index
        times = begin[word + 1] - begin[word]
        ends, low = np.cumsum(times), 0
        while low < len(word):
            high = max(int(np.searchsorted(ends, ends[low] - times[low] + CELLS // 2, "right")), low + 1)
            n = times[low:high]
            which = np.repeat(begin[word[low:high]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield lists[which] * width + np.repeat(at[low:high], n), np.repeat(count[low:high], n)
            low = high

    def score(given, rows):
        block, index, exact, patterns = given
        shape = (block.num_rows, rows.num_rows)
        occurrences = np.zeros(shape[0] * shape[1])
        for cell, count in cells(rows.column("text").to_pylist(), index, shape[1]):
            occurrences += np.bincount(cell, count, len(occurrences))
        occurrences = occurrences.reshape(shape).astype(np.int64)
        found = occurrences > 0
        if match == "like":
            texts = rows.column("content").to_pylist()
            found = np.zeros(shape, bool)
            for cell, _ in cells(texts, exact, shape[1]):
                found.ravel()[cell] = True
            for pattern, qs in patterns:
                held = np.array([t is not None and bool(pattern.search(t)) for t in texts])
                found[qs] |= held
        if not keyword_filter_documents:
            found |= (objects(rows.column("chunkType")) == "document")[None, :]
        if filtered:
            found &= ~misfits(block, rows)
        n = np.asarray(block.column("n"), np.int64)[:, None]
        value = -np.minimum(occurrences / np.maximum(5 * n, 1), 1.0)
        if candidate_cap is None:
            return np.where(found, value, np.inf), [occurrences]
        return np.where(found, np.asarray(rows.column("norm"), np.float64)[None, :], np.inf), [occurrences, value]

    def best(asks, rows, few=False):
        questions = asks.withColumn("lower", F.transform("words", F.lower))
        rows = rows.withColumn("text", F.lower("content"))
        rows = rows if match == "like" else rows.drop("content")
        if candidate_cap is None:
            out = best_of_blocks(questions, rows, prepare, score, k, "negative", {"occurrences": T.LongType()}, floor=-1.0, compact=few)
        else:
            extra = {"occurrences": T.LongType(), "negative": T.DoubleType()}
            out = top(best_of_blocks(questions, rows, prepare, score, candidate_cap, "order", extra), candidate_cap, "order", "id").drop("rank")
        return top(out.select("query_id", "id", "occurrences", (-F.col("negative") + F.lit(0.0)).alias("score")), k, F.desc("score"), "id")

    if candidate_cap is None:
        rows = chunks.select(*rows_c)
        rows = rows if kept else saved(rows.sortWithinPartitions("id"), "searched")
        spread = rows.sparkSession.sparkContext.defaultParallelism
        total, n, asking, hits, low = rows.count(), FIRST_CHUNKS, asks, None, None
        while True:
            here = rows if low is None else rows.where(F.col("id") > low)
            if n < total:
                edge = rows.select("id").orderBy("id").limit(n).agg(F.max("id").alias("id")).first()["id"]  # one id
                here = here.where(F.coalesce(F.col("id") <= edge, F.lit(True)))
            # A few chunks may stand in one file and are spread; many are read where they are.
            spread_anew = n < total and n <= FIRST_CHUNKS * GROWTH
            here = here.repartition(spread).sortWithinPartitions("id") if spread_anew else here.coalesce(spread)
            # A text is read anew for each block of questions.
            found = best(asking if spread_anew else asking.coalesce(-(-asking.count() // QUERY_BLOCK) or 1), here, spread_anew)
            hits = found if hits is None else top(hits.unionByName(found).drop("rank"), k, F.desc("score"), "id")
            if n >= total:
                break
            # No later chunk has a better score than 1 or, for an equal one, a lesser id.
            hits = saved(hits, "hits")
            done = hits.where("score = 1.0").groupBy("query_id").count().where(F.col("count") >= k)
            asking = saved(asks.join(done, "query_id", "left_anti"), "asking")
            if asking.isEmpty():
                break
            n, low = n * GROWTH, edge
    else:
        hits = best(asks, chunks.select(*rows_c))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in wants]
    both = asked.alias("a").join(asks.alias("b"), same).select(F.col("a.query_id").alias("query_id"), F.col("b.query_id").alias("__ask"))
    return both.join(hits.withColumnRenamed("query_id", "__ask"), "__ask").select("query_id", "id", "occurrences", "score", "rank")


def last_rank(hits: DataFrame) -> DataFrame:
    """(query_id, id, rank) of a ranked list; an id that is in it twice keeps its last rank."""
    return hits.groupBy("query_id", "id").agg(F.max("rank").alias("rank"))


def fused(semantic: DataFrame, keyword: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank, semantic_rank, keyword_rank): reciprocal rank fusion of two
    ranked lists; ties stay in semantic, then keyword order."""
    s = last_rank(semantic).withColumnRenamed("rank", "semantic_rank")
    w = last_rank(keyword).withColumnRenamed("rank", "keyword_rank")
    both = s.join(w, ["query_id", "id"], "full")
    part = lambda c: F.coalesce(F.lit(1.0) / (RRF + F.col(c)), F.lit(0.0))
    both = both.withColumn("score", part("semantic_rank") + part("keyword_rank"))
    return top(both, k, F.desc("score"), F.asc_nulls_last("semantic_rank"), F.asc_nulls_last("keyword_rank"), "id")


def hybrid_search(queries: DataFrame, chunks: DataFrame, limit: int = LIMIT * MULTIPLIER, **keyword_options) -> DataFrame:
    """Semantic and keyword search over chunks (id, content, vector, chunkType ...) fused, best
    `limit` of each question (query_id, vector, keywords, serviceFilter, fileTypeFilter)."""
    semantic = nearest(queries, chunks, limit, filtered=True)
    keyed = keyword_hits(queries, chunks, limit, filtered=True, **keyword_options)
    return fused(semantic, keyed, limit)
