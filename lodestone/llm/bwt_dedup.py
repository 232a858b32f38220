"""Exact substring deduplication: which byte strings of a given length stand anywhere else.

A text's windows of `length` bytes are cut into runs that share the K-byte substring with the least
hash (the leftmost of equals). Equal windows have it at the same place, so all occurrences of a
window fall into the group of its hash, whichever documents they stand in, and two in one document
into two of its runs: groups can be judged apart from each other. Only groups
with two occurrences are looked at further, and equal segments of a group are kept once, with
their count.

A group too large for a block is dealt anew by longer substrings of its windows, and so on; at
`length` bytes a group is one window. Whole groups are packed into blocks of bounded size. In a block, the LCP values below `length` of
all suffixes come from its Burrows-Wheeler transform by breadth-first backward extension of
intervals: common prefixes in increasing order, stopping at `length`. Suffixes between which no
value was derived share at least `length` bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASE, BASE_INVERSE, BYTE, column_bytes, mix, powers, saved, slices, small_side

LENGTH = 200
K = 96
#: Bytes of a block, about; a group of more than HOT_BYTES is dealt anew by longer substrings.
BLOCK_BYTES = 3 << 18
HOT_BYTES = 1 << 20
MAX_BROADCAST_ROWS = 200_000
#: Ends every segment in a block; no UTF-8 text has this byte.
SEPARATOR = 255


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def segments(data: np.ndarray, offsets: np.ndarray, length: int, k: int):
    """(row, start in row, windows, least hash, fingerprint) of the runs of windows of each row."""
    n = len(data)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    up, down = powers(BASE, n), powers(BASE_INVERSE, n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[data] * up, out=total[1:])
    hashes = mix((total[k:] - total[:-k]) * down[: n - k + 1])
    # Upper half: by what the least is chosen; lower half: where it is, the leftmost of equals.
    where = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    least = sliding_min(where, length - k + 1)
    # Windows that would cross into the next row are no windows.
    sizes = np.diff(offsets)
    first = np.zeros(len(least) + 1, np.int32)
    long = np.flatnonzero(sizes >= length)
    first[offsets[long]] += 1
    first[offsets[long] + sizes[long] - length + 1] -= 1
    valid = np.cumsum(first[:-1]) > 0
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    new[offsets[long]] = True
    start = np.flatnonzero(new)
    last = valid.copy()
    last[:-1] &= new[1:] | ~valid[1:]
    end = np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    windows = end - start
    mark = mix((total[end + length - 1] - total[start]) * down[start] + windows.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return row, start - offsets[row], windows, hashes[(least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)], mark


def scan(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(h, fp, id, key, at, windows) of all segments of documents (id, key, text)."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = column_bytes(part.column("text"))
                row, at, windows, least, mark = segments(data, offsets, length, k)
                arrays = [pa.array(x) for x in (least.view(np.int64), mark.view(np.int64))]
                arrays += [part.column(c).take(pa.array(row)) for c in ("id", "key")]
                arrays += [pa.array(x.astype(np.int32)) for x in (at, windows)]
                yield pa.RecordBatch.from_arrays(arrays, names=["h", "fp", "id", "key", "at", "windows"])

    return docs.mapInArrow(run, f"h long, fp long, id {kind}, key long, at int, windows int")


def group_counts(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(h, c): segments of each group, counted within slices before any shuffle."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                least, count = np.unique(segments(*column_bytes(part.column("text")), length, k)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(least.view(np.int64)), pa.array(count.astype(np.int32))], names=["h", "c"])

    return docs.select("text").mapInArrow(run, "h long, c int").groupBy("h").agg(F.sum("c").alias("c"))


def first_bytes(text: np.ndarray) -> np.ndarray:
    """The first 8 bytes of every suffix as a number; past the end: separators."""
    padded = np.append(text, np.full(8, SEPARATOR, np.uint8)).astype(np.uint64)
    word = np.zeros(len(text), np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | padded[j : j + len(text)]
    return word


def suffix_order(word: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` bytes at least, from the order by 8 (`word`), 24,
    72 and so on; what is alone in its group is left alone."""
    n = len(word)

    def regroup(order, values, base):
        """Ranks of `order` by equal runs of `values`: places of the runs' first members."""
        new = np.ones(len(order), bool)
        new[1:] = values[1:] != values[:-1]
        place = np.arange(len(order))
        return base[np.maximum.accumulate(np.where(new, place, 0))], new

    order = np.argsort(word)
    rank = np.zeros(n + 1, np.int64)
    group, new = regroup(order, word[order], np.arange(1, n + 1))
    rank[order] = group
    size, done = 8, np.zeros(n, bool)
    sorted_all = order
    fold = 3 if (n + 2) ** 3 < 2**63 else 2  # ranks that one number holds
    while size < depth:
        alone = new & np.append(new[1:], True)
        done[order[alone]] = True
        active = sorted_all[~done[sorted_all]]
        if not len(active):
            break
        value = rank[active]
        for j in range(1, fold):
            value = value * np.int64(n + 2) + rank[np.minimum(active + j * size, n)]
        by = np.argsort(value)
        order = active[by]
        # Members of a group take the group's places, in their new order.
        places = rank_places(rank[active])
        group, new = regroup(order, value[by], places)
        rank[order] = group
        sorted_all[places - 1] = order
        size *= fold
    return sorted_all


def rank_places(first: np.ndarray) -> np.ndarray:
    """Places of members of groups: the group's first place and on, for ranks in sorted order."""
    new = np.ones(len(first), bool)
    new[1:] = first[1:] != first[:-1]
    at = np.arange(len(first))
    return first + at - np.maximum.accumulate(np.where(new, at, 0))


def common_prefix_groups(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, group of each place): neighbours in one group share `length` bytes or more.

    LCP values are set once each, in increasing order. An interval of suffixes that begin with a
    string is extended to the left by each byte before them (their LF images); if the value at the
    new interval's end is still open, it is the length of the string before, and only then is the
    interval extended further. Values below 8 are read off the first 8 bytes, and the extension
    starts from strings of 8. What is open at the end is `length` or more.
    """
    word = first_bytes(text)
    order = suffix_order(word, length + 1)
    n = len(text)
    order = order.astype(np.int32)  # a block is far smaller than 2**31; narrow arrays are faster
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    before = text[order - 1]  # the transform; the first suffix is preceded by the last byte
    back = place[order - 1]
    initial = text[order]
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    owner = np.full(n + 1, -1, np.int32)
    low, high = np.array([0], np.int32), np.array([n], np.int32)
    begin = 0
    if length > 8:
        begin, word = 8, word[order]
        high = np.flatnonzero(word[1:] != word[:-1]).astype(np.int32) + 1
        known[high] = True
        low = np.append(np.int32(0), high[:-1])[: len(high)]
        last = (word[high - 1] >> np.uint64(8)) == (word[high] >> np.uint64(8))  # of these the value is 7
        low, high = low[last], high[last]
    for depth in range(begin, length):
        if not len(low):
            break
        width = high - low
        rows = np.repeat(low - np.cumsum(width, dtype=np.int32) + width, width)
        rows += np.arange(len(rows), dtype=np.int32)
        which = np.repeat(np.arange(len(low), dtype=np.int32), width)
        if depth:  # strings across a separator are of no interest
            inner = before[rows] != SEPARATOR
            rows, which = rows[inner], which[inner]
        images = back[rows]
        owner[images] = which
        after = images + 1
        ends = after[(owner[after] != which) | (initial[np.minimum(after, n - 1)] != initial[images])]
        begins = images[(owner[images - 1] != which) | (initial[images - 1] != initial[images])]
        owner[images] = -1
        begins.sort()
        ends.sort()
        fresh = ~known[ends]
        known[ends[fresh]] = True
        low, high = begins[fresh], ends[fresh]
    return order, np.cumsum(known[:n]) - 1


def repeated_windows(pieces: list[bytes], windows: np.ndarray, counts: np.ndarray, length: int) -> list[list[int]]:
    """For each distinct segment of a block, [from, to, from, to ...): its windows that occur again
    (in another segment or place, or because the segment itself occurs more than once)."""
    joined = np.frombuffer(bytes([SEPARATOR]).join(pieces) + bytes([SEPARATOR]), np.uint8)
    starts = np.cumsum([0] + [len(p) + 1 for p in pieces[:-1]])
    order, group = common_prefix_groups(joined, length)
    weight = np.zeros(len(joined), np.int64)
    for s, w, c in zip(starts, windows, counts, strict=True):
        weight[s : s + w] = c
    by_place = weight[order]
    total = np.bincount(group, by_place)
    again = np.zeros(len(joined) + 1, bool)
    again[order] = (total[group] >= 2) & (by_place > 0)
    edges = np.flatnonzero(np.diff(again.astype(np.int8), prepend=0))
    # Windows of different segments are never adjacent: a segment is longer than its windows.
    piece = np.searchsorted(starts, edges, side="right") - 1
    local = edges - starts[piece]
    cuts = np.searchsorted(piece, np.arange(len(pieces) + 1))
    return [local[cuts[k] : cuts[k + 1]].tolist() for k in range(len(pieces))]


def judged_in_blocks(distinct: DataFrame, length: int, block_bytes: int, blocks: int) -> DataFrame:
    """(h, fp, runs) of distinct segments (h, fp, n, windows, bytes), whole groups to a block."""

    def run(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            runs = repeated_windows([r[4] for r in held], np.array([r[3] for r in held]), np.array([r[2] for r in held]), length)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.int64()), pa.array([r[1] for r in held], pa.int64()), pa.array(runs, pa.list_(pa.int32()))], names=["h", "fp", "runs"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and size >= block_bytes and r[0] != held[-1][0]:
                    yield flush()
                    held, size = [], 0
                held.append(r)
                size += len(r[4])
        if held:
            yield flush()

    return distinct.repartition(blocks, "h").sortWithinPartitions("h", "fp").select("h", "fp", "n", "windows", "bytes").mapInArrow(run, "h long, fp long, runs array<int>")


def dealt_anew(pieces: DataFrame, length: int, k: int) -> DataFrame:
    """(h, fp, n, from, windows, h2, fp2): the segments (h, fp, n, windows, bytes) cut again, by
    longer substrings of `k` bytes."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "bytes", 1 << 20):
                row, at, windows, least, mark = segments(*column_bytes(part.column("bytes")), length, k)
                arrays = [part.column(c).take(pa.array(row)) for c in ("h", "fp", "n")]
                arrays += [pa.array(x.astype(np.int32)) for x in (at, windows)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(least.view(np.int64)), pa.array(mark.view(np.int64))], names=["h", "fp", "n", "from", "windows", "h2", "fp2"])

    return pieces.mapInArrow(run, "h long, fp long, n long, from int, windows int, h2 long, fp2 long")


def judged(pieces: DataFrame, length: int, k: int, block_bytes: int, hot_bytes: int) -> DataFrame:
    """(h, fp, runs) of distinct segments (h, fp, n, windows, bytes) that hold repeated windows."""
    size = saved(pieces.groupBy("h").agg(F.sum(F.octet_length("bytes") + 1).alias("b")))
    total = size.agg(F.sum("b")).first()[0] or 0
    hot = size.where(F.col("b") > hot_bytes).select("h")
    if k >= length or hot.isEmpty():
        return judged_in_blocks(pieces, length, block_bytes, max(1, -(-total // (2 * block_bytes))))
    out = judged_in_blocks(pieces.join(hot, "h", "left_anti"), length, block_bytes, max(1, -(-total // (2 * block_bytes))))
    large = pieces.join(hot, "h", "left_semi")
    longer = (k + length + 1) // 2
    parts = dealt_anew(large, length, longer)
    several = parts.groupBy("h2").agg(F.sum("n").alias("c")).where("c > 1").select("h2")
    parts = saved(parts.join(several.hint("shuffle_hash"), "h2", "left_semi"))
    distinct = parts.groupBy("h2", "fp2").agg(F.sum("n").alias("n"), F.first("windows").alias("windows"), F.min(F.struct("h", "fp", "from")).alias("one"))
    distinct = distinct.select("h2", "fp2", "n", "windows", "one.h", "one.fp", "one.from").join(large.select("h", "fp", "bytes"), ["h", "fp"])
    cut = F.expr(f"substring(bytes, `from` + 1, windows + {length - 1})").alias("bytes")
    inner = saved(distinct.select(F.col("h2").alias("h"), F.col("fp2").alias("fp"), "n", "windows", cut))
    found = judged(inner, length, longer, block_bytes, hot_bytes).select(F.col("h").alias("h2"), F.col("fp").alias("fp2"), "runs")
    moved = F.transform("runs", lambda x: x + F.col("from"))
    again = parts.join(found.where(F.size("runs") > 0), ["h2", "fp2"]).groupBy("h", "fp").agg(F.flatten(F.collect_list(moved)).alias("runs"))  # of one segment
    return out.unionByName(again)


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = K, block_bytes: int = BLOCK_BYTES, hot_bytes: int = HOT_BYTES, max_broadcast: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """(id, key, spans): for documents (id, key, text) that hold repeated strings, the covered byte
    ranges as an array of (begin, end), maximal and in order. id and key stand for a text."""
    counted = group_counts(docs, length, k).where("c > 1").select("h")
    found = saved(scan(docs, length, k).join(counted.hint("shuffle_hash"), "h", "left_semi"))
    distinct = found.groupBy("h", "fp").agg(F.count("*").alias("n"), F.first("windows").alias("windows"), F.min(F.struct("id", "key", "at")).alias("one"))
    facts = F.struct("h", "fp", "n", "windows", F.col("one.at").alias("at"))
    asked = saved(distinct.groupBy(F.col("one.id").alias("one_id"), F.col("one.key").alias("one_key")).agg(F.collect_list(facts).alias("asked")))  # of one text
    keys = asked.select("one_id", "one_key")
    same = F.col("id").eqNullSafe(F.col("one_id")) & (F.col("key") == F.col("one_key"))
    wanted = docs.join(small_side(keys, keys.count(), max_broadcast), same, "left_semi").dropDuplicates(["id", "key"])

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = column_bytes(part.column("text"))
                rows = [
                    (a["h"], a["fp"], a["n"], a["windows"], data[o + a["at"] : o + a["at"] + a["windows"] + length - 1].tobytes())
                    for o, asked in zip(offsets, part.column("asked").to_pylist(), strict=False)
                    for a in asked
                ]
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names=["h", "fp", "n", "windows", "bytes"])

    pieces = saved(wanted.join(asked, same).select("text", "asked").mapInArrow(cut, "h long, fp long, n long, windows int, bytes binary"))
    again = saved(judged(pieces, length, k, block_bytes, hot_bytes).where(F.size("runs") > 0))
    pairs = F.transform(
        F.sequence(F.lit(0), F.size("runs") - 2, F.lit(2)),
        lambda i: F.struct((F.col("at") + F.get("runs", i)).alias("begin"), (F.col("at") + F.get("runs", i + 1) + length - 1).alias("end")),
    )
    spans = found.join(again, ["h", "fp"]).select("id", "key", F.inline(pairs)).distinct()
    # Overlapping or touching spans of a document become one.
    by = Window.partitionBy("id", "key").orderBy("begin", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(F.col("begin") <= reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(by))
    spans = spans.groupBy("id", "key", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return spans.groupBy("id", "key").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))


def remove_repeats(df: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row; strings are judged on the
    input. A null text is empty; a text shorter than `length` has nothing removed; repeated rows
    and equal texts lose all they share; overlapping occurrences count; a very long text is one row
    of a batch at a time. Other columns are ignored; an empty table gives none."""
    kind = df.schema["doc_id"].dataType.simpleString()
    docs = df.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("id", "text"))
    spans = saved(repeated_spans(docs, length, **how).select(F.col("id").alias("s_id"), F.col("key").alias("s_key"), "spans"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = column_bytes(part.column("text"))
                removed, count, sha = [], [], []
                for k, spans in enumerate(part.column("spans").to_pylist()):
                    text = data[offsets[k] : offsets[k + 1]]
                    keep, at = [], 0
                    for s in spans or []:
                        keep.append(text[at : s["begin"]].tobytes())
                        at = s["end"]
                    keep.append(text[at:].tobytes())
                    kept = b"".join(keep)
                    removed.append(len(text) - len(kept))
                    count.append(len(spans or []))
                    sha.append(hashlib.sha256(kept).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (np.diff(offsets), removed, count)), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    same = F.col("id").eqNullSafe(F.col("s_id")) & (F.col("key") == F.col("s_key"))
    joined = docs.join(small_side(spans, spans.count(), MAX_BROADCAST_ROWS), same, "left").select(F.col("id").alias("doc_id"), "text", "spans")
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
