"""MinHash near-duplicates by a signature-coordinate inverted join.

Every document (every distinct set of shingles, rather) is posted under its `COORDINATES`
(coordinate, value) pairs. Two sets with Jaccard similarity 0.8 agree in fewer than `MATCHES` of
them with a probability of about 3e-6. So a pair must collide in one of the COORDINATES - MATCHES + 1
rarest pairs of either (the prefix): only these lists are merged, and lists that only one set has
are skipped altogether. Collisions of a candidate pair are counted over the whole signatures, and
what reaches the threshold is confirmed on the full sets.

No list is expanded into all its pairs. Its members are compared with its leader (the set that
shares most pairs with others); after that, two of them are compared only if they differ from the
leader alike, or else if their sketches (four bits of each coordinate) differ in no more coordinates
than MATCHES lets them (`linked_components`).
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, components, mix, powers, saved, shingles_of, slices, small_side, words_of

COORDINATES = 64
MATCHES = 36
#: A set with fewer collisions with its leader has no partner near the leader (four deviations below 0.5).
NEAR_MATCHES = 16
#: Rounds in which members not linked with their leader are compared with a few that are.
ROUNDS = 1
#: Steps from a pivot to its pivot.
CHAIN = 2
#: Bitmaps of changes have at most 64 << MAX_BIT_WORDS bits.
MAX_BIT_WORDS = 6
#: Members of a cell that are not linked with its leader and meet the others in one task.
SPLIT = 256
#: Members linked with a leader that the others of its cell are held against before any pairs are looked for,
#: and how many of these, the likeliest ones, each is compared with.
PROBES = 64
TRIED = 3
#: Times that members still apart are compared with the likeliest member of another component.
CELL_ROUNDS = 3
#: So many pairs are compared without such rounds.
FEW_PAIRS = 100_000
#: Bits of each coordinate's value in a sketch.
SKETCH = 4
SKETCH_TYPE = "struct<" + ", ".join(f"s{k}: bigint" for k in range(SKETCH)) + ">"
#: Keys are broadcast up to so many rows.
MAX_BROADCAST_ROWS = 200_000
MULTIPLIERS = powers(np.uint64(0xF1357AEA2E62A9C5), COORDINATES + 1)[1:]
ADDENDS = mix(np.arange(1, COORDINATES + 1).astype(np.uint64))


def shingle_sets(column, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, row starts, row sizes) of the distinct shingles of each text of a batch."""
    data, offsets = column_bytes(column)
    word, row, _, _ = words_of(data, offsets)
    value, row = shingles_of(word, row, len(offsets) - 1, size)
    counts = np.bincount(row, minlength=len(offsets) - 1)
    return value, np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64), counts


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, key, n_shingles, cls, tokens, sketch): `cls` is a 16-byte hash of the set (null if empty),
    `tokens` has the 32 bits of its least value in each coordinate, `sketch` the last SKETCH of these,
    bit k of coordinate j at bit j of sk; `key` stands for id and text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                value, start, counts = shingle_sets(part.column("text"), size)
                some = np.flatnonzero(counts)
                at, n = start[some], len(some)
                cls = np.empty((n, 2), np.uint64)
                tokens = np.empty((n, COORDINATES), np.int32)
                if n:
                    cls[:, 0] = mix(np.add.reduceat(mix(value), at) + counts[some].astype(np.uint64))
                    cls[:, 1] = mix(np.add.reduceat(mix(value ^ np.uint64(0x5851F42D4C957F2D)), at))
                    for k in range(COORDINATES):
                        least = np.minimum.reduceat(value * MULTIPLIERS[k] + ADDENDS[k], at)
                        tokens[:, k] = (least >> np.uint64(32)).astype(np.uint32).view(np.int32)
                planes = np.zeros((SKETCH, part.num_rows), np.uint64)
                for k in range(SKETCH):
                    planes[k, some] = np.packbits((tokens >> k) & 1 == 1, axis=1, bitorder="little").view(np.uint64)[:, 0]
                whole = np.zeros(part.num_rows + 1, np.int32)
                whole[some + 1] = 1
                ends = np.cumsum(whole).astype(np.int32)
                null = np.packbits(counts > 0, bitorder="little")
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("key"),
                        pa.array(counts.astype(np.int64)),
                        pa.Array.from_buffers(pa.binary(), part.num_rows, [pa.py_buffer(null), pa.py_buffer(ends * 16), pa.py_buffer(cls.tobytes())]),
                        pa.ListArray.from_arrays(pa.array(ends * COORDINATES), pa.array(tokens.ravel())),
                        pa.StructArray.from_arrays([pa.array(x.view(np.int64)) for x in planes], names=[f"s{k}" for k in range(SKETCH)]),
                    ],
                    names=["doc_id", "key", "n_shingles", "cls", "tokens", "sketch"],
                )

    return keyed.mapInArrow(run, f"doc_id {kind}, key long, n_shingles long, cls binary, tokens array<int>, sketch {SKETCH_TYPE}")


def texts_of(docs: DataFrame, wanted: DataFrame, max_broadcast: int) -> DataFrame:
    """(cls, text): the text of a document of each wanted class (cls, doc_id, key). Where a row of
    the table is repeated, so is its text here, which only repeats comparisons."""
    asked = small_side(wanted.select("cls", "key", F.col("doc_id").alias("__id")), wanted.count(), max_broadcast)
    same = (F.col("__key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("__key"), "text").join(asked, same).select("cls", "text")


def changed_sets(left, right, percent: int) -> pa.RecordBatch:
    """Facts of pairs of sets (values, sizes), row by row: sizes, links, and what changed.

    `near` is a similarity of 0.5. `changes` counts the shingles that only one of
    the two has; of near pairs, `bits` marks their places in a bitmap about as large as the left set.
    """
    (va, na), (vb, nb) = left, right
    rows = len(na)
    value = np.concatenate([va, vb])
    row = np.concatenate([np.repeat(np.arange(rows), na), np.repeat(np.arange(rows), nb)])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    same = np.flatnonzero((value[1:] == value[:-1]) & (row[1:] == row[:-1]))
    inter = np.bincount(row[same], minlength=rows)
    union = na + nb - inter
    near, linked = 2 * inter >= union, 100 * inter >= percent * union
    alone = near[row]
    alone[same] = alone[same + 1] = False
    value, row = value[alone], row[alone]
    width = 1 << np.clip(np.ceil(np.log2(np.maximum(na, 1) / 64)), 0, MAX_BIT_WORDS).astype(np.int64)  # in words
    width[~near] = 0
    first = np.append(0, np.cumsum(width))
    place = (value >> np.uint64(20)) & (width[row] * 64 - 1).astype(np.uint64)
    bits = np.zeros(first[-1], np.uint64)
    np.bitwise_or.at(bits, first[row] + (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    arrays = [*map(pa.array, (na.astype(np.int64), nb.astype(np.int64), (na + nb - 2 * inter).astype(np.int64), near, linked))]
    return pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(bits.view(np.int64)))], names=FACTS)


FACTS = ["n_a", "n_b", "changes", "near", "linked", "bits"]
FACT_TYPES = "a long, b long, n_a long, n_b long, changes long, near boolean, linked boolean, bits array<long>"


def of_pairs(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of `classes` that are in a pair, where these are few enough to be told to all tasks, so that
    the others aren't shuffled; else all."""
    asked = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    n = asked.count()
    return classes.join(F.broadcast(asked), "cls", "left_semi") if n <= MAX_BROADCAST_ROWS else classes


def compared(sets: DataFrame, column: str, of_column, percent: int):
    """A comparison of pairs (a, b) of classes by their full sets: (a, b) and `changed_sets`.

    `sets` is (cls, column); of_column makes (values, sizes) of a batch's column: of whole texts,
    which compressed are a fraction of the size of their hashes, or of sets at hand.
    """

    def compare(pairs: DataFrame) -> DataFrame:
        some = of_pairs(sets, pairs)
        with_b = pairs.join(some.select(F.col("cls").alias("b"), F.col(column).alias("__b")), "b")
        both = with_b.join(some.select(F.col("cls").alias("a"), F.col(column).alias("__a")), "a").select("a", "b", "__a", "__b")

        def run(batches):
            for batch in batches:
                for part in slices(batch, "__b", 1 << 20):
                    facts = changed_sets(of_column(part.column("__a")), of_column(part.column("__b")), percent)
                    yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), *facts.columns], names=["a", "b", *FACTS])

        return both.mapInArrow(run, FACT_TYPES)

    return compare


def of_texts(size: int):
    def sets(column):
        value, _, counts = shingle_sets(column, size)
        return value, counts

    return sets


def of_items(column) -> tuple[np.ndarray, np.ndarray]:
    """Sets held as binary columns of 8-byte values, sorted and distinct."""
    data, offsets = column_bytes(column)
    return np.ascontiguousarray(data).view(np.uint64), np.diff(offsets) // 8


def prefixes(classes: DataFrame) -> DataFrame:
    """(cls, hub, token): the pairs in each class's prefix that another class has as well; `hub`
    counts the classes that have its pairs."""
    pairs = classes.select("cls", F.posexplode("tokens").alias("at", "value"))
    tokens = pairs.select("cls", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("value")).alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = tokens.join(common, "token").groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("s"))
    room = (COORDINATES - MATCHES + 1) - (COORDINATES - F.size("s"))  # the rarest ones are those that no other class has
    hub = F.aggregate("s", F.lit(0).cast("long"), lambda t, x: t + x["df"])
    prefix = F.explode(F.slice("s", F.lit(1), room))
    return shared.where(room > 0).select("cls", hub.alias("hub"), prefix.alias("t")).select("cls", "hub", F.col("t.token").alias("token"))


def parts_of(*sketches: str) -> list[tuple[Column, ...]]:
    return [tuple(F.col(f"{s}.s{k}") for s in sketches) for k in range(SKETCH)]


def signatures_alike(n: str, sketch: str, x_n: str, x_sketch: str, percent: int) -> Column:
    """Whether two signatures may have the matches that a similarity of `percent` (or 50) asks for: coordinates whose
    bits in the sketch differ don't match."""
    differ = functools.reduce(lambda p, q: p.bitwiseOR(q), [a.bitwiseXOR(b) for a, b in parts_of(sketch, x_sketch)])
    return F.bit_count(differ) <= COORDINATES - (MATCHES if percent >= 80 else NEAR_MATCHES)


def linked_components(posted: DataFrame, compare, percent: int, alike, rounds: int = ROUNDS) -> DataFrame:
    """(node, component) of the classes in `posted` (token, cls, n, hub, sketch) that `compare` finds to have a
    Jaccard similarity of `percent` or more; only pairs that share a token are compared, and of these
    only those that may be similar by `alike`, a quick bound on sizes and sketches.

    First every member is compared with its pivot, the leader of its lists that shares most. Members
    near the same pivot (0.5 and more) form a cell, whose pairs are settled by what they changed of
    the pivot (`changed_alike`), after `rounds` of `probes`. Then pairs of members of different cells and
    components meet by list, `alike` being a condition of the join. Components are made once, of all
    links; on the way a member is only known to be in its leader's.
    """

    def found_links(pairs: DataFrame) -> DataFrame:
        return saved(compare(saved(pairs)).where("linked").select("a", "b"))

    lead = F.struct((-F.col("hub")).alias("hub"), "cls", "n", "sketch")
    leads = posted.groupBy("token").agg(F.min(lead).alias("lead"))
    near_lead = alike("n", "sketch", "lead.n", "lead.sketch", 50)
    pivots = posted.join(leads, "token").where("cls <> lead.cls").where(near_lead)
    pivots = saved(pivots.groupBy("cls").agg(F.min("lead").alias("lead"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    # The pivot's pivot, and so on, gathers what several leaders share; where a member is not near to
    # the last one, its own pivot stands.
    last = pivots
    for _ in range(CHAIN):
        over = pivots.select(F.col("cls").alias("of"), F.col("lead").alias("over"))
        nearer = F.col("over").isNull() | ~alike("n", "sketch", "over.n", "over.sketch", 50)
        last = last.join(over, F.col("lead.cls") == F.col("of"), "left").withColumn("lead", F.when(nearer, F.col("lead")).otherwise(F.col("over"))).drop("of", "over")
    known = saved(compare(saved(last.select(F.col("lead.cls").alias("a"), F.col("cls").alias("b")))))
    links = [known.where("linked").select("a", "b")]
    near = known.where("near").withColumn("comp", F.when(F.col("linked"), F.col("a")).otherwise(F.col("b")))
    for k in range(rounds):
        tried = probes(near, percent, k)
        links.append(found_links(tried))
        merged = links[-1].select("b", F.lit(True).alias("merged")).distinct()
        near = near.join(merged, "b", "left").withColumn("comp", F.when(F.col("merged"), F.col("a")).otherwise(F.col("comp"))).drop("merged")
        near = saved(near)

    pairs = saved(changed_alike(near, percent))
    for _ in range(CELL_ROUNDS):
        if pairs.count() <= FEW_PAIRS:
            break
        best = pairs.groupBy("x_b").agg(F.max(F.struct("surplus", "b")).alias("best")).select(F.col("best.b").alias("a"), F.col("x_b").alias("b"))
        tried = saved(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        links.append(found_links(tried))
        pairs = saved(still_apart(pairs, tried, links[-1]))
    pairs = pairs.select(F.least("x_b", "b").alias("a"), F.greatest("x_b", "b").alias("b"))

    of = near.select(F.col("b").alias("cls"), "comp", F.col("a").alias("cell"))
    over = of.select(F.col("cls").alias("comp"), F.col("comp").alias("over"))
    rows = posted.join(of.join(over, "comp", "left"), "cls", "left")
    rows = saved(rows.select("token", "cls", "n", "sketch", F.coalesce("over", "comp", "cls").alias("comp"), F.coalesce("cell", "cls").alias("cell")))
    # Lists that hold pairs of different components and cells go on.
    several = rows.groupBy("token").agg(*[f(c).alias(f"{c}{k}") for c in ("comp", "cell") for k, f in enumerate((F.min, F.max))])
    alive = saved(rows.join(several.where("comp0 <> comp1 and cell0 <> cell1").select("token"), "token", "left_semi"))
    x = alive.select("token", *[F.col(c).alias(f"x_{c}") for c in ("cls", "n", "sketch", "comp", "cell")])
    apart = (F.col("comp") != F.col("x_comp")) & (F.col("cell") != F.col("x_cell")) & (F.col("cls") > F.col("x_cls"))
    apart = apart & similar_size(F.col("n"), F.col("x_n"), percent) & alike("n", "sketch", "x_n", "x_sketch", percent)
    listed = alive.join(x, "token").where(apart).select(F.col("x_cls").alias("a"), F.col("cls").alias("b"))
    links.append(found_links(pairs.union(listed).distinct()))
    return saved(components(functools.reduce(DataFrame.unionByName, links)))


def similar_size(a, b, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def surplus(common, percent: int) -> Column:
    """How many of `common` changes two members of one leader (b, x_b) have beyond those that make them
    similar; negative if they can't be linked."""
    return (100 - percent) * (F.col("n_b") + F.col("x_n_b")) - (100 + percent) * (F.col("changes") + F.col("x_changes") - 2 * common)


def most_common() -> Column:
    """A bound on the changes that two members of one leader have in common: what two bitmaps of changes
    have apart is not in common."""

    def only(one: str, other: str) -> Column:
        alone = F.zip_with(one, other, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q))))
        return F.aggregate(alone, F.lit(0), lambda total, n: total + n)

    return F.least(F.col("changes") - only("bits", "x_bits"), F.col("x_changes") - only("x_bits", "bits"))


def may_be_linked(percent: int) -> Column:
    """Whether two members of one leader, of different components, can be linked at all."""
    meet = (F.col("comp") != F.col("x_comp")) & similar_size(F.col("n_b"), F.col("x_n_b"), percent)
    meet = meet & (surplus(F.least("changes", "x_changes"), percent) >= 0)
    return meet & (surplus(most_common(), percent) >= 0)


def against_loose(near: DataFrame, others: DataFrame, percent: int) -> DataFrame:
    """Pairs of a member x of a cell that is not known to be in its leader's component with one of `others`, rows
    of `near` (lead, ...), that may be linked with it. The x of a leader are dealt out SPLIT at a time, each portion
    with a copy of the others, so no task has all of a large cell."""
    loose = near.where("comp <> a").withColumnRenamed("a", "lead")
    cells = loose.groupBy("lead").agg(F.floor(F.count("*") / SPLIT).cast("int").alias("portions"))
    portion = F.pmod(F.xxhash64("b"), F.col("portions") + 1).cast("int")
    x = loose.join(cells, "lead").select("lead", portion.alias("portion"), *[F.col(c).alias(f"x_{c}") for c in CELL_FACTS])
    y = others.join(cells, "lead").select("lead", *CELL_FACTS, F.explode(F.sequence(F.lit(0), F.col("portions"))).alias("portion"))
    return x.join(y, ["lead", "portion"]).where(may_be_linked(percent))


CELL_FACTS = ["b", "n_b", "changes", "comp", "bits"]


def probes(near: DataFrame, percent: int, seed: int = 0) -> DataFrame:
    """(a, b): for each member b near a leader that is not known to be in its component, the TRIED likeliest members a
    of PROBES that are. Most members of a group of near copies are linked with one of these, and then
    need no look at the rest."""
    part = F.pmod(F.xxhash64("b", F.lit(seed)), F.lit(PROBES))
    first = near.where("comp = a").groupBy("a", part.alias("part")).agg(F.min(F.struct(F.xxhash64("b").alias("h"), *CELL_FACTS)).alias("p"))
    both = against_loose(near, first.select(F.col("a").alias("lead"), "p.*"), percent)
    likeliest = F.slice(F.sort_array(F.collect_list(F.struct(surplus(most_common(), percent).alias("surplus"), "b")), False), 1, TRIED)  # of at most PROBES
    return both.groupBy("x_b").agg(likeliest.alias("best")).select(F.explode("best.b").alias("a"), F.col("x_b").alias("b"))


def changed_alike(near: DataFrame, percent: int) -> DataFrame:
    """(x_b, b, x_comp, comp, surplus): pairs of members near one leader that may be linked, of
    different components (`comp`). `near` has the leader as a, the member as b, and
    `changed_sets` of them; surplus is how many changes they may have in common beyond those needed.

    Let a member differ from the leader by the set C of shingles; two members have
    |C_b| + |C_x| - 2 |C_b & C_x| different shingles, so they are linked only if they changed enough
    alike. What two bitmaps of changes have apart bounds what they can have in common, and this is
    a condition of the join, so only pairs that may well be linked become rows. Of two members of
    different components one, x, is not in the leader's.
    """
    both = against_loose(near, near.withColumnRenamed("a", "lead"), percent)
    return both.select("x_b", "b", "x_comp", "comp", surplus(most_common(), percent).alias("surplus"))


def still_apart(pairs: DataFrame, tried: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of `changed_alike` not among `tried` (a, b) whose components aren't merged by `links` (a, b) that
    were found; with the merged components. Most pairs of a group of near copies fall away with a few links."""
    of = pairs.select(F.col("x_b").alias("node"), F.col("x_comp").alias("of")).union(pairs.select("b", "comp")).distinct()
    ends = [of.select(F.col("node").alias(c), F.col("of").alias(f"of_{c}")) for c in "ab"]
    merged = saved(components(links.join(ends[0], "a").join(ends[1], "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))))
    for c in ("comp", "x_comp"):
        pairs = pairs.join(merged.select(F.col("node").alias(c), F.col("component").alias("now")), c, "left").withColumn(c, F.coalesce("now", c)).drop("now")
    known = tried.select(F.col("a").alias("x_b"), "b").union(tried.select("b", "a"))
    return pairs.where("comp <> x_comp").join(known, ["x_b", "b"], "left_anti").select("x_b", "b", "x_comp", "comp", "surplus")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, rounds: int = ROUNDS, max_broadcast: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Documents whose sets of `size`-word shingles have a Jaccard similarity of `percent` (80 at
    least) or more are linked; component_id is the least doc_id reachable, kept says whether it is
    the document's own. A null or blank text has no shingles and is linked with nothing; a text of
    fewer words than `size` has its whole sequence as one shingle. Repeated rows are linked with
    each other and all returned; null ids are kept apart from the least id. An empty table gives an
    empty result; very long texts are taken whole; other columns are ignored.
    """
    signed, of_class = judged_classes(docs, size, percent, rounds, max_broadcast)
    of_class = of_class.select("cls", F.col("keeper.doc_id").alias("component"))
    own = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    out = signed.select("doc_id", "n_shingles", "cls").join(of_class, "cls", "left")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def judged_classes(docs: DataFrame, size: int = 5, percent: int = 80, rounds: int = ROUNDS, max_broadcast: int = MAX_BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """The signatures of all documents, and (cls, keeper) of their classes: the first document
    (its doc_id and key; null ids last) that is linked."""
    if percent < 80:
        raise ValueError("signatures are tuned for 80 percent or more")
    docs = docs.select("doc_id", "text")
    signed = saved(signatures(docs, size))
    # Classes are numbered, since numbers are shuffled at half the cost of their hashes.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("least")
    of_hash = signed.where("cls is not null").groupBy("cls").agg(F.first("n_shingles").alias("n"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"), least)
    classes = saved(of_hash.withColumnRenamed("cls", "hash").withColumn("cls", F.monotonically_increasing_id()))
    posted = saved(prefixes(classes).join(classes.select("cls", "n", "sketch"), "cls"))
    lists = posted.groupBy("token").agg(F.count("*").alias("m")).where("m > 1")
    posted = saved(posted.join(lists, "token").drop("m"))
    listed = posted.select("cls").distinct()
    member = saved(classes.join(listed, "cls", "left_semi").select("cls", "least.doc_id", "least.key"))
    texts = saved(texts_of(docs, member, max_broadcast))
    groups = linked_components(posted, compared(texts, "text", of_texts(size), percent), percent, signatures_alike, rounds)

    of_class = classes.select("hash", "cls", "least").join(groups.withColumnRenamed("node", "cls"), "cls", "left").select("hash", "least", F.coalesce("component", "cls").alias("comp"))
    of_comp = of_class.groupBy("comp").agg(F.min("least").alias("keeper"))
    return signed, saved(of_class.join(of_comp, "comp").select(F.col("hash").alias("cls"), "keeper"))


def without_copies(docs: DataFrame, **how) -> DataFrame:
    """One document of each group stays: the one with the least id (null ids last; of equal ids,
    one text). Repeated rows of the one that stays all stay if they have an id; of those without
    an id one stays, since nothing says that they are one document. Null and blank texts are
    copies of nothing."""
    signed, of_class = judged_classes(docs, **how)
    judged = signed.select("cls", "key", "doc_id").join(of_class, "cls")
    copies = judged.where("key <> keeper.key or not (doc_id <=> keeper.doc_id)").select(F.col("key").alias("__copy"), F.col("doc_id").alias("__id")).distinct()
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    left = keyed.join(copies, (keyed["__key"] == F.col("__copy")) & keyed["doc_id"].eqNullSafe(F.col("__id")), "left_anti")
    blank = signed.where("doc_id is null and cls is null").select("key").distinct()
    nameless = left.where("doc_id is null")
    bare = nameless.join(blank, nameless["__key"] == blank["key"], "left_semi")
    single = nameless.join(blank, nameless["__key"] == blank["key"], "left_anti").dropDuplicates(["__key"])
    return left.where("doc_id is not null").unionByName(bare).unionByName(single).drop("__key")
