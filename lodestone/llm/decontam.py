"""Benchmark decontamination by spaced-seed hashing. Native: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small_side

#: Fixed masks over consecutive words, four words each; 0 marks an ignored position. Any of them suffices
#: for a hit. With up to a fifth of an item's words substituted, one of the first two always fits in an
#: item of six words or more: either four words in a row are left, or two runs of two or three with one
#: word between them. Items of five words need the other two as well, for a word next to the ends.
MASKS, FIVE_MASKS = ("1111", "11011"), ("11101", "10111")
SPAN = 5  # words of the shortest item that masks are used for
LEAST = 4  # words of a mask
#: Seeds of the items (a hash, an int and an id each) are broadcast up to so many rows.
MAX_BROADCAST_ROWS = 200_000
#: Words of a part of an item whose overlap is reported by itself.
WINDOW = 13
#: Words that may be put in or left out, in all, while an item is followed along a document.
BAND = 2


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words of a text (runs of ASCII letters and digits and of all other
    characters beyond ASCII); null: none."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-/:-`{-\x7f]+")
    return F.transform(F.array_remove(words, ""), lambda w: F.xxhash64(w))


def paired(a: Column, b: Column, ahead: int, salt: int) -> Column:
    """For each position i, a hash of a[i] and b[i + ahead]; past the end, of a[i] alone."""
    return F.zip_with(a, F.slice(b, ahead + 1, F.size(b)), lambda x, y: F.xxhash64(x, y, F.lit(salt)))


def staged(df: DataFrame, name: str, value: Column) -> DataFrame:
    """`df` with a column that is computed once per row: merged into the expressions that use it
    several times, an array expression would be computed anew for each use."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def positions(df: DataFrame, words: str, at: str, five: bool, *keep: str) -> DataFrame:
    """`keep` columns, the word position and `seed` for each position and mask, with `five` for the
    masks of items of five words too.

    Seeds are built from hashes of neighbours (two words, three words), so each costs one hash,
    and the words themselves are not carried along with the rows made from them. At the last words
    seeds are of fewer words; what they hit is verified like any other hit.
    """
    w = F.col(words)
    out = staged(df.where(F.size(w) >= LEAST), "__two", paired(w, w, 1, 2))
    two = F.col("__two")
    seeds = [paired(two, two, 2, 10), paired(two, two, 3, 11)]
    if five:
        out = staged(out, "__three", paired(two, w, 2, 3))
        seeds += [paired(F.col("__three"), w, 4, 12), paired(w, F.col("__three"), 2, 13)]
    out = out.withColumn("__n", F.size(w)).select(*keep, "__n", F.posexplode(F.concat(*seeds)).alias("__p", "seed"))
    return out.select(*keep, (F.col("__p") % F.col("__n")).alias(at), "seed")


def short_seeds(df: DataFrame, words: str, at: str, length: int, *keep: str) -> DataFrame:
    """`keep` columns, the position and `seed` for each `length` words in a row, fewer than SPAN."""
    w = F.col(words)
    runs = F.slice(w, 1, F.size(w) - length + 1)
    for k in range(1, length):
        runs = F.zip_with(runs, F.slice(w, k + 1, F.size(w) - length + 1), lambda x, y: F.xxhash64(x, y))
    seed = F.transform(runs, lambda x: F.xxhash64(x, F.lit(100 + length)))
    return df.where(F.size(w) >= length).select(*keep, F.posexplode(seed).alias(at, "seed"))


def in_order(least: Column) -> Column:
    """How many of the item's words `iw` stand in `w` in order, from `start_word` on, if up to BAND
    words are put in or left out on the way; -1 where even the words within reach are too few."""
    width = 2 * BAND + 1
    place = F.transform("iw", lambda x, j: F.slice("w", F.greatest(F.col("start_word") + j - BAND, F.lit(0)) + 1, F.greatest(F.least(F.lit(width), F.col("start_word") + j + BAND + 1), F.lit(0))))
    reach = F.size(F.filter(F.zip_with("iw", place, lambda x, p: F.array_contains(p, x)), lambda x: x))

    def step(best: Column, j: Column) -> Column:
        def held(d: int) -> Column:
            hit = F.coalesce(F.get("w", F.col("start_word") + j + F.lit(d - BAND)) == F.get("iw", j), F.lit(False))
            here = F.get(best, F.lit(d)) + hit.cast("int")
            return here if d == width - 1 else F.greatest(here, F.get(best, F.lit(d + 1)))  # the item's word is left out

        return F.array(*[held(0) if d == 0 else F.greatest(*[held(e) for e in range(d + 1)]) for d in range(width)])

    none = F.array(*[F.lit(0)] * width)
    whole = F.aggregate(F.sequence(F.lit(0), F.size("iw") - 1), none, step, F.array_max)
    return F.when(reach >= least, whole).otherwise(F.lit(-1))


def verified(aligned: DataFrame, min_match: float) -> DataFrame:
    """Of rows with words `w`, item words `iw` and the item's `start_word` in the document (it may
    be negative), those that hold the item: `min_match` of its words equal the words they lie on,
    or stand there in order if up to BAND words are put in or left out, or `min_match` of WINDOW
    words of the item in a row equal the words they lie on.
    """
    shift = F.greatest(-F.col("start_word"), F.lit(0))
    length = F.size("iw") - shift
    there = F.slice("w", F.greatest(F.col("start_word"), F.lit(0)) + 1, length)
    same = F.zip_with(F.slice("iw", shift + 1, length), there, lambda x, y: F.coalesce(x == y, F.lit(False)))
    rows = staged(aligned.withColumn("__n", F.size("iw")), "__same", same)
    rows = rows.withColumn("__held", F.size(F.filter("__same", lambda x: x)))
    least = F.lit(min_match) * F.col("__n")
    straight = F.col("__held") >= least
    gapped = F.when(straight | (F.col("__n") < SPAN), F.lit(-1)).otherwise(in_order(least))
    rows = staged(rows, "__order", gapped)
    # The part with the most equal words, the first of such: (words, -place among the compared ones).
    parts = F.transform(F.sequence(F.lit(0), F.size("__same") - WINDOW), lambda p: F.struct(F.size(F.filter(F.slice("__same", p + 1, WINDOW), lambda x: x)).alias("held"), (-p).alias("at")))
    tried = ~straight & (F.col("__order") < least) & (F.size("__same") >= WINDOW) & (F.col("__held") >= min_match * WINDOW)
    rows = staged(rows, "__part", F.when(tried, F.array_max(parts)))
    kind = F.when(straight, 0).when(F.col("__order") >= least, 1).when(F.col("__part.held") >= min_match * WINDOW, 2)
    first = F.greatest("start_word", F.lit(0))
    found = rows.select(
        "__key", "doc_id", "item_id", F.col("start_word").alias("__start"), kind.alias("__kind"),
        F.when(kind == 2, first - F.col("__part.at")).otherwise(first).alias("start_word"),
        F.when(kind == 2, WINDOW).otherwise(F.col("__n")).alias("n_words"),
        F.when(kind == 0, F.col("__held")).when(kind == 1, F.col("__order")).otherwise(F.col("__part.held")).alias("n_matched"),
    ).where("__kind is not null").distinct()
    # Where words are put in or left out, an item is met on several alignments: one is reported.
    by = Window.partitionBy("__key", "item_id").orderBy("__start")
    found = found.withColumn("__best", F.min("__kind").over(by.rangeBetween(-2 * BAND, 2 * BAND)))
    found = found.withColumn("__before", F.min("__kind").over(by.rangeBetween(-2 * BAND, -1)))
    again = (F.col("__kind") == 1) & F.coalesce(F.col("__before") == 1, F.lit(False))
    return found.where((F.col("__kind") == F.col("__best")) & ~again).drop("__start", "__kind", "__best", "__before")


def find_overlaps(docs: DataFrame, items: DataFrame, min_match: float = 0.8, max_broadcast: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, n_matched): places where a document holds a test item.

    A hit of one seed aligns an item with a document; the overlap is kept if, aligned so, at least
    `min_match` of all the item's words equal the document's, or stand there in order with up to
    BAND words put in or left out; failing that, if `min_match` of WINDOW of its words in a row
    do, and then this part is what start_word and n_words tell (the best part of an alignment). With a
    `min_match` of 0.8 or more, no place where an item of five words or more stands with words
    substituted is missed; an item of fewer words is found where all its words stand in a row. Null
    texts count as empty; repeated rows give one row; an empty table gives none; very long texts are
    taken whole; other columns are ignored.

    Seeds of the items are counted: up to `max_broadcast` rows they are broadcast, beyond that
    joined by a shuffle. Hits meet their documents again by a key of id and text, in a shuffle of
    the documents, since hits grow with them.
    """
    return keyed_overlaps(docs, items, min_match, max_broadcast).drop("__key").distinct()


def keyed_overlaps(docs: DataFrame, items: DataFrame, min_match: float = 0.8, max_broadcast: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """`find_overlaps` with `__key`, which stands for id and text of the document."""
    item = saved(items.select("item_id", word_hashes(F.col("text")).alias("iw")).distinct())
    sizes = [r[0] for r in item.where(F.size("iw").between(1, SPAN)).select(F.size("iw")).distinct().collect()]  # SPAN at most
    short, five = [n for n in sizes if n < SPAN], SPAN in sizes
    seeds = positions(item.where(F.size("iw") >= SPAN), "iw", "__j", five, "item_id")
    for n in short:
        seeds = seeds.unionByName(short_seeds(item.where(F.size("iw") == n), "iw", "__j", n, "item_id"))
    seeds = saved(seeds.distinct())
    key = F.xxhash64("doc_id", "text").alias("__key")
    words = staged(docs.select(key, "text"), "w", word_hashes(F.col("text"))).drop("text")
    start = (F.col("__i") - F.col("__j")).alias("start_word")
    places = positions(words, "w", "__i", five, "__key")
    for n in short:
        places = places.unionByName(short_seeds(words, "w", "__i", n, "__key"))
    hits = places.join(small_side(seeds, seeds.count(), max_broadcast), "seed")
    hits = saved(hits.select("__key", "item_id", start).distinct())
    held = docs.select("doc_id", "text", key).join(hits.hint("merge"), "__key")  # never a broadcast: hits grow with the documents
    aligned = held.select("__key", "doc_id", "item_id", "start_word", word_hashes(F.col("text")).alias("w")).join(item, "item_id")
    return verified(aligned, min_match)


def without_leaks(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The documents that hold no test item, with all their columns. Each text is judged for itself, whatever
    other rows have the same doc_id or none, so of repeated rows all stay or all go. Null and empty texts
    stay; very long texts are taken whole; an empty table of items removes nothing, an empty table of
    documents gives none. A row is told by 64 bits of its id and text."""
    leaks = keyed_overlaps(docs, items, **how).select(F.col("__key").alias("__leak")).distinct()
    return docs.join(leaks, F.xxhash64(docs["doc_id"], docs["text"]) == F.col("__leak"), "left_anti")
