"""Toxicity: a counterfactual-regularised linear classifier on hashed words and word beginnings."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, column_bytes, slices, words_of

#: At most so many labelled rows are used for fitting (those with the least hash of doc_id).
MAX_TRAIN = 20_000
#: Hash space of the features; the model uses the MAX_FEATURES of them that tell most about the label
#: (chi-square) among those that MIN_DOCS fitted rows have. Both are parameters of the fit alone.
DIMS = 1 << 18
MAX_FEATURES = 4096
MIN_DOCS = 3
#: Weight of the squared score change under a swap in the loss.
SWAP_PENALTY = 5.0
PREFIXES = (4, 5, 6, 7, 8, 9)

# Identity terms, swapped within a line to make counterfactual sentences.
IDENTITY_TERMS = [
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino", "arab"],
    ["gay", "lesbian", "straight", "bisexual", "transgender"],
    ["women", "men"], ["woman", "man"], ["girls", "boys"],
    ["immigrants", "refugees", "natives", "foreigners"],
    ["frauen", "männer"], ["muslime", "christen", "juden"],
    ["femmes", "hommes"], ["musulmans", "chrétiens", "juifs"],
    ["mujeres", "hombres"], ["musulmanes", "cristianos", "judíos"],
]


def swaps(terms: list[list[str]]) -> tuple[dict[str, str], re.Pattern | None]:
    """What each identity term is swapped for, the next one of its line, and a pattern of all terms."""
    swap = {w: group[(k + 1) % len(group)] for group in terms for k, w in enumerate(group)}
    listed = "|".join(re.escape(w) for w in sorted(swap, key=lambda w: (-len(w), w)))
    return swap, re.compile(rf"(?<!\w)({listed})(?!\w)") if swap else None


IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of DIMS numbers, most of them 0
    bias: float


def batch_features(column) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row) of a batch of texts: hashed words and word beginnings, with repetitions."""
    data, offsets = column_bytes(pc.utf8_lower(column))
    _, row, start, end = words_of(data, offsets, IN_WORD)
    rolling = Rolling(data)
    found = [(rolling.hashes(start, end), row)]
    for k in PREFIXES:
        long = end - start > k
        found.append((rolling.hashes(start[long], start[long] + k) ^ np.uint64(k * 0x9E3779B9), row[long]))
    return (np.concatenate([f for f, _ in found]) >> np.uint64(46)).astype(np.int64), np.concatenate([r for _, r in found])


def distinct(feature: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(row.astype(np.int64) * DIMS + feature)
    return both % DIMS, both // DIMS


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """(text, label) of at most `max_train` labelled documents. Ids labelled twice count as toxic if
    any row says so; null labels and ids are ignored."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)  # a bounded side, so it may be broadcast
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")


def fit(
    docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, swap_penalty: float = SWAP_PENALTY, ridge: float = 1e-4, steps: int = 400, terms: list[list[str]] = IDENTITY_TERMS
) -> Model:
    """Chooses features by their chi-square with the label, then fits a logistic regression whose
    loss has `swap_penalty` times the squared score change under a swap of identity `terms`."""
    swap, identity = swaps(terms)
    rows = training_rows(docs, labels, max_train)

    def count(batches):
        total = np.zeros((2, DIMS), np.int64)
        sizes = np.zeros(2, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                label = np.asarray(part.column("label"))
                feature, row = distinct(*batch_features(part.column("text")))
                for y in (0, 1):
                    total[y] += np.bincount(feature[label[row] == y], minlength=DIMS)
                    sizes[y] += int((label == y).sum())
        seen = np.flatnonzero(total.sum(axis=0))
        yield pa.RecordBatch.from_pydict({"feature": np.append(seen, -1), "n0": np.append(total[0, seen], sizes[0]), "n1": np.append(total[1, seen], sizes[1])})

    counts = rows.mapInArrow(count, "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    table = counts.where((F.col("n0") + F.col("n1") >= MIN_DOCS) | (F.col("feature") < 0)).toArrow()  # DIMS + 1 rows at most
    feature, n0, n1 = (np.asarray(table.column(c)) for c in ("feature", "n0", "n1"))
    sizes = [int(n[feature == -1].sum()) for n in (n0, n1)]
    if not min(sizes):
        return Model(np.zeros(DIMS, np.float32), 0.0 if not max(sizes) else (5.0 if sizes[1] else -5.0))
    n0, n1, feature = n0[feature >= 0], n1[feature >= 0], feature[feature >= 0]
    p, q, both = n1 / sizes[1], n0 / sizes[0], (n0 + n1) / sum(sizes)
    chi = (p - q) ** 2 / np.maximum(both * (1 - both), 1e-9)
    chosen = np.sort(feature[np.lexsort((feature, -chi))[:MAX_FEATURES]])
    place = np.full(DIMS, -1, np.int64)
    place[chosen] = np.arange(len(chosen))

    def encode(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text")
                lower = pc.utf8_lower(texts).to_pylist()
                swapped = [identity.sub(lambda m: swap[m[0]], t) if t and identity and identity.search(t) else None for t in lower]
                lists = []
                for column in (texts, pa.array(swapped, pa.string())):
                    f, r = distinct(*batch_features(column))
                    r, f = r[place[f] >= 0], place[f[place[f] >= 0]]
                    lists.append(np.split(f, np.searchsorted(r, np.arange(1, part.num_rows))))
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), pa.array(lists[0], pa.list_(pa.int64())), pa.array([x if s is not None else None for x, s in zip(lists[1], swapped, strict=True)], pa.list_(pa.int64()))],
                    names=["label", "own", "swapped"],
                )

    data = rows.mapInArrow(encode, "label int, own array<long>, swapped array<long>").toArrow()  # max_train rows at most
    y = np.asarray(data.column("label"), np.float64)

    def flat(lists) -> tuple[np.ndarray, np.ndarray]:
        lists = [np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64) for x in lists.to_pylist()]
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate([*lists, np.zeros(0, np.int64)])

    r, f = flat(data.column("own"))
    has = np.asarray(data.column("swapped").is_valid())
    rs, fs = flat(data.column("swapped"))
    w, bias, n, width = np.zeros(len(chosen)), float(np.log(sizes[1] / sizes[0])), len(y), len(chosen)
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        z = bias + np.bincount(r, w[f], n)
        push = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        change = np.where(has, z - bias - np.bincount(rs, w[fs], n), 0.0) * (2 * swap_penalty / n)
        grad = np.append(np.bincount(f, (push + change)[r], width) - np.bincount(fs, change[rs], width) + ridge * w, push.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    weights = np.zeros(DIMS, np.float32)
    weights[chosen] = w
    return Model(weights, float(bias))


def batch_scores(column, model: Model) -> np.ndarray:
    """The probability of label 1 of each text of a batch; null counts as empty."""
    feature, row = batch_features(column.fill_null(""))
    used = model.weights[feature] != 0
    feature, row = distinct(feature[used], row[used])
    z = model.bias + np.bincount(row, model.weights[feature], len(column))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score_texts(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): the probability of label 1 of each whole text; null counts as empty."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(batch_scores(part.column(text), model))], names=[key, "score"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, score double")


def is_held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, learnt from the rows not held out.

    A null or empty text is scored by the bias alone; a null doc_id has held_out false and is never
    learnt from. Without labels of both kinds the score is a constant. Repeated rows repeat; an empty
    table gives none; a very long text is one row of a slice at a time; other columns are ignored.
    """
    learnt = labels.where(~is_held_out())
    scored = score_texts(docs, fit(docs, learnt))
    return scored.select("doc_id", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents not predicted toxic, with all their columns. Each row is judged by its own text,
    whatever other rows have the same doc_id or none; a null or empty text by the bias alone; repeated
    rows stay or go together; an empty table gives none."""
    model = fit(docs, labels.where(~is_held_out()))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(batch_scores(part.column("text"), model) < 0.5))

    return docs.mapInArrow(run, docs.schema)
