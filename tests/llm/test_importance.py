import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.llm import importance


def test_top_rows_is_exact(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([rng.gauss(0, 1), 0.5, 100.0])) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, v double")
    for k in (0, 1, 700, 2500, 3000, 4000):
        want = {r[0] for r in sorted(rows, key=lambda r: (-r[1], r[0]))[:k]}
        for small in (10_000, 20):
            got = [r["doc_id"] for r in importance.top_rows(df, "v", "doc_id", k, fine=16, small=small).collect()]
            assert len(got) == len(want)
            if small == 10_000:
                assert set(got) == want


def test_many_copies_of_one_row_are_not_ranked_in_one_task(spark):
    df = spark.createDataFrame([(7, 1.0)] * 900 + [(8, 2.0), (9, 0.0)], "doc_id long, v double")
    got = [r["doc_id"] for r in importance.top_rows(df, "v", "doc_id", 500, fine=16, small=20).collect()]
    assert sorted(got) == [7] * 499 + [8]


def test_the_draw_against_a_plain_version(spark, docs):
    """Gumbel top-k as a whole: the k documents with the greatest log weight + noise."""
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 30)))) for k in range(150)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(100)], "doc_id long, quality int")
    ratio = importance.models(docs(rows), labels.where("quality = 1").select("doc_id"))
    noise = {r["doc_id"]: (r["h"] % 2**64 >> 11) for r in docs(rows).select("doc_id", F.xxhash64("doc_id", "text", F.lit(0)).alias("h")).collect()}
    key = {}
    for k, t in rows:
        bucket, _ = importance.batch_grams(pa.array([t]))
        key[k] = round(float(ratio[bucket].sum()), 9) - np.log(-np.log((noise[k] + 0.5) / 2.0**53))
    want = sorted(key, key=lambda k: -key[k])[:60]
    got = {r["doc_id"]: r["sample_key"] for r in importance.resample(docs(rows), labels, 0.4).collect()}
    assert set(got) == set(want) and all(abs(got[k] - key[k]) < 1e-6 for k in want)


def test_very_long_texts(spark, docs):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    got = importance.resample(docs([(1, "good words " * 100_000), (2, "x y"), (None, None)]), labels, 1.0)
    assert got.count() == 3


def test_weights_against_plain_counts(spark, docs):
    rows = [(1, "a b a"), (2, "b c"), (3, "c c c d"), (4, None), (5, "")]
    target = spark.createDataFrame([(1,), (2,)], "doc_id long")
    ratio = importance.models(docs(rows), target)
    raw, good = np.full(importance.DIMS, 1 / importance.DIMS), np.zeros(importance.DIMS)
    for k, t in rows:
        bucket, _ = importance.batch_grams(pa.array([t]))
        assert len(bucket) == max(0, 2 * len((t or "").split()) - 1)
        np.add.at(raw, bucket, 1)
        if k < 3:
            np.add.at(good, bucket, 1)
    raw /= raw.sum()
    assert np.allclose(ratio, np.log((good + importance.PRIOR * raw) / (good.sum() + importance.PRIOR)) - np.log(raw))
    got = {r["doc_id"]: r["log_weight"] for r in importance.score(docs(rows), ratio).collect()}
    assert got[4] == got[5] == 0 and got[1] > got[3]


def test_junk_is_left_out(spark, docs):
    rng = random.Random(7)
    good = ["%s%s" % (a, b) for a in "abcdef" for b in "xyz"]
    rows = [(k, " ".join(rng.choices(good, k=60)) if k % 4 else " ".join(f"###{rng.random()}" for _ in range(60))) for k in range(200)] + [(500, None), (1, "ax by")]
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(0, 200, 2)] + [(None, 1)], "doc_id long, quality int")
    got = importance.resample(docs(rows), labels, 0.75)
    ids = [r["doc_id"] for r in got.collect()]
    assert len(ids) == round(0.75 * len(rows)) and sum(k % 4 == 0 for k in ids) <= 3
    assert importance.resample(docs([]), labels).count() == 0
    none = labels.where(F.lit(False))
    assert importance.resample(docs(rows), none, 0.5).count() == round(0.5 * len(rows))
