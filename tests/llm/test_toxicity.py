import random
import zlib

from lodestone.llm import toxicity
from lodestone.llm.common import table


def test_held_out_accuracy_and_contract(spark, docs):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for k in range(600):
        words = [word() for _ in range(rng.randint(5, 60))]
        bad = k % 4 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["Vileword!", "nastyish", "NASTYLY"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad), 1))
    rows += [(700, None), (701, ""), (702, "vileword " + "calm " * 20_000), (None, "nastyish"), (0, rows[0][1])]
    labels += [(5, None, 0), (None, 1, 0), (7, 0, 0)]
    got = toxicity.judge(docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int, text int")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [(by[k]["predicted"], t) for k, t, _ in labels[:600] if by[k]["held_out"]]
    assert sum(p == t for p, t in held) / len(held) > 0.97
    assert by[700]["score"] == by[701]["score"] < 0.5 and by[702]["predicted"] == 1
    kept = {r["doc_id"] for r in toxicity.without_toxic(docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int, text int")).collect()}
    assert kept == {r["doc_id"] for r in got if not r["predicted"]}


def test_swaps_reduce_the_weight_of_identity_terms(spark, docs):
    rng = random.Random(9)
    neutral = "morning train paper garden river window table".split()
    rows, labels = [], []
    for k in range(400):
        words = rng.choices(neutral, k=12)
        bad = k % 2
        if bad and k % 8 != 7:
            words[3] = "vileword"
        if bad and k % 4 == 1 or k % 40 == 0:
            words[6] = "muslim"
        if k % 40 == 2:
            words[6] = "christian"
        rows.append((k, " ".join(words)))
        labels.append((k, bad))
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    gap = []
    for penalty in (0.0, 20.0):
        model = toxicity.fit(docs(rows), labels, swap_penalty=penalty)
        s = {r["doc_id"]: r["score"] for r in toxicity.score_texts(docs([(1, "morning muslim train"), (2, "morning christian train"), (3, "vileword")]), model).collect()}
        gap.append(abs(s[1] - s[2]))
        assert s[3] > 0.5
    assert gap[1] < 0.5 * gap[0]


def test_without_labels_and_empty_table(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.judge(docs([(1, "a"), (2, "b c")]), none).collect()} == {0.5}
    assert toxicity.judge(docs([]), none).count() == 0


def test_given_tables(spark, sf):
    got = toxicity.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))
    assert got.count() == table(spark, sf, "documents").count()


def test_the_stage_takes_very_long_texts_null_ids_and_empty_tables(spark, docs):
    nice, foul = "calm green river " * 3, "vile rotten swine " * 3
    rows = [(k, (foul if k % 2 else nice) + f"w{k}") for k in range(200)] + [(None, foul), (None, nice), (7, None), (500, "calm river " * 200_000), (501, "rotten swine " * 200_000)]
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(200)], "doc_id long, quality int, toxic int")
    made = docs(rows)
    left = toxicity.without_toxic(made, labels)
    kept = left.collect()
    assert left.columns == made.columns
    assert {r["doc_id"] for r in kept} >= {k for k in range(0, 200, 2)} | {500} and 501 not in {r["doc_id"] for r in kept}
    assert not {r["doc_id"] for r in kept if r["text"] and "vile" in r["text"]} and [r["text"] for r in kept if r["doc_id"] is None] == [nice]
    assert toxicity.without_toxic(docs([]), labels).collect() == []


def test_false_positives_on_neutral_mentions_of_groups(spark, docs):
    """Labelled sentences in which some groups are mentioned in hostile ones far more often than in
    neutral ones. With the swaps at their shipped weight, fewer held-out neutral mentions are called
    toxic, and hostile ones are still found."""
    rng = random.Random(12)
    filler = "market station village teacher reading summer kitchen bridge concert holiday writing forest".split()
    hostile = "vermin scumbags parasites filthy".split()
    groups = [t for line in toxicity.IDENTITY_TERMS[:2] for t in line]
    rows, truth, plain = [], {}, set()
    for k in range(900):
        words = rng.choices(filler, k=9)
        toxic = k % 3 == 0
        group = rng.choice(groups[:2] if rng.random() < (0.95 if toxic else 0.08) else groups[2:])
        words[rng.randrange(4)] = group
        if toxic and rng.random() < 0.6:
            words[4 + rng.randrange(5)] = rng.choice(hostile)
            plain.add(k)  # not by allusion alone
        rows.append((k, " ".join(words)))
        truth[k] = int(toxic)
    train, labels = docs(rows[:600]), spark.createDataFrame([(k, t) for k, t in truth.items() if k < 600], "doc_id long, toxic int")
    neutral = [(2000 + k, " ".join([*rng.choices(filler, k=4), groups[k % 2], *rng.choices(filler, k=4)])) for k in range(200)]
    rate, recall = {}, {}
    for penalty in (0.0, toxicity.SWAP_PENALTY):
        model = toxicity.fit(train, labels, swap_penalty=penalty)
        score = {r["doc_id"]: r["score"] for r in toxicity.score_texts(docs(rows[600:] + neutral), model).collect()}
        rate[penalty] = sum(score[k] >= 0.5 for k, _ in neutral) / len(neutral)
        recall[penalty] = sum(score[k] >= 0.5 for k in plain if k >= 600) / sum(k >= 600 for k in plain)
    print("false positives", rate, "recall", recall)
    assert rate[toxicity.SWAP_PENALTY] < 0.5 * rate[0.0] and rate[0.0] > 0.05
    assert recall[toxicity.SWAP_PENALTY] >= 0.9


def test_terms_are_a_parameter(spark, docs):
    rows = [(k, "foo bad" if k % 2 else "bar good") for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    gap = []
    for terms in ([], [["foo", "bar"]]):
        model = toxicity.fit(docs(rows), labels, terms=terms)
        s = {r["doc_id"]: r["score"] for r in toxicity.score_texts(docs([(1, "foo"), (2, "bar")]), model).collect()}
        gap.append(s[1] - s[2])
    assert gap[1] < 0.5 * gap[0]
