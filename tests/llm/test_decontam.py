from lodestone.llm import decontam

ITEM = "The quick brown fox jumps over the lazy dog near a quiet river bank at dawn today"


def found(docs, spark, rows, items, **how):
    bench = spark.createDataFrame(items, "item_id long, text string, w string, seed long")
    return sorted(tuple(r) for r in decontam.find_overlaps(docs(rows), bench, **how).collect())


def test_exact_substituted_partial_and_clean(spark, docs):
    w = ITEM.split()
    two = [x if k not in (4, 9) else "changed" for k, x in enumerate(w)]
    many = [x if k % 3 else "changed" for k, x in enumerate(w)]
    rows = [
        (1, "before it " + ITEM.upper() + "! after it"), (2, "aa bb cc " + " ".join(two)), (3, " ".join(many)), (4, " ".join(w[:8]) + " then something else follows here"),
        (5, None), (6, ""), (7, "nothing of the kind is said in this text"), (8, ITEM + " . " + ITEM), (8, ITEM + " . " + ITEM), (9, " ".join(w[2:])),
    ]
    items = [(10, ITEM, "", 0), (10, ITEM, "", 0), (11, None, "", 0), (12, "", "", 0), (13, "too short", "", 0)]
    want = [(1, 10, 2, 17, 17), (2, 10, 3, 17, 15), (8, 10, 0, 17, 17), (8, 10, 17, 17, 17), (9, 10, 0, 17, 15)]
    assert found(docs, spark, rows, items) == want
    assert found(docs, spark, rows, items, max_broadcast=0) == want


def test_against_brute_force(spark, docs):
    import random

    rng = random.Random(6)
    vocabulary = ["v%d" % k for k in range(30)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(5, 30))), "", 0) for k in range(12)]
    rows = []
    for k in range(60):
        words = rng.choices(vocabulary, k=rng.randint(0, 40))
        if k % 2:
            held = rng.choice(items)[1].split()
            held = [x if rng.random() > 0.08 else "new" for x in held]
            words[len(words) // 2 : len(words) // 2] = held
        rows.append((k, " ".join(words)))
    want = set()
    for d, t in rows:
        w = t.split()
        for i, text, *_ in items:
            x = text.split()
            for s in range(1 - len(x), len(w)):
                same = [0 <= s + j < len(w) and w[s + j] == x[j] for j in range(len(x))]
                if sum(same) < 0.8 * len(x):
                    continue
                want.add((d, i, max(s, 0), len(x), sum(same)))
    got = set(found(docs, spark, rows, items))
    assert want <= got and all(n >= 0.8 * m for *_, m, n in got)
    # What is reported beyond it: a part of 13 words, or an item with words put in or left out.
    lengths = {i: len(text.split()) for i, text, *_ in items}
    for d, i, start, n, held in got - want:
        assert n in (13, lengths[i]) and held >= 0.8 * n
        x, w = dict((i, t.split()) for i, t, *_ in items)[i], dict(rows)[d].split()
        if n == lengths[i]:
            assert longest_common(x, w[max(0, start - 2) : start + n + 2]) >= held
        else:
            assert max(sum(a == b for a, b in zip(x[p : p + 13], w[start : start + 13], strict=False)) for p in range(len(x) - 12)) >= held


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b):
            last, row[k + 1] = row[k + 1], last + 1 if x == y else max(row[k + 1], row[k])
    return row[-1]


def test_every_pattern_of_substituted_words(spark, docs):
    """For items of 5 to 16 words, each way to substitute up to a fifth of them is found in running text."""
    import itertools

    rows, want = [], set()
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n)), "", 0) for n in range(5, 17)]
    for n, text, *_ in items:
        for many in range(n // 5 + 1):
            for gone in itertools.combinations(range(n), many):
                words = ["new" if k in gone else x for k, x in enumerate(text.split())]
                want.add((len(rows), n, 2, n, n - many))
                rows.append((len(rows), "aa bb " + " ".join(words) + " cc dd ee"))
    assert want <= set(found(docs, spark, rows, items))


def test_very_long_texts(spark, docs):
    filler = " ".join(f"f{k % 3001}" for k in range(150_000))
    assert found(docs, spark, [(1, filler + " " + ITEM + " " + filler)], [(9, ITEM, "", 0)]) == [(1, 9, 150_000, 17, 17)]


def test_empty_tables_and_removal(spark, docs):
    assert found(docs, spark, [], [(1, ITEM, "", 0)]) == [] and found(docs, spark, [(1, ITEM)], []) == []
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    kept = decontam.without_leaks(docs([(1, ITEM), (2, "clean"), (None, "x"), (3, None)]), bench).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 2, 3]


def test_removal_is_by_text_where_ids_are_null_or_repeated(spark, docs):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    rows = [(None, ITEM), (None, "a clean text"), (None, None), (7, ITEM + " again"), (7, "another clean text")]
    kept = decontam.without_leaks(docs(rows), bench).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == [(0, ""), (0, "a clean text"), (7, "another clean text")]


def test_parts_insertions_and_short_items(spark, docs):
    item = [f"w{k}" for k in range(60)]
    halves = item[:9] + ["put"] + item[9:17]  # 17 words of its own item, one put in
    rows = [
        (1, "aa bb " + " ".join(item[5:50]) + " cc"), (2, "x " + " ".join(item[:30] + ["put", "in"] + item[30:])), (3, " ".join(item[:29] + item[30:])),
        (4, " ".join(item[:8]) + " and no more of it"), (5, "y " + " ".join(halves)), (6, "it says Blue Moon here"), (7, "blue and moon"), (8, "blue moon"), (9, " ".join(item[20:33])),
    ]
    items = [(10, " ".join(item), "", 0), (11, " ".join(item[:17]), "", 0), (12, "blue moon", "", 0), (13, "alone", "", 0)]
    got = found(docs, spark, rows, items)
    assert [r for r in got if r[1] == 10] == [(1, 10, 2, 13, 13), (2, 10, 1, 60, 60), (3, 10, 0, 60, 59), (9, 10, 0, 13, 13)]
    assert {(r[0], r[3], r[4]) for r in got if r[1] == 11 and r[0] in (3, 4, 5)} == {(3, 17, 17), (5, 17, 17)}
    assert [r for r in got if r[1] == 12] == [(6, 12, 2, 2, 2), (8, 12, 0, 2, 2)]
    assert not [r for r in got if r[1] == 13]
