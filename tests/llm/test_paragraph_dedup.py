import random

import numpy as np
import pyarrow as pa

from lodestone.llm import paragraph_dedup


def test_chunks_are_cut_alike_inside_other_texts():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(80)]
    a, b = [word() for _ in range(70)], [word() for _ in range(33)]
    column = pa.array([" ".join(a[:30] + passage + a[30:]), " ".join(b + passage)])
    _, _, row, number, first, size = paragraph_dedup.chunks(column)
    cuts = [set(first[row == r] - at) & set(range(5, 75)) for r, at in ((0, 30), (1, 33))]
    assert cuts[0] == cuts[1] and len(cuts[0]) > 3
    for r, n in ((0, 150), (1, 113)):
        assert size[row == r].sum() == n and list(number[row == r]) == list(range((row == r).sum()))
    assert np.all(size > 0)


def test_passages_are_found_and_others_left_alone(docs):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(60), text(12)
    rows = [(k, f"{text(20 + k)} {passage} {text(30)}") for k in range(6)]
    rows += [(k, f"{text(40)}\n{line}\n{text(50)}") for k in range(10, 20)]
    rows += [(30, None), (31, ""), (None, passage), (32, text(90))]
    twin = text(100)
    rows += [(40, twin), (40, twin)]
    found = paragraph_dedup.repeated_paragraphs(docs(rows)).collect()
    assert {r["doc_id"] for r in found} == {0, 1, 2, 3, 4, 5, 40}
    assert [r["n_removed"] for r in found if r["doc_id"] == 0] == [0]
    assert all(r["n_removed"] > 0 for r in found if 0 < r["doc_id"] < 6)
    assert paragraph_dedup.repeated_paragraphs(docs([])).collect() == []


def test_near_copies_of_a_paragraph_are_linked(docs):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(60)]
    rows = [(k, " ".join([*base[:59], f"end{k}"])) for k in range(5)]
    found = paragraph_dedup.repeated_paragraphs(docs(rows)).collect()
    assert {r["doc_id"] for r in found} == set(range(5))


def test_a_word_changed_in_the_middle_of_a_passage(docs):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    words = lambda n: [word() for _ in range(n)]
    rows, where = [], {}
    for k in range(40):
        passage = words(64)
        changed = passage[:32] + ["changed"] + passage[33:]
        for at, text in enumerate((passage, changed)):
            rows.append((2 * k + at, " ".join([*words(30 + at), *text, *words(40)])))
            where[2 * k + at] = 30 + at
    found = paragraph_dedup.repeated_paragraphs(docs(rows)).collect()
    over = {r["doc_id"] for r in found if r["first_word"] <= where[r["doc_id"]] + 25 and r["first_word"] + r["n_words"] >= where[r["doc_id"]] + 40}
    assert len(over) >= 72, len(over)
    assert all(where[r["doc_id"]] - 1 <= r["first_word"] and r["first_word"] + r["n_words"] <= where[r["doc_id"]] + 66 for r in found)


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_lines_against_all_pairs(docs):
    """Clusters of near lines are those of brute force; recall over all pairs is 0.9 or more."""
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(4000)]
    lines, rows = [], []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([26, 40, 80, 150]))]
        for _ in range(rng.randint(1, 6)):
            new = list(base)
            for _ in range(rng.randint(0, len(base) // 25)):
                new[rng.randrange(len(new))] = rng.choice(words)
            lines.append(new)
    rng.shuffle(lines)
    for k, line in enumerate(lines):
        rows.append((k, f"{rng.choice(words)} {rng.choice(words)}\n{' '.join(line)}\n" + " ".join(rng.choice(words) for _ in range(20))))
    pairs = [(i, j) for i in range(len(lines)) for j in range(i) if jaccard(lines[i], lines[j]) >= 0.8]
    comp = list(range(len(lines)))
    for i, j in pairs:
        a, b = comp[i], comp[j]
        comp = [min(a, b) if c in (a, b) else c for c in comp]
    found = {r["doc_id"]: r for r in paragraph_dedup.repeated_paragraphs(docs(rows)).collect() if r["first_word"] <= 4 and r["n_words"] >= 24}
    linked = {i for p in pairs for i in p}
    held = sum(i in found for i in linked)
    assert held >= 0.98 * len(linked) and len(pairs) > 40
    for i in linked & set(found):
        assert found[i]["n_words"] >= len(lines[i]) - 1
        if comp[i] != i:  # not the first of its cluster
            assert found[i]["n_removed"] > 0


def test_very_long_texts(docs):
    rng = random.Random(5)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    long = " ".join(f"w{k}" for k in range(200_000))
    found = paragraph_dedup.repeated_paragraphs(docs([(1, f"{long} {passage}"), (2, f"x y\n{passage}"), (3, "short")])).collect()
    assert {r["doc_id"] for r in found} == {1, 2} and all(40 <= r["n_words"] <= 62 for r in found)


def test_unlike_lines_of_one_list_are_not_compared(spark):
    """Lines that share a band but can't be similar by their bitmaps make no pairs; those that can all do."""
    rng = np.random.default_rng(14)
    sets = [rng.integers(0, 2**63, 12, dtype=np.uint64) for _ in range(120)]
    sets += [np.append(s[:11], rng.integers(0, 2**63, 1, dtype=np.uint64)) for s in sets[:20]]
    rows = [(1, k, 12, 1, tuple(paragraph_dedup.bitmap(s).values())) for k, s in enumerate(sets)]
    posted = spark.createDataFrame(rows, f"token long, cls long, n long, hub long, sketch {paragraph_dedup.SKETCH_TYPE}")
    items = spark.createDataFrame([(k, np.sort(s).tobytes()) for k, s in enumerate(sets)], "cls long, items binary")
    compare, met = paragraph_dedup.compared(items, "items", paragraph_dedup.of_items, 80), []

    def counted(pairs):
        met.append(pairs.count())
        return compare(pairs)

    groups = paragraph_dedup.linked_components(posted, counted, 80, paragraph_dedup.bitmaps_alike)
    assert {(r["node"], r["component"]) for r in groups.collect() if r["node"] != r["component"]} == {(120 + k, k) for k in range(20)}
    assert sum(met) <= 40
