import random
import re

from lodestone.llm import minhash_join


def sets(texts, size):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    return out


def brute(rows, size):
    s = sets([t for _, t in rows], size)
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if s[i] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    least = {}
    for (doc, _), c in zip(rows, comp, strict=True):
        least[c] = min(least.get(c, doc), doc)
    return {doc: (len(x), least[c], doc == least[c]) for (doc, _), x, c in zip(rows, s, comp, strict=True)}


def test_against_brute_force(docs):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    common = " ".join(word() for _ in range(12))
    texts = [None, "", " \n\t", "one", "One", "two words", "Two  Words", common]
    for _ in range(12):
        base = [word() for _ in range(rng.choice([8, 40, 90]))]
        for _ in range(rng.randint(1, 9)):
            new = list(base)
            for _ in range(rng.randint(0, len(base) // 7)):
                new[rng.randrange(len(new))] = word()
            texts.append(" ".join(new) + rng.choice(["", " " + common]))
    rng.shuffle(texts)
    rows = [(100 + k, t) for k, t in enumerate(texts)]
    for size in (2, 5):
        got = {r["doc_id"]: tuple(r)[1:] for r in minhash_join.near_duplicates(docs(rows), size=size).collect()}
        assert got == brute(rows, size)


def test_repeated_rows_and_empty_table(docs):
    got = minhash_join.near_duplicates(docs([(3, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f"), (None, "x")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in got if r["doc_id"]) == [(2, 2, True), (3, 2, False), (3, 2, False)]
    assert minhash_join.near_duplicates(docs([])).collect() == []
    assert [r["doc_id"] for r in minhash_join.without_copies(docs([(3, "a b c"), (2, "a b c"), (9, None)])).orderBy("doc_id").collect()] == [2, 9]


def test_copies_without_an_id_or_with_a_repeated_one(docs):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = [(1, a), (None, a), (None, b), (None, b), (None, b + " end"), (None, None), (None, " "), (None, " "), (5, c), (6, c), (6, d), (8, d), (9, d + " end")]
    kept = [(r["doc_id"], r["text"]) for r in minhash_join.without_copies(docs(rows)).collect()]
    assert sorted(t for i, t in kept if i is not None) == sorted([a, c, d]) and {(1, a), (5, c), (6, d)} <= set(kept)
    of_b = [t for i, t in kept if i is None and t and t.strip()]
    assert len(of_b) == 1 and of_b[0].startswith(b)
    assert len(kept) == 7


def near_copies(rng, base, count, most, words):
    out = []
    for _ in range(count):
        new = list(base)
        for _ in range(rng.randint(1, most)):
            at = rng.randrange(len(new))
            new[at : at + rng.choice([0, 1, 1, 2])] = [rng.choice(words)] * rng.choice([0, 1, 1])
        out.append(" ".join(new))
    return out


def test_a_template_that_is_itself_not_in_the_table(docs):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    bases = [[rng.choice(words) for _ in range(n)] for n in (60, 110)]
    texts = [t for b in bases for t in near_copies(rng, b, 70, len(b) // 7, words[:40])]
    texts += [" ".join(b[: len(b) * k // 20]) for b in bases for k in range(8, 20)]
    rows = list(enumerate(texts))
    for size, rounds in ((2, 2), (2, 0), (5, 1)):
        got = {r["doc_id"]: tuple(r)[1:] for r in minhash_join.near_duplicates(docs(rows), size=size, rounds=rounds).collect()}
        assert got == brute(rows, size)


def test_a_large_group_is_not_expanded_into_pairs(spark, docs, monkeypatch):
    """Candidates of a group of near copies of one text stay far below its pairs, and no link is lost."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(2000)]
    base = [rng.choice(words) for _ in range(80)]
    rows = list(enumerate([" ".join(base), *near_copies(rng, base, 400, 11, words)]))
    made, alike = [], minhash_join.changed_alike

    def counted(*args):
        out = alike(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(minhash_join, "changed_alike", counted)
    got = {r["doc_id"]: r["component_id"] for r in minhash_join.near_duplicates(docs(rows), size=2).collect()}
    assert got == {d: x[1] for d, x in brute(rows, 2).items()}
    assert sum(made) < 400 * 399 / 2 / 10


def test_very_long_texts(docs):
    long = " ".join(f"w{k % 7001}x{k % 13}" for k in range(120_000))
    rows = [(1, long), (2, long + " end"), (3, long[: len(long) // 2]), (4, None)]
    got = {r["doc_id"]: r["component_id"] for r in minhash_join.near_duplicates(docs(rows)).collect()}
    assert got[2] == 1 and got[4] == 4


def test_merged_components_spare_comparisons(spark):
    """Pairs whose components were merged by a chain of links, or that were tried, aren't compared again."""
    pairs = spark.createDataFrame([(1, 2, 1, 2, 5), (2, 3, 2, 3, 4), (1, 3, 1, 3, 3), (4, 1, 4, 1, 2), (1, 4, 1, 4, 2)], "x_b long, b long, x_comp long, comp long, surplus long")
    links = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert {tuple(r) for r in minhash_join.still_apart(pairs, links, links).collect()} == {(4, 1, 4, 1, 2), (1, 4, 1, 4, 2)}
    tried = spark.createDataFrame([(1, 2), (2, 3), (1, 4)], "a long, b long")
    assert minhash_join.still_apart(pairs, tried, links).isEmpty()


def test_components_are_made_once(docs, monkeypatch):
    """Two groups under one common list take one computation of components, whatever steps find their links."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    bases = [[rng.choice(words) for _ in range(60)] for _ in range(2)]
    bases.append(bases[0][:40] + bases[1][:20])
    rows = list(enumerate(t for b in bases for t in near_copies(rng, b, 30, 8, words[:40])))
    made, of_edges = [], minhash_join.components
    monkeypatch.setattr(minhash_join, "components", lambda edges: made.append(1) or of_edges(edges))
    got = {r["doc_id"]: r["component_id"] for r in minhash_join.near_duplicates(docs(rows), size=2).collect()}
    assert got == {d: x[1] for d, x in brute(rows, 2).items()}
    assert len(made) == 1


def test_sketches_lose_no_pair_with_enough_matches(docs):
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    texts = near_copies(rng, [rng.choice(words) for _ in range(60)], 40, 20, words)
    signed = minhash_join.signatures(docs(list(enumerate(texts))), 2).select("doc_id", "tokens", "sketch", "n_shingles")
    both = signed.crossJoin(signed.select(*[signed[c].alias(f"x_{c}") for c in signed.columns]))
    alike = [minhash_join.signatures_alike("n_shingles", "sketch", "x_n_shingles", "x_sketch", p) for p in (50, 80)]
    rows = both.select("tokens", "x_tokens", *[c.alias(f"p{k}") for k, c in enumerate(alike)]).collect()
    matches = [sum(a == b for a, b in zip(r["tokens"], r["x_tokens"], strict=True)) for r in rows]
    assert all(r["p0"] for r, m in zip(rows, matches, strict=True) if m >= minhash_join.NEAR_MATCHES)
    assert all(r["p1"] for r, m in zip(rows, matches, strict=True) if m >= minhash_join.MATCHES)
    assert not all(r["p1"] for r in rows)
