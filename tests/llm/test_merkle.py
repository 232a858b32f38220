import hashlib
import random
import zlib

from lodestone.llm import merkle, queries

NAMES = ("doc_id", "source", "lang", "n_chars", "text")
COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, root string, g string, place long, hash string, total long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes):
    """The root, and for each node the runs on its way: (left, right) a level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, k in zip(paths, at, strict=True):
            run = nodes[k // 16 * 16 : k // 16 * 16 + 16]
            path.append(("".join(run[: k % 16]), "".join(run[k % 16 + 1 :])))
        nodes = [h("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
        at = [k // 16 for k in at]
    return nodes[0], paths


def plain(rows):
    by = {}
    for row in rows:
        by.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources]
    root, tops = plain_tree([t[0] for t in trees])
    out = []
    for s, (subroot, paths), top in zip(sources, trees, tops, strict=True):
        for (_, _, leaf, row), path in zip(sorted(by[s], key=lambda x: x[:3]), paths, strict=True):
            path = path + top
            proof = h("".join(a + b for a, b in path))
            now = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                text = row[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
                now = leaf_of((*row[:4], text))
            for a, b in path:
                now = h(a + now + b)
            out.append((row[0], leaf, subroot, root, proof, now, now == root))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "old", "old", 3, "old", 4) for r in rows], COLUMNS)
    out = queries.manifest_digests(df)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == (plain(rows) if rows else [])


def test_against_plain(spark):
    rng = random.Random(3)
    rows = [(k * 7 % 5003, f"s{rng.choice([0, 0, 0, 1, 2])}", "en", k, rng.choice(["Ab", "x", "", "É Z\n"]) * rng.randint(0, 3)) for k in range(300)]
    rows += [(k, "one", None, None, None) for k in (5,)] + [(None, None, "de", 1, "A"), (None, "s1", "de", 1, "A"), (None, "s1", "de", 1, "B"), (3, None, None, None, "T"), (-9, "s1", "fr", 2, "C"), (2**62, "s1", "fr", 2, "D"), (-(2**63), "s1", "fr", 2, "E"), (2**63 - 1, "s1", "fr", 2, "F")]
    rows += [rows[4]] * 3 + [(63, "s2", "x", 1, "q"), (64, "s2", "x", 1, "q"), (64, "s2", "x", 1, "r"), (64, "s2", "x", 1, "q"), (1, "ü", "x", 1, "long " * 50_000), (1, "", "x", 1, "Z"), (2, "zz", None, None, "a")]
    check(spark, rows)


def test_one_leaf_one_source_and_none(spark):
    check(spark, [(5, "a", "en", 1, "X")])
    check(spark, [(k, "a", "en", 1, "X") for k in range(17)])
    check(spark, [])


def test_many_sources(spark):
    check(spark, [(k, f"s{k % 40}", "en", 1, "Xy") for k in range(90)])


def test_more_slots_than_an_array_holds(spark, monkeypatch):
    """With arrays of 16 slots, every tree of more than 16 leaves takes further rounds."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "SLOTS", 16)
    rows = [(k * 3, "a" if k % 4 else f"b{k}", "en", 1, "Xy") for k in range(700)] + [(77, "a", "en", 1, "same")] * 40
    check(spark, rows)


def test_two_words_of_the_directory(spark):
    """Ids far apart fall into other steps of the directory."""
    rng = random.Random(4)
    check(spark, [(rng.randrange(-(2**63), 2**63), "a", "en", 1, "Xy") for _ in range(80)] + [(k, "a", "en", 1, "Z") for k in range(40)])
