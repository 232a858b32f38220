import hashlib
import random

import numpy as np
import pytest

from lodestone.llm import bwt_dedup


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for b in data:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in data:
        keep, reach, spans, inside = bytearray(), 0, 0, False
        for p in range(len(b)):
            if p + length <= len(b) and seen[b[p : p + length]] > 1:
                reach = p + length
            spans += p < reach and not inside
            inside = p < reach
            if not inside:
                keep.append(b[p])
        out.append((len(b), len(b) - len(keep), spans, hashlib.sha256(bytes(keep)).hexdigest()))
    return out


def test_blocks_against_brute_force():
    rng = random.Random(3)
    base = bytes(rng.choice(b"ab") for _ in range(60))
    for k in range(120):
        length = rng.choice([3, 5, 8, 9, 12, 20, 40])
        pieces = list(dict.fromkeys(bytes(rng.choice(b"abc") for _ in range(rng.randint(length, length + 17))) for _ in range(rng.randint(1, 8))))
        if k % 2:  # with long common parts
            pieces = list(dict.fromkeys(base[rng.randint(0, 20) :][: rng.randint(length, 60)] + p for p in pieces))
        counts = np.array([rng.choice([1, 1, 2]) for _ in pieces])
        windows = np.array([len(p) - length + 1 for p in pieces])
        runs = bwt_dedup.repeated_windows(pieces, windows, counts, length)
        total: dict[bytes, int] = {}
        for p, c in zip(pieces, counts, strict=True):
            for i in range(len(p) - length + 1):
                total[p[i : i + length]] = total.get(p[i : i + length], 0) + c
        for p, r in zip(pieces, runs, strict=True):
            assert [i for a, b in zip(r[::2], r[1::2], strict=True) for i in range(a, b)] == [i for i in range(len(p) - length + 1) if total[p[i : i + length]] > 1]


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    base = [" ".join(word() for _ in range(120)) for _ in range(6)]
    passage = " ".join(word() for _ in range(60))
    out = [base[0], base[0], base[1], base[2][:100] + passage + base[2][100:], base[3] + passage, passage, "For " * 200, "ab" * 150, None, "", "short"]
    return out + [base[4] + base[4][:260], base[5], base[5].replace("a", "b", 3)]


@pytest.mark.parametrize("hot_bytes", [1 << 30, 100])
def test_against_brute_force(docs, hot_bytes):
    given = texts()
    df = docs(list(enumerate(given)))
    got = {r["doc_id"]: tuple(r)[1:] for r in bwt_dedup.remove_repeats(df, 100, k=40, hot_bytes=hot_bytes, block_bytes=4000).collect()}
    assert [got[k] for k in range(len(given))] == brute(given, 100)


def test_repeated_rows_null_ids_and_empty_table(docs):
    long = " ".join(f"w{k}" for k in range(100))
    rows = bwt_dedup.remove_repeats(docs([(1, long), (1, long), (None, long[:250]), (None, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in rows) == [(0, 0, 0), (0, 250, 250), (1, len(long), len(long)), (1, len(long), len(long))]
    assert bwt_dedup.remove_repeats(docs([])).collect() == []


def test_very_long_texts_and_one_hot_passage(docs):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(30)
    given = [text(40) + passage + text(40) for _ in range(60)] + [text(60_000) + passage]
    rows = bwt_dedup.remove_repeats(docs(list(enumerate(given))), hot_bytes=5000, block_bytes=4000).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == dict(enumerate(brute(given, 200)))
