import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from lodestone.llm import turns

WS = "\x20\x09-\x0d"
SCHEMA = "conv_id long, turn long, role string, text string, kind int, part string, seq string, n long, gone boolean"


def is_allowed(initials):
    return re.fullmatch("(s?(ua)+)?", initials) is not None


def search(symbols):
    """The cheapest edits by uniform-cost search over (rows done, roles so far): letters least at a tie."""
    heap, done = [(0, "", 0, 0)], set()
    move = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    while heap:
        cost, audit, at, where = heapq.heappop(heap)
        if at == len(symbols) and where in (0, 3):
            return cost, audit
        if (audit, at, where) in done or len(audit) > 3 * len(symbols) + 2:
            continue
        done.add((audit, at, where))
        for role, to in move[where].items():
            if role != "s":
                heapq.heappush(heap, (cost + 3, audit + "I", at, to))
        if at < len(symbols):
            s = symbols[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, where))
            if s != "d":
                more = 3 if s.isupper() else 0
                for role, to in move[where].items():
                    if role == s.lower():
                        heapq.heappush(heap, (cost + more, audit + "K", at + 1, to))
                    if role != "s":
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, to))


def by_product(symbols, rules=()):
    fold = turns.Fold()
    if symbols:
        m = turns.evaluated(symbols, list(rules), turns.matrices(list(rules)))
        cells = [c for row in m for c in row]
        fold.add({"blank": 0, "duplicate": 0, "truncated": 0, "roles": "", "costs": [c and c[0] for c in cells], "audits": [c and turns.spelled(c[1]) for c in cells]})
    return fold.result()


def test_every_short_string_against_search():
    for n in range(4):
        for symbols in map("".join, itertools.product("suaxUAd", repeat=n)):
            assert by_product(symbols) == search(symbols), symbols


def test_longer_strings_and_rules():
    rng = random.Random(1)
    rules = [("ua", "\ue000"), ("\ue000\ue000", "\ue001"), ("su", "\ue002"), ("d\ue000", "\ue003")]
    for _ in range(60):
        symbols = "".join(rng.choice("suauauaUAdx") for _ in range(rng.randint(4, 9)))
        want = search(symbols)
        assert by_product(symbols) == want and by_product(symbols, rules) == want, symbols


def plain(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        text, role = " " if text is None else text, " " if role is None else role
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        row = (turn is not None, turn or 0, "user" if code == 4 else role, text)
        convs[conv] += [row] * (2 if code == 3 else 1)
    out = []
    for conv, held in convs.items():
        held = sorted(held, key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        numbers = {r[1] for r in held if r[0]}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        seen, faults, symbols = set(), [], ""
        for r in held:
            stripped = r[3].strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not stripped else "duplicate" if r[2:] in seen else "truncated" if stripped[-1] not in ".!?" else ""
            seen.add(r[2:])
            faults.append(fault)
            initial = r[2][:1] if r[2][:1] in ("s", "u", "a") else "x"
            symbols += "d" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(held)]
        cost, audit = by_product(symbols)
        if len(symbols) < 9:
            assert (cost, audit) == search(symbols)
        lines, at, last = [], 0, ""
        for letter in audit:
            role = "assistant" if last == "u" else "user"
            if letter == "I":
                lines.append((role, ""))
            else:
                if letter != "D":
                    lines.append((held[at][2] if letter == "K" else role, held[at][3]))
                at += 1
            last = lines[-1][0][:1] if lines else ""
        assert at == len(held) and is_allowed("".join(r[:1] for r, _ in lines))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [10, 3])
def test_query_against_plain(spark, monkeypatch, bits):
    monkeypatch.setattr(turns, "SEGMENT_BITS", bits)
    rng = random.Random(bits)
    texts = ["Hello.", "Hello.", "what is it?", "no mark", "", " \t\n", None, "É! ", "x.\x0b", "a\nb!", "w " * 20_000 + "."]
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 8)):
            if rng.random() < 0.9:
                rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(texts)))
    rows += [(500, k, "user" if k % 2 == 0 else "assistant", f"line {k}." if k % 5 else "same.") for k in range(700)]
    rows += [(600, None, "user", "a."), (600, 3, "assistant", "b."), (601, None, None, None), (None, 1, "user", "x."), (None, 2, "assistant", "y."), (None, 2, "assistant", "y."), (602, -5, "user", "q?"), (602, 9, "user", "q?")]
    df = spark.createDataFrame([(*r, 9, "p", "q", 8) for r in rows], SCHEMA.removesuffix(", gone boolean"))
    out = turns.digests(turns.repair(turns.damaged(df)))
    assert sorted((tuple(r) for r in out.collect()), key=str) == plain(rows)


def test_empty_and_all_dropped(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert turns.digests(turns.repair(turns.damaged(df))).count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "x.", 1, "", "", 1, False)], SCHEMA)
    out = turns.digests(turns.repair(turns.damaged(df))).collect()
    assert [tuple(r) for r in out] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_messages(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "Hi."), (1, 2, "user", "What?"), (1, 3, "assistant", "So.")], "conv_id long, turn long, role string, text string")
    got = turns.repaired_messages(turns.repair(df)).orderBy("position").collect()
    assert [tuple(r)[2:] for r in got] == [("I", "user", ""), ("K", "assistant", "Hi."), ("K", "user", "What?"), ("K", "assistant", "So.")]
