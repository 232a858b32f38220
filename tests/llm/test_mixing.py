import math

import pytest

from lodestone.llm import mixing


def test_every_block_keeps_its_window_and_deviation_is_less_than_a_block():
    for weights in ({"a": 5, "b": 3, "c": 1, "d": 0.01}, dict.fromkeys("abcdefg", 1), {"x": 1}):
        slots = mixing.quotas(weights)
        assert sum(slots.values()) == mixing.PERIOD
        plan = mixing.pfair_period(slots)
        done = dict.fromkeys(slots, 0)
        for t, s, k in plan:
            assert k == done[s] and k * 1000 // slots[s] <= t < math.ceil((k + 1) * 1000 / slots[s])
            done[s] += 1
            assert all(abs(done[x] - (t + 1) * slots[x] / 1000) < 1 for x in slots)
        assert done == slots


def order_of(row):
    """The hash of key and text by which a source's rows are ordered."""
    import hashlib

    import xxhash

    text = 42 if row[1] is None else xxhash.xxh64(row[1].encode(), seed=42).intdigest()
    return hashlib.md5(f"{row[0]}:{text - (1 << 64) if text >> 63 else text}".encode()).hexdigest()


def expected(rows, weights, block):

    slots = mixing.quotas(weights)
    place = {(s, k): t for t, s, k in mixing.pfair_period(slots)}
    out = {}
    for s in weights:
        at = 0
        for k, n in sorted(((order_of(r), len((r[1] or "").encode())), r[0]) for r in rows if (r[2] or "") == s):
            b = at // block
            out[n] = (s, b, b // slots[s] * 1000 + place[s, b % slots[s]])
            at += k[1]
    return out


@pytest.mark.parametrize("bucket_rows", [20_000, 3])
def test_against_a_plain_version(docs, monkeypatch, bucket_rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    rows = [(k, "x" * (k * 37 % 900), ["a", "b", None][min(k % 5, 2)]) for k in range(200)] + [(500, None, "a"), (501, "", "b")]
    weights = {"a": 1, "b": 2, "": 3, "absent": 0}
    got = mixing.mix_sources(docs(rows), weights, block_bytes=2000)
    assert {r["doc_id"]: (r["mix_source"], r["mix_block"], r["mix_slot"]) for r in got.collect()} == expected(rows, {s: w for s, w in weights.items() if w}, 2000)


def test_rows_without_an_id_or_with_one_are_spread(docs, monkeypatch):
    """A key that many rows share doesn't put them into one range; long and repeated rows keep their blocks."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    rows = [(None, f"text {k} " * 5, "a") for k in range(200)] + [(7, "y" * k, "a") for k in range(100)] + [(8, "z" * 50_000, "a"), (9, "same", "a"), (9, "same", "a")]
    got = mixing.mix_sources(docs(rows), block_bytes=1000).select("doc_id", "text", "mix_block").collect()
    assert len(got) == len(rows)
    held = {}
    for r in got:
        held.setdefault(r["mix_block"], []).append(len(r["text"]))
    # A block's rows but the last one to start in it fit into it.
    assert all(sum(v) - max(v) <= 1000 for v in held.values()) and max(held) <= sum(len(t) for _, t, _ in rows) // 1000


def test_rows_stay_and_bad_weights_are_refused(docs):
    rows = [(1, "a", "s"), (1, "a", "s"), (None, "b", "s")]
    assert mixing.mix_sources(docs(rows)).count() == 3
    assert mixing.mix_sources(docs([])).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(docs(rows), {"other": 1})


def test_exact_weights_over_many_periods():
    weights = {f"s{k}": math.sqrt(k + 2) for k in range(20)} | {"rare": 0.0001}
    total = sum(weights.values())
    blocks = {s: int(40_000 * w / total) + 1 for s, w in weights.items()}
    done, slots = dict.fromkeys(weights, 0), 0
    for t, s, k in mixing.pfair_slots(weights, blocks):
        assert k == done[s]
        done[s] += 1
        if t < 39_000:
            assert t == slots
            slots += 1
            if t % 97 == 0 or t > 38_900:
                assert all(abs(done[x] - (t + 1) * weights[x] / total) < 1 + 1e-6 for x in weights)
    assert done == blocks


def test_used_up_sources_leave_the_others_their_windows():
    weights, blocks = {"a": 1, "b": 98, "c": 1}, {"a": 50, "b": 3, "c": 20}
    seen = list(mixing.pfair_slots(weights, blocks))
    assert len(seen) == 73 and len({t for t, *_ in seen}) == 73
    assert all(k * 100 // weights[s] <= t < -(-(k + 1) * 100 // weights[s]) for t, s, k in seen)


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_more_than_a_thousand_sources(docs, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "MAX_BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(mixing, "PLAN_ROWS", 500)
    rows = mixing.mix_sources(docs([(k, "x" * 10, f"host{k % 1200}") for k in range(2400)]), block_bytes=10).collect()
    assert len(rows) == 2400 and len({r["mix_slot"] for r in rows}) == 2400
