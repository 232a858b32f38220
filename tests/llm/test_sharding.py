import hashlib

from lodestone.llm import sharding


def directory(rows, limit):
    sixty = lambda x: bin(int(hashlib.md5(str("" if x is None else x).encode()).hexdigest()[:15], 16))[2:].zfill(60)
    bits = [(sixty(k) + sixty(t), len((t or "").encode())) for k, t in rows]

    def split(prefix, members):
        if sum(b for _, b in members) <= limit or len({h for h, _ in members}) < 2:
            return {prefix: (sum(b for _, b in members), len(members))} if members or not prefix else {}
        out = {}
        for bit in "01":
            part = [m for m in members if m[0].startswith(prefix + bit)]
            if part:
                out |= split(prefix + bit, part)
        return out

    return split("", bits) if bits else {}


def test_against_recursive_splitting(docs):
    rows = [(k, "x" * (k * 53 % 700)) for k in range(300)] + [(1, "same id"), (1, "y" * 5000), (None, "n"), (900, None), (901, "z" * 9000)]
    for limit in (1 << 30, 3000, 400):
        got = sharding.shard_rows(docs(rows), limit)
        assert got.count() == len(rows) and got.columns.count("shard") == 1
        found = {r["shard"]: (r["shard_bytes"], r["shard_rows"]) for r in got.select("shard", "shard_bytes", "shard_rows").distinct().collect()}
        assert found == directory(rows, limit)


def test_deep_buckets_and_empty_table(docs, spark):
    rows = spark.createDataFrame([("0" * 30 + "01" * 45, 5, 1), ("0" * 30 + "10" * 45, 5, 1), ("1" * 120, 50, 2)], "bits string, n_bytes long, n_rows long")
    got = {r["shard"]: r["shard_bytes"] for r in sharding.shard_directory(rows, 6).collect()}
    assert got == {"0" * 30 + "0": 5, "0" * 30 + "1": 5, "1": 50}
    assert sharding.shard_rows(docs([]), 100).count() == 0


def test_every_shard_fits_with_null_repeated_and_equal_rows(docs):
    rows = [(None, f"null {k} " * 60) for k in range(40)] + [(5, f"five {k} " * 50) for k in range(40)] + [(6, "same " * 100)] * 23 + [(None, None)] * 9 + [(7, "long " * 2000)] + [(8, "w" * 1800)] * 3
    limit = 2000
    got = sharding.shard_rows(docs(rows), limit).select("doc_id", "text", "shard", "shard_bytes", "shard_rows").collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == sorted((str(k), str(t)) for k, t in rows)
    held = {}
    for r in got:
        held.setdefault(r["shard"], []).append((len((r["text"] or "").encode()), r["shard_bytes"], r["shard_rows"]))
    for shard in held.values():
        assert {b for _, b, _ in shard} == {sum(n for n, _, _ in shard)} and {m for _, _, m in shard} == {len(shard)}
        assert shard[0][1] <= limit or len(shard) == 1
