"""The pipeline's stages against plain versions, each on what its predecessor kept."""

import re

import corpus_pipeline
from lodestone.llm import decontam, queries, toxicity
from lodestone.llm.common import table


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def kept_of_groups(rows):
    """Ids that stay: the least of each group of texts linked by similarity 0.8."""
    s = {d: sets(t) for d, t in rows}
    comp = {d: d for d in s}

    def find(d):
        while comp[d] != d:
            d = comp[d]
        return d

    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if s[a] and s[b] and 0.8 <= len(s[a]) / len(s[b]) <= 1.25:
                inter = len(s[a] & s[b])
                if 100 * inter >= 80 * (len(s[a]) + len(s[b]) - inter):
                    x, y = find(a), find(b)
                    comp[max(x, y)] = min(x, y)
    return {d for d in ids if find(d) == d}


def words(text):
    return [w for w in re.split(r"[\x00-/:-`{-\x7f]+", (text or "").lower()) if w]


def leaks(rows, items):
    out = set()
    for d, t in rows:
        w = words(t)
        for x in items:
            for k in range(len(w)):
                same = sum(p == q for p, q in zip(w[k:], x, strict=False))
                if len(x) >= decontam.SPAN and same >= 0.8 * len(x):
                    out.add(d)
    return out


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    bad = {r["doc_id"] for r in toxicity.judge(docs, table(spark, sf, "labels")).where("predicted = 1").collect()}
    items = [words(r["text"]) for r in table(spark, sf, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, sf)
        rows = out.collect()
        after = {r["doc_id"] for r in rows}
        assert len(after) == len(rows)
        if name != "sharding":
            assert out.columns == docs.columns
        if name == "toxicity":
            assert after == set(before) - bad
        elif name == "near_dedup":
            assert after == kept_of_groups(list(before.items()))
        elif name == "decontamination":
            assert after == set(before) - leaks(before.items(), items)
        else:
            assert after == set(before)
        docs = spark.createDataFrame(rows, out.schema) if name != "sharding" else docs
    assert {r["shard_bytes"] <= queries.SHARD_BYTES or r["shard_rows"] == 1 for r in rows} == {True}
    whole = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert whole == after


def test_the_mixture_reaches_the_output(spark, docs, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "BLOCK_BYTES", 100)
    made = docs([(k, "x" * 50, "ab"[k % 2]) for k in range(80)])
    slots = {}
    for weights in ({"a": 1, "b": 1}, {"a": 9, "b": 1}):
        rows = corpus_pipeline.sharding_stage(spark, made, "", weights).collect()
        assert [r["mix_slot"] for r in rows] == sorted(r["mix_slot"] for r in rows) and {r["shard"] for r in rows} == {""}
        slots[weights["a"]] = {r["doc_id"]: r["mix_slot"] for r in rows}
        first = [r["source"] for r in rows if r["mix_slot"] < 20]
        assert abs(first.count("a") / len(first) - weights["a"] / sum(weights.values())) < 0.06
    assert slots[1] != slots[9] and len(slots[1]) == len(slots[9]) == 80


def test_stages_take_nulls_repeats_clashing_names_and_empty_tables(spark, sf, docs):
    item = table(spark, sf, "benchmark").first()["text"]
    text = " ".join(f"calm{k}" for k in range(40))
    rows = [(1, text, "a"), (1, text, "a"), (2, text + " end", "b"), (None, None, None), (None, "", "a"), (3, "", "b"), (None, f"{text[:20]} other words {item}", "c"), (None, "just some words", None), (4, "long " * 100_000, "a")]
    now, empty = docs(rows), docs([])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf)
        got = out.collect()
        assert stage(spark, empty, sf).collect() == []
        if name != "sharding":
            assert out.columns == now.columns
        now = spark.createDataFrame(got, out.schema)
    kept = sorted(((r["doc_id"] or 0, (r["text"] or "")[:10]) for r in got), key=str)
    # The two equal rows of id 1 stay together, their near copy goes; the row with a test item goes;
    # null and empty texts are copies of nothing.
    assert kept == sorted([(1, text[:10])] * 2 + [(0, ""), (0, ""), (3, ""), (0, "just some "), (4, ("long " * 3)[:10])], key=str)
