"""Rules that small tables don't reach, against the SQL on made tables."""

import random
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone import registry
from lodestone.operators import gram_index, rerank, search, word_index
from lodestone.plans import jobs


def same_as_sql(spark, name, tables, out):
    """The rows of a query over made tables, which are those of its SQL."""
    c = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{out}/{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{out}/{t}.parquet/*.parquet'")
    found = registry.QUERIES[name](spark, str(out))
    found.write.parquet(f"{out}/found")
    have = f"'{out}/found/*.parquet'"
    columns = ", ".join(f'"{x}"' for x in sorted(found.columns))
    c.execute(f"CREATE TABLE expected AS {registry.ORACLE[name]}")
    for a, b in (("expected", have), (have, "expected")):
        assert c.execute(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b}").fetchall() == []
    return spark.read.parquet(f"{out}/found").collect()


@pytest.mark.parametrize("text, seen", [("1 (one) of many", "1"), ("a class  of (x)", "of"), ("x" * 193 + " f(", "unknown"), ("none", "unknown")])
def test_targets_reach_into_texts(spark, tmp_path, text, seen):
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("src1").alias("source"), F.lit("en").alias("lang"), F.lit(text).alias("text"))
    rows = {r["doc_id"]: r["occurrences"] for r in same_as_sql(spark, "framework_metadata", {"documents": docs}, tmp_path)}
    assert rows[0].endswith(f"Post() {seen}")


def test_equal_questions_are_searched_once_and_full_ones_not_further(spark, monkeypatch):
    """Repeated questions reach the scorer once, and those with full scores enough among the least ids
    don't meet the other chunks; the hits are those of a plain count."""
    texts = {f"c{k:02}": "ab " * (k % 7) + "rare " * (k == 38) for k in range(40)}
    asked = {q: (["ab"], ["rare"], ["ab", "rare"], [])[q % 4] for q in range(40)}
    chunks = spark.createDataFrame([(i, t, "document" if i > "c20" else "code") for i, t in texts.items()], "id string, content string, chunkType string").repartition(3)
    queries = spark.createDataFrame(list(asked.items()), "query_id long, keywords array<string>")
    seen = []
    inner = search.best_of_blocks
    monkeypatch.setattr(search, "best_of_blocks", lambda q, c, *rest, **how: (seen.append((q.count(), c.count())), inner(q, c, *rest, **how))[1])
    monkeypatch.setattr(search, "FIRST_CHUNKS", 20)
    for documents in (True, False):
        want = set()
        for q, ws in asked.items():
            rows = [(-min(n / max(5 * len(ws), 1), 1.0), i, n) for i, t in texts.items() if (n := sum(t.count(w) for w in ws)) or (not documents and i > "c20")]
            want |= {(q, i, n, -s, k + 1) for k, (s, i, n) in enumerate(sorted(rows)[:3])}
        assert {tuple(r) for r in search.keyword_hits(queries, chunks, 3, keyword_filter_documents=documents).collect()} == want
    assert seen == [(4, 20), (3, 20)] * 2


def test_prompts_carry_no_texts_and_many_questions_meet_small_chunks_once(spark, monkeypatch):
    """Candidates are reranked without their texts, which are joined to the few that fit; each of many questions gets its
    nearest chunks in one task, so no more than k rows are made for it; the prompts are those of results with texts."""
    vec = lambda n: [float((n * p) % 11) for p in (3, 5, 7)]
    rows = [(f"c{k:02}", ("Alpha beta " * (k % 5) + f"word{k} ") * (k % 4 + 1), vec(k), "code" if k % 2 else "document", f"f{k // 6}", f"f{k // 6}", "s", "t", "n", k % 6 * 9 + 1, k % 6 * 9 + 9) for k in range(48)]
    chunks = spark.createDataFrame(rows, "id string, content string, vector array<float>, chunkType string, filePath string, relativePath string, serviceName string, fileType string, symbolName string, startLine int, endLine int")
    queries = spark.createDataFrame([(k, f"Where is Alpha or word{k}?", vec(k + 1)) for k in range(30)], "query_id long, question string, vector array<float>")
    got = {r["query_id"]: r["prompt"] for r in jobs.asked_prompts(queries, chunks.repartition(3), ["s"]).collect()}
    assert len(got) == 30 and all("## Question" in p and "word" in p for p in got.values())
    held, inner = [], rerank.rerank
    monkeypatch.setattr(jobs.rerank, "rerank", lambda c, *rest, **how: (held.append(set(c.columns)), inner(c, *rest, **how))[1])
    assert got == {r["query_id"]: r["prompt"] for r in jobs.prompts(queries, jobs.retrieve(queries, chunks, ["s"])).collect()}
    assert held and not held[0] & {"content", "keywords"}
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    made, topped = [], search.top
    monkeypatch.setattr(search, "top", lambda df, *rest, **how: (made.append(df.count()), topped(df, *rest, **how))[1])
    assert search.nearest(queries, chunks.repartition(9), 5).count() == 150 and made == [150]


def test_the_index_of_words_equals_the_scan(spark, tmp_path, monkeypatch):
    """Keywords within words, over parts of them, with blanks, short and in other case; equal questions are looked up once,
    and a chunk is posted once for each word."""
    rng = random.Random(6)
    words = ["abcabcabcabc", "xabcabcabcabcabc", "Übergrößenträger", "übergrößen", "aaaaaaaaaaaaaaaaaaaa", "ab", "日本語日本語日本語", "it's-a-long-one", "\x1cnot\x85parted", ""]
    texts = [None, "", " \n "] + ["".join(rng.choice(words) + rng.choice(["", " ", "\n", "\t", "\u00a0", " \r\n"]) for _ in range(rng.randint(0, 12))) for _ in range(150)]
    chunks = spark.createDataFrame([(f"c{k:03}", t, ("code", "document")[k % 2], f"s{k % 3}", "t") for k, t in enumerate(texts)], "id string, content string, chunkType string, serviceName string, fileType string").repartition(3)
    asked = [["abcabcabc"], ["ABCABCABC", "abcabcabc"], ["aaaaaaaa", "nowhere-at-all"], ["übergröß"], ["本語日本語日本語"], ["long-one", "abcabcab"], ["ab"], ["long-one", "ab"], ["a long one"], ["nowhere-at-all"], [], ["parted", "not\x85part"], ["abcabcabc", "aaaaaaaa", "long-one"], ["bcabcabca", "träger", "übergröß"], None]
    schema = "query_id int, keywords array<string>, serviceFilter string, fileTypeFilter string"
    queries = spark.createDataFrame([(k, asked[k % len(asked)], None if k % 2 else "s1", None) for k in range(4 * len(asked))], schema)
    path = f"file://{tmp_path}/index"
    monkeypatch.setattr(word_index, "ROWS", 40)
    word_index.build(chunks, path)
    posted = spark.read.parquet(f"{path}/postings").select("word", F.explode("numbers").alias("number"))
    assert posted.count() == posted.distinct().count() == sum(len(set(re.findall(r"[^ \t\n\x0b\f\r]+", (t or "").lower()))) for t in texts)
    for share, filtered, most in ((0.0, False, 9), (0.3, True, 0), (5.0, False, 0), (50.0, True, 1 << 20)):
        monkeypatch.setattr(word_index, "MAX_BROADCAST", most)
        got = sorted(tuple(r) for r in word_index.indexed_keyword_hits(queries, spark, path, 9, filtered=filtered, share=share).collect())
        assert got == sorted(tuple(r) for r in search.keyword_hits(queries, chunks, 9, filtered=filtered).collect()) and len(got) > 250


def test_lists_of_the_index_are_begun_where_chunks_are_read():
    """A batch gives a row for each piece and block, not for each piece of a chunk."""
    texts = ["aXéb", "aXé", None, "a"]
    made = list(gram_index._posted(iter([pa.RecordBatch.from_pydict({"number": [0, 1, 2, 1 << gram_index.BLOCK_BITS], "text": texts})])))
    rows = {(r["piece"], r["block"]): r["numbers"] for r in made[0].to_pylist()}
    assert rows == {("aX", 0): [0, 1], ("Xé", 0): [0, 1], ("éb", 0): [0], ("aXé", 0): [0, 1], ("Xéb", 0): [0]}
