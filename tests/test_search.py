"""Search, fusion, reranking, expansion, prompts, chat."""

import random
from decimal import ROUND_FLOOR, Decimal

from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import chat, context, expand, rerank, search


def nearest_by_join(queries, chunks, k, decimals=6):
    """What `nearest` computes, as one plain join."""
    pairs = queries.select("query_id", F.col("vector").alias("q")).crossJoin(chunks.select("id", F.col("vector").alias("c")))
    square = F.aggregate(F.zip_with("q", "c", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return search.top(pairs.select("query_id", "id", F.round(square, decimals).alias("distance")), k, "distance", "id")


def test_nearest_equals_the_plain_join(spark, monkeypatch):
    rng = random.Random(1)
    vec = lambda: [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]
    chunks = spark.createDataFrame([(f"c{k:03}", vec()) for k in range(90)] + [("none", None)], "id string, vector array<float>").repartition(5)
    queries = spark.createDataFrame([(k, vec()) for k in range(7)], "query_id long, vector array<float>")
    got = sorted(tuple(r) for r in search.nearest(queries, chunks, 5).collect())
    assert got == sorted(tuple(r) for r in nearest_by_join(queries, chunks.where("vector is not null"), 5).collect())
    no_vector = spark.createDataFrame([(99, None)], queries.schema)
    for name, rows in (("QUERY_BLOCK", 2), ("CHUNK_BLOCK", 7), ("MAX_BROADCAST_BLOCKS", 0), ("HELD_QUESTIONS", 3)):
        monkeypatch.setattr(search, name, rows)
        assert got == sorted(tuple(r) for r in search.nearest(queries.unionByName(no_vector), chunks, 5).collect())
    assert search.nearest(queries.limit(0), chunks, 5).count() == 0 and search.nearest(queries, chunks.limit(0), 5).count() == 0


def test_keywords_modes(spark):
    chunks = spark.createDataFrame([("1", "aaaa Foo foo", "code", [3.0]), ("2", "100% _x", "code", [1.0]), ("3", "FOO bar", "document", [2.0]), ("4", "none", "document", [1.0])], "id string, content string, chunkType string, vector array<float>")
    ask = lambda *w: spark.createDataFrame([(1, list(w))], "query_id long, keywords array<string>")
    run = lambda q, **how: [(r["id"], r["occurrences"]) for r in search.keyword_hits(q, chunks, 9, **how).orderBy("rank").collect()]
    assert run(ask("foo")) == [("1", 2), ("3", 1)]
    assert run(ask("aa")) == [("1", 2)]
    assert run(ask("%")) == [("2", 1)] and run(ask("_x")) == [("2", 1)]
    assert run(ask("foo"), match="like") == [("1", 2)]
    assert len(run(ask("%"), match="like")) == 4
    assert run(ask("foo"), keyword_filter_documents=False) == [("1", 2), ("3", 1), ("4", 0)]
    assert run(ask("foo"), candidate_cap=1) == [("3", 1)]
    assert run(ask()) == []


def test_fusion(spark):
    ranked = lambda ids: spark.createDataFrame([(1, i, k + 1) for k, i in enumerate(ids)], "query_id long, id string, rank int")
    got = search.fused(ranked(["a", "b", "c", "a"]), ranked(["c", "d"]), 10).orderBy("rank").collect()
    assert [(r["id"], r["semantic_rank"], r["keyword_rank"]) for r in got] == [("c", 3, 1), ("b", 2, None), ("d", None, 2), ("a", 4, None)]
    assert abs(got[0]["score"] - (1 / 63 + 1 / 61)) < 1e-12
    assert search.fused(ranked([]), ranked(["x"]), 3).count() == 1


def test_rerank(spark):
    schema = "query_id long, id string, score double, rank int, content string, serviceName string, fileType string"
    rows = [(1, "a", 0.03, 1, "nothing", "s", "t"), (1, "b", 0.02, 2, "a User word", "svc", "module"), (1, "b", 0.02, 3, "a User word", "svc", "module"), (2, "z", 0.01, 1, "x", "", "")]
    analysis = spark.createDataFrame([(1, ["word"], ["User"], "svc", "module", True), (2, [], [], None, None, False)], "query_id long, keywords array<string>, entityNames array<string>, serviceFilter string, fileTypeFilter string, isArchitectural boolean")
    df = spark.createDataFrame(rows, schema)
    got = {(r["query_id"], r["id"]): (r["score"], r["rank"]) for r in rerank.rerank(df, analysis).collect()}
    assert got == {(1, "b"): (1.0, 1), (1, "a"): (0.0, 2), (2, "z"): (1.0, 1)}
    raw = df.where("rank = 2").join(analysis, "query_id").select(rerank.boost().alias("b")).first()["b"]
    assert abs(raw - (0.2 + 0.15 + 0.1 + 0.1 + 0.05)) < 1e-12


def test_expansion_takes_three_before_leaving_itself_out(spark):
    chunks = spark.createDataFrame([(f"c{k}", "f", k * 10 + 1, "code", f"t{k}", [float(9 - k)]) for k in range(9)] + [("d", "f", 1, "document", "t", [0.0])], "id string, filePath string, startLine int, chunkType string, content string, vector array<float>")
    base = spark.createDataFrame([(1, "c4", 0.8, 1, "f", 41, "code", "t4"), (1, "d", 0.5, 2, "f", 1, "document", "t")], "query_id long, id string, score double, rank int, filePath string, startLine int, chunkType string, content string")
    assert [(r["id"], r["score"]) for r in expand.expand(base, chunks).orderBy("rank").collect()] == [("c4", 0.8), ("d", 0.5), ("c3", 0.4), ("c5", 0.4)]
    assert [r["id"] for r in expand.expand(base, chunks, order="norm").orderBy("rank").collect()] == ["c4", "d", "c8", "c7", "c6"]


def test_prompts(spark):
    schema = "query_id long, position int, content string, filePath string, serviceName string, fileType string, score double, chunkType string, startLine int"
    contexts = spark.createDataFrame([(1, 2, "B", "p.pdf", "", "pdf", 0.125, "document", 3), (1, 1, "A", "f.ts", "svc", "service", 1.0, "code", 5), (1, 3, "C", "q.md", "x", "markdown", 0.0625, "document", 0)], schema)
    queries = spark.createDataFrame([(1, "why?"), (2, "no context")], "query_id long, question string")
    got = {r["query_id"]: r["prompt"] for r in context.build_prompts(queries, contexts).collect()}
    assert "[1] svc/f.ts (service, 100.0%)\nA\n\n[2] p.pdf (pdf, page 3, 12.5%)\nB\n\n[3] q.md (markdown, 6.3%)\nC\n\n## Question\n\nwhy?\n\n## Instructions\n\n" in got[1]
    assert got[2].startswith("## Context\n\nThe following") and "knowledge base:\n\n## Question\n\nno context" in got[2]
    projects = spark.createDataFrame([("P", "d", "", ["g"]), ("", None, None, [])], "project string, description string, systemContext string, guidelines array<string>")
    services = spark.createDataFrame([("P", 2, "b", "React", "web"), ("P", 1, "a", "NestJS", "api")], "project string, position int, name string, framework string, role string")
    got = {r["project"]: r["prompt"] for r in context.system_prompts(projects, services).collect()}
    assert got["P"] == "You are an expert assistant for P.\nd\n\n프로젝트 서비스 구성:\n- a: NestJS (api)\n- b: React (web)\n\nGuidelines:\n- g"
    assert got[""] == "You are an expert code and document assistant."


def test_history_is_cleared(spark):
    said = [("user", "q1"), ("assistant", "a1"), ("system", "s"), ("user", "q2"), ("assistant", "a2"), ("user", "q3"), ("user", " CLEAR "), ("user", "q4"), ("assistant", None), ("user", "q5")]
    df = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(said)], "conv_id long, turn long, role string, text string")
    got = {r["question"]: r["history"] for r in chat.histories(df).collect()}
    assert got == {"q1": "", "q2": "질문: q1\n답변: a1", "q3": "질문: q1\n답변: a1\n질문: q2\n답변: a2", "q4": "", "q5": "질문: q4\n답변: "}


def test_keyword_search_in_blocks_equals_counting(spark, monkeypatch):
    rng = random.Random(4)
    words = ["ab", "aba", "abab", "b", "zz", "Ab", "c d"]
    texts = {f"c{k:03}": " ".join(rng.choice(["abab", "ababab", "AB", "c", "d", "zzz", "x"]) for _ in range(rng.randint(0, 9))) for k in range(60)}
    asked = {q: rng.sample(words, rng.randint(0, 4)) for q in range(9)}
    chunks = spark.createDataFrame([(i, t, "code") for i, t in texts.items()], "id string, content string, chunkType string").repartition(4)
    queries = spark.createDataFrame(list(asked.items()), "query_id long, keywords array<string>")
    want = set()
    for q, ws in asked.items():
        rows = [(-min(n / max(5 * len(ws), 1), 1.0), i, n) for i, t in texts.items() if (n := sum(t.lower().count(w.lower()) for w in ws))]
        want |= {(q, i, n, -s, k + 1) for k, (s, i, n) in enumerate(sorted(rows)[:5])}
    for name, rows in (("QUERY_BLOCK", 512), ("QUERY_BLOCK", 2), ("CHUNK_BLOCK", 7), ("HELD_QUESTIONS", 3)):
        monkeypatch.setattr(search, name, rows)
        assert {tuple(r) for r in search.keyword_hits(queries, chunks, 5).collect()} == want


def test_percent_goes_by_the_binary_value(spark):
    shown = {0.1235: "12.3", 0.1225: "12.3", 0.125: "12.5", 0.0005: "0.1", 1.0: "100.0", 0.0: "0.0", 0.99949: "99.9", 0.9996: "100.0", 0.00125: "0.1", 0.0625: "6.3", 0.333333: "33.3"}
    rows = spark.createDataFrame([(x,) for x in shown], "x double").select("x", text.percent(F.col("x")).alias("p")).collect()
    exact = {}
    for x in shown:
        tenth = Decimal(x * 100) * 10
        exact[x] = str((tenth + Decimal("0.5")).to_integral_value(ROUND_FLOOR) / 10)
    assert {r["x"]: float(r["p"]) for r in rows} == {x: float(p) for x, p in exact.items()}
    assert {r["x"]: r["p"] for r in rows}[0.1235] == "12.3"
