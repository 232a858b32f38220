"""Window starts and the token budget against plain loops."""

from pyspark.sql import functions as F

from lodestone.operators import chunking, context


def loop(n, size, overlap):
    out, start = [], 0
    while start < n:
        end = min(start + size, n)
        out.append(start)
        if end - overlap <= start:
            break
        start = end - overlap
    return out


def test_starts_equal_the_loop(spark):
    df = spark.range(0, 61).select(F.col("id").cast("int").alias("n")).coalesce(1).cache()
    for size in (1, 2, 3, 5, 8, 10):
        for overlap in (0, 1, 2, 4, 7, 10, 12):
            got = df.select("n", chunking.window_starts(F.col("n"), size, overlap).alias("s")).collect()
            assert all(r["s"] == loop(r["n"], size, overlap) for r in got), (size, overlap)


def test_pieces(spark):
    texts = ["", "   ", "short", "x" * 10, "abcdefghijk", "ab" + " " * 9 + "cd", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(chunking.text_pieces(F.col("t"), 4, 1)).collect()]
    for t, g in zip(texts, got, strict=True):
        if t is None:
            assert g == []
            continue
        want = [t] if len(t) <= 4 else [t[s : s + 4] for s in loop(len(t), 4, 1)]
        assert g == [w for w in want if w.strip()]
    lines = spark.createDataFrame([("a\nb\n\n\n\n\nc",), ("",)], "t string")
    got = [[(p["content"], p["startLine"], p["endLine"]) for p in r[0]] for r in lines.select(chunking.line_windows(F.col("t"), 160, 0)).collect()]
    assert got == [[("a\nb", 1, 2), ("c", 7, 7)], []]


def test_budget_stops_at_the_first_that_overflows(spark):
    row = lambda k, n, s: ("q", f"c{k}", "x" * n, "p", "", "t", s, k, "code", 1)
    schema = "query_id string, id string, content string, filePath string, serviceName string, fileType string, score double, rank int, chunkType string, startLine int"
    df = spark.createDataFrame([row(1, 30, 0.9), row(2, 30, 0.8), row(3, 3000, 0.7), row(4, 3, 0.6)], schema)
    assert [r["position"] for r in context.assemble(df, tokens=100).collect()] == [1, 2]
    tiny = spark.createDataFrame([row(k, 0 if k == 3 else 2, 0.5) for k in range(1, 10)], schema)
    got = context.assemble(tiny).collect()
    assert [r["position"] for r in got] == list(range(1, 9)) and got[-1]["tokens"] == 7
    assert context.assemble(df.limit(0)).count() == 0
