"""Failed files, batches that count once, stamped tables, joins on folders, bounded first rows, indexes."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import analysis
from lodestone.operators import chunking, embedding, expand, gram_index, search, vector_cells
from lodestone.plans import jobs
from lodestone.schema import FILES
from lodestone.sources import files as source_files
from lodestone.sources import tables
from lodestone.streaming import index_stream

NOW = datetime.datetime(2024, 5, 6, 7, 8, 9)


def files(spark, rows):
    return spark.createDataFrame([(p, NOW, n, None if c is None else bytearray(c)) for p, n, c in rows], FILES)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_damaged_files_do_not_stop_the_others(spark, tmp_path):
    given = files(spark, [("/r/a.txt", 3, b"ok."), ("/r/b.txt", 3, b"x\xff\xc3"), ("/r/c.md", 9, None), ("/r/d.txt", 0, b""), ("/r/e.md", 11 << 20, b"# T\nbody"), ("/r/f.txt", 4, "é".encode()[:1] + b"ab"), ("/r/g.pdf", 2, b"%P")])
    for strict, damaged in ((False, []), (True, ["b.txt", "f.txt"])):
        path = f"file://{tmp_path}/chunks-{strict}"
        totals, errors = jobs.index_documents(given, "/r", path, embedding.hashing_model(8), strict=strict)
        told = {r["name"]: (r["source"], r["message"]) for r in errors.collect()}
        assert told == {"c.md": ("/r/c.md", "cannot be read"), "d.txt": ("/r/d.txt", "empty"), "e.md": ("/r/e.md", "larger than 10485760 bytes")} | {n: (f"/r/{n}", "not UTF-8") for n in damaged}
        texts = {r["content"] for r in tables.read_chunks(spark, path).collect()}
        assert texts == ({"ok."} if strict else {"ok.", "x��", "�ab"})
        assert totals.first()["chunks"] == len(texts)
    code = source_files.load_code(source_files.list_code(files(spark, [("/r/a/x.ts", 2, b"\xffa"), ("/r/a/y.ts", 2, None)]), spark.createDataFrame([("a", "a")], "name string, path string"), "/r"))
    assert [r["content"] for r in code.collect()] == ["�a"]


def test_tables_of_pages_and_sheets_report_their_failures(spark):
    pages = spark.createDataFrame([("p/a.pdf", "x\fy", 2, "t", "a"), ("p/b.pdf", None, 2, "t", "a"), ("p/c.pdf", "z", None, "t", "a")], "source string, text string, pageCount int, title string, author string")
    texts = spark.createDataFrame([("t", "text", "one"), ("u", "markdown", None), ("v", "text", "  ")], "source string, sourceType string, text string")
    both = [chunking.split_outcomes(chunking.chunk_outcomes(texts, pages)), chunking.chunk_documents(texts, pages)]
    for chunks, errors in both:
        assert sorted(r["content"] for r in chunks.collect()) == ["one", "x", "y"]
        assert sorted(tuple(r) for r in errors.collect()) == [("b.pdf", "p/b.pdf", "no text"), ("c.pdf", "p/c.pdf", "no page count"), ("u", "u", "no text")]
    assert both[0][0].columns == both[1][0].columns


def test_a_batch_counts_once_and_holds_code(spark, tmp_path):
    services = spark.createDataFrame([("api", "api"), ("in", "api/in"), ("all", ".")], "name string, path string")
    given = files(spark, [("/r/api/in/a.ts", 9, b"let a = 1"), ("/r/api/b.md", 6, b"# T\nx"), ("/r/api/c.ts", 3, None), ("/r/d.txt", 0, b"")])
    path = f"file://{tmp_path}/chunks"
    write = index_stream.batch_writer(path, embedding.hashing_model(8), services=services, root="/r")
    for number in (0, 0, 1, 0):
        write(given, number)
    rows = tables.read_chunks(spark, path)
    once = rows.groupBy("chunkType", "serviceName").count().collect()
    assert {(r[0], r[1]): r[2] for r in once} == {("code", "api"): 4, ("code", "in"): 4, ("code", "all"): 4, ("document", ""): 2}
    errors = [tuple(r) for r in index_stream.errors_of(spark, path).collect()]
    assert len(errors) == 2 * 3 and {e[1:] for e in errors} == {("c.ts", "/r/api/c.ts", "cannot be read"), ("d.txt", "/r/d.txt", "empty")}
    # A later run of the batch without the code takes it out again.
    index_stream.batch_writer(path, embedding.hashing_model(8), root="/r")(given, 1)
    assert tables.read_chunks(spark, path).where("chunkType = 'code'").count() == 6


def test_another_model_is_refused(spark, tmp_path):
    path, model = f"file://{tmp_path}/chunks", embedding.hashing_model(8)
    given = files(spark, [("/r/a.txt", 3, b"red fox"), ("/r/b.txt", 3, b"blue sea")])
    questions = spark.createDataFrame([(1, "a red fox")], "query_id int, question string")
    with pytest.raises(ValueError, match="no known model"):
        jobs.ask(questions, path, model)
    jobs.index_documents(given, "/r", path, model)
    assert tables.model_of(spark, path) == ("hashing-8", 8)
    best = jobs.ask(questions, path, model).orderBy("rank").first()
    assert best["content"] == "red fox"
    for other in (embedding.hashing_model(16), embedding.Model("other", 8, embedding.hashing_embedder(8))):
        with pytest.raises(ValueError, match="hashing-8"):
            jobs.ask(questions, path, other)
        with pytest.raises(ValueError, match="hashing-8"):
            jobs.index_documents(given, "/r", path, other)


def test_services_meet_files_in_an_equi_join(spark):
    many = spark.range(100_000).select(F.concat(F.lit("s"), "id").alias("name"), F.concat(F.lit("top/s"), "id").alias("path"))
    given = files(spark, [("/r/top/s7/x/a.ts", 1, b"a"), ("/r/top/s77777/b.ts", 1, b"b"), ("/r/top/s7a/c.ts", 1, b"c"), ("/r/d.ts", 1, b"d")])
    found = source_files.list_code(given, many.unionByName(spark.createDataFrame([("x", "./top/s7/x//")], "name string, path string")), "/r")
    assert sorted((r["serviceName"], r["relativePath"]) for r in found.collect()) == [("s7", "top/s7/x/a.ts"), ("s77777", "top/s77777/b.ts"), ("x", "top/s7/x/a.ts")]
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)


def test_first_rows_of_a_large_group(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("g"), ((F.col("id") * 7919) % 60_000).alias("k"))
    for cells in ("40", "4", "1"):
        spark.conf.set("spark.sql.shuffle.partitions", cells)
        try:
            got = chunking.first_rows(rows, 3000, ["g"], ["k"]).groupBy("g").agg(F.count("*").alias("n"), F.max("__row").alias("m"), F.max("k").alias("k")).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        want = {g: sorted(int(i) * 7919 % 60_000 for i in range(60_000) if (i % 10 == 0) == (g == "small"))[2999] for g in ("small", "large")}
        assert {r["g"]: (r["n"], r["m"], r["k"]) for r in got} == {g: (3000, 3000, k) for g, k in want.items()}


def test_pages_take_time_in_proportion(spark):
    text = "abcdefghi\n" * 100_000
    pages = spark.createDataFrame([(text, 2000)], "text string, n int").select(chunking.text_pages(F.col("text"), F.col("n")).alias("p")).first()["p"]
    assert len(pages) == 2000 and pages[0]["content"] == text[:500].strip() and pages[-1]["pageNumber"] == 2000


def test_counts_read_no_column(spark, tmp_path):
    path = f"file://{tmp_path}/chunks"
    rows = [(str(k), "c", [0.0], "f", "f", "", "", "", "", "", 1, 1, "code") for k in range(5)]
    tables.append_chunks(spark.createDataFrame(rows, "id string, content string, vector array<float>, filePath string, relativePath string, serviceName string, fileType string, language string, symbolName string, level string, startLine int, endLine int, chunkType string"), path, 1)
    counted = tables.count_chunks(tables.read_chunks(spark, path))
    assert {r[0]: r[1] for r in counted.collect()} == {"code": 5, "document": 0}
    assert "ReadSchema: struct<>" in plan_of(counted)


def test_services_named_in_questions(spark):
    """The table of services and the chain of patterns agree; the order of names decides."""
    rng = random.Random(6)
    names = ["order-api", "user-service", "orderx", "a.b-c+d", "x", "api", "-odd", "web-", "pay-x-y", "größe-dienst", "Order-Api-2"]
    parts = ["order", "api", "-", " ", "\t", "user", "SERVICE", "x", "y", "pay", "odd", "web", "größe", "Dienst", "a.b", "c+d", "2", "_", "the"]
    asked = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 7)))) for k in range(300)] + [(300, None)]
    questions = spark.createDataFrame(asked, "query_id int, question string")
    services = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "name string, place int")
    chain = {r[0]: r[1] for r in questions.select("query_id", analysis.service_filter(F.col("question"), names)).collect()}
    joined = {r["query_id"]: r["serviceFilter"] for r in analysis.with_service_filter(questions, services).collect()}
    assert joined == chain and len(set(chain.values())) > 8
    many = spark.range(10_000).select(F.concat(F.lit("svc-"), "id").alias("name"), F.col("id").alias("place"))
    got = analysis.analyse(spark.createDataFrame([(1, "what does SVC 9999 do"), (2, "of svc12?"), (3, "none")], "query_id int, question string"), many)
    # svc-1 comes first in the order of names, and its name is part of svc12.
    assert {r["query_id"]: r["serviceFilter"] for r in got.collect()} == {1: "svc-9", 2: "svc-1", 3: None}


def test_neighbours_across_bands(spark):
    rows = [(f"c{k}", "f", k, "code") for k in range(1, 400, 7)]
    chunks = spark.createDataFrame(rows, "id string, filePath string, startLine int, chunkType string")
    base = chunks.select(F.lit(1).alias("query_id"), "id", F.lit(1.0).alias("score"), F.lit(1).alias("rank"), "filePath", "startLine", "chunkType")
    got = {}
    for r in expand.neighbours(base, chunks).collect():
        got.setdefault(r["base_id"], set()).add(r["id"])
    for name, _, line, _ in rows:
        near = sorted((abs(x - line), x, i) for i, _, x, _ in rows if abs(x - line) <= 50)[:3]
        assert got[name] == {i for _, _, i in near if i != name}


def test_the_index_equals_the_scan(spark, tmp_path):
    rng = random.Random(2)
    words = ["ab", "abab", "xyz", "the", "é", "日本語", "aaaa", "rare-word", "it's", "x"]
    chunks = spark.createDataFrame([(f"c{k}", None if k == 5 else "".join(rng.choice([*words, " ", "\n", "THE "]) for _ in range(rng.randint(0, 30))), "code") for k in range(200)], "id string, content string, chunkType string")
    asked = [(1, ["rare-word"]), (2, ["ab", "xyz"]), (3, ["日本語", "aa"]), (4, ["zzz", "qqqq"]), (5, []), (6, ["x"]), (7, ["the", "é"]), (8, ["abab", "it's", "nope"])]
    queries = spark.createDataFrame(asked, "query_id int, keywords array<string>")
    path = f"file://{tmp_path}/index"
    gram_index.build(chunks, path)
    for share in (0.0, 0.3, 5.0):
        got = sorted(tuple(r) for r in gram_index.indexed_keyword_hits(queries, spark, path, 9, share=share).collect())
        assert got == sorted(tuple(r) for r in search.keyword_hits(queries, chunks, 9).collect())


def test_a_rare_keyword_reads_few_chunks(spark, tmp_path):
    rng = random.Random(7)
    made = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40))
    chunks = spark.createDataFrame([(f"c{k}", made() + (" zebra crossing" if k % 100 == 3 else ""), "code") for k in range(1000)], "id string, content string, chunkType string")
    path = f"file://{tmp_path}/index"
    gram_index.build(chunks, path)
    postings = spark.read.parquet(f"{path}/postings")
    few = gram_index.rarest(spark.createDataFrame([("zebra",)], "word string"), postings)
    assert gram_index.candidates(few, postings).count() == 10


def test_cells_equal_the_scan_and_skip(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 4
    x = np.concatenate([c + rng.normal(size=(300, 16)) * 0.3 for c in centres]).astype(np.float32)
    x[7] = x[11]
    schema = "id string, vector array<float>"
    chunks = spark.createDataFrame([(f"c{k}", v.tolist()) for k, v in enumerate(x)] + [("none", None)], schema)
    queries = spark.createDataFrame([(k, x[k * 90 + 11].tolist()) for k in range(39)] + [(99, None)], "query_id int, vector array<float>")
    path = f"file://{tmp_path}/cells"
    vector_cells.build(chunks, path)
    for k in (1, 18, 400):
        got = sorted(tuple(r) for r in vector_cells.nearest_in_cells(queries, spark, path, k).collect())
        assert got == sorted(tuple(r) for r in search.nearest(queries, chunks, k).collect())
    assert vector_cells.looked_share(queries, spark, path, 5) < 0.35
    empty = f"file://{tmp_path}/empty"
    vector_cells.build(chunks.limit(0), empty)
    assert vector_cells.nearest_in_cells(queries, spark, empty, 3).count() == 0


def test_bounds_do_not_hold_the_distances(monkeypatch):
    """A worker keeps a number for each question, not its distances to the whole sample, nor makes them all at once."""
    rng = np.random.default_rng(4)
    m, known = rng.normal(size=(1000, 8)), rng.normal(size=(60, 8))
    inner, seen = vector_cells.squares, []
    monkeypatch.setattr(vector_cells, "squares", lambda a, b: (seen.append(len(a)), inner(a, b))[1])
    got = vector_cells.first_bounds(m, known, 18, 6)
    assert got.base is None and got.nbytes == 8 * 1000 and max(seen) <= vector_cells.PART
    assert (got == np.sort(inner(m, known).round(6), axis=1)[:, 17]).all()
    assert np.isinf(vector_cells.first_bounds(m, known[:5], 18, 6)).all()


def test_vectors_that_do_not_fit_are_refused(spark):
    schema = "id string, vector array<float>"
    queries = spark.createDataFrame([(1, [0.0, 1.0])], "query_id int, vector array<float>")
    for bad in ([0.0], [0.0, None], [0.0, 1.0, 2.0]):
        chunks = spark.createDataFrame([("a", [1.0, 1.0]), ("b", bad)], schema).coalesce(1)
        with pytest.raises(Exception, match="width|null|numbers"):
            search.nearest(queries, chunks, 1).collect()
