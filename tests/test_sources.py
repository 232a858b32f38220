"""Files, services, the chunk table, jobs and the stream."""

import datetime
import hashlib
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import embedding
from lodestone.plans import jobs
from lodestone.schema import CHUNKS, FILES
from lodestone.sources import files as source_files
from lodestone.sources import tables
from lodestone.streaming import index_stream

NOW = datetime.datetime(2024, 5, 6, 7, 8, 9)


def inventory(spark, contents):
    return spark.createDataFrame([(p, NOW, len(c.encode()), c.encode()) for p, c in contents.items()], FILES)


@pytest.fixture(scope="module")
def tree(spark):
    return inventory(
        spark,
        {
            "/r/api/src/a.service.ts": "import x from 'y'\nconst a = 1", "/r/api/src/__init__.py": "x", "/r/api/.hid/b.ts": "b", "/r/api/node_modules/c.ts": "c", "/r/api/a.spec.ts": "s",
            "/r/api/empty.ts": "", "/r/api/big.ts": "x" * 50_001, "/r/web/app.tsx": "t", "/r/web/readme.md": "# T\nbody", "/r/web/dist/x.md": "x", "/r/web/notes.TXT": "n", "/r/notes.txt": "plain",
            "/r/api/package.json": json.dumps({"dependencies": {"react": "1"}, "devDependencies": {"@nestjs/core": "2", "express": ""}}), "/r/web/tsconfig.json": "{}", "/r/bad/package.json": "{no",
            "/r/plain/package.json": "{}", "/r/.git/package.json": "{}", "/r/none/x.ts": "x", "/r/deep/in/package.json": "{}",
        },
    )


@pytest.fixture(scope="module")
def services(spark):
    return spark.createDataFrame([("api", "api", "NestJS", "r"), ("src", "./api/src/", "", ""), ("web", "web", "", "")], "name string, path string, framework string, role string")


def test_code_files(tree, services):
    listed = source_files.list_code(tree, services, "/r")
    loaded = {(r["serviceName"], r["relativePath"]): r for r in source_files.load_code(listed).collect()}
    assert set(loaded) == {("api", "api/src/a.service.ts"), ("src", "api/src/a.service.ts"), ("api", "api/src/__init__.py"), ("src", "api/src/__init__.py"), ("web", "web/app.tsx")}
    r = loaded["api", "api/src/a.service.ts"]
    assert (r["fileType"], r["language"], r["lineCount"], r["metadata"]["lastModified"]) == ("service", "typescript", 2, "2024-05-06T07:08:09.000Z")
    assert source_files.list_code(tree, services, "/r", service="web").count() == 1
    with pytest.raises(ValueError):
        source_files.list_code(tree, services, "/r", service="nope")


def test_documents_and_services(tree):
    docs = {r["relativePath"]: r["documentType"] for r in source_files.list_documents(tree, "/r").collect()}
    assert docs == {"web/readme.md": "markdown", "notes.txt": "text"}
    found = {r["name"]: (r["framework"], r["role"]) for r in source_files.detect_services(tree, "/r").collect()}
    assert found == {"api": ("NestJS", "백엔드 API"), "web": ("unknown", "service"), "bad": ("unknown", "service"), "plain": ("Node.js", "service")}


def test_opened(spark, tmp_path):
    (tmp_path / "_x.py").write_text("hi")
    paths = spark.createDataFrame([(str(tmp_path / "_x.py"), 2), (str(tmp_path / "no"), 1)], "path string, length long")
    assert [r["content"] for r in source_files.opened(paths).orderBy(F.desc("length")).collect()] == [bytearray(b"hi"), None]


def test_chunk_table_and_jobs(spark, tree, services, tmp_path):
    path = f"file://{tmp_path}/chunks"
    assert tables.read_chunks(spark, path).count() == 0
    tables.clear_chunks(spark, path)
    model = embedding.hashing_model(8)
    total = jobs.index_code(tree, services, "/r", path, model).first()
    # Files that are listed but not read (empty, too large) count as processed.
    assert (total["processedFiles"], total["chunks"]) == (5, 10)
    total, errors = jobs.index_documents(tree, "/r", path, model)
    assert tuple(total.first()) == (2, 2) and errors.count() == 0
    rows = tables.read_chunks(spark, path)
    assert rows.columns == [f.name for f in CHUNKS] and {r["chunkType"]: r["n"] for r in tables.count_chunks(rows).collect()} == {"code": 10, "document": 2}
    jobs.index_documents(tree, "/r", path, model, mode="append")
    assert tables.read_chunks(spark, path).count() == 14
    tables.clear_chunks(spark, path, "document")
    assert {r["chunkType"]: r["n"] for r in tables.count_chunks(tables.read_chunks(spark, path)).collect()} == {"code": 10, "document": 0}
    with pytest.raises(Exception, match="numbers"):
        tables.append_chunks(tables.read_chunks(spark, path), path, 9)


def test_embedding_is_made_once_per_text(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "c")], "id long, content string")
    got = {r["id"]: r["vector"] for r in embedding.embed(df, embedding.hashing_embedder(16), 16).collect()}
    assert got[1] == got[2] != got[4] and len(got[3]) == 16


def test_a_word_is_hashed_once(monkeypatch):
    """The test embedder's time goes by distinct words; its vectors are those of a hash for each word."""
    inner, asked = hashlib.md5, []
    monkeypatch.setattr(hashlib, "md5", lambda data: (asked.append(data), inner(data))[1])
    embed = embedding.hashing_embedder(8)()
    got = embed(np.array(["a b a A", "b  a\tb", "", "x"], object))
    assert asked == [b"a", b"b", b"x"]
    for text, vector in zip(["a b a a", "b a b", "", "x"], got, strict=True):
        want = np.zeros(8)
        for word in text.split():
            h = int.from_bytes(inner(word.encode()).digest()[:4])
            want[h % 8] += 1 if h >> 31 else -1
        assert np.allclose(vector, want / (np.linalg.norm(want) or 1))


def test_stream_in_batches(spark, tmp_path):
    folder, path = tmp_path / "in", f"file://{tmp_path}/out"
    os.makedirs(folder)
    for k in range(45):
        (folder / f"d{k}.txt").write_text(f"text {k}")

    def run():
        query = index_stream.index_stream(index_stream.document_stream(spark, f"file://{folder}"), path, f"file://{tmp_path}/cp", embedding.hashing_model(8))
        query.awaitTermination(120)
        return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]

    assert run() == [20, 20, 5] and tables.read_chunks(spark, path).count() == 45
    assert run() == [] and tables.read_chunks(spark, path).count() == 45
