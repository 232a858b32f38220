"""Registered queries of the reference's own operators, over the given tables, and their SQL.

Documents stand in for text files (source/doc_id.txt); benchmark texts for questions; embeddings for
chunk vectors (vec_id = doc_id) and, every twentieth, for question vectors; customers and orders for sheets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .functions import analysis, classify, extract
from .functions.text import js_trim
from .operators import chat, chunking, context, embedding, expand, rerank, search, vector_cells, word_index
from .plans import jobs
from .sources import files as source_files
from .sources import tables as chunk_tables
from .storage import saved, scratch
from .streaming import index_stream

SERVICES = sorted(f"src{k}" for k in range(20))
LABEL = "test data"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _texts(spark, d):
    return _t(spark, d, "documents").select(F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("source"), F.lit("text").alias("sourceType"), "text", "doc_id")


def _questions(spark, d):
    """(query_id, question) of every benchmark item; a service and at times a file type is named."""
    extra = F.concat(F.lit(" in src"), F.col("item_id") % 20, F.when(F.col("item_id") % 3 == 0, " module").otherwise(""))
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat("text", extra).alias("question"))


def _markdown(spark, d):
    """Every document as markdown: a heading at each line break, and a title, none or a lower heading before."""
    i = F.col("doc_id")
    first = F.when(i % 3 == 0, F.concat(F.lit("# "), "source", F.lit("  \n"))).when(i % 3 == 1, "").otherwise("## Sub\n")
    text = F.concat(first, F.replace("text", F.lit("\n"), F.concat(F.lit("\n## Part "), "lang", F.lit(" \n"))))
    return _t(spark, d, "documents").select(F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("source"), F.lit("markdown").alias("sourceType"), text.alias("text"))


def _sheets(spark, d):
    """Customers as sheets by market segment; the values need quoting; every two hundredth is on a sheet without text."""
    k = F.col("c_custkey")
    note = F.concat(F.lit(' "'), F.substring("c_name", 10, 20), F.lit('", '), "c_mktsegment", F.lit(" "))
    rows = _t(spark, d, "customer").select(F.lit("customers.xlsx").alias("file"), F.when(k % 200 == 7, "EMPTY").otherwise(F.col("c_mktsegment")).alias("segment"), k.alias("place"), F.when(k % 200 != 7, k).alias("key"), F.when(k % 200 != 7, note).alias("note"))
    return chunking.sheet_texts(rows.withColumn("none", F.lit(None).cast("string")), "file", "segment", ["place"], ["none", "key", "note"]), rows


def _chunks(spark, d):
    """One chunk for each document, with its vector if it has one: code for even ids, documents for odd."""
    docs, vectors = _t(spark, d, "documents"), _t(spark, d, "embeddings")
    i = F.col("doc_id")
    return docs.join(vectors, docs["doc_id"] == vectors["vec_id"], "left").select(
        i.cast("string").alias("id"), F.col("text").alias("content"), F.col("embedding").alias("vector"),
        F.when(i % 2 == 0, "code").otherwise("document").alias("chunkType"),
        F.concat("source", F.lit("/f"), F.floor(i / 40), F.lit(".ts")).alias("filePath"), F.concat("source", F.lit("/f"), F.floor(i / 40), F.lit(".ts")).alias("relativePath"),
        F.when(i % 2 == 0, F.col("source")).otherwise("").alias("serviceName"), F.col("lang").alias("fileType"), F.lit("").alias("language"),
        F.lit("").alias("symbolName"), F.lit("text").alias("level"), ((i % 40) * 7 + 1).cast("int").alias("startLine"), ((i % 40) * 7 + 7).cast("int").alias("endLine"),
    )


def _queries(spark, d):
    """Questions with vectors: every twentieth embedding, with the texts of the benchmark in turn."""
    items = _t(spark, d, "benchmark").agg(F.count("*").alias("items"))  # one row
    q = _t(spark, d, "embeddings").where("vec_id % 20 = 0").crossJoin(F.broadcast(items))
    q = q.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), (F.floor(F.col("vec_id") / 20) % F.col("items")).alias("item"))
    return q.join(_questions(spark, d).withColumnRenamed("query_id", "item"), "item").select("query_id", "vector", "question")


def _analysed(spark, d):
    return analysis.analyse(_queries(spark, d), SERVICES)


def _inventory(spark, d):
    """Documents as an inventory of files."""
    docs = _t(spark, d, "documents")
    i = F.col("doc_id")
    code = F.concat(F.lit("import { X } from './x"), i, F.lit("'\nexport class K"), i, F.lit(" {}\n"), "text")
    docs = docs.withColumn("text", F.when(i % 3 == 0, code).otherwise(F.col("text")))
    return docs.select(
        F.concat(F.lit("/data/"), "source", F.when(i % 11 == 5, "/node_modules/").otherwise("/"), "lang", F.lit("/"), "doc_id", F.when(F.col("doc_id") % 3 == 0, ".service.ts").when(F.col("doc_id") % 3 == 1, ".txt").otherwise(".md")).alias("path"),
        F.timestamp_seconds(F.col("doc_id") + 1_700_000_000).alias("modificationTime"), F.octet_length("text").cast("long").alias("length"), F.encode("text", "UTF-8").alias("content"),
    )


def _tree(spark, d):
    """Every document as a file of a source tree, of many kinds: in nested services, in folders that are
    left out, tests and declarations, damaged, larger than a code file may be, empty, not to be read."""
    i, lit = F.col("doc_id"), F.lit
    one_of = lambda *names: F.element_at(F.array(*map(lit, names)), (i % len(names) + 1).cast("int"))
    folder = one_of("src/", "lib/deep/", "node_modules/x/", "", "api/", ".hid/", "api/dist/")
    ending = one_of(".service.ts", ".tsx", ".py", ".spec.ts", ".go", ".d.ts", ".md", ".txt", ".controller.js", ".pdf", ".rs")
    path = F.concat(lit("/data/"), "source", lit("/"), "lang", lit("/"), folder, lit("f"), i, ending)
    content = F.encode("text", "UTF-8")
    content = F.when(i % 13 == 1, F.concat(content, lit(b"\xff."))).when(i % 13 == 2, F.concat(lit(b"a\xc3 "), content)).when(i % 13 == 3, None).when(i % 13 == 4, lit(b"")).otherwise(content)
    length = F.when(i % 13 == 3, 7).when(i % 13 == 5, 10 * 1024 * 1024 + 1).otherwise(F.octet_length("content"))
    docs = _t(spark, d, "documents").withColumn("path", path).withColumn("content", content)
    return docs.select("path", F.timestamp_seconds(i).alias("modificationTime"), length.cast("long").alias("length"), "content")


def _nested_services(spark, d):
    """A service for the whole tree, one for each source, one for each source and language, and in some an inner one."""
    docs = _t(spark, d, "documents").select("source", "lang").distinct()
    paths = [F.lit("."), F.col("source"), F.concat(F.lit("./"), "source", F.lit("/"), "lang", F.lit("/")), F.concat_ws("/", "source", "lang", F.lit("api"))]
    made = docs.select(F.explode(F.array(*paths)).alias("path")).distinct()
    return made.select(F.concat(F.lit("s:"), "path").alias("name"), "path", F.lit("NestJS").alias("framework"), F.lit("api").alias("role"))


def _services(spark):
    return spark.createDataFrame([(s, s, "NestJS", "api") for s in SERVICES], "name string, path string, framework string, role string")


# --- queries -----------------------------------------------------------------------------------


def document_chunks(spark, d):
    """Every document cut into pieces, as chunk records."""
    return chunking.document_records(chunking.chunk_documents(_texts(spark, d))[0])


def code_windows(spark, d):
    """Line windows of 4 lines with one of overlap."""
    files = _t(spark, d, "documents").select(F.concat("source", F.lit("/"), "doc_id").alias("filePath"), F.concat("source", F.lit("/"), "doc_id").alias("relativePath"), F.col("source").alias("serviceName"), F.col("lang").alias("fileType"), F.lit("").alias("language"), F.col("text").alias("content"))
    return chunking.code_records(chunking.chunk_code(files, 320, 80))


def page_chunks(spark, d):
    """K6, K7: texts as three pages each."""
    docs = _texts(spark, d).select("source", "text", F.lit(3).alias("pageCount"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("author"))
    out = chunking.chunk_pages(docs)
    return out.select("id", "content", "source", "page", "index", F.element_at("metadata", "totalPages").alias("total_pages"))


def sheet_chunks(spark, d):
    """A sheet per market segment."""
    return chunking.chunk_sheets(_sheets(spark, d)[0]).select("id", "content", "source", "sheet", F.element_at("metadata", "rowCount").alias("row_count"), F.element_at("metadata", "totalSheets").alias("total_sheets"))


def sheet_caps(spark, d):
    """Sheets by order status, cut to the row limit of a sheet."""
    sheets = chunking.sheet_texts(_t(spark, d, "orders").withColumn("file", F.lit("orders")), "file", "o_orderstatus", ["o_orderkey"], ["o_orderkey"])
    return sheets.select("sheetName", "rowCount", "content")


def document_totals(spark, d):
    """Sections and titles of each document, as plain text and as markdown."""
    return chunking.document_totals(_texts(spark, d).drop("doc_id").unionByName(_markdown(spark, d)))


def part_totals(spark, d):
    """Pages of each document, and sheets of the workbook."""
    docs = _texts(spark, d).select("source", F.concat("text", F.lit("\f \f"), F.when(F.col("doc_id") % 2 == 0, "end").otherwise("")).alias("text"), F.lit(3).alias("pageCount"))
    pages = chunking.page_totals(docs).select("source", F.col("pages").cast("long").alias("parts"), F.col("totalPages").cast("long").alias("total"))
    return pages.unionByName(chunking.sheet_totals(_sheets(spark, d)[0]).select("source", F.col("sheets").alias("parts"), F.col("totalSheets").cast("long").alias("total")))


def markdown_chunks(spark, d):
    """K4, K9, P10: every document as markdown, cut into sections and pieces."""
    held = [F.element_at("metadata", c).alias(n) for c, n in (("heading", "level"), ("headingLevel", "heading_level"), ("sectionCount", "section_count"))]
    return chunking.chunk_sections(_markdown(spark, d)).select("id", "content", F.col("source").alias("filePath"), F.col("sourceType").alias("fileType"), *held)


def all_documents(spark, d):
    """Chunks of texts, markdown, pages and sheets in one table."""
    pages = _texts(spark, d).select("source", "text", F.lit(2).alias("pageCount"), F.lit("t").alias("title"), F.lit("a").alias("author"))
    texts = _texts(spark, d).drop("doc_id").unionByName(_markdown(spark, d))
    chunks, _ = chunking.chunk_documents(texts, pages, _sheets(spark, d)[0])
    return chunks.groupBy("sourceType").agg(F.count("*").alias("chunks"), F.countDistinct("source").alias("sources"), F.sum(F.length("content")).alias("characters"))


def classified_paths(spark, d):
    """Type, language, name of made-up paths of every document."""
    names = [".controller.ts", ".service.ts", ".module.tsx", ".entity.py", ".dto.go", "/components/a.jsx", "/pages/b.java", "/hooks/c.rs", "/utils/d.rb", "/models/e.php", "/routes/f.kt", ".spec.cs", ".config.cpp", ".md", ".xlsx", ".pdf"]
    ending = F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % len(names) + 1).cast("int"))
    path = F.concat(F.lit("/srv/"), "source", F.lit("/"), "doc_id", ending)
    docs = _t(spark, d, "documents").withColumn("path", path)
    rel = classify.relative_path(F.col("path"), "/srv")
    return docs.select("doc_id", rel.alias("relative"), classify.file_name(F.col("path")).alias("name"), classify.file_type(rel).alias("file_type"), classify.language(rel).alias("language"), classify.document_type(rel).alias("document_type"))


def question_analysis(spark, d):
    """Q1-Q6 of every benchmark item."""
    out = analysis.analyse(_questions(spark, d), SERVICES)
    return out.select("query_id", F.array_join("keywords", " ").alias("keywords"), F.array_join("entityNames", " ").alias("entity_names"), F.col("serviceFilter").alias("service_filter"), F.col("fileTypeFilter").alias("file_type_filter"), F.col("isArchitectural").alias("is_architectural"))


def trimmed(spark, d):
    """every document trimmed, by its hash."""
    return _t(spark, d, "documents").select("doc_id", F.sha2(js_trim(F.concat(F.lit(" \t\n"), "text", F.lit("\n \r"))), 256).alias("sha"))


def keyword_search(spark, d):
    """Keyword search of all chunks for all benchmark items."""
    chunks = document_chunks(spark, d).select("id", "content", "chunkType")
    questions = analysis.analyse(_questions(spark, d), SERVICES)
    out = search.keyword_hits(questions, chunks, 18)
    return out.select("query_id", "id", "occurrences", F.round("score", 6).alias("score"), "rank")


def semantic_search(spark, d):
    """Nearest chunks of every question vector."""
    out = search.nearest(_queries(spark, d), _chunks(spark, d), 18)
    return out.select("query_id", "id", "distance", F.round(search.semantic_score(F.col("distance")), 6).alias("score"), "rank")


def nearest_by_cells(spark, d):
    """Nearest chunks of every question vector, from cells around pivots, blocks that can't hold any being skipped."""
    path = scratch(spark, "cells")
    vector_cells.build(_chunks(spark, d), path)
    out = vector_cells.nearest_in_cells(_queries(spark, d), spark, path, 18)
    return out.select("query_id", "id", "distance", F.round(search.semantic_score(F.col("distance")), 6).alias("score"), "rank")


def merged_hits(spark, d):
    """Hits among code and among documents in one list."""
    chunks, queries = _chunks(spark, d), _queries(spark, d)
    code, docs = (search.nearest(queries, chunks.where(F.col("chunkType") == k), 10) for k in chunk_tables.KINDS)
    return search.merged_by_distance(code, docs, 10).select("query_id", "id", "distance", "rank")


def search_results(spark, d):
    """Hits as results with nested metadata."""
    chunks = _chunks(spark, d)
    hits = search.nearest(_queries(spark, d), chunks, 5).withColumn("score", F.round(search.semantic_score(F.col("distance")), 6))
    out = search.results(hits, chunks)
    return out.select("query_id", "rank", "id", F.sha2("content", 256).alias("sha"), "score", "metadata.relativePath", "metadata.chunkType", "metadata.startLine", "metadata.endLine", "metadata.level", "filePath", "serviceName", "fileType", "symbolName")


def indexed_keywords(spark, d):
    """Keyword search through an index of words, for questions of long words of every
    document, mostly rare, and for those of the benchmark, which are scanned for."""
    path = scratch(spark, "index")
    word_index.build(document_chunks(spark, d).select("id", "content", "chunkType"), path)
    long = F.array_distinct(F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{11,}"), F.lit(0)), 1, 3))
    rare = _t(spark, d, "documents").select(F.col("doc_id").alias("query_id"), long.alias("keywords"))
    asked = analysis.analyse(_questions(spark, d), SERVICES).select((-1 - F.col("query_id")).alias("query_id"), "keywords")
    out = word_index.indexed_keyword_hits(rare.unionByName(asked), spark, path, 18)
    return out.select("query_id", "id", "occurrences", F.round("score", 6).alias("score"), "rank")


def keyword_parity(spark, d):
    """J2 as the reference has it: LIKE minds case, documents without any keyword are let in."""
    out = search.keyword_hits(_analysed(spark, d), _chunks(spark, d), 18, match="like", keyword_filter_documents=False, filtered=True)
    return out.select("query_id", "id", "occurrences", F.round("score", 6).alias("score"), "rank")


def _scaled(spark, d):
    """Chunks with vectors of different norms: each is 1, 2 or 4 times as long."""
    factor = F.element_at(F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0)), (F.col("id").cast("int") % 3 + 1)).cast("float")
    return _chunks(spark, d).where("vector is not null").withColumn("vector", F.transform("vector", lambda x: x * factor))


def keyword_capped(spark, d):
    """T2, J2 as the reference has it: of the chunks with a keyword, the 54 of least norm are scored."""
    out = search.keyword_hits(_analysed(spark, d), _scaled(spark, d), 18, candidate_cap=54)
    return out.select("query_id", "id", "occurrences", F.round("score", 6).alias("score"), "rank")


def expanded_by_norm(spark, d):
    """R5, W5 as the reference has it: the neighbours of least norm."""
    chunks = _scaled(spark, d)
    base = search.nearest(_queries(spark, d), chunks, 6).join(chunks.drop("vector", "content"), "id")
    base = base.withColumn("score", F.round(search.semantic_score(F.col("distance")), 6)).drop("distance", "vector")
    return expand.expand(base, chunks, "norm").select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def hybrid_search(spark, d):
    """Both searches fused."""
    out = search.hybrid_search(_analysed(spark, d), _chunks(spark, d))
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "rank", "semantic_rank", "keyword_rank")


def reranked(spark, d):
    """Fused candidates reranked."""
    analysed, chunks = _analysed(spark, d), _chunks(spark, d)
    found = search.hybrid_search(analysed, chunks).select("query_id", "id", "score", "rank")
    best = rerank.rerank(found.join(chunks.select("id", "content", "serviceName", "fileType"), "id"), analysed)
    return best.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def expanded(spark, d):
    """The nearest six chunks and their neighbours."""
    chunks = _chunks(spark, d)
    base = search.nearest(_queries(spark, d), chunks, 6).join(chunks.drop("vector", "content"), "id")
    base = base.withColumn("score", F.round(search.semantic_score(F.col("distance")), 6)).drop("distance", "vector")
    return expand.expand(base, chunks).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def retrieved(spark, d):
    """The whole retrieval."""
    return jobs.retrieve(_queries(spark, d), _chunks(spark, d), SERVICES).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def assembled(spark, d):
    """Contexts within the budget."""
    out = context.assemble(jobs.retrieve(_queries(spark, d), _chunks(spark, d), SERVICES))
    return out.select("query_id", "position", "tokens", "filePath", "serviceName", "fileType", F.round("score", 6).alias("score"), "chunkType")


def rag_prompts(spark, d):
    """Prompts of all questions, by their hash."""
    out = jobs.asked_prompts(_queries(spark, d), _chunks(spark, d), SERVICES, LABEL)
    return out.select("query_id", F.length("prompt").alias("n"), F.sha2("prompt", 256).alias("sha"))


def minimum_slice(spark, d):
    """Documents chunked, searched by keyword for every benchmark item, packed into prompts. Chunks are
    saved, since they are read twice."""
    chunks = saved(document_chunks(spark, d), "chunks")
    questions = analysis.analyse(_questions(spark, d), SERVICES)
    hits = search.keyword_hits(questions, chunks.select("id", "content", "chunkType"), 18)
    results = hits.withColumn("score", F.round("score", 6)).join(chunks, "id")
    out = context.build_prompts(questions, context.assemble(results), LABEL)
    return out.select("query_id", F.length("prompt").alias("n"), F.sha2("prompt", 256).alias("sha"))


def chat_histories(spark, d):
    """Recent messages before every question."""
    return chat.histories(_t(spark, d, "conversations"))


def chat_prompts(spark, d):
    """Prompts of every question in conversations."""
    messages = _t(spark, d, "conversations")
    asked = messages.where("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), (F.col("conv_id") * 31 + F.col("turn")).alias("k"))
    vectors = _t(spark, d, "embeddings")
    asked = asked.crossJoin(F.broadcast(vectors.agg(F.count("*").alias("n")))).withColumn("vec_id", F.col("k") % F.col("n"))  # one row
    vectors = asked.join(vectors, "vec_id").select("query_id", F.col("embedding").alias("vector"))
    out = jobs.chat_prompts(messages, vectors, _chunks(spark, d), SERVICES, LABEL)
    return out.select("query_id", F.length("prompt").alias("n"), F.sha2("prompt", 256).alias("sha"))


def chunk_counts(spark, d):
    """Rows of both kinds."""
    return chunk_tables.count_chunks(_chunks(spark, d))


def service_files(spark, d):
    """Code files of all services, loaded."""
    listed = source_files.list_code(_inventory(spark, d), _services(spark), "/data")
    out = source_files.load_code(listed)
    return out.select("filePath", "relativePath", "serviceName", "fileType", "language", F.col("lineCount").alias("line_count"), "metadata.lastModified", "metadata.size")


def listed_documents(spark, d):
    """Documents of the inventory."""
    return source_files.list_documents(_inventory(spark, d), "/data").select("relativePath", "documentType", "fileName", "sizeBytes")


def file_chunks(spark, d):
    """Summaries and windows of the inventory's code files."""
    loaded = source_files.load_code(source_files.list_code(_inventory(spark, d), _services(spark), "/data"))
    return chunking.code_records(chunking.chunk_code(loaded))


def indexed_documents(spark, d):
    """All documents chunked, embedded and written; run totals."""
    return jobs.index_documents(_inventory(spark, d), "/data", scratch(spark, "chunks"), embedding.hashing_model(64))[0]


def indexed_code(spark, d):
    """The same for the inventory's code files."""
    return jobs.index_code(_inventory(spark, d), _services(spark), "/data", scratch(spark, "chunks"), embedding.hashing_model(64))


def detected_services(spark, d):
    """Services of a tree whose manifests are made from every document's source and language."""
    dependency = F.when(F.col("lang") == "en", "@nestjs/core").when(F.col("lang") == "fr", "react").when(F.col("lang") == "de", "express").otherwise("other")
    part = F.when(F.col("doc_id") % 2 == 0, "dependencies").otherwise("devDependencies")
    manifest = F.concat(F.lit('{"name":"'), F.lpad(F.col("doc_id") % 1000, 3, "0"), F.lit('","'), part, F.lit('":{"'), dependency, F.lit('":"1"}}'))
    files = _t(spark, d, "documents").select(F.concat(F.lit("/r/"), "source", F.lit("/package.json")).alias("path"), F.encode(manifest, "UTF-8").alias("content"))
    return source_files.detect_services(files, "/r")


def system_prompts(spark, d):
    """a system prompt for each language, the sources of its documents standing for services."""
    docs = _t(spark, d, "documents")
    services = docs.groupBy(F.col("lang").alias("project"), F.col("source").alias("name")).agg(F.min("doc_id").alias("position"))
    services = services.withColumns({"framework": F.lit("NestJS"), "role": F.lit("api")})
    projects = docs.groupBy(F.col("lang").alias("project")).agg(F.concat(F.lit("Texts: "), F.count("*"), F.lit(".")).alias("description"))
    projects = projects.withColumns({"systemContext": F.lit(None).cast("string"), "guidelines": F.array(F.lit("Be brief."))})
    return context.system_prompts(projects, services)


def streamed_chunks(spark, d):
    """ST1: all documents read as a stream, chunked, embedded and appended batch by batch."""
    docs = _t(spark, d, "documents")
    folder = scratch(spark, "incoming")  # a folder of 45 files, since a single file can't be streamed
    docs.repartition(45).write.parquet(folder)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", index_stream.FILES_PER_BATCH).parquet(folder)
    files = stream.select(F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    path = scratch(spark, "chunks")
    index_stream.index_stream(files, path, scratch(spark, "stream"), embedding.hashing_model(64)).awaitTermination()
    return chunk_tables.read_chunks(spark, path).drop("vector")


def embedded_chunks(spark, d):
    """Every chunk with a vector of the test embedder: its length, how many numbers are not 0, and where the greatest is."""
    out = embedding.embed(document_chunks(spark, d).select("id", "content", "filePath", "startLine"), embedding.hashing_embedder(64), 64)
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    some = F.size(F.filter("vector", lambda x: x != 0))
    return out.select("id", "filePath", F.size("vector").alias("width"), F.round(square, 3).alias("square"), some.alias("filled"), F.array_position("vector", F.array_max("vector")).cast("int").alias("greatest"))


def chunk_table(spark, d):
    """Chunks appended twice to the chunk table, of which the code is cleared in between; what is left."""
    empty = F.array_repeat(F.lit(0.0).cast("float"), 64)
    path, rows = scratch(spark, "chunks"), _chunks(spark, d).withColumn("vector", F.coalesce("vector", empty))
    chunk_tables.append_chunks(rows, path, 64)
    chunk_tables.clear_chunks(spark, path, "code")
    chunk_tables.append_chunks(rows.where("chunkType = 'code' and startLine < 100"), path, 64)
    return chunk_tables.read_chunks(spark, path).select("id", "filePath", "chunkType", "startLine", F.size("vector").alias("width"))


def paired_vectors(spark, d):
    """Documents with their precomputed vectors."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    out = embedding.paired(docs, _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
    return out.select("id", "lang", F.size("vector").alias("width"), F.round(F.element_at("vector", 1).cast("double"), 5).alias("first"))


def code_tree(spark, d):
    """Code files of nested services, damaged ones read leniently, others left out."""
    loaded = source_files.load_code(source_files.list_code(_tree(spark, d), _nested_services(spark, d), "/data"))
    return loaded.select("serviceName", "relativePath", "fileType", "language", F.col("lineCount").alias("line_count"), "metadata.size", F.sha2("content", 256).alias("sha"))


def failed_documents(spark, d):
    """Every good chunk and a row for each file that failed, read leniently and strictly;
    services told from manifests of which some are damaged or not to be read."""
    out = []
    for mode, strict in (("lenient", False), ("strict", True)):
        texts = source_files.document_texts(source_files.list_documents(_tree(spark, d), "/data", any_size=True), strict)
        chunks, errors = chunking.split_outcomes(saved(chunking.chunk_outcomes(texts), "outcomes"))
        good = chunks.select(F.lit(mode).alias("mode"), "source", "id", F.sha2("content", 256).alias("sha"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("message"))
        out += [good, errors.select(F.lit(mode).alias("mode"), "source", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("sha"), "name", "message")]
    manifests = _t(spark, d, "documents").select(
        F.concat(F.lit("/r/d"), "doc_id", F.lit("/package.json")).alias("path"),
        F.when(F.col("doc_id") % 4 == 0, None).when(F.col("doc_id") % 4 == 1, F.concat(F.lit(b'{"dependencies":{"vue":"1"},"x":"\xff"'), F.encode(F.when(F.col("doc_id") % 8 == 1, "}").otherwise(""), "UTF-8"))).otherwise(F.encode(F.lit('{"devDependencies":{"next":"1"}}'), "UTF-8")).alias("content"),
    )
    services = source_files.detect_services(manifests, "/r")
    out.append(services.select(F.lit("service").alias("mode"), F.col("path").alias("source"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("sha"), "name", F.col("framework").alias("message")))
    every = out[0]
    for part in out[1:]:
        every = every.unionByName(part)
    return every


def streamed_files(spark, d):
    """ST1: code and documents of a tree read as a stream, each batch written twice, as after a crash; chunks
    and failed files."""
    folder, path = scratch(spark, "incoming"), scratch(spark, "chunks")
    files = _tree(spark, d)
    files.repartition(45, "path").write.parquet(folder)
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", index_stream.FILES_PER_BATCH).parquet(folder)
    write = index_stream.batch_writer(path, embedding.hashing_model(64), services=_nested_services(spark, d), root="/data")

    def twice(batch, number):
        write(batch, number)
        write(batch, number)

    stream.writeStream.foreachBatch(twice).option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    chunks = chunk_tables.read_chunks(spark, path).select("chunkType", F.col("filePath").alias("source"), "serviceName", "id", F.sha2("content", 256).alias("told"))
    failed = index_stream.errors_of(spark, path).select(F.lit("error").alias("chunkType"), "source", F.lit(None).cast("string").alias("serviceName"), F.col("name").alias("id"), F.col("message").alias("told"))
    return chunks.unionByName(failed)


def asked_results(spark, d):
    """Documents indexed by a model, questions embedded by the same, from text to results."""
    files = _t(spark, d, "documents").select(F.concat(F.lit("/data/"), "source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.lit(None).cast("timestamp").alias("modificationTime"), F.octet_length("text").cast("long").alias("length"), F.encode("text", "UTF-8").alias("content"))
    path, model = scratch(spark, "chunks"), embedding.hashing_model(64)
    jobs.index_documents(files, "/", path, model)
    out = jobs.ask(_questions(spark, d), path, model, SERVICES)
    return out.select("query_id", "id", "filePath", F.round("score", 6).alias("score"), "rank")


def capped_sheets(spark, d):
    """Order lines as sheets by return flag, most of which have more rows than a sheet keeps."""
    rows = _t(spark, d, "lineitem").withColumn("file", F.lit("lines"))
    sheets = chunking.sheet_texts(rows, "file", "l_returnflag", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return sheets.select("sheetName", "rowCount", "totalSheets", F.sha2("content", 256).alias("sha"))


def service_filters(spark, d):
    """Q4: the service that each question names, out of a table of as many services as there are documents;
    full names with loose hyphens come before what follows a hyphen."""
    docs = _t(spark, d, "documents")
    services = docs.select(F.concat_ws("-", F.concat(F.lit("app"), "doc_id"), "lang").alias("name"), F.col("doc_id").alias("place"))
    i = F.col("item_id")
    named = F.when(i % 4 == 0, F.concat(F.lit(" of APP"), i, F.lit(" en"))).when(i % 4 == 1, F.concat(F.lit(" of app"), i, F.lit("-de?"))).when(i % 4 == 2, F.concat(F.lit(" of app"), i * 3, F.lit("fr"))).otherwise("")
    questions = _t(spark, d, "benchmark").select(i.alias("query_id"), F.concat("text", named).alias("question"))
    return analysis.with_service_filter(questions, services).select("query_id", F.col("serviceFilter").alias("service"))


def cleared_histories(spark, d):
    """Histories where every eleventh message of a user is `clear`."""
    messages = _t(spark, d, "conversations")
    clear = (F.col("role") == "user") & ((F.col("conv_id") + 3 * F.col("turn")) % 11 == 6)
    return chat.histories(messages.withColumn("text", F.when(clear, " Clear ").otherwise(F.col("text"))))


def table_states(spark, d):
    """Rows of both kinds where no table is, after an append, and after one kind is cleared."""
    path, empty = scratch(spark, "chunks"), F.array_repeat(F.lit(0.0).cast("float"), 64)
    rows = _chunks(spark, d).withColumn("vector", F.coalesce("vector", empty))
    counted = lambda state: saved(chunk_tables.count_chunks(chunk_tables.read_chunks(spark, path)).withColumn("state", F.lit(state)), "counts")
    absent = counted("absent")
    chunk_tables.append_chunks(rows, path, 64)
    filled = counted("filled")
    chunk_tables.clear_chunks(spark, path, "code")
    return absent.unionByName(filled).unionByName(counted("cleared"))


def _sources(spark, d):
    """Source files of each kind, made from every document's fields and followed by its text; a fifth are the
    texts alone."""
    i, lit = F.col("doc_id"), F.lit
    controller = F.concat(
        lit("import { A } from './m"), i, lit("'\nimport B from \"b"), i % 3, lit("\"\n@Controller('"), "source", lit("')\nexport class C"), i, lit(" {\n  constructor(private a: A"), i % 7,
        lit(", readonly b: B) {}\n  @Get('"), "lang", lit("')\n  @UseGuards(G1, G"), i % 4, lit(")\n  list() {}\n  @UseInterceptors(I"), i % 2, lit(")\n  @Post()\n  async make() {}\n}\n"),
    )
    entity = F.concat(
        lit("@Entity('e"), i, lit("')\nexport class E"), i, lit(" {\n  @ManyToOne(() => User, (u) => u.items"), i % 3,
        lit(") @JoinColumn()\n  user: User;\n  @OneToOne(() => P"), i % 2, lit(")\n  p: P;\n}\n"),
    )
    module = F.concat(lit("import X from 'x'\n@Module({\n imports: [A"), i % 3, lit(", B.forRoot({ a: [1] }), C(D)],\n})\nexport class M"), i, lit(" {}\n"))
    service = F.concat(
        lit("import { Q } from 'q"), i % 5, lit("'\n@Injectable()\nexport class S"), i, lit(" {\n  constructor(private readonly repo: Repo"), i % 3,
        lit(", public readonly x: X) {}\n  async run() {}\n}\n"),
    )
    plain = F.when(i % 2 == 1, F.concat(lit("custom "), i, lit("\n"))).otherwise(lit(""))
    made = F.when(i % 5 == 0, controller).when(i % 5 == 1, entity).when(i % 5 == 2, module).when(i % 5 == 3, service).otherwise(plain)
    content = F.concat(made, F.col("text"))
    files = _t(spark, d, "documents").select("doc_id", content.alias("content"), F.col("source").alias("serviceName"), F.col("lang").alias("fileType"), lit("typescript").alias("language"))
    return files.withColumn("lineCount", F.size(F.split("content", "\n")))


def framework_metadata(spark, d):
    """X1-X12, and a further plug-in: source files analysed, every field of the result."""

    def custom(content):
        inner = extract.framework_of(content)
        return F.struct(F.array(F.lit("custom")).alias("moduleImports"), *[inner[c].alias(c) for c in ("controllerRoutes", "entityRelations", "injectableDeps", "decorators")])

    out = extract.with_framework(_sources(spark, d), [("custom", lambda c: c.startswith("custom "), custom)])
    joined = lambda x: F.array_join(x, ",")
    route = lambda r: F.concat_ws(" ", r["method"], r["path"], r["handlerName"], joined(r["guards"]), joined(r["interceptors"]))
    relation = lambda r: F.concat_ws(" ", r["type"], r["target"], F.coalesce(r["inverseSide"], F.lit("-")), r["joinColumn"].cast("string"))
    seen = lambda r: F.concat(r["name"], F.lit("("), joined(r["args"]), F.lit(") "), r["target"])
    f, c = F.col("framework"), F.col("content")
    return out.select(
        "doc_id", "plugin", "hasFramework", "role", "summary", joined(extract.imports(c)).alias("imports"), joined(extract.exports(c)).alias("exports"), joined(extract.decorators(c)).alias("decorators"),
        joined(f["moduleImports"]).alias("modules"), F.array_join(F.transform(f["controllerRoutes"], route), ";").alias("routes"),
        F.array_join(F.transform(f["entityRelations"], relation), ";").alias("relations"), joined(f["injectableDeps"]).alias("deps"),
        F.array_join(F.transform(f["decorators"], seen), ";").alias("occurrences"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        minimum_slice, document_chunks, code_windows, page_chunks, sheet_chunks, sheet_caps, document_totals, classified_paths, question_analysis, trimmed,
        keyword_search, semantic_search, merged_hits, hybrid_search, reranked, expanded, retrieved, assembled, rag_prompts, chat_histories, chat_prompts,
        chunk_counts, service_files, listed_documents, file_chunks, indexed_documents, indexed_code, embedded_chunks, paired_vectors, framework_metadata,
        detected_services, system_prompts, streamed_chunks, part_totals, markdown_chunks, all_documents, search_results, keyword_parity, chunk_table,
        failed_documents, code_tree, streamed_files, asked_results, capped_sheets, service_filters, indexed_keywords, nearest_by_cells, keyword_capped, expanded_by_norm, cleared_histories, table_states,
    )
}
ORACLE: dict[str, str] = oracle.statements(SERVICES, LABEL)
