"""Composite jobs: indexing, retrieval, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import analyse
from ..functions.text import token_estimate
from ..operators import chat, chunking, context, embedding, expand, rerank, search
from ..sources import files as source_files
from ..sources import tables
from ..storage import saved


def run_totals(listed: DataFrame, records: DataFrame) -> DataFrame:
    """(processedFiles, chunks): files listed, also those skipped, and chunks written."""
    n = listed.agg(F.countDistinct("path").alias("processedFiles"))
    return n.join(F.broadcast(records.agg(F.count("*").alias("chunks"))))  # one row each


def index_code(files: DataFrame, services: DataFrame, root: str, path: str, model: embedding.Model, size: int = chunking.CODE_SIZE, overlap: int = chunking.OVERLAP, mode: str = "overwrite", partitions: int | None = None) -> DataFrame:
    """Lists, loads, chunks and embeds code and writes it to the chunk table; returns the totals. Files
    that can't be read are skipped, as are those of another size."""
    tables.stamp(files.sparkSession, path, model.name, model.width)
    listed = source_files.list_code(files, services, root)
    chunks = saved(chunking.chunk_code(source_files.load_code(listed), size, overlap), "code-chunks")
    tables.append_chunks(chunking.code_records(model.embed(chunks, partitions=partitions)), path, model.width, mode)
    return run_totals(listed, tables.read_chunks(files.sparkSession, path).where("chunkType = 'code'"))


def index_documents(files: DataFrame, root: str, path: str, model: embedding.Model, pages: DataFrame | None = None, sheets: DataFrame | None = None, size: int = chunking.DOCUMENT_SIZE, overlap: int = chunking.OVERLAP, mode: str = "overwrite", partitions: int | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """The same for documents; texts are read from files, extracted pages and sheets are tables.
    Returns the totals and the documents that failed (name, source, message): those that can't be read, are
    empty or too large, or, with `strict`, are no UTF-8; the others are indexed. Files are read once."""
    tables.stamp(files.sparkSession, path, model.name, model.width)
    texts = source_files.document_texts(source_files.list_documents(files, root, any_size=True), strict)
    outcomes = saved(chunking.chunk_outcomes(texts, pages, sheets, size, overlap), "document-chunks")
    chunks, errors = chunking.split_outcomes(outcomes)
    tables.append_chunks(chunking.document_records(model.embed(chunks, partitions=partitions)), path, model.width, mode)
    listed = source_files.list_documents(files, root)
    return run_totals(listed, tables.read_chunks(files.sparkSession, path).where("chunkType = 'document'")), errors


def ask(questions: DataFrame, path: str, model: embedding.Model, services: list[str] | None = None, question: str = "question", **how) -> DataFrame:
    """Results of questions (query_id, question) in the chunk table at `path`, embedded by `model`. It is
    refused at once if the table's vectors are of another model."""
    tables.check_model(questions.sparkSession, path, model.name, model.width)
    chunks = tables.read_chunks(questions.sparkSession, path)
    return retrieve(saved(model.embed(questions, question), "asked"), chunks, services, question=question, **how)


#: Ids of the chunks whose texts are wanted are broadcast up to so many.
MAX_BROADCAST_IDS = 1 << 20
#: What a result has besides its text.
PAYLOAD = ["id", "filePath", "relativePath", "serviceName", "fileType", "symbolName", "startLine", "endLine", "chunkType"]


def texts_of(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, content) of the chunks of `hits` (id), each once; the other texts are left where they are read, as long as the ids
    are few enough to be broadcast."""
    wanted = hits.select("id").distinct()
    few = wanted.count() <= MAX_BROADCAST_IDS
    return chunks.select("id", "content").join(F.broadcast(wanted) if few else wanted, "id", "left_semi").dropDuplicates(["id"])


def found(analysis: DataFrame, chunks: DataFrame, limit: int = search.LIMIT, multiplier: int = search.MULTIPLIER, order: str = "lines", **keyword_options) -> DataFrame:
    """Results of every analysed question without their texts, but with their `cost` in tokens. Both are saved
    already: they are read several times."""
    hits = saved(search.hybrid_search(analysis, chunks, limit * multiplier, kept=True, **keyword_options).select("query_id", "id", "score", "rank"), "candidates")
    rows = chunks.withColumn("cost", token_estimate(F.col("content")))
    candidates = rerank.with_boost(hits.join(rows.select(*PAYLOAD, "cost"), "id"), analysis, texts_of(hits, chunks))
    best = saved(rerank.rerank(candidates, analysis, limit).drop("position"), "best")
    return expand.expand(best, rows.drop("content"), order)


def _read_often(queries: DataFrame, chunks: DataFrame, services: list[str] | None, question: str) -> tuple[DataFrame, DataFrame]:
    """The analysed questions and the chunks, saved."""
    return saved(analyse(queries, services, question), "analysed"), saved(chunks.select(*PAYLOAD, "content", "vector").sortWithinPartitions("id"), "searched")


def retrieve(queries: DataFrame, chunks: DataFrame, services: list[str] | None = None, limit: int = search.LIMIT, multiplier: int = search.MULTIPLIER, question: str = "question", order: str = "lines", **keyword_options) -> DataFrame:
    """Results of every question (query_id, question, vector): analysed, searched both ways, fused,
    reranked and expanded. Texts are read where candidates are reranked and joined to the results, not carried along."""
    analysis, chunks = _read_often(queries, chunks, services, question)
    results = saved(found(analysis, chunks, limit, multiplier, order, **keyword_options), "results")
    return results.drop("cost").join(texts_of(results, chunks), "id")


def prompts(queries: DataFrame, results: DataFrame, label: str | None = None, question: str = "question") -> DataFrame:
    return context.build_prompts(queries, context.assemble(results), label, question)


def asked_prompts(queries: DataFrame, chunks: DataFrame, services: list[str] | None = None, label: str | None = None, question: str = "question", **how) -> DataFrame:
    """`prompts` of what `retrieve` gives, but texts are joined only to the results that fit the budget."""
    analysis, chunks = _read_often(queries, chunks, services, question)
    fit = saved(context.within_budget(found(analysis, chunks, **how)), "contexts")
    contexts = fit.join(texts_of(fit, chunks), "id").select(*context.to_context(), "position", "tokens")
    return context.build_prompts(analysis.select("query_id", question), contexts, label, question)


def chat_prompts(messages: DataFrame, vectors: DataFrame, chunks: DataFrame, services: list[str] | None = None, label: str | None = None, **how) -> DataFrame:
    """(query_id, prompt) of every question in conversations: query_id is conv_id:turn; `vectors`
    (query_id, vector) are the questions' embeddings."""
    told = chat.histories(messages).withColumn("query_id", F.concat_ws(":", "conv_id", "turn"))
    queries = told.select("query_id", "question").join(vectors, "query_id")
    return chat.with_history(asked_prompts(queries, chunks, services, label, **how), told)
