"""Context within a token budget, and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import percent, token_estimate

TOKENS, CHUNKS = 6000, 8
LABEL = "knowledge base"

# The texts of a prompt.
CONTEXT_HEAD, QUESTION_HEAD, INSTRUCTIONS_HEAD = "## Context", "## Question", "## Instructions"
CONTEXT_LINE = "The following code snippets and documents are retrieved from the %s:"
INSTRUCTIONS = [
    "Answer the question based on the provided context above.",
    "Cite the relevant file paths (e.g., [1] src/user/user.service.ts) when referencing code.",
    "If the context does not contain enough information, clearly state the limitation.",
]
NAMED_INTRO, PLAIN_INTRO = "You are an expert assistant for %s.", "You are an expert code and document assistant."
SERVICES_HEAD, GUIDELINES_HEAD = "프로젝트 서비스 구성:", "Guidelines:"


def to_context() -> list[Column]:
    """Columns of a context of a result row; what is missing is 'unknown'."""
    unknown = F.lit("unknown")
    return [
        F.col("query_id"),
        F.col("content"),
        F.coalesce("filePath", unknown).alias("filePath"),
        F.coalesce("serviceName", unknown).alias("serviceName"),
        F.coalesce("fileType", unknown).alias("fileType"),
        F.col("score"),
        F.when(F.col("chunkType") == "document", "document").otherwise("code").alias("chunkType"),
        F.col("startLine"),
    ]


def within_budget(results: DataFrame, tokens: int = TOKENS, chunks: int = CHUNKS) -> DataFrame:
    """Of the results (query_id, score, rank, cost ...) of each question, best first (ties by rank), those up
    to the first that overflows the budget, and `chunks` at most; `position` counts them from 1, `tokens`
    is the cost up to each."""
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    spent = F.sum("cost").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = results.withColumn("position", F.row_number().over(by)).withColumn("tokens", spent)
    return kept.where((F.col("tokens") <= tokens) & (F.col("position") <= chunks))


def assemble(results: DataFrame, tokens: int = TOKENS, chunks: int = CHUNKS) -> DataFrame:
    """Contexts of each question, best first (ties by rank), up to the first chunk that overflows the
    budget and `chunks` at most; `position` counts them from 1."""
    return within_budget(results.withColumn("cost", token_estimate(F.col("content"))), tokens, chunks).select(*to_context(), "position", "tokens")


def header() -> Column:
    document = F.col("chunkType") == "document"
    page = F.when(F.col("startLine") > 0, F.concat(F.lit(", page "), F.col("startLine"))).otherwise("")
    path = F.when(~document & (F.length("serviceName") > 0), F.concat_ws("/", "serviceName", "filePath")).otherwise(F.col("filePath"))
    extra = F.when(document, page).otherwise("")
    return F.concat(F.lit("["), F.col("position"), F.lit("] "), path, F.lit(" ("), F.col("fileType"), extra, F.lit(", "), percent(F.col("score")), F.lit("%)"))


def build_prompts(queries: DataFrame, contexts: DataFrame, label: str | None = None, question: str = "question") -> DataFrame:
    """(query_id, prompt) of every question, also of those without contexts. At most as many
    contexts as `assemble` lets through are gathered for a question."""
    section = F.struct("position", F.concat(header(), F.lit("\n"), F.col("content"), F.lit("\n\n")).alias("s"))
    gathered = contexts.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(section)), lambda x: x["s"]), "").alias("sections"))
    head = "\n".join([CONTEXT_HEAD, "", CONTEXT_LINE % (label or LABEL), "", ""])
    tail = "\n".join(["", "", INSTRUCTIONS_HEAD, "", *INSTRUCTIONS])
    prompt = F.concat(F.lit(head), F.coalesce("sections", F.lit("")), F.lit(f"{QUESTION_HEAD}\n\n"), F.col(question), F.lit(tail))
    return queries.join(gathered, "query_id", "left").select("query_id", prompt.alias("prompt"))


def system_prompts(projects: DataFrame, services: DataFrame) -> DataFrame:
    """(project, prompt) of projects (project, description, systemContext, guidelines array) with
    their services (project, position, name, framework, role)."""
    line = F.concat(F.lit("- "), F.col("name"), F.lit(": "), F.col("framework"), F.lit(" ("), F.col("role"), F.lit(")"))
    listed = services.groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("s")))), lambda x: x["s"]), "\n").alias("services"))
    some = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))) > 0
    guidelines = F.array_join(F.transform("guidelines", lambda g: F.concat(F.lit("- "), g)), "\n")
    prompt = F.concat(
        F.when(some("project"), F.format_string(NAMED_INTRO, "project")).otherwise(PLAIN_INTRO),
        F.when(some("description"), F.concat(F.lit("\n"), F.col("description"))).otherwise(""),
        F.when(some("systemContext"), F.concat(F.lit("\n"), F.col("systemContext"))).otherwise(""),
        F.when(some("services"), F.concat(F.lit(f"\n\n{SERVICES_HEAD}\n"), F.col("services"))).otherwise(""),
        F.when(F.size("guidelines") > 0, F.concat(F.lit(f"\n\n{GUIDELINES_HEAD}\n"), guidelines)).otherwise(""),
    )
    return projects.join(listed, "project", "left").select("project", prompt.alias("prompt"))
