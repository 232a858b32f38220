"""Sources: inventories of files, services, documents.

The main input is an inventory (path, modificationTime, length, content): any table will do.
`binary_files` makes one from a folder, but Spark's listing leaves out names that begin with `_` or
a dot; for these, list the paths some other way and use `opened`.

Damaged files don't stop a job. Bytes that are no UTF-8 are read as U+FFFD, as the reference reads them;
`checked` says of each file why it can't be used, so that one scan gives good rows and failed ones.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import classify
from ..functions.text import bound

MAX_CODE_BYTES, MAX_DOCUMENT_BYTES = 50_000, 10 * 1024 * 1024
# Patterns of files to take and to leave out.
CODE_PATTERNS = ["**/*.ts", "**/*.tsx", "**/*.js", "**/*.jsx", "**/*.py", "**/*.go", "**/*.java", "**/*.rs"]
CODE_IGNORED = [
    "**/node_modules/**", "**/dist/**", "**/build/**", "**/.next/**", "**/coverage/**", "**/*.spec.ts", "**/*.test.ts",
    "**/*.d.ts", "**/*.stories.ts", "**/*.stories.tsx", "**/migrations/**", "**/__mocks__/**", "**/__tests__/**",
    "**/__pycache__/**", "**/target/**", "**/vendor/**",
]
DOCUMENT_PATTERNS = ["**/*.pdf", "**/*.xls", "**/*.xlsx", "**/*.md", "**/*.txt"]
DOCUMENT_IGNORED = ["**/node_modules/**", "**/dist/**", "**/.git/**", "**/build/**"]
# Frameworks by the dependency that tells them, in order, and roles by framework.
FRAMEWORKS = [("@nestjs/core", "NestJS"), ("next", "Next.js"), ("express", "Express"), ("fastify", "Fastify"), ("react", "React"), ("vue", "Vue"), ("django", "Django"), ("flask", "Flask")]
ROLES = {"NestJS": "백엔드 API", "Next.js": "프론트엔드", "Express": "백엔드 API", "Fastify": "백엔드 API", "React": "프론트엔드", "Vue": "프론트엔드", "Django": "백엔드 API", "Flask": "백엔드 API"}


def glob_pattern(glob: str) -> str:
    """A regular expression for a whole relative path. `*` and `**` don't match names that begin
    with a dot, as is usual for globs."""
    out = ""
    for part in re.split(r"(\*\*/|/\*\*\Z|\*\*|\*|\?)", glob):
        out += {"**/": r"(?:(?!\.)[^/]+/)*", "/**": r"(?:/(?!\.)[^/]+)+", "**": ".*", "*": r"(?!\.)[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return rf"\A{out}\z"


def _any(globs: list[str]) -> str:
    return "|".join(f"(?:{glob_pattern(g)})" for g in globs)


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(path)


def opened(paths: DataFrame) -> DataFrame:
    """`paths` (path, length, modificationTime) with `content`, read where workers reach the paths;
    what can't be read has null content."""

    def run(batches):
        for batch in batches:
            data = []
            for path in batch.column("path").to_pylist():
                try:
                    with open(re.sub(r"\Afile:/*", "/", path), "rb") as f:
                        data.append(f.read())
                except OSError:
                    data.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], names=[*batch.schema.names, "content"])

    return paths.mapInArrow(run, T.StructType([*paths.schema.fields, T.StructField("content", T.BinaryType())]))


def text_of(content: Column) -> Column:
    """Bytes as text; what is no UTF-8 becomes U+FFFD. Null stays null."""
    return F.make_valid_utf8(content.cast("string"))


def problem_of(max_bytes: int, strict: bool = False) -> Column:
    """Why a file (length, content) can't be used, or null. With `strict`, bytes that are no UTF-8 are
    a reason too."""
    out = F.when(F.coalesce(F.col("length"), F.lit(0)) < 1, "empty")
    out = out.when(F.col("length") > max_bytes, f"larger than {max_bytes} bytes").when(F.col("content").isNull(), "cannot be read")
    return out.when(~F.is_valid_utf8(F.col("content").cast("string")), "not UTF-8") if strict else out


def checked(files: DataFrame, max_bytes: int, strict: bool = False) -> DataFrame:
    """`files` with `problem`: null for good ones. Nothing is left out, so one scan serves both."""
    return files.withColumn("problem", problem_of(max_bytes, strict))


def failures(checked_files: DataFrame, name: Column) -> DataFrame:
    """(name, message) of the files that `checked` found unusable."""
    return checked_files.where(F.col("problem").isNotNull()).select(name.alias("name"), F.col("problem").alias("message"))


def assigned(files: DataFrame, services: DataFrame, root: str) -> DataFrame:
    """`files` with relativePath, inner path and serviceName of every service whose folder holds
    them; a file in nested services appears once for each.

    A file is given out once for each folder above it and meets the services in an equi-join on the
    folder, so any number of services will do; which side is sent to the other is left to Spark.
    """
    rel = files.withColumn("relativePath", classify.relative_path(F.regexp_replace("path", r"\Afile:/+", "/"), root))
    own = F.regexp_replace(F.regexp_replace("path", r"\A\./?", ""), r"/+\z", "")
    known = services.select(F.col("name").alias("serviceName"), own.alias("__folder"))
    parts = F.split("relativePath", "/")
    folders = bound(parts, lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda k: F.array_join(F.slice(x, F.lit(1), k), "/")))
    found = rel.withColumn("__folder", F.explode(folders)).join(known, "__folder")
    inner = F.when(F.length("__folder") > 0, F.expr("substring(relativePath, length(__folder) + 2)")).otherwise(F.col("relativePath"))
    return found.withColumn("__inner", inner).drop("__folder")


def list_code(files: DataFrame, services: DataFrame, root: str, include=CODE_PATTERNS, exclude=CODE_IGNORED, service: str | None = None) -> DataFrame:
    """Files of all services or of one, by patterns within each service's folder."""
    if service is not None:
        services = services.where(F.col("name") == service)
        if services.isEmpty():
            raise ValueError(f"unknown service: {service}")
    inner = F.col("__inner")
    fits = inner.rlike(_any(include))
    if exclude:
        fits = fits & ~inner.rlike(_any(exclude))
    return assigned(files, services, root).where(fits).drop("__inner")


def load_code(listed: DataFrame, classify_path: str = "relativePath") -> DataFrame:
    """Listed files of 1 to 50,000 bytes with their text, type, language and metadata; others, and files
    that can't be read, are left out (`checked` tells them). Types are told from the relative path;
    `classify_path="path"` uses the whole one, as the reference does."""
    out = listed.where(F.col("length").between(1, MAX_CODE_BYTES) & F.col("content").isNotNull())
    out = out.withColumn("content", text_of(F.col("content"))).withColumn("filePath", F.regexp_replace("path", r"\Afile:/+", "/"))
    out = out.withColumn("fileType", classify.file_type(F.col(classify_path))).withColumn("language", classify.language(F.col("path")))
    out = out.withColumn("lineCount", F.size(F.split("content", "\n")))
    iso = F.date_format(F.to_utc_timestamp("modificationTime", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    same = ("filePath", "relativePath", "serviceName", "fileType", "language", "lineCount")
    return out.select(*same, "content", F.struct(*same, iso.alias("lastModified"), F.col("length").alias("size")).alias("metadata"))


def list_documents(files: DataFrame, root: str, patterns=DOCUMENT_PATTERNS, ignored=DOCUMENT_IGNORED, any_size: bool = False) -> DataFrame:
    """Documents of 1 byte to 10 MiB, or of `any_size`, with type, name and size."""
    path = F.regexp_replace("path", r"\Afile:/+", "/")
    out = files.withColumn("filePath", path).withColumn("relativePath", classify.relative_path(path, root))
    out = out.where(F.col("relativePath").rlike(_any(patterns)) & ~F.col("relativePath").rlike(_any(ignored)))
    if not any_size:
        out = out.where(F.col("length").between(1, MAX_DOCUMENT_BYTES))
    return out.withColumns({"documentType": classify.document_type(path), "fileName": classify.file_name(path), "sizeBytes": F.col("length")})


def document_texts(documents: DataFrame, strict: bool = False) -> DataFrame:
    """(source, sourceType, text, problem) of markdown and plain text documents; where there is a
    problem, the text is null."""
    some = checked(documents.where(F.col("documentType").isin("markdown", "text")), MAX_DOCUMENT_BYTES, strict)
    text = F.when(F.col("problem").isNull(), text_of(F.col("content")))
    return some.select(F.col("filePath").alias("source"), F.col("documentType").alias("sourceType"), text.alias("text"), "problem")


def detect_services(files: DataFrame, root: str) -> DataFrame:
    """Services of a tree: top folders without a leading dot that hold package.json or
    tsconfig.json, with the framework that their dependencies tell and its role. A manifest that can't be
    read or is no JSON tells `unknown`."""
    path = classify.relative_path(F.regexp_replace("path", r"\Afile:/+", "/"), root)
    parts = F.split(path, "/")
    top = files.select(F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).alias("file"), F.size(parts).alias("deep"), "content")
    top = top.where((F.col("deep") == 2) & F.col("file").isin("package.json", "tsconfig.json") & ~F.col("name").startswith("."))
    manifest = F.max(F.when(F.col("file") == "package.json", text_of(F.col("content"))))
    found = top.groupBy("name").agg(manifest.alias("json"))
    found = found.withColumn("p", F.from_json("json", "dependencies map<string,string>, devDependencies map<string,string>, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    framework = F.lit("Node.js")
    for key, name in reversed(FRAMEWORKS):
        held = F.coalesce(F.element_at("p.devDependencies", key), F.element_at("p.dependencies", key))
        framework = F.when(F.length(held) > 0, name).otherwise(framework)
    framework = F.when(F.col("p").isNull() | F.col("p._bad").isNotNull(), "unknown").otherwise(framework)
    role = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), F.col("framework")), F.lit("service"))
    return found.withColumn("framework", framework).select("name", F.col("name").alias("path"), "framework", role.alias("role"))
