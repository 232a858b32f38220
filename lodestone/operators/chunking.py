"""Chunking: rows of source files and documents to rows of chunks. All of it is row-local."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract
from ..functions.classify import file_name
from ..functions.text import WS, bound, is_blank, js_trim, short_id

CODE_SIZE, DOCUMENT_SIZE, OVERLAP, LINE = 1500, 2000, 200, 80
SUMMARY_LINES = 10
SHEET_ROWS = 10_000
#: Parts of a group that meet in one task when its first rows are looked for.
MERGED = 16


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """Starts of overlapping windows over `n` units: every size - overlap, up to the first window
    that reaches the end, and one more for the last `overlap` units where these begin later. With
    an overlap of the size or more there is one window. No units, no windows."""
    step = size - overlap
    if step <= 0:
        return F.when(n > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    last = (F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0)) * step).cast("int")
    starts = F.sequence(F.lit(0), last, F.lit(step))
    if overlap:
        starts = F.when(n - overlap > last, F.concat(starts, F.array((n - overlap).cast("int")))).otherwise(starts)
    return F.when(n > 0, starts).otherwise(F.array().cast("array<int>"))


def line_windows(content: Column, size: int = CODE_SIZE, overlap: int = OVERLAP) -> Column:
    """array of (content, startLine, endLine): windows of size / 80 lines, blank ones left out."""
    per, back = max(1, size // LINE), max(0, overlap // LINE)

    def cut(lines: Column) -> Column:
        return F.transform(
            window_starts(F.size(lines), per, back),
            lambda s: F.struct(
                F.array_join(F.slice(lines, s + 1, per), "\n").alias("content"),
                (s + 1).alias("startLine"),
                F.least(s + per, F.size(lines)).alias("endLine"),
            ),
        )

    return F.filter(bound(F.split(content, "\n"), cut), lambda p: ~is_blank(p["content"]))


def text_pieces(text: Column, size: int = DOCUMENT_SIZE, overlap: int = OVERLAP) -> Column:
    """Windows of characters, blank ones left out; a text of no more than `size` is one piece.

    The text is cut once into parts of a step; a window is put together from the parts it covers, so
    the work is in proportion to the text. Only a window of the last `overlap` characters may begin
    within a part.
    """
    step = size - overlap

    def cut(x: Column) -> Column:
        def window(s: Column) -> Column:
            whole = F.array_join(F.slice(x["parts"], (s / step).cast("int") + 1, -(-size // step)), "")
            return F.when(s % step == 0, F.substring(whole, 1, size)).otherwise(F.right(x["text"], F.lit(overlap)))

        windows = F.transform(window_starts(x["n"], size, overlap), window) if step > 0 else F.array(F.substring(x["text"], 1, size))
        return F.when(x["n"] <= size, F.array(x["text"])).otherwise(windows)

    parts = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{max(step, 1)}}}"), F.lit(0)) if step > 0 else F.lit(None)
    given = F.struct(text.alias("text"), F.length(text).alias("n"), parts.alias("parts"))
    return F.filter(bound(given, cut), lambda p: ~is_blank(p))


def file_summary(relative_path: Column, service: Column, file_type: Column, content: Column) -> Column:
    lines = F.split(content, "\n")
    taken = F.slice(F.filter(lines, lambda x: x.startswith("import ")), 1, SUMMARY_LINES)
    given = F.slice(F.filter(lines, lambda x: x.contains("export ")), 1, SUMMARY_LINES)
    none = F.array().cast("array<string>")
    head = F.array(
        F.concat(F.lit("// File: "), relative_path),
        F.concat(F.lit("// Service: "), service),
        F.concat(F.lit("// Type: "), file_type),
        F.concat(F.lit("// Lines: "), F.size(lines).cast("string")),
        F.lit(""),
    )
    taken = F.when(F.size(taken) > 0, F.concat(F.array(F.lit("// Imports:")), taken, F.array(F.lit("")))).otherwise(none)
    given = F.when(F.size(given) > 0, F.concat(F.array(F.lit("// Exports:")), given)).otherwise(none)
    return F.array_join(F.concat(head, taken, given), "\n")


def chunk_code(files: DataFrame, size: int = CODE_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """A summary and the line windows of each file (filePath, relativePath, serviceName, fileType,
    language, content), with the names that each imports, exports and is decorated with."""
    c = F.col("content")
    none = F.lit(None).cast("array<string>")
    summary = F.struct(
        file_summary(F.col("relativePath"), F.col("serviceName"), F.col("fileType"), c).alias("content"),
        F.lit(1).alias("startLine"),
        F.size(F.split(c, "\n")).alias("endLine"),
        F.lit("file-summary").alias("level"),
        extract.imports(c).alias("imports"),
        extract.exports(c).alias("exports"),
        extract.decorators(c).alias("decorators"),
        short_id(F.col("filePath"), F.lit(0), F.lit(0)).alias("id"),
    )
    windows = F.transform(
        line_windows(c, size, overlap),
        lambda p: F.struct(
            p["content"].alias("content"),
            p["startLine"].alias("startLine"),
            p["endLine"].alias("endLine"),
            F.lit("text").alias("level"),
            none.alias("imports"),
            none.alias("exports"),
            extract.decorators(p["content"]).alias("decorators"),
            short_id(F.col("filePath"), p["startLine"], p["endLine"]).alias("id"),
        ),
    )
    kept = ["filePath", "relativePath", "serviceName", "fileType", "language"]
    out = files.select(*kept, F.explode(F.concat(F.array(summary), windows)).alias("p")).select(*kept, "p.*")
    return out.withColumns({"symbolName": F.lit(None).cast("string"), "parentSymbol": F.lit(None).cast("string")})


# --- sections, pages, sheets -------------------------------------------------------------------

_BLANK = WS.replace(r"\n", "")
_HEADING = rf"#{{1,6}}[{_BLANK}]+[^\n\r\x{{2028}}\x{{2029}}]+"


def markdown_sections(text: Column) -> Column:
    """array of (heading, level, content): cut before heading lines; sections without content are
    left out; a text with none of them is one section without a heading. Headings keep their blanks."""
    parts = F.split(text, rf"(?:\A|\n)(?={_HEADING}(?:\n|\z))")
    head = rf"\A(#{{1,6}})[{_BLANK}]+([^\n\r\x{{2028}}\x{{2029}}]+)(?=\n|\z)"
    sections = F.transform(
        parts,
        lambda p: F.struct(
            F.regexp_extract(p, head, 2).alias("heading"),
            F.length(F.regexp_extract(p, head, 1)).alias("level"),
            js_trim(F.regexp_replace(p, rf"\A{_HEADING}(?=\n|\z)", "")).alias("content"),
        ),
    )
    sections = F.filter(sections, lambda s: F.length(s["content"]) > 0)
    return bound(sections, lambda x: F.when(F.size(x) == 0, text_sections(text)).otherwise(x))


def text_sections(text: Column) -> Column:
    """One section of the trimmed text; none if it is blank."""
    whole = F.array(F.struct(F.lit("").alias("heading"), F.lit(0).alias("level"), js_trim(text).alias("content")))
    return F.filter(whole, lambda s: F.length(s["content"]) > 0)


def text_pages(text: Column, count: Column) -> Column:
    """array of (pageNumber, content) of an extracted text: as a whole if it has one page; else cut
    at form feeds; without these, into equal parts, in one pass. Empty pages keep their numbers but are
    left out."""
    size = F.greatest(F.ceil(F.length(text) / F.greatest(count, F.lit(1))).cast("int"), F.lit(1))
    even = F.regexp_extract_all(text, F.concat(F.lit("(?s).{1,"), size.cast("string"), F.lit("}")), F.lit(0))
    parts = F.when(count <= 1, F.array(text)).when(text.contains("\f"), F.split(text, "\f")).otherwise(even)
    pages = F.transform(parts, lambda p, i: F.struct((i + 1).alias("pageNumber"), js_trim(p).alias("content")))
    return F.filter(pages, lambda p: F.length(p["content"]) > 0)


def first_rows(rows: DataFrame, limit: int, by: list[str], order: list[str]) -> DataFrame:
    """The first `limit` rows of each group by `order`, with their number from 1 as `__row`.

    Spark cuts groups before a shuffle for small limits only. Here a group's rows are dealt out by a hash
    of their order columns to as many cells as there are partitions; each cell hands on its first
    `limit` rows, and MERGED cells meet at a time, until one is left. So no task sorts a whole group,
    however large, and what meets in one task is at most MERGED times the limit.
    """
    cells = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = rows.withColumn("__cell", F.pmod(F.xxhash64(*order), F.lit(cells)))
    while True:
        first = Window.partitionBy(*by, "__cell").orderBy(*order)
        out = out.withColumn("__row", F.row_number().over(first)).where(F.col("__row") <= limit)
        if cells == 1:
            return out.drop("__cell")
        cells = -(-cells // MERGED)
        out = out.withColumn("__cell", F.floor(F.col("__cell") / MERGED))


def sheet_texts(rows: DataFrame, source: str, sheet: str, order: list[str], columns: list[str], limit: int = SHEET_ROWS) -> DataFrame:
    """(source, sheetName, rowCount, totalSheets, content): rows of each sheet as CSV lines, the first
    `limit` in order; the text is trimmed as a whole. totalSheets counts all sheets of a source, also
    those without text, which are left out. What is collected per sheet is bounded by `limit`."""
    kept = first_rows(rows, limit, [source, sheet], order)
    line = F.to_csv(F.struct(*columns), {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": ""})
    lines = F.array_sort(F.collect_list(F.struct("__row", line.alias("line"))))
    out = kept.groupBy(F.col(source).alias("source"), F.col(sheet).alias("sheetName")).agg(F.count("*").cast("int").alias("rowCount"), lines.alias("lines"))
    out = out.withColumn("totalSheets", F.count("*").over(Window.partitionBy("source")))
    out = out.withColumn("content", js_trim(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))).drop("lines")
    return out.where(F.length("content") > 0)


def _document_chunks(parts: DataFrame, text: Column, name: Column, page: Column, sheet: Column, metadata: Column, size: int, overlap: int) -> DataFrame:
    told = ["message"] if "message" in parts.columns else []
    pieces = text_pieces(text, size, overlap)
    if told:
        pieces = F.when(F.col("message").isNull(), pieces).otherwise(F.array(F.lit(None).cast("string")))
    out = parts.select(
        "source",
        "sourceType",
        name.alias("__name"),
        page.cast("int").alias("page"),
        sheet.cast("string").alias("sheet"),
        metadata.alias("metadata"),
        *told,
        F.posexplode(pieces).alias("index", "content"),
    )
    key = short_id(F.lit("doc"), F.col("source"), F.col("__name"), F.col("index"))
    return out.select(key.alias("id"), "content", "source", "sourceType", "page", "sheet", "metadata", "index", *told)


def judged(docs: DataFrame, text: str) -> DataFrame:
    """`docs` with `message`: why a document can't be chunked, or null. A `problem` that was found when it
    was read comes first; else it has no text, or is to be cut into pages and has no page count."""
    message = F.when(F.col(text).isNull(), "no text")
    if "pageCount" in docs.columns:
        message = message.when(F.col("pageCount").isNull(), "no page count")
    if "problem" in docs.columns:
        message = F.coalesce("problem", message)
    return docs.withColumn("message", message)


def _usable(docs: DataFrame, text: str, failed: bool) -> DataFrame:
    out = judged(docs, text)
    return out if failed else out.where("message is null").drop("message")


def _map(**values) -> Column:
    pairs = F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*[v.cast("string") for v in values.values()]))
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def chunk_sections(docs: DataFrame, size: int = DOCUMENT_SIZE, overlap: int = OVERLAP, failed: bool = False) -> DataFrame:
    """Chunks of markdown and plain text documents (source, sourceType, text). Those that can't be
    chunked are left out or, with `failed`, are a row each with a `message`, as in the next two."""
    docs = _usable(docs, "text", failed)
    sections = F.when(F.col("sourceType") == "markdown", markdown_sections(F.col("text"))).otherwise(text_sections(F.col("text")))
    told = ["message"] if failed else []
    if failed:
        none = F.array(F.struct(F.lit("").alias("heading"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("content")))
        sections = F.when(F.col("message").isNull(), sections).otherwise(none)
    parts = docs.withColumn("__s", sections).select("source", "sourceType", *told, F.size("__s").alias("__n"), F.explode("__s").alias("s"))
    heading, level = F.col("s.heading"), F.col("s.level")
    titled = F.length(heading) > 0
    text = F.when(titled, F.concat(F.expr("repeat('#', s.level)"), F.lit(" "), heading, F.lit("\n\n"), F.col("s.content"))).otherwise(F.col("s.content"))
    name = F.when(titled, F.concat(F.lit("section-"), heading)).otherwise("section-root")
    null = F.lit(None)
    return _document_chunks(parts, text, name, null, null, _map(heading=heading, headingLevel=level, sectionCount=F.col("__n")), size, overlap)


def chunk_pages(docs: DataFrame, size: int = DOCUMENT_SIZE, overlap: int = OVERLAP, failed: bool = False) -> DataFrame:
    """Chunks of extracted texts with a page count (source, text, pageCount, title, author)."""
    docs = _usable(docs, "text", failed)
    pages = text_pages(F.col("text"), F.col("pageCount"))
    told = ["message"] if failed else []
    if failed:
        pages = F.when(F.col("message").isNull(), pages).otherwise(F.array(F.struct(F.lit(0).alias("pageNumber"), F.lit(None).cast("string").alias("content"))))
    parts = docs.select("source", F.lit("pdf").alias("sourceType"), "title", "author", "pageCount", *told, F.explode(pages).alias("p"))
    name = F.concat(F.lit("page-"), F.col("p.pageNumber"))
    metadata = _map(title=F.coalesce("title", F.lit("")), author=F.coalesce("author", F.lit("")), totalPages=F.col("pageCount"))
    return _document_chunks(parts, F.col("p.content"), name, F.col("p.pageNumber"), F.lit(None), metadata, size, overlap)


def chunk_sheets(sheets: DataFrame, size: int = DOCUMENT_SIZE, overlap: int = OVERLAP, failed: bool = False) -> DataFrame:
    """Chunks of `sheet_texts` (source, sheetName, rowCount, totalSheets, content)."""
    parts = _usable(sheets, "content", failed).withColumn("sourceType", F.lit("excel"))
    name = F.concat(F.lit("sheet-"), F.col("sheetName"))
    metadata = _map(sheetName=F.col("sheetName"), rowCount=F.col("rowCount"), totalSheets=F.col("totalSheets"))
    return _document_chunks(parts, F.col("content"), name, F.lit(None), F.col("sheetName"), metadata, size, overlap)


def _by_kind(texts: DataFrame | None, pages: DataFrame | None, sheets: DataFrame | None) -> list[tuple]:
    every = ((texts, chunk_sections, "text"), (pages, chunk_pages, "text"), (sheets, chunk_sheets, "content"))
    return [x for x in every if x[0] is not None]


def chunk_outcomes(texts: DataFrame | None = None, pages: DataFrame | None = None, sheets: DataFrame | None = None, size: int = DOCUMENT_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """The chunks of documents by kind and, among them, a row with a `message` for each document that
    failed: one scan gives both. `split_outcomes` tells them apart, best once they are saved."""
    parts = [chunk(given, size, overlap, failed=True) for given, chunk, _ in _by_kind(texts, pages, sheets)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def split_outcomes(outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, errors) of outcomes; errors are (name, source, message)."""
    errors = outcomes.where("message is not null").select(file_name(F.col("source")).alias("name"), "source", "message")
    return outcomes.where("message is null").drop("message"), errors


def chunk_documents(texts: DataFrame | None = None, pages: DataFrame | None = None, sheets: DataFrame | None = None, size: int = DOCUMENT_SIZE, overlap: int = OVERLAP) -> tuple[DataFrame, DataFrame]:
    """(chunks, errors) of documents by kind, each with a scan of its own. A document that can't be
    chunked goes to errors (name, source, message) and does not stop the others."""
    kinds = _by_kind(texts, pages, sheets)
    chunks = [chunk(given, size, overlap) for given, chunk, _ in kinds]
    failed = [judged(given, text).where("message is not null").select(file_name(F.col("source")).alias("name"), "source", "message") for given, _, text in kinds]
    return reduce(lambda a, b: a.unionByName(b), chunks), reduce(lambda a, b: a.unionByName(b), failed)


# --- records -----------------------------------------------------------------------------------


def code_records(chunks: DataFrame) -> DataFrame:
    """Code chunks as rows of the chunk table (without `vector` if they have none)."""
    vector = ["vector"] if "vector" in chunks.columns else []
    return chunks.select(
        "id", "content", *vector, "filePath", "relativePath", "serviceName", "fileType", "language",
        F.coalesce("symbolName", F.lit("")).alias("symbolName"), "level", "startLine", "endLine", F.lit("code").alias("chunkType"),
    )


def document_records(chunks: DataFrame) -> DataFrame:
    """Document chunks as rows of the chunk table (without `vector` if they have none)."""
    vector = ["vector"] if "vector" in chunks.columns else []
    empty = F.lit("")
    return chunks.select(
        "id", "content", *vector, F.col("source").alias("filePath"), F.col("source").alias("relativePath"), empty.alias("serviceName"),
        F.col("sourceType").alias("fileType"), empty.alias("language"), empty.alias("symbolName"),
        F.coalesce("sheet", F.element_at("metadata", "heading"), empty).alias("level"),
        F.coalesce("page", F.lit(0)).alias("startLine"), F.lit(0).alias("endLine"), F.lit("document").alias("chunkType"),
    )


def document_totals(docs: DataFrame) -> DataFrame:
    """(source, sections, hasTitle): sections of each text (source, sourceType, text), and whether it
    is markdown and its first section has a heading of level 1."""
    markdown = F.col("sourceType") == "markdown"
    sections = F.when(markdown, markdown_sections(F.col("text"))).otherwise(text_sections(F.col("text")))
    titled = markdown & (F.get("s", F.lit(0))["level"] == 1)
    return docs.select("source", "sourceType", sections.alias("s")).select("source", F.size("s").alias("sections"), F.coalesce(titled, F.lit(False)).alias("hasTitle"))


def page_totals(docs: DataFrame) -> DataFrame:
    """(source, pages, totalPages): pages with text of each extracted text (source, text, pageCount),
    and all of them."""
    return docs.select("source", F.size(text_pages(F.col("text"), F.col("pageCount"))).alias("pages"), F.col("pageCount").alias("totalPages"))


def sheet_totals(sheets: DataFrame) -> DataFrame:
    """(source, sheets, totalSheets, rows) of `sheet_texts`: sheets with text, all sheets, rows kept.
    A source none of whose sheets has text is not in there."""
    return sheets.groupBy("source").agg(F.count("*").alias("sheets"), F.first("totalSheets").alias("totalSheets"), F.sum("rowCount").alias("rows"))
