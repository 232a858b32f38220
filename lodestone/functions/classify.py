"""Classification of paths by fixed rules: the first that fits decides."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# File types in the order of their rules; a rule is (contained parts, endings).
FILE_TYPES = [
    ("controller", [".controller."], []),
    ("service", [".service."], []),
    ("module", [".module."], []),
    ("entity", [".entity."], []),
    ("dto", [".dto."], []),
    ("guard", [".guard."], []),
    ("interceptor", [".interceptor."], []),
    ("pipe", [".pipe."], []),
    ("middleware", [".middleware."], []),
    ("resolver", [".resolver."], []),
    ("gateway", [".gateway."], []),
    ("strategy", [".strategy."], []),
    ("repository", [".repository."], []),
    ("interface", [".interface."], []),
    ("enum", [".enum."], []),
    ("config", [".config.", ".configuration."], []),
    ("test", [".spec.", ".test."], []),
    ("component", ["/components/"], [".tsx", ".jsx"]),
    ("page", ["/pages/", "/app/"], []),
    ("hook", ["/hooks/", "use"], []),
    ("util", ["/utils/", "/util/", "/helpers/"], []),
    ("model", ["/models/", "/schemas/"], []),
    ("route", ["/routes/", "/router"], []),
]
# Languages by extension.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript-react", ".js": "javascript", ".jsx": "javascript-react", ".py": "python",
    ".go": "go", ".java": "java", ".rs": "rust", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin",
    ".scala": "scala", ".cs": "csharp", ".cpp": "cpp", ".c": "c",
}
# Document types by extension.
DOCUMENT_TYPES = {".pdf": "pdf", ".xls": "excel", ".xlsx": "excel", ".md": "markdown", ".txt": "text"}


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """With its dot, lower-cased; '' for none, also for names that only begin with a dot."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)\A.+(\.[^.]*)\z", 1))


def relative_path(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def file_type(path: Column) -> Column:
    name = F.lower(path)
    out = F.lit("unknown")
    for kind, parts, endings in reversed(FILE_TYPES):
        fits = F.lit(False)
        for p in parts:
            fits = fits | name.contains(p)
        for e in endings:
            fits = fits | name.endswith(e)
        out = F.when(fits, kind).otherwise(out)
    return out


def _by_extension(path: Column, table: dict, default: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), extension(path)), F.lit(default))


def language(path: Column) -> Column:
    return _by_extension(path, LANGUAGES, "unknown")


def document_type(path: Column) -> Column:
    return _by_extension(path, DOCUMENT_TYPES, "text")
