"""Extraction from source text, as column expressions over a table of files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bound, js_trim

# Decorators of routes and of relations, in the order of the results.
VERBS = ["Get", "Post", "Put", "Delete", "Patch"]
RELATIONS = ["OneToOne", "OneToMany", "ManyToOne", "ManyToMany"]
# Patterns of the extracted forms.
IMPORT = r"""import\s+.*?\s+from\s+['"](.+?)['"]"""
EXPORT = r"export\s+(?:default\s+)?(?:class|function|const|interface|type|enum)\s+(\w+)"
DECORATOR = r"@(\w+)\("
MARKERS = r"@(?:Module|Controller|Injectable|Entity)\s*\("
# Fixed values (X8, X3, X6, X9, X10, X11): parameters of a constructor, lists of a decorator, modules,
# occurrences and their targets, and the phrases of summaries.
PARAMETERS, BALANCED = r"[^)]*", r"[^()]*(?:\((?:[^()]|\([^()]*\))*\)[^()]*)*"
CONSTRUCTOR = r"constructor\s*\((%s)\)"
LISTED = r"@%s\s*\(([^)]+)\)"
CLASS = r"class\s+(\w+)"
MODULE_SAID, CONTROLLER_SAID, ENTITY_SAID, SERVICE_SAID, FILE_SAID = "모듈", "REST 컨트롤러", "엔티티", "서비스", " 파일"
TYPED = r"(?:private|protected|public|readonly)\s+\w+\s*:\s*(\w+)"
INJECTED = r"""@Inject\s*\(\s*['"]?(\w+)['"]?\s*\)"""
CONTROLLER = r"""@Controller\s*\(\s*['"]([^'"]*)['"]\s*\)"""
VERB = r"""@%s\s*\(\s*(?:['"]([^'"]*)['"])?\s*\)([\s\S]*?)(?=@(?:%s)|\z)"""
HANDLER = r"(?:async\s+)?(\w+)\s*\("
RELATION = r"@%s\s*\(\s*\(\)\s*=>\s*(\w+)(?:\s*,\s*(?:\(\w+\)\s*=>\s*(\w+\.\w+)|[^)]+))?\)([\s\S]*?)(?=\n\s*(?:@|\w))"
MODULE = r"@Module\s*\(\s*\{"
MODULE_LIST = r"imports\s*:\s*\["
MODULE_CALL = r"(\w+)\.(forRoot|forRootAsync|forFeature|register|registerAsync)\s*\("
OCCURRENCE = r"@(\w+)\s*\(([^)]*)\)\s*\n\s*(?:export\s+)?(?:class|(?:async\s+)?\w+\s*\(|(?:readonly\s+)?(\w+)\s*[:(])"
ROLES = [("module", r"@Module\s*\("), ("controller", r"@Controller\s*\("), ("entity", r"@Entity\s*\("), ("service", r"@Injectable\s*\(")]


def imports(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(IMPORT), 1)


def exports(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(EXPORT), 1)


def decorators(content: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(content, F.lit(DECORATOR), 1))


def has_framework(content: Column) -> Column:
    return content.rlike(MARKERS)


def role(content: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(ROLES):
        out = F.when(content.rlike(pattern), name).otherwise(out)
    return out


def _listed(block: Column, decorator: str) -> Column:
    inside = F.regexp_extract(block, LISTED % decorator, 1)
    return F.filter(F.transform(F.split(inside, ","), js_trim), lambda g: F.length(g) > 0)


def controller_routes(content: Column) -> Column:
    """array of (method, path, handlerName, guards, interceptors), verb by verb. What lies between
    a verb's decorator and the next one belongs to the former."""
    named = F.regexp_extract(content, CONTROLLER, 1)
    base = F.concat(F.lit("/"), F.regexp_replace(named, r"\A/", ""))

    def of_verb(verb: str) -> Column:
        pattern = VERB % (verb, "|".join(VERBS))
        # A whole match ends before the look-ahead, so its parts are found without it.
        part = pattern[: pattern.rindex("(?=")].replace(r"([\s\S]*?)", r"([\s\S]*)\z")

        def route(m: Column) -> Column:
            path, block = F.regexp_extract(m, part, 1), F.regexp_extract(m, part, 2)
            handler = F.regexp_extract(block, HANDLER, 1)
            return F.struct(
                F.lit(verb.upper()).alias("method"),
                F.when(F.length(path) > 0, F.regexp_replace(F.concat(base, F.lit("/"), path), "/+", "/")).otherwise(base).alias("path"),
                F.when(F.length(handler) > 0, handler).otherwise("unknown").alias("handlerName"),
                _listed(block, "UseGuards").alias("guards"),
                _listed(block, "UseInterceptors").alias("interceptors"),
            )

        return F.transform(F.regexp_extract_all(content, F.lit(pattern), 0), route)

    return F.concat(*map(of_verb, VERBS))


def entity_relations(content: Column) -> Column:
    """array of (type, target, inverseSide, joinColumn), type by type."""

    def of_kind(kind: str) -> Column:
        pattern = RELATION % kind
        part = pattern[: pattern.rindex("(?=")].replace(r"([\s\S]*?)", r"([\s\S]*)\z")

        def relation(m: Column) -> Column:
            side = F.regexp_extract(m, part, 2)
            return F.struct(
                F.lit(kind).alias("type"),
                F.regexp_extract(m, part, 1).alias("target"),
                F.when(F.length(side) > 0, side).alias("inverseSide"),
                F.regexp_extract(m, part, 3).rlike(r"@JoinColumn\s*\(").alias("joinColumn"),
            )

        return F.transform(F.regexp_extract_all(content, F.lit(pattern), 0), relation)

    return F.concat(*map(of_kind, RELATIONS))


def injectable_deps(content: Column, full_params: bool = False) -> Column:
    """Injected names, then parameter types not listed yet. By default the parameters end at the
    first closing bracket, as in the reference; `full_params` takes them to the balanced one (three
    levels deep)."""
    params = F.regexp_extract(content, CONSTRUCTOR % (BALANCED if full_params else PARAMETERS), 1)
    injected = F.regexp_extract_all(params, F.lit(INJECTED), 1)
    typed = F.regexp_extract_all(params, F.lit(TYPED), 1)
    return F.aggregate(typed, injected, lambda out, t: F.when(F.array_contains(out, t), out).otherwise(F.concat(out, F.array(t))))


def _behind(text: Column, pattern: str) -> Column:
    """What follows the first place that the pattern fits; '' if none does."""
    return F.regexp_extract(text, rf"(?s)\A.*?(?:{pattern})(.*)\z", 1)


def _closed(text: Column) -> Column:
    """`text` up to the bracket that closes one opened before it; '' if it isn't closed. Brackets are
    counted over the pieces between them, in one pass."""
    start = F.struct(F.lit(1).alias("level"), F.lit(0).alias("at"), F.lit(-1).alias("end"))

    def step(held: Column, piece: Column) -> Column:
        level = held["level"] + F.when(piece == "[", 1).when(piece == "]", -1).otherwise(0)
        end = F.when((held["end"] < 0) & (level == 0), held["at"]).otherwise(held["end"])
        return F.struct(level.alias("level"), (held["at"] + F.length(piece)).alias("at"), end.alias("end"))

    pieces = F.regexp_extract_all(text, F.lit(r"[\[\]]|[^\[\]]+"), F.lit(0))
    end = F.aggregate(pieces, start, step, lambda held: held["end"])
    return F.substring(text, F.lit(1), F.greatest(end, F.lit(0)))


def module_imports(content: Column) -> Column:
    """Items of the module's `imports` list; brackets are balanced. As in the reference, a module at the
    very beginning is not seen."""
    seen = F.when(content.rlike(rf"\A{MODULE}"), "").otherwise(_behind(content, MODULE))

    def name(item: Column) -> Column:
        called = F.concat_ws(".", F.regexp_extract(item, rf"\A{MODULE_CALL}", 1), F.regexp_extract(item, rf"\A{MODULE_CALL}", 2))
        plain = js_trim(F.regexp_replace(item, r"(?s)\A(.*?)\((?-s:.*)\)", "$1"))
        return F.when(item.rlike(rf"\A{MODULE_CALL}"), called).otherwise(plain)

    items = bound(_behind(seen, MODULE_LIST), lambda x: F.split(_closed(x), ","))
    return F.when(content.isNotNull(), F.filter(F.transform(F.transform(items, js_trim), name), lambda n: F.length(n) > 0))


def decorator_occurrences(content: Column) -> Column:
    """array of (name, args, target): decorators with their arguments and targets; a target that the match
    doesn't hold is looked for in the 200 characters behind it."""
    pattern = OCCURRENCE + r"(?=([\s\S]{0,200}))"
    name, args, own, ahead = (F.regexp_extract_all(content, F.lit(pattern), F.lit(k)) for k in (1, 2, 3, 4))
    found = F.arrays_zip(name.alias("name"), args.alias("args"), own.alias("own"), ahead.alias("ahead"))

    def one(m: Column) -> Column:
        inside = js_trim(m["args"])
        target = F.lit("unknown")
        for p in (HANDLER, CLASS):
            target = F.when(m["ahead"].rlike(p), F.regexp_extract(m["ahead"], p, 1)).otherwise(target)
        given = F.when(F.length(inside) > 0, F.array(inside)).otherwise(F.array().cast("array<string>"))
        return F.struct(m["name"].alias("name"), given.alias("args"), F.when(F.length(m["own"]) > 0, m["own"]).otherwise(target).alias("target"))

    return F.transform(found, one)


def framework_of(content: Column) -> Column:
    """What `with_framework` finds in a file, as one struct."""
    return F.struct(
        module_imports(content).alias("moduleImports"),
        controller_routes(content).alias("controllerRoutes"),
        entity_relations(content).alias("entityRelations"),
        injectable_deps(content).alias("injectableDeps"),
        decorator_occurrences(content).alias("decorators"),
    )


def with_framework(files: DataFrame, plugins: Sequence[tuple[str, Callable, Callable]] = ()) -> DataFrame:
    """`files` (content, serviceName, fileType, language, lineCount) with hasFramework, plugin, role,
    framework and summary.

    `plugins` are further analysers (name, can_analyse, analyse), tried after the built-in one; the
    first whose can_analyse(content) holds is the file's. Both functions make columns of the content;
    analyse makes a struct of the fields of `framework_of`. Files are read once; each is analysed by its
    plug-in alone.
    """
    c = F.col("content")
    known = [("nestjs", has_framework, framework_of), *plugins]
    name, framework = F.lit(None).cast("string"), F.lit(None)
    for plugin, can, analyse in reversed(known):
        name = F.when(F.coalesce(can(c), F.lit(False)), plugin).otherwise(name)
        framework = F.when(F.col("plugin") == plugin, analyse(c)).otherwise(framework)
    out = files.withColumn("plugin", name).withColumn("hasFramework", F.col("plugin").isNotNull()).withColumn("role", F.when(F.col("hasFramework"), role(c)))
    both = out.withColumn("framework", framework)

    def listed(array: Column, one) -> Column:
        text = F.array_join(F.transform(array, one), ", ")
        return F.when(F.size(array) > 0, text).otherwise("none")

    f, service = F.col("framework"), F.concat(F.lit(" ("), F.col("serviceName"), F.lit("). "))
    summary = (
        F.when(F.col("role") == "module", F.concat(F.lit(MODULE_SAID), service, F.lit("Imports: "), listed(f["moduleImports"], lambda x: x)))
        .when(F.col("role") == "controller", F.concat(F.lit(CONTROLLER_SAID), service, F.lit("Routes: "), listed(f["controllerRoutes"], lambda x: F.concat_ws(" ", x["method"], x["path"]))))
        .when(F.col("role") == "entity", F.concat(F.lit(ENTITY_SAID), service, F.lit("Relations: "), listed(f["entityRelations"], lambda x: F.concat_ws(" → ", x["type"], x["target"]))))
        .when(F.col("role") == "service", F.concat(F.lit(SERVICE_SAID), service, F.lit("Dependencies: "), listed(f["injectableDeps"], lambda x: x)))
        .otherwise(F.concat(F.col("fileType"), F.lit(FILE_SAID), service, F.col("language"), F.lit(", "), F.col("lineCount"), F.lit(" lines")))
    )
    return both.withColumn("summary", summary)
