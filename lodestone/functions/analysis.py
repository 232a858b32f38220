"""Analysis of questions: keywords, names, filters."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WS, bound

# Words that are no keywords (Korean particles, English function words).
STOP_WORDS = (
    "의 에서 를 이 가 은 는 에 로 으로 와 과 도 만 부터 까지 한 할 하는 된 "
    "the is a an in on at to for of how what where when why which who "
    "and or but not this that it be are was were been has have had do does"
).split()
# Words that name a file type, in the order in which they are tried.
FILE_TYPE_WORDS = (
    "controller service entity module dto guard interceptor pipe middleware resolver gateway strategy "
    "repository component page hook util model route"
).split()
# Words of questions about architecture.
ARCHITECTURAL_WORDS = "구조 아키텍처 architecture structure 설계 design 흐름 flow 전체 overview diagram 패턴 pattern 의존성 dependency".split()
# File types that such questions prefer.
ARCHITECTURAL_TYPES = ["module", "service"]


def _array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def keywords(question: Column) -> Column:
    """Distinct words longer than one letter that aren't stop words, lower-cased, in order."""
    words = F.transform(F.split(question, rf"[{WS},;.!?]+"), F.lower)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(_array(STOP_WORDS), w)))


def entity_names(question: Column) -> Column:
    """Distinct capitalised ASCII words (also in camel case) longer than two letters, in order."""
    # Look-arounds and not \b, which takes accented letters for parts of a word.
    found = F.regexp_extract_all(question, F.lit(r"(?<![A-Za-z0-9_])([A-Z][a-z]+(?:[A-Z][a-z]+)*)(?![A-Za-z0-9_])"), 1)
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~F.array_contains(_array(STOP_WORDS), F.lower(w))))


def file_type_filter(question: Column) -> Column:
    out = F.lit(None).cast("string")
    for word in reversed(FILE_TYPE_WORDS):
        out = F.when(F.lower(question).contains(word), word).otherwise(out)
    return out


def service_filter(question: Column, services: list[str]) -> Column:
    """The first service named in full (a hyphen may be a blank or missing), else the first whose
    name after its first hyphen stands in the question as a word. `services` is a small list."""
    loose = f"[-{WS}]?".join  # in the place of hyphens
    tests = [("(?iu)" + loose(map(re.escape, s.split("-"))), s) for s in services]
    short = [(re.sub(r"\A.*?-", "", s, count=1), s) for s in services]
    tests += [(f"(?iu)(?<![A-Za-z0-9_]){re.escape(x)}(?![A-Za-z0-9_])", s) for x, s in short if x and x != s]
    out = F.lit(None).cast("string")
    for pattern, s in reversed(tests):
        out = F.when(question.rlike(pattern), s).otherwise(out)
    return out


def service_patterns(services: DataFrame) -> DataFrame:
    """(name, place, part, key, pattern): for each service (name, place) its full name with loose hyphens
    and, if it has a hyphen, what follows the first. `key` is what a question must hold, in lower case
    and for full names without hyphens; `pattern` decides."""
    quoted = lambda c: F.regexp_replace(c, r"([^A-Za-z0-9_])", r"\\$1")
    loose = F.array_join(F.transform(F.split("name", "-"), quoted), f"[-{WS}]?")
    full = services.select("name", "place", F.lit(0).alias("part"), F.lower(F.replace("name", F.lit("-"))).alias("key"), F.concat(F.lit("(?iu)"), loose).alias("pattern"))
    rest = F.expr("substring(name, position('-' IN name) + 1)")
    word = F.concat(F.lit("(?iu)(?<![A-Za-z0-9_])"), quoted(rest), F.lit("(?![A-Za-z0-9_])"))
    short = services.where(F.contains("name", F.lit("-")) & (F.length(rest) > 0)).select("name", "place", F.lit(1).alias("part"), F.lower(rest).alias("key"), word.alias("pattern"))
    return full.unionByName(short).where(F.length("key") > 0)


def with_service_filter(questions: DataFrame, services: DataFrame, text: str = "question", key: str = "query_id") -> DataFrame:
    """`questions` with serviceFilter, as `service_filter` finds it, for a table of services (name, place)
    of any size; `place` is their order, and `key` tells questions apart.

    A question gives out its substrings of the lengths that names have, without hyphens and blanks for
    full names; they meet the names in an equi-join, the pattern confirms the few that fit, and
    the first by order wins. Only the distinct lengths of names pass through the driver.
    """
    patterns = service_patterns(services)
    lengths: dict[int, list[int]] = {0: [], 1: []}
    for part, n in patterns.select("part", F.length("key")).distinct().collect():  # a few numbers
        lengths[part].append(n)
    asked = questions.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    lowered = F.lower("__text")
    squeezed = F.regexp_replace(lowered, f"[-{WS}]", "")

    def cut(x: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(x) - n + 1, F.lit(1)))
        return F.transform(starts, lambda k: F.substring(x, k, F.lit(n)))

    def pieces(value: Column, sizes: list[int]) -> Column:
        if not sizes:
            return F.array().cast("array<string>")
        return bound(value, lambda x: F.array_distinct(F.concat(*[cut(x, n) for n in sorted(sizes)])))

    given = [asked.select("__key", "__text", F.lit(p).alias("part"), F.explode(pieces(v, lengths[p])).alias("key")) for p, v in ((0, squeezed), (1, lowered))]
    found = given[0].unionByName(given[1]).join(patterns, ["part", "key"]).where(F.regexp("__text", F.col("pattern")))
    best = found.groupBy("__key").agg(F.min_by("name", F.struct("part", "place")).alias("serviceFilter"))
    return questions.drop("serviceFilter").join(best, questions[key] == best["__key"], "left").drop("__key")


def is_architectural(question: Column) -> Column:
    return F.exists(_array(ARCHITECTURAL_WORDS), lambda w: F.contains(F.lower(question), w))


def analyse(questions: DataFrame, services: list[str] | DataFrame | None = None, text: str = "question") -> DataFrame:
    """`questions` with keywords, entityNames, serviceFilter, fileTypeFilter and isArchitectural.
    `services` is a short list of names or a table of them (name, place) of any size."""
    q = F.col(text)
    if isinstance(services, DataFrame):
        questions = with_service_filter(questions, services, text)
    return questions.withColumns(
        {
            "keywords": keywords(q),
            "entityNames": entity_names(q),
            "serviceFilter": F.col("serviceFilter") if isinstance(services, DataFrame) else service_filter(q, services or []),
            "fileTypeFilter": file_type_filter(q),
            "isArchitectural": is_architectural(q),
        }
    )
