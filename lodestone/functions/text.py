"""Scalar text expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript has it: tab to carriage return, Unicode separators, the byte order mark.
WS = r"\t\n\x0B\f\r\p{Z}\x{FEFF}"


def js_trim(text: Column) -> Column:
    """Without white space at either end (all Unicode white space, not only blanks)."""
    return F.regexp_replace(text, rf"\A[{WS}]+|[{WS}]+\z", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"[^{WS}]")


def bound(value: Column, body) -> Column:
    """The array `body(value)`, with `value` computed once: in the lambda of a higher-order function
    an expression would be computed anew for each element."""
    return F.flatten(F.transform(F.array(value), body))


def short_id(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts, joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 16)


def token_estimate(text: Column) -> Column:
    """A token for every three characters begun."""
    return F.ceil(F.length(text) / 3)


def occurrences(text: Column, word: Column) -> Column:
    """How often `word` stands in `text`, without overlaps; both as they are."""
    return F.when(F.length(word) > 0, ((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word)).cast("int")).otherwise(0)


def percent(score: Column) -> Column:
    """`score` (0 to 1) as percent with one decimal, by the exact binary value of the percentage; an
    exact tie goes up. Spark rounds the decimal print instead: 12.35 is a little less than that."""
    x = score * 100
    tenths = F.round(x * 10).cast("long")  # right unless x prints as a tie
    # x and the tie as multiples of a power of two, which they are exactly.
    scale = F.when(x < 4, F.lit(float(2**56))).otherwise(F.lit(float(2**50)))
    k = F.round(x * 20).cast("long")
    prints_as_tie = (F.round(x, 2) == x) & (k % 2 == 1) & (F.round(x * 100).cast("long") == k * 5)
    below = (x * scale).cast("long") * 20 < k * scale.cast("long")
    n = F.when(prints_as_tie, F.when(below, F.floor(k / 2)).otherwise(F.floor(k / 2) + 1)).otherwise(tenths).cast("long")
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))
