"""Personal data in texts: patterns propose spans, check digits confirm them, words nearby adjust a score.

Positions are code points, ends exclusive. Patterns are run so that the work is in proportion to the
text: no pattern is tried anew from within a run of digits or of a name that has failed.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

#: Kinds that are always reported if their pattern and check hold, in the order of reports.
BASE = ("email", "ip", "card", "phone")
#: Further kinds, reported if their score reaches a threshold and no span before overlaps them.
FURTHER = ("iban", "ssn", "local_phone", "spelled_email")
KINDS = (*BASE, *FURTHER)
#: Score of a span by its kind alone, in hundredths; a check digit is worth more than a mere form.
PRIOR = {"email": 80, "ip": 60, "card": 90, "phone": 70, "iban": 90, "ssn": 40, "local_phone": 40, "spelled_email": 70}
THRESHOLD = 60
#: How far words count as near, in code points, and what they are worth.
BEFORE, AFTER, NEAR, AGAINST = 48, 24, 25, 25
# Words that speak for a kind when they stand near, and words that speak against any.
WORDS = {
    "email": "email e-mail mail contact write reach correo courriel".split(),
    "ip": "ip address host server client login adresse".split(),
    "card": "card credit debit visa mastercard amex payment karte tarjeta carte".split(),
    "phone": "phone tel telephone call mobile cell fax whatsapp telefon móvil portable".split(),
    "iban": "iban account bank konto cuenta compte transfer".split(),
    "ssn": "ssn social security taxpayer".split(),
    "local_phone": "phone tel telephone call mobile cell fax whatsapp telefon".split(),
    "spelled_email": "email e-mail mail contact write reach".split(),
}
DOUBTS = "version example sample order invoice isbn serial tracking section release build".split()

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_SPELLED = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9._-]{1,64}\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[(\[]dot[)\]]\x20?[A-Za-z0-9-]{1,63}){1,8}", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number holds."""
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def mod_97(account: str) -> bool:
    """Whether the check digits of an international account number hold: letters count 10 to 35."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ is looked at once: the name before it, as far as it reaches back, and the domain after."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            free = domain.end()
            yield start, free
        at = text.find("@", at + 1)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers with dots, taken in turn from each longest row of such numbers."""
    for run in _DOTTED.finditer(text):
        parts = [(m.start(), m.end()) for m in _DIGITS.finditer(text, *run.span())]
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            if all(len(n := text[a:b].lstrip("0")) < 3 or len(n) == 3 and n <= "255" for a, b in four):
                yield four[0][0], four[3][1]


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


def accounts(text: str) -> Iterator[tuple[int, int]]:
    """A proposal may run on into a word after the number; it is cut back at blanks until it checks."""
    for m in _IBAN.finditer(text):
        start, end = m.span()
        while end > start:
            account = text[start:end].replace(" ", "")
            if len(account) < 15:
                break
            if mod_97(account):
                yield start, end
                break
            end = text.rfind(" ", start, end)


def social_numbers(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


def _found(pattern: re.Pattern):
    return lambda text: (m.span() for m in pattern.finditer(text))


#: For each kind: what a text must hold, and the spans that its pattern and check confirm.
FINDERS = {
    "email": ("@", emails),
    "ip": (".", addresses),
    "card": ("", cards),
    "phone": ("+", phones),
    "iban": ("", accounts),
    "ssn": ("-", social_numbers),
    "local_phone": ("", _found(_LOCAL_PHONE)),
    "spelled_email": ("", _found(_SPELLED)),
}


def score(text: str, kind: str, start: int, end: int) -> int:
    """Hundredths: the prior of the kind, more if a word that speaks for it is near, less for doubts."""
    near = {w.lower() for w in _WORD.findall(text, max(0, start - BEFORE), start)}
    near |= {w.lower() for w in _WORD.findall(text, end, end + AFTER)}
    out = PRIOR[kind] + NEAR * bool(near.intersection(WORDS[kind])) - AGAINST * bool(near.intersection(DOUBTS))
    return max(0, min(100, out))


def merged(old: list[tuple[int, int]], new: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What two lists of ranges cover together, in order and without overlaps."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(old + new):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def overlaps(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    at = bisect.bisect_left(taken, (end, -1))
    return at > 0 and taken[at - 1][1] > start


def spans_of(text: str, threshold: int = THRESHOLD) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, score) of a text, by start, then in the order of KINDS."""
    has_digit = _DIGITS.search(text) is not None
    lowered = None
    out: list[tuple[str, int, int, int]] = []
    taken: list[tuple[int, int]] = []  # what the kinds before cover, in order and without overlaps
    for kind, (mark, find) in FINDERS.items():
        if kind == "spelled_email":
            lowered = text.lower() if lowered is None else lowered
            if not any(m in lowered for m in ("(at)", "[at]")):
                continue
        elif kind != "email" and not has_digit or mark not in text:
            continue
        mine = []
        for start, end in find(text):
            held = score(text, kind, start, end)
            if kind in BASE or held >= threshold and not overlaps(taken, start, end):
                mine.append((kind, start, end, held))
        if mine:
            out += mine
            taken = merged(taken, [(a, b) for _, a, b, _ in mine])
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.IntegerType())]))


def find_spans(df: DataFrame, text: str = "text", column: str = "pii", threshold: int = THRESHOLD) -> DataFrame:
    """`df` with `column`: an array of (kind, start, end, score) of the personal data in `text`, by start,
    then kind. A column of that name is replaced; all others are kept.

    Null and empty texts have none; a very long text is a slice by itself; repeated rows are judged
    each by themselves; an empty table gives an empty result. Base kinds are always reported, further
    kinds from `threshold` on, where they overlap nothing found before. Spans of one kind never overlap.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.int32())]))

    @F.arrow_udf(SPANS)
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = []
            for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
                for t in part.column(0).to_pylist():
                    found.append([dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans_of(t or "", threshold)])
            yield pa.array(found, kind)

    return df.drop(column).withColumn(column, spans(F.col(text).cast("string")))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def redacted(text: Column, spans: Column) -> Column:
    """`text` with each span of `find_spans` replaced by its kind in brackets; where spans of two kinds
    overlap, what is left of the later one is covered by it. Null stays null."""
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(held: Column, s: Column) -> Column:
        gap = F.substring(text, (held["at"] + 1).cast("int"), F.greatest(s["start"] - held["at"], F.lit(0)).cast("int"))
        mark = F.when(s["end"] > held["at"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise("")
        return F.struct(F.concat(held["done"], gap, mark).alias("done"), F.greatest(held["at"], s["end"]).alias("at"))

    return F.aggregate(spans, start, step, lambda held: F.concat(held["done"], F.substring(text, (held["at"] + 1).cast("int"), F.length(text))))
