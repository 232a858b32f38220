"""Repair of conversations: the cheapest edits that give an allowed order of roles.

Each message is a symbol of its role and fault. Strings of symbols are compressed by a grammar that all
conversations share (the most frequent pairs become rules, round by round); a rule has one matrix of
least costs between the states of the order of roles, with the letters of the edits as a rope of its
two parts' ropes. What is left of a string is a product of few matrices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import saved
from .merkle import field_text

#: Costs of edits: delete, insert, another role, a message left truncated.
DELETE, INSERT, REROLE, LEFT_CUT = 4, 3, 3, 3
#: States of `(s?(ua)+)?`: nothing yet, after system, after user, after assistant. First and last may end.
STATES, FINAL = range(4), (0, 3)
#: Where a role leads: state to state.
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ROLES = {2: "user", 3: "assistant"}
#: Messages of a segment of a conversation; segments are evaluated apart and joined in order.
SEGMENT_BITS = 10
#: Rounds of the grammar and rules of a round: they bound how far strings are compressed, no result.
ROUNDS, RULES = 8, 32
#: Rows of a batch of results.
BATCH_ROWS = 1024
_GAP = r"\x20\x09-\x0D"

Rope = str | tuple
Matrix = list[list[tuple[int, Rope] | None]]


def damaged(messages: DataFrame) -> DataFrame:
    """`messages` (conv_id, turn, role, text) damaged by their checksums, as a test bed: of 20 parts one
    is dropped (`gone`), one loses its text, one its marks at the end of sentences, one is repeated, one
    gets the role of a user. Null role and text are one space."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    rows = messages.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), code.alias("code"))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("code") == 0).alias("gone"))


# --- matrices ----------------------------------------------------------------------------------


def spelled(rope: Rope) -> str:
    """The letters of a rope."""
    out, stack = [], [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            out.append(top)
        else:
            stack += (top[1], top[0])
    return "".join(out)


def least(a: tuple[int, Rope] | None, b: tuple[int, Rope] | None):
    """The cheaper of two, at equal cost the one whose letters come first."""
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if spelled(b[1]) < spelled(a[1]) else a


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = []
    for row in a:
        cells = []
        for r in STATES:
            best = None
            for q in STATES:
                if (x := row[q]) is not None and (y := b[q][r]) is not None:
                    best = least(best, (x[0] + y[0], (x[1], y[1])))
            cells.append(best)
        out.append(cells)
    return out


def inserts() -> Matrix:
    """Any number of inserted messages."""
    out: Matrix = [[(0, "") if p == q else None for q in STATES] for p in STATES]
    for p in STATES:
        at, n = p, 0
        for _ in STATES:
            at, n = next(steps[at] for role, steps in STEPS.items() if role in "ua" and at in steps), n + 1
            out[p][at] = least(out[p][at], (INSERT * n, "I" * n))
    return out


def symbol_matrix(symbol: str) -> Matrix:
    """Inserts, then one message: `d` must go, others are a role's initial (`x`: none that fits), in
    upper case if the text is cut short."""
    one: Matrix = [[(DELETE, "D") if p == q else None for q in STATES] for p in STATES]
    if symbol != "d":
        more = LEFT_CUT if symbol.isupper() else 0
        for role, cost, letter in (("u", REROLE, "R"), ("a", REROLE, "R"), (symbol.lower(), 0, "K")):
            for p, q in STEPS.get(role, {}).items():
                one[p][q] = least(one[p][q], (cost + more, letter))
    return product(inserts(), one)


SYMBOLS = "suaxSUAXd"


def matrices(rules: list[tuple[str, str]]) -> dict[str, Matrix]:
    """A matrix for every symbol and, from the first to the last, for every rule (pair, new symbol)."""
    out = {s: symbol_matrix(s) for s in SYMBOLS}
    for pair, new in rules:
        out[new] = product(out[pair[0]], out[pair[1]])
    return out


def evaluated(text: str, rules: list[tuple[str, str]], known: dict[str, Matrix]) -> Matrix:
    """The matrix of a string: compressed by the rules, then multiplied as a balanced tree."""
    for pair, new in rules:
        text = text.replace(pair, new)
    line = [known[s] for s in text]
    while len(line) > 1:
        line = [product(*line[k : k + 2]) if k + 1 < len(line) else line[k] for k in range(0, len(line), 2)]
    return line[0]


# --- grammar -----------------------------------------------------------------------------------


def grammar(strings: DataFrame) -> list[tuple[str, str]]:
    """Rules (pair, new symbol) for `strings` (seq, weight). In each round all pairs of neighbours are
    counted, and the most frequent that cannot overlap one another are replaced; a round hands at most
    RULES pairs to the driver. It ends when no pair occurs twice."""
    rules: list[tuple[str, str]] = []
    for _ in range(ROUNDS):
        text = F.col("seq")
        if rules:
            held = F.array(*[F.struct(F.lit(p).alias("pair"), F.lit(n).alias("new")) for p, n in rules])
            text = F.aggregate(held, text, lambda s, r: F.replace(s, r["pair"], r["new"]))
        short = strings.select("weight", text.alias("s")).where(F.length("s") > 1)
        pairs = short.select("weight", F.explode(F.expr("transform(sequence(1, length(s) - 1), i -> substring(s, i, 2))")).alias("pair"))
        counted = pairs.groupBy("pair").agg(F.sum("weight").alias("n")).where("n > 1").orderBy(F.desc("n"), "pair").limit(RULES).collect()
        left: set[str] = set()
        right: set[str] = set()
        fresh = []
        for pair, _ in counted:
            a, b = pair
            if a in right or b in left or a == b and (a in left or b in right):
                continue
            left.add(a)
            right.add(b)
            fresh.append((pair, chr(0xE000 + len(rules) + len(fresh))))
        if not fresh:
            break
        rules += fresh
    return rules


# --- repair ------------------------------------------------------------------------------------

CELLS = "costs array<long>, audits array<string>"


def with_matrices(strings: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(seq, costs, audits) of distinct strings: 16 cells, state by state; null where there is no way."""
    known = matrices(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                seq = batch.column("seq").slice(at, 256)
                cells = [[c for row in evaluated(s, rules, known) for c in row] for s in seq.to_pylist()]
                costs = pa.array([[c and c[0] for c in m] for m in cells], pa.list_(pa.int64()))
                audits = pa.array([[c and spelled(c[1]) for c in m] for m in cells], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([seq, costs, audits], names=["seq", "costs", "audits"])

    return strings.select("seq").mapInArrow(run, f"seq string, {CELLS}")


def segments(rows: DataFrame) -> DataFrame:
    """(conv_id, part, chunk, seq, roles, blank, duplicate, truncated): messages in order, in segments of at
    most 1,024. A range partitioning puts them in order, so a long conversation is spread over tasks;
    what was said before is told by the least number of its digest, which is found by an aggregation."""
    order = ["conv_id", "turn", "role", "head", "digest"]
    blank = ~F.col("text").rlike(f"[^{_GAP}]")
    cut = ~F.col("text").rlike(rf"[.!?][{_GAP}]*\z")
    first = F.substring("role", 1, 1)
    keys = rows.select(*order, blank.alias("is_blank"), cut.alias("is_cut"), F.when(first.isin(*STEPS), first).otherwise("x").alias("initial"))
    numbered = saved(keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("n", F.monotonically_increasing_id()).drop("turn", "role", "head"))
    firsts = numbered.where("not is_blank").groupBy("digest").agg(F.min("n").alias("n")).select("n", F.lit(True).alias("is_first"))
    told = numbered.drop("digest").join(firsts, "n", "left")
    fault = F.when(F.col("is_blank"), "b").when(F.col("is_first").isNull(), "d").when(F.col("is_cut"), "t")
    told = told.withColumn("fault", fault)
    symbol = F.when(F.col("fault").isin("b", "d"), "d").when(F.col("fault") == "t", F.upper("initial")).otherwise(F.col("initial"))
    place = {"part": F.shiftright("n", 33), "chunk": F.shiftright(F.col("n").bitwiseAND((1 << 33) - 1), SEGMENT_BITS)}
    lines = F.array_sort(F.collect_list(F.struct("n", symbol.alias("symbol"), "initial")))
    counts = [F.count_if(F.col("fault") == f).alias(c) for f, c in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))]
    out = told.withColumns(place).groupBy("conv_id", "part", "chunk").agg(lines.alias("lines"), *counts)
    joined = lambda c: F.array_join(F.transform("lines", lambda x: x[c]), "")
    return saved(out.select("conv_id", "part", "chunk", joined("symbol").alias("seq"), joined("initial").alias("roles"), "blank", "duplicate", "truncated"))


class Fold:
    """What is known of a conversation after its segments so far."""

    def __init__(self):
        self.gaps = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last = ""
        self.ways: list = [(0, ""), None, None, None]

    def add(self, r: dict) -> None:
        self.blank += r["blank"]
        self.duplicate += r["duplicate"]
        self.truncated += r["truncated"]
        roles = self.last + r["roles"]
        self.illegal += sum(roles[k : k + 2] not in ("su", "ua", "au") for k in range(len(roles) - 1))
        self.last = roles[-1:]
        cells = [None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"], strict=True)]
        self.ways = product([self.ways], [cells[4 * p : 4 * p + 4] for p in STATES])[0]

    def result(self) -> tuple[int, str]:
        ends = product([self.ways], inserts())[0]
        best = None
        for q in FINAL:
            best = least(best, ends[q])
        return best[0], spelled(best[1])


def repair(messages: DataFrame) -> DataFrame:
    """The repaired conversations of `messages` (conv_id, turn, role, text; with `gone`, rows that only tell
    that a conversation is there). Rows: for each conversation one of position -1 with its report
    (gaps, blank, duplicate, truncated, illegal, cost, audit), then its messages (position from 0, edit,
    role, text), all in this order and next to each other in a partition.

    Messages are taken by turn, null first; those of one turn by role, then text. Null role and text are
    one space; a null conv_id is a conversation of its own. Repeated rows are duplicates. Very long texts
    are held one batch at a time; an empty table gives none; other columns are ignored. A conversation
    may be any length: its order is found in parts, and only at the end do its messages, in batches,
    pass through one task, where the edits are applied in order.
    """
    gone = F.col("gone") if "gone" in messages.columns else F.lit(False)
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    every = messages.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), F.coalesce(gone, F.lit(False)).alias("gone"))
    head = F.substring("text", 1, 32)  # nearly always tells texts of one turn apart, else their digests do
    rows = every.where("not gone").withColumns({"head": head, "digest": F.sha2(F.concat(field_text(F.col("conv_id")), field_text(F.col("role")), field_text(F.col("text"))), 256)})

    parts = segments(rows)
    strings = saved(parts.groupBy("seq").agg(F.count("*").alias("weight")))
    solved = parts.join(with_matrices(strings, grammar(strings)), "seq").drop("seq")
    live = F.when(~F.col("gone"), F.col("turn"))
    gaps = F.coalesce(F.max(live) - F.min(live) + 1 - F.countDistinct(live), F.lit(0))
    totals = every.groupBy("conv_id").agg(gaps.cast("long").alias("gaps"))
    stream = totals.withColumn("kind", F.lit(0)).unionByName(solved.withColumn("kind", F.lit(1)), True)
    stream = stream.unionByName(rows.drop("gone").withColumn("kind", F.lit(2)), True)
    order = ["conv_id", "kind", "part", "chunk", "turn", "role", "head", "digest"]
    stream = stream.repartition("conv_id").sortWithinPartitions(*order)

    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = T.StructType([
        messages.schema["conv_id"], T.StructField("position", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()), *[T.StructField(c, T.LongType()) for c in numbers], T.StructField("audit", T.StringType()),
    ])
    form = to_arrow_schema(schema)

    def edits(conv, state: dict) -> Iterator[tuple]:
        """Reports and inserted messages up to the next that was there."""
        if state["audit"] is None:
            fold = state["fold"]
            cost, state["audit"] = fold.result()
            counts = (fold.gaps, fold.blank, fold.duplicate, fold.truncated, fold.illegal, cost)
            yield (conv, -1, None, None, None, *counts, state["audit"])
        while state["at"] < len(state["audit"]) and state["audit"][state["at"]] == "I":
            yield step(conv, state, "I", None, "")

    def step(conv, state: dict, edit: str, role: str | None, text: str) -> tuple:
        if edit == "K":
            state["where"] = STEPS[role[:1]][state["where"]]
        else:
            state["where"] = 3 if state["where"] == 2 else 2
            role = ROLES[state["where"]]
        state["at"] += 1
        state["position"] += 1
        return (conv, state["position"] - 1, edit, role, text, *[None] * len(numbers), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, out, held = None, None, [], 0

        def full(force: bool = False):
            nonlocal out, held
            if out and (force or len(out) >= BATCH_ROWS or held > 1 << 22):
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, form, strict=True)], schema=form)
                out, held = [], 0

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for r in batch.slice(at, 256).to_pylist():
                    if r["kind"] == 0:
                        if state is not None:
                            out += edits(conv, state)
                        conv, state = r["conv_id"], {"fold": Fold(), "audit": None, "at": 0, "where": 0, "position": 0}
                        state["fold"].gaps = r["gaps"]
                    elif r["kind"] == 1:
                        state["fold"].add(r)
                    else:
                        out += edits(conv, state)
                        edit = state["audit"][state["at"]]
                        if edit == "D":
                            state["at"] += 1
                        else:
                            out.append(step(conv, state, edit, r["role"], r["text"]))
                            held += len(r["text"])
                    yield from full()
        if state is not None:
            out += edits(conv, state)
        yield from full(force=True)

    return stream.mapInArrow(run, schema)


def repaired_messages(repaired: DataFrame) -> DataFrame:
    """The messages of `repair`'s result."""
    return repaired.where("position >= 0").select("conv_id", "position", "edit", "role", "text")


def digests(repaired: DataFrame) -> DataFrame:
    """The reports of `repair`, each with the digest of its messages as `role:text` lines. It reads
    `repair`'s own result, whose rows lie in order."""
    kept = [f for f in repaired.schema.fields if f.name not in ("position", "edit", "role", "text")]
    schema = T.StructType([*kept, T.StructField("repaired_sha256", T.StringType())])
    form = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report, sha, out = None, None, []

        def full(force: bool = False):
            nonlocal out
            if out and (force or len(out) >= BATCH_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), form, strict=True)], schema=form)
                out = []

        for batch in batches:
            for r in batch.to_pylist():
                if r["position"] < 0:
                    if report is not None:
                        out.append((*report, sha.hexdigest()))
                    report, sha = [r[f.name] for f in kept], hashlib.sha256()
                    yield from full()
                else:
                    sha.update(("\n" * (r["position"] > 0) + f"{r['role']}:{r['text']}").encode())
        if report is not None:
            out.append((*report, sha.hexdigest()))
        yield from full(force=True)

    return repaired.mapInArrow(run, schema)
