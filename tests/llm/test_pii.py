import hashlib
import random
import re

from lodestone.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain(text):
    """The base spans by the patterns as they are stated."""
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(x) <= 255 for x in m.group().split(".")),
                "card": lambda digits=digits: 12 <= len(digits) <= 19 and plain_luhn(digits),
                "phone": lambda digits=digits: 9 <= len(digits) <= 15,
            }[kind]()
            if ok:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def base(text):
    return [(k, a, b) for k, a, b, _ in pii.spans_of(text) if k in pii.BASE]


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    pieces = ["a", "é😀", "@", ".", "..", "-", " ", "_", "+", "+1", "(", ")", "4", "12", "255", "256", "007", "1.2.3.4", "x@y.z", "4876179267539117", "4111 1111-1111 1111", "+1 (873) 555-4781", "\n", "d.e", "%", "@b.c_d@e.f"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 24)))
        assert base(text) == plain(text), text


def test_long_runs_take_time_in_proportion():
    for text in ("7" * 300_000, "a" * 300_000 + "@", "1." * 200_000, "+1" + "(" * 300_000, "a@b." * 100_000, "A" * 300_000, "1 " * 150_000):
        pii.spans_of(text)


def test_checks_and_context():
    assert pii.mod_97("GB82WEST12345698765432") and not pii.mod_97("GB82WEST12345698765431")
    kinds = lambda text: [s[0] for s in pii.spans_of(text)]
    assert kinds("account GB82 WEST 1234 5698 7654 32 is mine") == ["iban"] and kinds("GB82 WEST 1234 5698 7654 33") == []
    assert kinds("my SSN 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == [] and kinds("ssn 666-45-6789") == []
    assert kinds("call (555) 123-4567 now") == ["local_phone"] and kinds("see 555 123 4567") == []
    assert kinds("write to ann (at) mail [dot] org") == ["spelled_email"]
    # A phone number that is a base span isn't reported again as a local one.
    assert kinds("phone +1 (873) 555-4781") == ["phone"]
    near, far, doubt = (pii.spans_of(t)[0][3] for t in ("server 10.0.0.1", "xx 10.0.0.1", "version 10.0.0.1"))
    assert near > far > doubt


def test_query_against_plain(spark, docs):
    rng = random.Random(9)
    words = ["the", "é", "a.b@c.de", "1.2.3.4", "4876179267539117", "+1 (873) 555-4781", "ssn", "123-45-6789", "\n"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for k in range(60)]
    rows += [(100, None), (101, ""), (None, "x@y.zz"), (3, rows[3][1]), (200, "lorem ipsum " * 60_000 + "q@r.st")]
    got = sorted(queries.pii_digests(docs(rows)).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for r, (k, text) in zip(got, want, strict=True):
        spans = plain(text or "")
        assert r["doc_id"] == k and [r[f"n_{x}"] for x in pii.BASE] == [sum(s[0] == x for s in spans) for x in pii.BASE]
        told = ",".join(f"{x}:{a}:{b}" for x, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert set(filter(None, told.split(","))) <= set(r["spans"].split(","))
    assert queries.pii_digests(docs([])).count() == 0


def test_other_columns_and_redaction(spark):
    rows = spark.createDataFrame([(1, "to a@b.cc, card 4876179267539117!", "old"), (2, None, "old"), (3, "none", "old")], "id int, body string, pii string")
    out = pii.find_spans(rows, "body")
    assert out.columns == ["id", "body", "pii"]
    got = {r["id"]: r["t"] for r in out.select("id", pii.redacted(out["body"], out["pii"]).alias("t")).collect()}
    assert got == {1: "to [email], card [card]!", 2: None, 3: "none"}
