"""Personal data against plain regular expressions, and the query against its SQL on odd texts."""

import hashlib
import random
import re
import time

import duckdb
import pytest

from gridloom.llm import pii

from .. import duck

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CARD, IBAN = "4539 1488 0343 6467", "DE89 3704 0044 0532 0130 00"


def luhn(digits):
    total = 0
    for k, x in enumerate(reversed(digits)):
        v = int(x) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def holds(kind, found):
    digits = re.sub("[^0-9]", "", found)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in found.split(".")), "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def base(text):
    return {(k, m.start(), m.end()) for k, form in FORMS.items() for m in re.finditer(form, text) if holds(k, m[0])}


def random_texts(n, seed=3):
    rng = random.Random(seed)
    bits = ["a", "B2", "@", ".", "..", "x.y", "1", "12", "255", "256", "007", " ", "-", "+", "+1", "(", ")", "é", "\U0001f600", "\n", "%", CARD, IBAN, "1.2.3.4", "136 555-7479", "123-45-6789", "call ", "ssn ", "iban ", "GB82WEST12345698765432", "m@d.co", "0" * 12]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_base_spans_equal_plain_expressions():
    for text in random_texts(4000):
        got = {(s.kind, s.start, s.end) for s in pii.spans_of(text)}
        assert {s for s in got if s[0] in pii.BASE} == base(text), text


def test_added_spans_overlap_nothing_and_are_in_order():
    for text in random_texts(3000, 8):
        spans = pii.spans_of(text)
        assert spans == sorted(spans, key=lambda s: (s.start, pii.KINDS.index(s.kind)))
        for s in spans:
            if s.kind not in pii.BASE:
                assert s.score >= pii.MIN_SCORE and not any(x is not s and x.start < s.end and s.start < x.end for x in spans)


def docs_with(spark, texts):
    return spark.createDataFrame([(i, t, "s", 7, "k") for i, t in enumerate(texts)], "doc_id long, text string, spans string, score int, kind string")


def test_query_equals_sql_on_odd_texts(spark):
    from gridloom.llm.oracles import ORACLES

    texts = [None, "", " ", *random_texts(1500, 5)]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    duck.compare(c, pii.find(docs_with(spark, texts)), ORACLES["op12_personal_data"])


def test_query_equals_sql(spark):
    from gridloom.llm.queries import oracle_sql, queries

    duck.compare(duck.connect(), queries()["op12_personal_data"](spark, duck.SF), oracle_sql()["op12_personal_data"])


@pytest.mark.parametrize(
    ("text", "said"),
    [
        (f"pay by card {CARD}.", "card:12:31"),
        (f"{CARD[:-1]}8", ""),  # the sum fails
        (f"iban {IBAN}, thanks", "iban:5:32"),
        ("IBAN DE89 3704 0044 0532 0130 01", ""),
        ("GB82WEST12345698765432", "iban:0:22"),
        ("GB82WEST123456987654321", ""),
        ("her ssn is 123-45-6789", "ssn:11:22"),
        ("part 123-45-6789 of the list", ""),  # no word says what it is
        ("ssn 666-45-6789 or 123-00-6789, 123-45-67890", ""),
        ("call (136) 555-7479 now", "tel:5:19"),
        ("number (136) 555-7479 of", ""),
        ("call +1 (136) 555-7479", "phone:5:22"),
        ("1.2.3.4.5.6.7.8", "ip:0:7,ip:8:15"),
        ("300.1.1.1.1", ""),
        ("a@b.c%d@e.f", "email:0:5,email:5:11"),
        ("é\U0001f600 x@y.z", "email:3:8"),
        ("x.y@4539148803436467.com 10.0.0.1", "email:0:24,card:4:20,ip:25:33"),
    ],
)
def test_cases(text, said):
    assert pii.said(pii.spans_of(text)) == said


def test_words_nearby_raise_the_score():
    assert [s.score for s in pii.spans_of(f"card {CARD}")] == [0.9] and [s.score for s in pii.spans_of(f"code {CARD}")] == [0.6]
    assert [s.score for s in pii.spans_of(f"card{' ' * 60}{CARD}")] == [0.6]


def test_rows(spark):
    rows = sorted(pii.find(docs_with(spark, [None, "", "a@b.c", "a@b.c"])).collect())
    assert [r.n_email for r in rows] == [0, 0, 1, 1] and rows[0].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[2].base_sha256 == hashlib.sha256(b"email:0:5").hexdigest()
    assert pii.find(docs_with(spark, ["x"]).filter("false")).collect() == []


def test_redacted_text_keeps_the_rest(spark):
    df = docs_with(spark, [None, f"write to a@b.c or 1.2.3.4, card {CARD}!", "clean text, 12 of 300"])
    out = pii.redact(df)
    assert out.columns == df.columns
    assert [r.text for r in out.orderBy("doc_id").collect()] == [None, "write to <email> or <ip>, card <card>!", "clean text, 12 of 300"]
    assert pii.masked("x@4539148803436467.com y") == "<email> y"


@pytest.mark.parametrize("unit", ["a", "1", "@", "+1", "1.", "1 ", "A", "DE89", "-", "(", "a@b.", "123-45-6789 ", "+1 "])
def test_long_texts_take_linear_time(unit):
    text = unit * (400_000 // len(unit))
    began = time.process_time()
    pii.spans_of(text)
    assert time.process_time() - began < 8
