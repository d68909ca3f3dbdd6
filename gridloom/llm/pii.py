"""Personal data: regular expressions propose spans, checksums and ranges confirm them, words nearby adjust their score.

Base kinds (all confirmed spans count): email, ip (parts at most 255), card (12 to 19 digits, Luhn), phone (`+`, 9 to 15
digits). The method adds, where the score reaches `MIN_SCORE` and no span of an earlier kind overlaps: iban (the
country's length and mod-97), ssn (a free-standing 3-2-4 number in an issued range, with words that name it nearby) and
tel (a phone number without country code, with words that name it nearby).

Every scan is linear in the text's length: runs of characters are consumed whole, so no pattern starts anew inside a run
that it has already rejected. Spans are code points, end exclusive. A null text is empty and has no spans; rows don't
depend on each other, so repeated rows get the same result and an empty table gives none; other columns are never read
(`redact` hands them on). Bytes that aren't UTF-8 count as replacement characters.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "tel")
MIN_SCORE = 0.5
#: Code points on either side in which words count, and what one of them adds.
NEARBY = 40
CONTEXT_BONUS = 0.3
#: Score of a confirmed span without words nearby: how much its own form says.
PRIOR = {"email": 0.7, "ip": 0.5, "card": 0.6, "phone": 0.6, "iban": 0.7, "ssn": 0.3, "tel": 0.3}
NAMED_BY = {
    "email": ("email", "mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "payment"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax", "cell"),
    "iban": ("iban", "account", "bank", "transfer", "konto"),
    "ssn": ("ssn", "social", "security"),
    "tel": ("phone", "tel", "telephone", "call", "mobile", "fax", "cell"),
}
#: Lengths of international bank account numbers by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "BA": 20, "BE": 16, "BG": 22, "BR": 29, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27,
    "GB": 22, "GI": 23, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15,
    "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}

LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a greedy match ends with its run of digits, so a match can only begin where a run does
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9])++|[A-Za-z0-9]++")
_SSN = re.compile(r"[0-9-]++")
_SSN_FORM = re.compile(r"([0-9]{3})-([0-9]{2})-([0-9]{4})")
_TEL = re.compile(r"[0-9().\x20-]{10,}+")
_TEL_FORM = re.compile(r"[\x20.-]*(\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4})[\x20.-]*")
_WORD = re.compile(r"[a-z]+")
_DIGIT = re.compile(r"[0-9]")
_LOWER = {a: a + 32 for a in range(65, 91)}

SPANS = "array<struct<kind: string, start: int, end: int, score: double>>"


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Whether a digit string's Luhn sum is a multiple of ten."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(int(x) * 2 - 9 * (x > "4") for x in even)) % 10 == 0


def mod97(number: str) -> bool:
    """Whether an account number's check digits hold: its first four characters last, letters as 10 to 35, remainder 1."""
    return int("".join(str(int(x, 36)) for x in number[4:] + number[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        run = len(before) - len(before.rstrip(LOCAL_PART))
        m = _DOMAIN.match(text, at) if run else None
        if m:
            yield at - run, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        parts = [x.lstrip("0") for x in m[0].split(".")]
        if all(len(x) <= 3 and int(x or "0") <= 255 for x in parts):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= x <= "9" for x in m[0]) <= 15:
                yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        if m.end() - m.start() < 15 or not (long := IBAN_LENGTH.get(m[0][:2])) or not m[0][2:4].isdigit():
            continue
        whole = m[0]
        if len(whole.replace(" ", "")) < long:
            continue
        n = end = 0
        while n < long:
            n += whole[end] != " "
            end += 1
        after = text[m.start() + end : m.start() + end + 1]
        if not (after.isascii() and after.isalnum()) and mod97(whole[:end].replace(" ", "")):
            yield m.start(), m.start() + end


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        if m.end() - m.start() == 11 and (f := _SSN_FORM.fullmatch(m[0])) and f[1] not in ("000", "666") and f[1] < "900" and f[2] != "00" and f[3] != "0000":
            yield m.span()


def _tels(text: str) -> Iterator[tuple[int, int]]:
    for m in _TEL.finditer(text):
        if f := _TEL_FORM.fullmatch(m[0]):
            yield m.start() + f.start(1), m.start() + f.end(1)


_FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "ssn": _ssns, "tel": _tels}
_HOLDS_DIGITS = tuple(k for k in KINDS if k != "email")


def score(text: str, kind: str, start: int, end: int) -> float:
    """What the form says, and more if one of the kind's words stands within NEARBY code points."""
    near = f"{text[max(0, start - NEARBY) : start]} {text[end : end + NEARBY]}".translate(_LOWER)
    return round(PRIOR[kind] + CONTEXT_BONUS * (not set(NAMED_BY[kind]).isdisjoint(_WORD.findall(near))), 3)


def spans_of(text: str | None) -> list[Span]:
    """All spans of a text, by start, then kind as listed."""
    text = text or ""
    found = [Span("email", a, b, score(text, "email", a, b)) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for kind in _HOLDS_DIGITS:
            added = [Span(kind, a, b, score(text, kind, a, b)) for a, b in _FINDERS[kind](text)]
            if kind not in BASE and added:
                added = _apart([s for s in added if s.score >= MIN_SCORE], found)
            found += added
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def _apart(added: list[Span], found: list[Span]) -> list[Span]:
    """The added spans that overlap none found before."""
    starts, ends = [], []  # of the stretches that spans found before cover
    for s in sorted(found, key=lambda s: s.start):
        if ends and s.start <= ends[-1]:
            ends[-1] = max(ends[-1], s.end)
        else:
            starts.append(s.start)
            ends.append(s.end)
    before = lambda s: bisect_left(starts, s.end)
    return [s for s in added if not before(s) or ends[before(s) - 1] <= s.start]


def said(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def _texts(column) -> Iterator[str]:
    """Texts of an Arrow string column one by one."""
    import pyarrow as pa

    for x in column.cast(pa.binary()):
        yield x.as_py().decode(errors="replace") if x.is_valid else ""


def detect(text: Column) -> Column:
    """Of a text column: its spans with kind, start, end and score."""

    @arrow_udf(SPANS)
    def run(column):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        return pa.array([[s._asdict() for s in spans_of(t)] for t in _texts(column)], kind)

    return run(text)


def redact(docs: DataFrame, text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The same rows and columns, every span of min_score or more replaced by its kind in angle brackets (overlapping ones by the first's); a null text stays null."""

    @arrow_udf("string")
    def run(column):
        import pyarrow as pa

        return pa.array([None if not x.is_valid else masked(t, min_score) for x, t in zip(column, _texts(column), strict=True)], pa.string())

    return docs.withColumn(text, run(F.col(text)))


def masked(text: str, min_score: float = MIN_SCORE) -> str:
    out, done, shown = [], 0, 0
    for s in spans_of(text):
        if s.score < min_score:
            continue
        if s.start >= done:
            out += [text[shown : s.start], f"<{s.kind}>"]
        shown = done = max(done, s.end)
    return "".join([*out, text[shown:]])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, spans, n_email, n_ip, n_card, n_phone, base_sha256, and all spans as kind:start:end, of every row."""
    fields = "struct<n_email: bigint, n_ip: bigint, n_card: bigint, n_phone: bigint, base_sha256: string, spans: string, scores: string>"

    @arrow_udf(fields)
    def run(column):
        import pyarrow as pa

        rows = []
        for t in _texts(column):
            spans = spans_of(t)
            base = [s for s in spans if s.kind in BASE]
            count = {f"n_{k}": sum(s.kind == k for s in base) for k in BASE}
            rows.append(count | {"base_sha256": hashlib.sha256(said(base).encode()).hexdigest(), "spans": said(spans), "scores": ",".join(f"{s.score:.1f}" for s in spans)})
        return pa.array(rows, pa.struct([(f"n_{k}", pa.int64()) for k in BASE] + [(x, pa.string()) for x in ("base_sha256", "spans", "scores")]))

    return docs.select("doc_id", run("text").alias("r")).select("doc_id", "r.*")
