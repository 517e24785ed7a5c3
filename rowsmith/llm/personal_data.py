"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score.

Base kinds (``email ip card phone``) follow fixed patterns, leftmost and without overlap per kind, and are
always reported when their check holds. The added kinds have weaker patterns and are reported when their
score reaches ``THRESHOLD``: an ``iban`` by its mod-97 checksum, a ``phone_local`` or ``ssn`` only next to words that speak
of one. Every span carries a score: prior of its kind, plus checksum, plus context within ``REACH`` characters.

All patterns are linear in the text: none can start again inside a run that has failed. Positions count code points, the
end excluded. A NULL text is empty and has no spans; equal ids and repeated rows stay rows of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm.common import small_batches

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "phone_local", "ssn")
KINDS = BASE + ADDED
REACH = 40
THRESHOLD = 0.7

#: Score of a span by its pattern alone, by its checksum, and by words near it. Reports of added kinds need THRESHOLD.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.4, "phone": 0.7, "iban": 0.3, "phone_local": 0.4, "ssn": 0.3}
CHECKED = {"card": 0.4, "iban": 0.6}
NEAR = {"email": 0.1, "ip": 0.3, "card": 0.2, "phone": 0.3, "iban": 0.1, "phone_local": 0.4, "ssn": 0.5}
AGAINST = -0.3

WORDS = {
    "email": ("mail", "contact", "address", "write to"),
    "ip": ("ip", "host", "server", "login", "address"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "payment", "cvv", "expires"),
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "whatsapp"),
    "iban": ("iban", "account", "bank", "transfer", "konto"),
    "phone_local": ("phone", "tel", "call", "mobile", "cell", "fax", "whatsapp"),
    "ssn": ("ssn", "social security", "tax id", "taxpayer"),
}
#: Words that speak against any kind of personal data.
OTHER_WORDS = ("version", "isbn", "order no", "invoice", "serial", "example number", "part no")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_CONTEXT = {
    kind: re.compile(r"(?<![a-z])(?:" + "|".join(map(re.escape, words)) + r")", re.IGNORECASE) for kind, words in WORDS.items()
}
_OTHER = re.compile(r"(?<![a-z])(?:" + "|".join(map(re.escape, OTHER_WORDS)) + r")", re.IGNORECASE)


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod97(text: str) -> bool:
    """The checksum of an account number: its first four characters moved to the end, letters as 10 to 35."""
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0  # where the next local part may start: after the last match and the last @
    at = text.find("@")
    while at >= 0:
        run = text[free:at]
        start = free + len(run.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for found in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in found.group().split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            yield found.span()


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for found in _CARD.finditer(text):
        digits = _digits(found.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield found.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for found in _PHONE.finditer(text):
        if 9 <= len(_digits(found.group())) <= 15:
            yield found.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for found in _IBAN.finditer(text):
        groups = found.group()
        # Capital words may stand right behind a number in groups, so groups are given back one by one.
        while len(groups.replace(" ", "")) >= 15:
            if mod97(groups.replace(" ", "")):
                yield found.start(), found.start() + len(groups)
                break
            groups = groups.rpartition(" ")[0]


FINDERS = {
    "email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans,
    "phone_local": lambda text: (m.span() for m in _LOCAL_PHONE.finditer(text)),
    "ssn": lambda text: (m.span() for m in _SSN.finditer(text)),
}


def score(text: str, kind: str, start: int, end: int) -> float:
    around = text[max(0, start - REACH) : start] + "\n" + text[end : end + REACH]
    value = PRIOR[kind] + CHECKED.get(kind, 0.0)
    value += NEAR[kind] * bool(_CONTEXT[kind].search(around)) + AGAINST * bool(_OTHER.search(around))
    return round(min(1.0, max(0.0, value)), 3)


def find_spans(text: str | None) -> list[Span]:
    """All spans by start, then kind in the order of ``KINDS``."""
    if not text:
        return []
    found = []
    for kind in KINDS:
        for start, end in FINDERS[kind](text):
            value = score(text, kind, start, end)
            if kind in BASE or value >= THRESHOLD:
                found.append(Span(start, end, kind, value))
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


SPANS = "array<struct<kind:string, start:long, end:long, score:double>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            [{"kind": s.kind, "start": s.start, "end": s.end, "score": s.score} for s in find_spans(text.as_py())]
            for text in batch.column("text")
        ]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, _SPAN_TYPE)], ["id", "spans"])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans (kind, start, end, score) of every row."""
    rows = small_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))
    return rows.mapInArrow(_span_rows, f"id long, spans {SPANS}").withColumnRenamed("id", id_col)


def _joined(column: str):
    shown = F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(shown, ",")


def _of_kind(column: str, kind: str):
    return F.size(F.filter(column, lambda s: s["kind"] == kind))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    rows = found.withColumn("base", base)
    counts = [_of_kind("base", kind).cast("long").alias(f"n_{kind}") for kind in BASE]
    hashed = F.sha2(_joined("base"), 256).alias("base_sha256")
    mean = F.aggregate("spans", F.lit(0.0), lambda total, s: total + s["score"]) / F.greatest(F.size("spans"), F.lit(1))
    return rows.select(id_col, *counts, hashed, _joined("spans").alias("spans"), mean.alias("mean_score"))


def base_hash(spans: list[Span]) -> str:
    """What ``digests`` gives as ``base_sha256``, for tests."""
    return hashlib.sha256(",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans if s.kind in BASE).encode()).hexdigest()
