from __future__ import annotations

import random
import re
import time

import pytest

from rowsmith.llm import personal_data as pd

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and pd.luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def plain_spans(text):
    found = [(m.start(), list(PATTERNS).index(k), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if holds(k, m.group())]
    return sorted(found)


def test_base_spans_equal_the_patterns():
    random.seed(1)
    pieces = [*"ab.@-+ 0123456789()%é\n", "12.34.5.6", "4111111111111111", "a@b.c", "+1 (974) 555-3436", "0000"]
    for _ in range(8000):
        text = "".join(random.choices(pieces, k=random.randrange(30)))
        assert [(s.start, pd.BASE.index(s.kind), s.end) for s in pd.find_spans(text) if s.kind in pd.BASE] == plain_spans(text)


def test_checksums():
    assert pd.luhn("4111111111111111") and not pd.luhn("4111111111111112")
    assert pd.mod97("GB82WEST12345698765432") and not pd.mod97("GB82WEST12345698765431")


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("pay to GB82 WEST 1234 5698 7654 32 NOW", ["iban"]),
        ("pay to GB83 WEST 1234 5698 7654 32 NOW", []),
        ("call me at (415) 555-1234 today", ["phone_local"]),
        ("sizes are (415) 555-1234 here", []),
        ("my ssn is 123-45-6789", ["ssn"]),
        ("part 123-45-6789", []),
    ],
)
def test_added_kinds_need_a_checksum_or_context(text, kinds):
    assert [s.kind for s in pd.find_spans(text)] == kinds


def test_context_moves_the_score():
    plain, near = pd.find_spans("x 4111111111111111 y")[0], pd.find_spans("credit card 4111111111111111")[0]
    assert near.score > plain.score > pd.find_spans("invoice 4111111111111111")[0].score


@pytest.mark.parametrize("piece", ["a", "1", "1.", "@", "+1", "1 ", "A", "AA11", "(123)", "a.", "12-"])
def test_long_runs_take_linear_time(piece):
    began = time.process_time()
    pd.find_spans(piece * (300_000 // len(piece)) + "@")
    assert time.process_time() - began < 6


def test_hard_rows(hard_docs, no_docs, docs_of):
    found = pd.digests(pd.personal_data(hard_docs)).collect()
    assert len(found) == 10
    assert {r.base_sha256 for r in found} == {pd.base_hash([])}
    assert pd.personal_data(no_docs).count() == 0
    row = pd.digests(pd.personal_data(docs_of(["👍 a@b.cd and 10.0.0.1"]))).first()
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone, row.spans) == (1, 1, 0, 0, "email:2:8,ip:13:21")
