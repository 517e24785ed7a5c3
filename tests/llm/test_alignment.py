from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from rowsmith.llm import alignment
from rowsmith.llm.token_files import _byte_letters

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    """Tokens and links of a text, one token at a time."""
    tokenizer, model = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    tokenizer.encode_special_tokens = True
    shown = _byte_letters()
    letters = {shown.get(b, chr(b)): b for b in range(256)}

    def of_piece(i):
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("\u2581", " ").encode()

    def aligned(text):
        ids_a = tokenizer.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = model.encode(text or "")
        parts_a = [bytes(letters[c] for c in tokenizer.id_to_token(i)) for i in ids_a]
        parts_b = [of_piece(i) for i in ids_b]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(parts_a) != raw or b"".join(parts_b) != raw:
            return [], [], [], []
        ends_b = {e: j for j, e in enumerate(np.cumsum([len(p) for p in parts_b]).tolist())}
        links, groups, i0, j0 = [], [], 0, 0
        for i, end in enumerate(np.cumsum([len(p) for p in parts_a]).tolist()):
            if end in ends_b:
                j = ends_b[end]
                links.append((ids_a[i], ids_b[j]))
                groups.append(f"{','.join(map(str, ids_a[i0 : i + 1]))}|{','.join(map(str, ids_b[j0 : j + 1]))}")
                i0, j0 = i + 1, j + 1
        return ids_a, ids_b, links, groups

    return aligned


def plain_rows(plain, docs):
    found = {i: plain(t) for i, t in docs}
    counts = Counter(link for _, _, links, _ in found.values() for link in links)
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return {
        (i, len(a), len(b), len(groups), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")
        for i, (a, b, links, groups) in found.items()
    }


def digests(docs):
    found = alignment.alignment_digests(docs, *PATHS)
    return [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found.collect()]


def test_equals_token_by_token(spark, docs_of, plain, monkeypatch):
    rng = random.Random(4)
    parts = ["the", " ", "  ", "\n", "naïve", "日本語", "👍🏽", "<s>", "<|endoftext|>", "<0x41>", "\x00", "1234", "can't", "\u2581", "é", "\u3000", "zq"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(60))) for _ in range(150)]
    texts += [None, "", " ", "word " * 9000, "x" * 5000, "\t" * 700, "日" * 900]
    assert set(digests(docs_of(texts).repartition(3))) == plain_rows(plain, enumerate(texts))


def test_the_query_equals_token_by_token(spark, plain):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    found = digests(docs)
    assert set(found) == plain_rows(plain, [tuple(r) for r in docs.collect()])
    assert len(found) == docs.count()


def test_lanes_and_batches_change_nothing(plain, monkeypatch):
    texts = ["", "a b c " * 300, "日本" * 100, "", "x", "The cat\n" * 200]
    both = alignment.Vocabularies(*PATHS)
    expected = [plain(t) for t in texts]
    for lane, reach in ((3, 1), (7, 3), (1 << 20, 1)):
        monkeypatch.setattr(alignment, "LANE", lane)
        monkeypatch.setattr(alignment, "REACH", reach)
        rows = alignment.align_texts(texts, both)
        assert alignment.group_texts(rows, alignment._written(60_000)) == [";".join(e[3]).encode() for e in expected]
        for (a, b, cuts_a, cuts_b), (ids_a, ids_b, links, _) in zip(rows, expected, strict=True):
            assert (a.tolist(), b.tolist()) == (ids_a, ids_b)
            assert [(a[i - 1], b[j - 1]) for i, j in zip(cuts_a, cuts_b, strict=True)] == links


def test_alignments_hold_ids_and_cuts(docs_of, plain):
    texts = ["The naïve cat.", None, "日本 x", "a\u2581b"]
    for r in alignment.alignments(docs_of(texts), *PATHS).collect():
        ids_a, ids_b, links, _ = plain(texts[r.doc_id])
        assert (r.a_ids, r.b_ids) == (ids_a, ids_b)
        assert [(r.a_ids[i - 1], r.b_ids[j - 1]) for i, j in zip(r.a_cuts, r.b_cuts, strict=True)] == links


def test_both_encoders_equal_the_libraries(plain):
    rng = random.Random(6)
    parts = [" ", "\n", "the", "Ab", "é", "1", "½", "_", "'s", "'", "!", "$$", "\u2581", "\x00", "👍", "\r\n", "日", "<|endoftext|>", "<s>", "\u0301", "\t", "  ", "don't"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 9))) for _ in range(4000)]
    both = alignment.Vocabularies(*PATHS)
    texts += [" " * 1_000_000, "a" + "\n" * 3000 + "b", "\t " * 999]
    for text, (a, b) in zip(texts, both.encoded(texts), strict=True):
        assert (a.tolist(), b.tolist()) == plain(text)[:2], repr(text[:99])


def test_possible_pairs_end_alike():
    both = alignment.Vocabularies(*PATHS)
    assert (np.diff(both.pairs) > 0).all()
    longest = sum(map(len, both.bytes_a)) + sum(map(len, both.bytes_b))
    assert len(both.pairs) < 2 * longest
    for key in both.pairs[:: len(both.pairs) // 500]:
        a, b = both.bytes_a[key >> 32], both.bytes_b[key & 0xFFFFFFFF]
        assert a.endswith(b) or b.endswith(a)


def test_hard_rows(hard_docs, no_docs):
    found = digests(hard_docs)
    assert len(found) == 10
    assert {f[0] for f in found if f[1:] == (0, 0, 0, 0, 0, 0, "")} == {3, 4}
    assert digests(no_docs) == []
