from __future__ import annotations

import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rowsmith.llm import token_files
from rowsmith.session import scratch_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def plain_ids(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


def test_ids_equal_the_library(tokenizer):
    random.seed(3)
    mine = token_files.ByteTokenizer(PATH)
    pieces = [" ", "  ", "\n", "\t", "a", "Ab", "é", "1", "½", "_", "'s", "'", "!", "$$$", " ", "　", "\x1c", "\x85", "👍",
              "\r\n", "日", "<|endoftext|>", "́", "\x0b", "..", "don't", "²x"]
    for _ in range(3000):
        text = "".join(random.choices(pieces, k=random.randrange(12)))
        assert mine.encode(text) == plain_ids(tokenizer, text)[:-1].tobytes(), repr(text)


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    for n in (1, 7, 1000, 65_536):
        ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
        assert (token_files.from_planes(token_files.to_planes(ids, bits), n) == ids).all()


def test_checksums_of_parts():
    data = os.urandom(5000)
    cuts = [0, 0, 3, 1500, 1501, 5000]
    parts = [(zlib.crc32(data[a:b]), b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    assert token_files.crc_of_parts(parts) == zlib.crc32(data)


@pytest.mark.parametrize("bits", [False, True])
def test_files_give_back_every_document(spark, tokenizer, hard_docs, bits):
    folder = scratch_folder(spark, "t")
    token_files.write_token_files(hard_docs.repartition(3), folder, PATH, block=512, bits=bits)
    rows = sorted(hard_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    start, expected = 0, []
    for row in rows:
        ids = plain_ids(tokenizer, row.text)
        expected.append((row.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    order = lambda r: (r[1], r[2])
    assert sorted((tuple(r) for r in token_files.token_digests(spark, folder).collect()), key=order) == expected
    read = sorted((tuple(r) for r in token_files.read_token_files(spark, folder).collect()), key=order)
    assert [(r[0], r[1], zlib.crc32(r[2])) for r in read] == [(e[0], e[1], e[3]) for e in expected]
    index = spark.read.parquet(f"{folder}/index").orderBy("first").collect()
    assert [r["first"] for r in index] == np.cumsum([0, *[r["n_ids"] for r in index]])[:-1].tolist()


def test_no_rows(no_docs):
    assert token_files.encode_and_read(no_docs, PATH).count() == 0
