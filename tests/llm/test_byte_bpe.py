"""Encoding by ranks against the library, with texts in whole and in chunks."""

import base64
import collections
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from docquill.llm import byte_bpe, queries
from tests.conftest import SF
from tests.llm.test_llm import EDGES, docs_of

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def some(rng, n, letters):
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.Ranks.from_file(byte_bpe.default_ranks())


def test_default_pattern_is_the_published_one():
    assert byte_bpe.SPLIT == public_tokenizers.PATTERN


@pytest.mark.parametrize("letters", ["ab", "thes", "etaoin", "abcdefghijklmnopqrstuvwxyz", "漢字日本語中国的是不"])
def test_pieces_merge_as_in_the_library(ranks, letters):
    rng = random.Random(len(letters))
    words = [some(rng, rng.randint(1, 700 if k % 10 == 0 else 40), letters).encode() for k in range(400)]
    ids, bounds = ranks.merge_words(words)
    for k, w in enumerate(words):
        want = LIBRARY.encode_ordinary(w.decode())
        assert ids[bounds[k] : bounds[k + 1]].tolist() == want
        if w not in RANKS:
            assert ranks.merge_long(w).tolist() == want


def test_letters_newer_than_the_library(ranks):
    encoder = byte_bpe.PieceEncoder(ranks, byte_bpe.SPLIT, byte_bpe.newer_letters())
    for start in range(0, 0x110000, 0x4000):
        text = "a".join(chr(c) for c in range(start, start + 0x4000) if not 0xD800 <= c < 0xE000)
        assert encoder.encode([text])[0].tolist() == LIBRARY.encode_ordinary(text)


def rows_of_chunks(rng):
    texts = [some(rng, rng.randint(0, 400), "ab '\n\t1.é漢rst") for _ in range(60)] + ["don't we'll they're " * 20, " \n" * 100 + "x", "a" * 900 + " b", " " * 700, "é" * 333, "漢" * 5000 + "a b", "՘a" * 50, "x\n   \n  y" * 40]
    return [(k, t, "a") for k, t in enumerate(texts)]


@pytest.mark.parametrize("chunk,lap", [(40, 12), (64, 30), (200, 20), (32_768, 512)])
def test_chunks_give_what_whole_texts_give(spark, chunk, lap):
    """Pre-tokens longer than the overlap included, for which chunks grow."""
    rows = [*EDGES, *rows_of_chunks(random.Random(chunk))]
    got = byte_bpe.encode_by_ranks(docs_of(spark, rows), byte_bpe.default_ranks(), chunk=chunk, lap=lap)
    got = byte_bpe.decode_by_ranks(got, byte_bpe.default_ranks()).collect()
    assert collections.Counter((r.doc_id, tuple(r.ids), bytes(r.bytes)) for r in got) == collections.Counter((i, tuple(LIBRARY.encode_ordinary(t or "")), (t or "").encode()) for i, t, _ in rows)


def test_empty_table_and_null_ids(spark):
    none = byte_bpe.encode_by_ranks(docs_of(spark, []), byte_bpe.default_ranks())
    assert none.count() == 0 and byte_bpe.decode_by_ranks(none, byte_bpe.default_ranks()).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [188, 50255])], "doc_id long, ids array<int>")
    got = {r.doc_id: bytes(r.bytes) for r in byte_bpe.decode_by_ranks(odd, byte_bpe.default_ranks()).collect()}
    assert got == {1: b"", 2: b"", 3: LIBRARY.decode_bytes([188, 50255])}


def test_query_on_the_tables(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {tuple(r) for r in queries.op11_chunked_bytes(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    coded = {i: LIBRARY.encode_ordinary(t) for i, t in texts.items()}
    assert got == {(i, len(c), sha(" ".join(map(str, c)).encode()), sha(texts[i].encode())) for i, c in coded.items()}
