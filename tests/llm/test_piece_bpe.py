"""BPE by a written sentencepiece model, against the library that reads the same ranks."""

import base64
import hashlib
import pickle
import random
import struct
from pathlib import Path

import pytest

from lumenfold.llm import bpe, piece_bpe, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    assert public_tokenizers.PATTERN == bpe.PATTERN
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(piece_bpe.ranks_path()).read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return piece_bpe.PieceCoder(pickle.loads(pickle.dumps(piece_bpe.PieceVocabulary(piece_bpe.read_ranks(piece_bpe.ranks_path())))))


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_equals_the_library(library, coder):
    random.seed(8)
    pool = [chr(i) for i in [*range(0x250), *range(0x300, 0x330), *range(0x400, 0x420), *range(0x2000, 0x2070), *range(0x3000, 0x3020), *range(0x4E00, 0x4E40), *range(0x1F600, 0x1F620), 0x85, 0x1680, 0x180E, 0x2581, 0xFEFF]]
    texts = ["".join(random.choices(pool, k=random.randint(0, 60))) for _ in range(4000)]
    texts += ["".join(random.choices("ab  \n'st1.é", k=random.randint(0, 40))) for _ in range(2000)]
    texts += ["", " ", "a<|endoftext|> b", "<unk>", "x" * 3000, " " * 300, "é" * 500, "two  spaces and\n\nlines ", "ab" * 20_000, "▁ a"]
    for t, ids in zip(texts, coder.encode_all(texts), strict=True):
        assert ids == packed(library.encode_ordinary(t)), t
        assert coder.decode_bytes(ids) == t.encode()


def test_every_token_decodes_to_its_bytes(coder):
    tokens = piece_bpe.read_ranks(piece_bpe.ranks_path())
    assert coder.decode_bytes(packed(range(len(tokens)))) == b"".join(tokens)


def test_tokens_that_merges_do_not_reach_are_taken_whole():
    import tiktoken

    tokens = [*[bytes([b]) for b in range(256)], b"bc", b"abcd", b"zz", b"zzz"]
    vocabulary = piece_bpe.PieceVocabulary(tokens)
    assert set(vocabulary.whole) == {b"abcd"}
    own, library = piece_bpe.PieceCoder(vocabulary), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    for t in ("abcd", "abcde", "xabcd abcd", "zzzzz", "zzzzzz zzz", "bcbcabc"):
        assert own.encode(t) == packed(library.encode_ordinary(t)), t


def test_a_vocabulary_without_a_byte_is_refused():
    with pytest.raises(ValueError, match="without a token"):
        piece_bpe.serialized_model([bytes([b]) for b in range(255)])


def test_whole_table(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op11_piece_bpe"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(packed(ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_odd_rows(spark):
    vocabulary = piece_bpe.PieceVocabulary(piece_bpe.read_ranks(piece_bpe.ranks_path()))
    schema = "doc_id long, text string, ids string, decoded int, _id string, _text string"
    data = [(1, "", "i", 1, "x", "y"), (1, "", "i", 1, "x", "y"), (2, None, None, None, None, None), (None, "some words", "i", 1, "", ""), (3, "word " * 30_000, "", 0, "", ""), (4, "x" * 100_000, "", 0, "", ""), (4, "x" * 100_000, "", 0, "", "")]
    out = piece_bpe.encode_and_decode(spark.createDataFrame(data, schema), vocabulary)
    assert out.columns == ["doc_id", "ids", "decoded"]
    got = sorted(((r["doc_id"], bytes(r["decoded"]).decode()) for r in out.collect()), key=str)
    assert got == sorted(((d[0], d[1] or "") for d in data), key=str)
    assert piece_bpe.encode_and_decode(spark.createDataFrame([], schema), vocabulary).collect() == []
