"""Byte-level BPE encoding and decoding by a sentencepiece model that is written straight from a vocabulary of ranks.

Each byte is a code point of its own from FIRST on, so a token is a piece of as many characters as it has bytes. A piece's
score is its negative rank, so that the best pair that sentencepiece merges is the one of the least rank, the leftmost of
equal ones. The model normalises nothing and adds nothing: what it encodes are pre-tokens, one by one, and the bytes of
an id are its piece, mapped back.
"""

from __future__ import annotations

import base64
import itertools
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm import bpe
from lumenfold.llm.words import keyed_texts

#: Code point of byte 0; the 256 from here on are letters that no tokenizer treats specially.
FIRST = 0x100
#: Fixed values of sentencepiece's model format: wire types, piece types, the model type of BPE.
_VARINT, _BYTES, _FLOAT = 0, 2, 5
_NORMAL, _UNKNOWN, _BPE = 1, 2, 2


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | str | int | float) -> bytes:
    """A field of a protobuf message."""
    if isinstance(value, float):
        return _varint(number << 3 | _FLOAT) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3 | _VARINT) + _varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | _BYTES) + _varint(len(raw)) + raw


def as_piece(data: bytes) -> str:
    return (np.frombuffer(data, np.uint8).astype("<u2") + FIRST).tobytes().decode("utf-16-le")


def from_piece(piece: str) -> bytes:
    return (np.frombuffer(piece.encode("utf-16-le"), "<u2") - FIRST).astype(np.uint8).tobytes()


def serialized_model(tokens: list[bytes]) -> bytes:
    """The model of `tokens` in the order of their ranks; an id is a rank. Every single byte has to be a token, so nothing is unknown."""
    if missing := {bytes([b]) for b in range(256)} - set(tokens):
        raise ValueError(f"{len(missing)} bytes are without a token")
    piece = lambda text, score, kind: _field(1, _field(1, text) + _field(2, float(score)) + _field(3, kind))
    pieces = [piece(as_piece(t), -rank, _NORMAL) for rank, t in enumerate(tokens)]
    trainer = _field(3, _BPE) + _field(4, len(tokens) + 1)
    # nothing put before a text, no space taken away, none replaced
    normalizer = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + piece("<unk>", 0, _UNKNOWN) + _field(2, trainer) + _field(3, normalizer)


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a file of lines `base64 rank`, by rank; the ranks are 0 to their number less one."""
    ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}
    return [ranks[i] for i in range(len(ranks))]


class PieceVocabulary:
    """What `bpe.Coder` needs of a vocabulary, by a sentencepiece model. A task gets the model's bytes and opens it once."""

    special: dict[str, int] = {}

    def __init__(self, tokens: list[bytes]):
        self.model = serialized_model(tokens)
        self._processor, self.bytes_of, self.whole = None, [], {}
        # a token that its own merges don't reach is taken where it is all of a pre-token
        own = self.processor().encode([as_piece(t) for t in tokens], num_threads=1)
        self.whole = {t: i for i, (t, ids) in enumerate(zip(tokens, own, strict=True)) if ids != [i]}

    def __getstate__(self) -> dict:
        return {"model": self.model, "whole": self.whole, "_processor": None, "bytes_of": []}

    def processor(self):
        if self._processor is None:
            from sentencepiece import SentencePieceProcessor

            self._processor = SentencePieceProcessor(model_proto=self.model)
            self.bytes_of = [from_piece(self._processor.id_to_piece(i)) for i in range(self._processor.vocab_size() - 1)]
        return self._processor

    def merge_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens in a row, number of ids of each)."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        ends = [0, *itertools.accumulate(map(len, raw))]
        mapped = as_piece(b"".join(raw))
        ids = self.processor().encode([mapped[i:j] for i, j in itertools.pairwise(ends)], num_threads=1)
        if self.whole:
            ids = [[self.whole[w]] if w in self.whole else x for w, x in zip(raw, ids, strict=True)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), "<u4", counts.sum()), counts


class PieceCoder(bpe.Coder):
    """Encodes as `bpe.Coder` does; decodes to bytes, as ids may end within a character."""

    def decode_bytes(self, ids: bytes) -> bytes:
        self.vocabulary.processor()
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_and_decode(docs: DataFrame, vocabulary: PieceVocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, ids (packed little-endian unsigned 32-bit integers), decoded (binary).

    Nothing is shuffled: texts are coded whole, batch by batch, and what a task remembers of words is bounded. A null or
    empty text has no ids and decodes to no bytes; null ids, ties and repeated rows pass through row by row; an empty
    table gives an empty result; further columns are left out, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder(vocabulary)
        for batch in batches:
            for first, texts in bpe._slices(t for _, t in keyed_texts(batch)):
                ids = coder.encode_all(texts)
                columns = [batch.column(0).slice(first, len(ids)), pa.array(ids, pa.binary()), pa.array([coder.decode_bytes(x) for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, ids binary, decoded binary").withColumnRenamed("_id", id_col)


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op11_piece_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Ids and decoded bytes of every whole text, by their digests; nulls, repeats and empty tables as `encode_and_decode` has them."""
    out = encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), PieceVocabulary(read_ranks(path or ranks_path())))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: The merges of a vocabulary file are beyond SQL; tests compare with a library that reads the same file.
SQL: dict[str, str] = {}
