"""Word hashes inside tasks, and joins of documents with sides of checked size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.fingerprint import kgram_hashes

#: A side up to this many bytes is broadcast to the documents; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Ids that are null sort after all others.
NULL_ID = 2**63 - 1
_CACHED = 1 << 16


class WordHashes(dict):
    """64-bit hashes of words (bytes); forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh3_64_intdigest(word)
        if len(self) >= _CACHED:
            self.clear()
        self[word] = out
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def keyed_texts(batch: pa.RecordBatch, rows: int = 256) -> Iterator[tuple]:
    """(key, text) of a batch of two columns; few texts at a time are Python objects, the others stay as they came."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)


def words_of(text: str | None) -> list[bytes]:
    """Runs of [^\\x20\\x09-\\x0D], in UTF-8: what bytes.split() takes for words."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def shingle_set(text: str | None, hashes: WordHashes, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles, A-Z in lower case; fewer words than k are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.unique(kgram_hashes(hashes.of(words), min(k, len(words)))) if words else np.empty(0, np.uint64)


def row_name(id_col: str, text_col: str) -> Column:
    """SHA-256 of a row's id and text: it tells apart rows that share an id, or have none; a null text counts as empty."""
    key = F.col(id_col).cast("string")
    return F.sha2(F.concat_ws("", F.length(key).cast("string"), F.lit(":"), key, F.col(text_col)), 256)


def id_key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))


def is_small(side: DataFrame, side_bytes: Column) -> bool:
    """Whether the sum of `side_bytes` over `side` (lineage cut, so that this is cheap) allows a broadcast."""
    return (side.agg(F.sum(side_bytes)).first()[0] or 0) <= BROADCAST_BYTES


def join_side(rows: DataFrame, side: DataFrame, on: str | list[str], how: str, side_bytes: Column) -> DataFrame:
    """Join by `on`; `side` (lineage cut, read twice) is broadcast if it is small, else shuffled."""
    return rows.join(F.broadcast(side) if is_small(side, side_bytes) else side, on, how)
