"""Byte-level BPE encoding and decoding.

A text is split into short words. Each word is a contiguous array of part boundaries and of the ranks of adjacent
parts; the least rank is looked for again and again, its boundary deleted, and the ranks beside it refreshed. New words
of equal length are the rows of one matrix, so that each step is done for all of them at once. Words longer than LONG
bytes, for which scanning again and again would be quadratic, keep their ranks in a heap instead.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.words import keyed_texts

#: Bytes of a long word; words that a task remembers; characters that it codes at once.
LONG, CACHED_WORDS, AT_ONCE = 96, 1 << 16, 1 << 19
#: Fixed value: the pattern by which byte-level tokenizers of this family split a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A space between two other characters belongs to the word after it, so a text falls apart there.
_APART = re.compile(r"(?<=\S) (?=\S)")
ID_BITS = 24
_NONE, _ID = 1 << 62, (1 << ID_BITS) - 1


def _byte_of_char() -> dict[str, int]:
    """Printable bytes stand for themselves, the others for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Merges and token bytes of a tokenizer file; small enough to go along with each task."""

    def __init__(self, path: str):
        data = json.loads(Path(path).read_text(encoding="utf-8"))
        model, chars = data["model"], _byte_of_char()
        ids = model["vocab"]
        self.byte_ids = [0] * 256
        for c, b in chars.items():
            self.byte_ids[b] = ids[c]
        #: (left id, right id) -> rank and id of both, in one number that sorts by rank
        self.merges: dict[tuple[int, int], int] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[ids[a], ids[b]] = rank << ID_BITS | ids[a + b]
        #: the same, as sorted keys (left << ID_BITS | right) and values
        self.pairs = np.array(sorted((a << ID_BITS | b, v) for (a, b), v in self.merges.items()), np.int64).reshape(-1, 2).T.copy()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max(*ids.values(), *self.special.values(), 0) + 1
        self.bytes_of = [b""] * size
        for token, i in ids.items():
            self.bytes_of[i] = bytes(chars[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()

    def merge_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each)."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        return self.merge_flat(np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw)))

    def merge_flat(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that lie in `data` one after the other."""
        begin, counts, done = np.cumsum(lengths) - lengths, np.zeros(len(lengths), np.int64), []
        table = np.array(self.byte_ids, np.int64)
        for n in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == n)
            if n > LONG:
                done += [(rows[j : j + 1], np.array([self._merge_heap(table[data[begin[i] : begin[i] + n]].tolist())])) for j, i in enumerate(rows.tolist())]
            else:
                done += self._merge_rows(rows, table[data[begin[rows][:, None] + np.arange(n)]])
        for rows, parts in done:
            counts[rows] = parts.shape[1]
        flat, begin = np.empty(counts.sum(), "<u4"), np.cumsum(counts) - counts
        for rows, parts in done:
            flat[begin[rows][:, None] + np.arange(parts.shape[1])] = parts
        return flat, counts

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, values = self.pairs
        pair = left << ID_BITS | right
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        return np.where(keys[at] == pair, values[at], _NONE)

    def _merge_rows(self, rows: np.ndarray, parts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, ids) of words of one length: `parts` has a word in each row."""
        if parts.shape[1] < 2 or not self.pairs.shape[1]:
            yield rows, parts
            return
        ranks = self._ranks(parts[:, :-1], parts[:, 1:])
        while len(rows):
            i = ranks.argmin(axis=1)  # the leftmost of ties
            every = np.arange(len(rows))
            least = ranks[every, i]
            live = least != _NONE
            yield rows[~live], parts[~live]
            rows, parts, ranks, i, least = rows[live], parts[live], ranks[live], i[live], least[live]
            every, width = every[: len(rows)], parts.shape[1] - 1
            if not len(rows):
                return
            parts[every, i] = least & _ID
            beside = np.arange(width)
            keep = beside + (beside > i[:, None])
            parts = np.take_along_axis(parts, keep, 1)
            if width == 1:
                yield rows, parts
                return
            ranks = np.take_along_axis(ranks, keep[:, :-1] + (beside[:-1] == i[:, None]), 1)
            left, right = i > 0, i < width - 1
            ranks[every[left], i[left] - 1] = self._ranks(parts[every[left], i[left] - 1], parts[every[left], i[left]])
            ranks[every[right], i[right]] = self._ranks(parts[every[right], i[right]], parts[every[right], i[right] + 1])

    def _merge_heap(self, parts: list[int]) -> list[int]:
        n = len(parts)
        before, after, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        get = self.merges.get
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get((parts[i], parts[i + 1]), _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i] = r & _ID
            alive[j] = False
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := get((parts[left], parts[right]), _NONE)) != _NONE:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return [p for p, live in zip(parts, alive, strict=True) if live]


class Coder:
    """Encodes and decodes texts; one for each Python worker. What it remembers of words has a fixed bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.find = vocabulary, regex.compile(PATTERN).findall
        #: packed ids of what follows a space up to the next one
        self.spaced: dict[str, bytes] = {}
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def _packed(self, texts: list[list[str]]) -> list[bytes]:
        """Packed ids of texts that are lists of words."""
        flat, counts = self.vocabulary.merge_all([w for words in texts for w in words])
        ends = np.r_[0, np.cumsum(counts)][np.cumsum([len(words) for words in texts], dtype=np.int64)] * 4
        data, start, out = flat.tobytes(), 0, []
        for end in ends.tolist():
            out.append(data[start:end])
            start = end
        return out

    def _learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.spaced]
        if len(self.spaced) + len(new) > CACHED_WORDS:
            self.spaced.clear()
            new = list(pieces)
        if not new:
            return
        words = self.find(" " + " ".join(new))
        first = [i for i, w in enumerate(words) if w[0] == " "]
        if len(first) == len(new):
            split = [words[i:j] for i, j in zip(first, [*first[1:], len(words)], strict=True)]
        else:  # some hold white space
            split = [self.find(" " + p) for p in new]
        self.spaced.update(zip(new, self._packed(split), strict=True))

    def _plain(self, texts: list[str]) -> list[bytes]:
        split = [_APART.split(t) for t in texts]
        self._learn({p for s in split for p in s[1:]})
        spaced, first = self.spaced.__getitem__, self._packed([self.find(s[0]) for s in split])
        return [b"".join([f, *map(spaced, s[1:])]) for f, s in zip(first, split, strict=True)]

    def _long(self, text: str) -> bytes:
        """A text beyond AT_ONCE characters, in parts that end where it falls apart."""
        out, start = [], 0
        while start < len(text):
            end = _APART.search(text, start + AT_ONCE)
            stop = end.start() if end else len(text)
            out += self._plain([text[start:stop]])
            start = stop
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. The strings of special tokens become those tokens."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        special, out, plain = self.vocabulary.special, [b""] * len(texts), []
        for i, t in enumerate(texts):
            if any(name in t for name in special):
                out[i] = b"".join(self._long(p) if p not in special else struct.pack("<I", special[p]) for p in self.special.split(t))
            elif len(t) > AT_ONCE:
                out[i] = self._long(t)
            else:
                plain.append(i)
        for i, ids in zip(plain, self._plain([texts[i] for i in plain]), strict=True):
            out[i] = ids
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def _slices(texts: Iterable[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of about AT_ONCE characters together."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t or "")
        size += len(held[-1])
        if size >= AT_ONCE:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def encode(text: Column, vocabulary: Vocabulary) -> Column:
    """Binary column: the ids, packed as little-endian unsigned 32-bit integers; null counts as empty."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = Coder(vocabulary)
        for texts in batches:
            yield pd.Series([x for _, some in _slices(texts) for x in coder.encode_all(some)], dtype=object)

    return run(text)


def decode(ids: Column, vocabulary: Vocabulary) -> Column:
    """String column: the text of packed ids; null counts as none."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = Coder(vocabulary)
        for packed in batches:
            yield pd.Series([coder.decode(p or b"") for p in packed], dtype=object)

    return run(ids)


def encode_and_decode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, ids (packed), decoded; both ways in one pass over the texts.

    Nothing is shuffled, texts are coded whole, batch by batch. A null or empty text has no ids and decodes to the
    empty text; null ids and repeated rows pass through; an empty table gives an empty result; further columns are
    left out (`encode` and `decode` add a column to any table).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(vocabulary)
        for batch in batches:
            for first, texts in _slices(t for _, t in keyed_texts(batch)):
                ids = coder.encode_all(texts)
                columns = [batch.column(0).slice(first, len(ids)), pa.array(ids, pa.binary()), pa.array([coder.decode(x) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, ids binary, decoded string").withColumnRenamed("_id", id_col)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    out = encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), Vocabulary(path or vocabulary_path()))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


SQL: dict[str, str] = {}
