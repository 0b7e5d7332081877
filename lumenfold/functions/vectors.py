"""Vectors as arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def dot(a: Column, b: Column) -> Column:
    """Truncates to the shorter of the two."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Of the common length; 0 where one of the two has no length."""
    n = F.least(F.size(a), F.size(b))
    one, two = F.slice(a, 1, n), F.slice(b, 1, n)
    size = F.sqrt(dot(one, one)) * F.sqrt(dot(two, two))
    return F.when(size > 0, dot(one, two) / size).otherwise(0.0)


def literal(a: Column) -> Column:
    """A vector as text, eight decimals."""
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: F.round(x.cast("double"), 8).cast("string")), ","), F.lit("]"))


def parse_literal(text: Column) -> Column:
    """Null where the text isn't a list of numbers."""
    return F.from_json(text, "array<double>")


def unit(a: Column) -> Column:
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(a, lambda x: x.cast("double") / norm)).otherwise(F.transform(a, lambda x: x.cast("double")))


def embedding_words(text: Column) -> Column:
    """Tokens of two characters or more."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9:#.>_-]+"), lambda t: F.length(t) > 1)


#: Rows whose cells are summed at once.
_TOGETHER = 512


def _cell_sums(dims: int):
    """(id, cell, sum) lists of a batch (id, words), an entry for each id of a few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _TOGETHER):
                part = batch.slice(at, _TOGETHER)
                ids = part.column(0).dictionary_encode(null_encoding="encode")
                words = part.column(1).flatten().dictionary_encode(null_encoding="encode")
                digests = b"".join(bytes(4) + b"\1\0" if w is None else hashlib.sha256(w.encode()).digest()[:6] for w in words.dictionary.to_pylist())
                h = np.frombuffer(digests, np.uint8).reshape(-1, 6)
                cell = h[:, :4].copy().view(">u4")[:, 0].astype(np.int64) % dims
                value = np.where(h[:, 4] % 2 == 1, 1.0, -1.0) * (1 + (h[:, 5] % 5) / 5.0)
                word = words.indices.to_numpy()
                owner = np.repeat(ids.indices.to_numpy().astype(np.int64), part.column(1).value_lengths().to_numpy())
                used, place = np.unique(owner * dims + cell[word], return_inverse=True)
                sums = np.bincount(place, weights=value[word], minlength=len(used))
                ends = np.searchsorted(used, np.arange(len(ids.dictionary) + 1) * dims).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (used % dims, sums)]
                yield pa.RecordBatch.from_arrays([ids.dictionary, *lists], ["_id", "_cells", "_sums"])

    return run


def _merged(dims: int, schema: pa.Schema):
    """(id, cell, value) of what _cell_sums gave, sorted by id: a few rows at a time, and the sums of the last id are carried on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, np.ndarray, np.ndarray] = [], np.empty(0, np.int64), np.empty(0)
        for batch in batches:
            for at in range(0, batch.num_rows, _TOGETHER):
                part = batch.slice(at, _TOGETHER)
                ids = held[0] + part.column(0).to_pylist()
                size = np.concatenate([[len(held[1])] * len(held[0]), part.column(1).value_lengths().to_numpy()]).astype(np.int64)
                first = np.array([True] + [x != y for x, y in zip(ids, ids[1:])])
                owner = np.repeat(np.cumsum(first) - 1, size)
                used, place = np.unique(owner * dims + np.concatenate([held[1], part.column(1).flatten().to_numpy()]), return_inverse=True)
                sums = np.bincount(place, weights=np.concatenate([held[2], part.column(2).flatten().to_numpy()]), minlength=len(used))
                ids = [ids[i] for i in np.flatnonzero(first)]
                cut = np.searchsorted(used, (len(ids) - 1) * dims)
                held = ids[-1:], used[cut:] % dims, sums[cut:]
                yield told(ids[:-1], used[:cut], sums[:cut])
        yield told(held[0], held[1], held[2])

    def told(ids: list, used: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        of = used // dims
        norm = np.sqrt(np.bincount(of, weights=sums * sums, minlength=len(ids)))[of]
        value = np.divide(sums, norm, out=np.zeros(len(sums)), where=norm > 0)
        return pa.RecordBatch.from_arrays([pa.array(ids, schema.field(0).type).take(pa.array(of)), pa.array(used % dims), pa.array(value)], schema=schema)

    return run


def hashing_embedding(rows: DataFrame, id_col: str, text_col: str, dims: int = 384) -> DataFrame:
    """(id, cell, value) of the signed, weighted hashing embedding, L2 normalised, sparse; a text without tokens is cell 0.

    Cell: first four bytes of a token's SHA-256 modulo `dims`; byte 4 gives the sign (odd is positive), byte 5 the weight.
    Cells that cancel out to 0 stay. No task holds a table of its cells: a few rows at a time become lists of cells, one
    shuffle by id sorts these, and what rows of one id have is merged as it comes.
    """
    words = embedding_words(F.col(text_col))
    words = F.when(F.size(words) > 0, words).otherwise(F.array(F.lit(None).cast("string")))
    kind = rows.schema[id_col].dataType
    listed = rows.select(F.col(id_col).alias("_id"), words.alias("_words")).mapInArrow(_cell_sums(dims), f"_id {kind.simpleString()}, _cells array<long>, _sums array<double>")
    schema = pa.schema([("_id", to_arrow_type(kind)), ("cell", pa.int64()), ("value", pa.float64())])
    told = listed.repartition("_id").sortWithinPartitions("_id").mapInArrow(_merged(dims, schema), f"_id {kind.simpleString()}, cell long, value double")
    return told.select(F.col("_id").alias(id_col), "cell", "value")
