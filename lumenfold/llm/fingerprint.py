"""Document fingerprints by winnowing.

Rolling hashes of all k-grams of code points, the least hash of every window of w k-grams (the rightmost one of ties),
and the positions of those chosen. Two texts that share w + k - 1 code points in a row share a chosen k-gram.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: k-gram and window lengths; bits of a hash that are kept; positions that one block of a very long text covers.
K, WINDOW, HASH_BITS, BLOCK = 16, 64, 40, 1 << 22
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def kgram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-grams: polynomial in a fixed base modulo 2^64, joined by doubling, then mixed."""
    n = len(codes) - k + 1
    have, power, out, done = codes.astype(np.uint64) + np.uint64(1), _BASE, None, 0
    length, rest = 1, k
    while rest:
        if rest & 1:
            part = have[done : done + n]
            out = part.copy() if out is None else out * np.uint64(power) + part
            done += length
        rest >>= 1
        if rest:
            have = have[:-length] * np.uint64(power) + have[length:]
            power = power * power % (1 << 64)
            length *= 2
    out ^= out >> np.uint64(32)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def _least_of_windows(keys: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w neighbours, by doubling."""
    out, length = keys, 1
    while length * 2 <= w:
        out = np.minimum(out[:-length], out[length:])
        length *= 2
    if length < w:
        m = len(keys) - w + 1
        out = np.minimum(out[:m], out[w - length : w - length + m])
    return out


def chosen_of_windows(hashes: np.ndarray, w: int) -> np.ndarray:
    """For every window of w hashes the position of the least one, compared by the top HASH_BITS, rightmost of ties."""
    out, span = [], np.uint64((1 << (64 - HASH_BITS)) - 1)
    for at in range(0, max(1, len(hashes) - w + 1), BLOCK):
        part = hashes[at : at + BLOCK + w - 1]
        keys = (part & ~span) | (span - np.arange(len(part), dtype=np.uint64))
        out.append((span - (_least_of_windows(keys, min(w, len(part))) & span)).astype(np.int64) + at)
    return np.concatenate(out)


def winnow(text: str, k: int = K, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) chosen, in order of position. A text shorter than k is one gram; an empty one has none."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    hashes = kgram_hashes(codes, min(k, len(codes)))
    positions = np.unique(chosen_of_windows(hashes, w))
    return positions, hashes[positions] >> np.uint64(64 - HASH_BITS)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of the sets of chosen hashes; two empty ones are alike."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def written(positions: np.ndarray, values: np.ndarray) -> str:
    """hash@position pairs, hex, comma-joined."""
    return ",".join(f"{h:010x}@{p:x}" for p, h in zip(positions.tolist(), values.tolist(), strict=True))


def fingerprint(text: Column, k: int = K, w: int = WINDOW) -> Column:
    """Column of array<struct<position long, hash long>> of the text's winnowed k-grams; null counts as empty."""

    @F.pandas_udf("array<struct<position:long,hash:long>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"position": p, "hash": h} for p, h in zip(*map(np.ndarray.tolist, winnow(t or "", k, w)), strict=True)] for t in texts])

    return run(text)


def in_ranges(docs: DataFrame, id_col: str, text_col: str, ranges: int) -> DataFrame:
    """(_range, _ghost, _key, _text) with each row in the range of its id and, as a ghost, after the range above.

    Ranges hold about as many rows each, so a range's successor in descending order is known from one small
    table of the largest id in each range.
    """
    from pyspark.ml.feature import Bucketizer  # tasks that import this module don't need it

    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    cuts = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or [0]
    splits = [-float("inf"), *sorted({float(c) for c in cuts}), float("inf")]
    # ids that are one as doubles share a range
    docs = Bucketizer(splits=splits, inputCol="_double", outputCol="_bucket", handleInvalid="keep").transform(docs.select(id_col, text_col, F.col(id_col).cast("double").alias("_double")))
    place = F.when(F.col(id_col).isNull(), F.lit(-1)).otherwise(F.col("_bucket")).cast("long")
    rows = docs.select(key.alias("_key"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.col(id_col).alias("_id"), place.alias("_range"))
    heads = [tuple(r) for r in rows.groupBy("_range").agg(F.max("_key")).collect()]  # a row for each of `ranges`
    heads.sort(reverse=True)
    after = [(heads[(i + 1) % len(heads)][1], heads[i][0]) for i in range(len(heads))]
    ghosts = docs.sparkSession.createDataFrame(after or [(0, 0)], "_head long, _of long")
    # a row goes to its own range, and to the one before if it is the head
    heads_of = rows.join(F.broadcast(ghosts), F.col("_key") == F.col("_head")).select("_key", "_text", "_id", F.col("_of").alias("_range"), F.lit(1).alias("_ghost"))
    return rows.withColumn("_ghost", F.lit(0)).select("_key", "_text", "_id", "_range", "_ghost").unionByName(heads_of)


def _pairs_of(k: int, w: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last document: id, range, text, chosen positions and hashes

        def row(now: tuple, nxt: tuple) -> tuple:
            text, part = now[2], len(now[2]) // 3
            edited = text[: len(text) - part] + nxt[2][:part]
            positions, values = winnow(edited, k, w)
            sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            return now[0], len(text), sha, written(*now[3]), written(positions, values), likeness(now[3][1], values), likeness(now[3][1], nxt[3][1])

        for pdf in batches:
            out = []
            for i, part, ghost, text in zip(pdf["_id"], pdf["_range"], pdf["_ghost"], pdf["_text"], strict=True):
                if held is None or held[1] != part:
                    held = None if ghost else (i, part, text, winnow(text, k, w))
                    continue
                now = (i, part, text, winnow(text, k, w))
                out.append(row(held, now))
                held = None if ghost else now  # rows after the first ghost repeat its id
            yield pd.DataFrame(out, columns=["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]).astype({"_id": "Int64", "n_chars": "int64"})

    return run


def compare_neighbours(docs: DataFrame, k: int = K, w: int = WINDOW, ranges: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each text, of its edited text, and their likeness, also to the next document's.

    The edited text has its last third replaced by the head of the next document in descending id (after the last:
    the first). Every text moves once, to the sorted range of its id; only the head of each range moves twice. Nulls:
    a null text is empty, a null id comes last. Of rows that repeat an id, those with the lesser text come first. A
    single document is its own next one; an empty table gives an empty result; further columns are left out.
    """
    spread = in_ranges(docs, id_col, text_col, ranges).repartition("_range").sortWithinPartitions("_range", "_ghost", F.col("_key").desc(), "_text")
    out = spread.select("_id", "_range", "_ghost", "_text").mapInPandas(_pairs_of(k, w), "_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("_id", id_col)


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL: dict[str, str] = {}
