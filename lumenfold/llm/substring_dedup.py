"""Substring dedup by seed and extend.

Seeds are winnowed anchors: the least K-gram of every LENGTH words in a row, chosen from these words alone, so two equal
passages choose equal seeds at equal places. The windows that choose one seed are its extension, a stretch of at most
2 * LENGTH - K words around it. Documents meet on seeds: one sort by (seed, extension, place) lays all that holds a
seed side by side, and each is compared with the earliest one (never with all others, so no pairs are formed).

 - An extension that an earlier place has too is a repeat as a whole.
 - The earliest places of different extensions of one seed are where a repeat may begin or end. These alone are looked
   at window by window, by 128-bit digests, of which the earliest stays.

Both ways together, the repeated windows of a document join to maximal repeats of LENGTH words or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import cut_lineage
from lumenfold.llm.fingerprint import chosen_of_windows, kgram_hashes
from lumenfold.llm.words import WordHashes, id_key, words_of

#: Words of a window, words of a seed.
LENGTH, K = 20, 8
_SALT = np.uint64(0xA0761D6478BD642F)
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_PLACE = ["_key", "_tie", "_at"]
_ANCHOR = "_told boolean, _seed long, _ext long, _key long, _tie long, _at int"


def _extensions(words: list[bytes], cache: WordHashes, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seeds, hashes of their extensions, places); a place is the first window * windows of a seed + those after it."""
    codes, w = cache.of(words), length - k + 1
    grams, whole = kgram_hashes(codes, k), kgram_hashes(codes, length)
    chosen = chosen_of_windows(grams, w)
    first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    last = np.r_[first[1:], len(chosen)] - 1
    at = chosen[first]
    # the first and the last window cover the extension
    shape = ((at - first) * w + last - first).astype(np.uint64)
    ext = whole[first] * _ODD[0] ^ (whole[last] * _ODD[1] + shape) * _ODD[2]
    ext ^= ext >> np.uint64(31)
    return grams[at], ext, first * w + last - first


def _anchors(length: int, k: int):
    """Rows of _ANCHOR: the earliest of equal extensions in a batch; _told marks the others, which need no one else."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        for pdf in batches:
            parts = []
            for key, tie, text in zip(pdf["_key"], pdf["_tie"], pdf["_text"], strict=True):
                words = words_of(text)
                if len(words) >= length:
                    seeds, ext, at = _extensions(words, cache, length, k)
                    parts.append((seeds, ext, np.full(len(at), key, np.int64), np.full(len(at), tie, np.int64), at.astype(np.int32)))
            if not parts:
                continue
            seeds, ext, keys, ties, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            order = np.lexsort((at, ties, keys, ext, seeds))
            seeds, ext, keys, ties, at = (x[order] for x in (seeds, ext, keys, ties, at))
            again = np.r_[False, (seeds[1:] == seeds[:-1]) & (ext[1:] == ext[:-1])]
            same = again & np.r_[False, (keys[1:] == keys[:-1]) & (ties[1:] == ties[:-1]) & (at[1:] == at[:-1])]
            # told rows only pass through, so they are dealt by their document
            dealt = np.where(again, keys.view(np.uint64) * _ODD[0], seeds).view(np.int64)
            out = pd.DataFrame({"_told": again, "_seed": dealt, "_ext": ext.view(np.int64), "_key": keys, "_tie": ties, "_at": at})
            yield out[~same] if same.any() else out

    return run


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From anchors sorted by (_told, _seed, _ext, place): places that are repeats as a whole (_full), or open.

    Holds one row and the earliest place of one extension, however many share a seed.
    """
    before, held, told = None, None, False  # the last row; the last earliest place, as a row; whether its seed has another one

    def places(rows: pd.DataFrame, full: bool) -> pd.DataFrame:
        return rows[_PLACE].assign(_full=full)

    for pdf in batches:
        if not len(pdf):
            continue
        yield places(pdf[pdf["_told"]], True)
        pdf = pdf[~pdf["_told"]]
        if not len(pdf):
            continue
        rows = pdf if before is None else pd.concat([before, pdf], ignore_index=True)
        seed, ext = rows["_seed"].to_numpy(), rows["_ext"].to_numpy()
        place = [rows[c].to_numpy() for c in _PLACE]
        again = (seed[1:] == seed[:-1]) & (ext[1:] == ext[:-1])
        same = again & np.logical_and.reduce([c[1:] == c[:-1] for c in place])
        if before is None:
            again, same = np.r_[False, again], np.r_[False, same]
        else:
            rows, seed = rows.iloc[1:], seed[1:]
        before = pdf.iloc[-1:]
        yield places(rows[again & ~same], True)
        first = rows[~again]
        if not len(first):
            continue
        firsts = first if held is None else pd.concat([held, first], ignore_index=True)
        s = firsts["_seed"].to_numpy()
        beside = s[1:] == s[:-1]
        is_open = np.r_[told, beside] | np.r_[beside, False]
        yield places(firsts[:-1][is_open[:-1]], False)
        held, told = firsts.iloc[-1:], bool(is_open[-1])
    if held is not None and told:
        yield places(held, False)


def _starts(places, w: int) -> np.ndarray:
    """The windows of places."""
    at = np.asarray(places, dtype=np.int64)
    first, n = at // w, at % w + 1
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def _windows(length: int, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        for pdf in batches:
            out, held = [], 0
            for key, tie, text, places in zip(pdf["_key"], pdf["_tie"], pdf["_text"], pdf["_open"], strict=True):
                codes = cache.of(words_of(text))
                starts = _starts(places, length - k + 1)
                one, two = kgram_hashes(codes, length)[starts], kgram_hashes(codes ^ _SALT, length)[starts]
                out.append(pd.DataFrame({"_one": one.view(np.int64), "_two": two.view(np.int64), "_key": np.int64(key), "_tie": np.int64(tie), "_pos": starts.astype(np.int32)}))
                held += len(starts)
                if held > 1 << 18:
                    yield pd.concat(out, ignore_index=True)
                    out, held = [], 0
            if out:
                yield pd.concat(out, ignore_index=True)

    return run


def _remove(length: int, k: int):
    w = length - k + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, held = [], 0
            for key, text, full, some, firsts in zip(pdf["_id"], pdf["_text"], pdf["_whole"], pdf["_open"], pdf["_firsts"], strict=True):
                words = words_of(text)
                n, runs = len(words), []
                starts = _starts([] if full is None else full, w)
                if some is not None and len(some):
                    again = np.setdiff1d(_starts(some, w), np.asarray([] if firsts is None else firsts, dtype=np.int64), assume_unique=True)
                    starts = np.concatenate([starts, again])
                if len(starts):
                    covered = np.zeros(n + 1, np.int64)
                    np.add.at(covered, starts, 1)
                    np.add.at(covered, starts + length, -1)
                    gone = np.cumsum(covered) > 0
                    edges = np.flatnonzero(np.diff(np.r_[False, gone]))
                    runs = edges.reshape(-1, 2).tolist()
                    words = [words[i] for i in np.flatnonzero(~gone[:n])]
                kept = b" ".join(words).decode("utf-8", "surrogatepass")
                out.append((key, n, n - len(words), [{"start": a, "end": b} for a, b in runs], kept))
                held += len(kept)
                if held > 1 << 22:
                    yield _frame(out)
                    out, held = [], 0
            yield _frame(out)

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["_id", "n_words", "n_removed", "repeats", "kept_text"]).astype({"_id": "Int64", "n_words": "int64", "n_removed": "int64"})


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n_words, n_removed, repeats (maximal runs of words that go: start, end), kept_text (the others, joined by a space).

    A word goes if a window of `length` words over it starts earlier too: in a smaller id, or earlier in the document.
    Windows are those of the input. Ids are integers. A null text has no words, a null id comes after all others. Rows
    of one id, or without one, are documents of their own, in the order of a hash of their text; rows that are equal in
    id and text are decided alike, as if there were one of them. An empty table gives an empty result; further columns are left out.
    """
    shared = not docs.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1 OR _id IS NULL").isEmpty()
    tie = F.xxhash64(F.col(text_col), F.col(id_col).isNull()) if shared else F.lit(0).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), id_key(id_col).alias("_key"), tie.alias("_tie"), F.col(text_col).alias("_text"))
    anchors = rows.select("_key", "_tie", "_text").mapInPandas(_anchors(length, k), _ANCHOR)
    settled = anchors.repartition("_seed").sortWithinPartitions("_told", "_seed", "_ext", *_PLACE).mapInPandas(_settle, "_key long, _tie long, _at int, _full boolean")
    on = ["_key", "_tie"] if shared else ["_key"]
    lists = settled.groupBy(*on).agg(F.collect_list(F.when(F.col("_full"), F.col("_at"))).alias("_whole"), F.collect_list(F.when(~F.col("_full"), F.col("_at"))).alias("_open"))
    lists = cut_lineage(lists)
    # texts move once: both joins below read this exchange, so both take the same columns of it
    texts = rows.repartition(*on)
    found = texts.join(lists.filter(F.size("_open") > 0), on).select("_id", "_key", "_tie", "_text", "_open").mapInPandas(_windows(length, k), "_one long, _two long, _key long, _tie long, _pos int")
    firsts = found.groupBy("_one", "_two").agg(F.min(F.struct("_key", "_tie", "_pos")).alias("_f"))
    firsts = firsts.groupBy(*[F.col(f"_f.{c}").alias(c) for c in on]).agg(F.collect_list("_f._pos").alias("_firsts"))
    marked = texts.join(lists.join(firsts, on, "left"), on, "left")
    out = marked.select("_id", "_text", "_whole", "_open", "_firsts").mapInPandas(_remove(length, k), "_id long, n_words long, n_removed long, repeats array<struct<start:long,end:long>>, kept_text string")
    return out.withColumnRenamed("_id", id_col)


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = {
    "op9_substring_dedup": """
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, unnest(range(len(w))) AS pos, w FROM d),
g AS (SELECT doc_id, pos, w[pos + 1] AS word, CASE WHEN pos + 20 <= n THEN array_to_string(w[pos + 1:pos + 20], ' ') END AS win FROM p),
f AS (SELECT *, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1 AS again FROM g),
c AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
a AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)""",
}
