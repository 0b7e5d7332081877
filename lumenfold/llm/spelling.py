"""Grouping of spelling variants: words one edit apart, the common form of a rare one, and the root at a chain's end.

Two words are one inserted, deleted or replaced code point apart when their common prefix and common suffix together
reach the longer length less one. For a pair whose longer word has m code points, the prefix ends within one of a few
ranges [lo, hi) of 0 to m; such a pair shares lo code points at the front and m - hi at the end, which are the key of a
range. Words of one key lie side by side in a partition as padded code-point matrices, and tiles of such rows are
compared block by block. Ranges are quarters of m; those of a key with very many words are halved until they are not,
and a range of one place has at most one word for each code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import cut_lineage
from lumenfold.llm.sql import CRC_TABLE, crc32
from lumenfold.llm.words import join_side

#: Letters of a word, with both signs that lie among them; its least length, and occurrences.
LETTERS, LEAST_LENGTH, LEAST_COUNT = r"[A-Za-zÀ-ÿ]", 7, 2
#: A form is at least so many times as frequent as its variant.
RATIO = 10
#: Words of a key beyond which its range is halved; rows of a tile's side; rows and cells that are compared at once.
MOST, SIDE, ROWS, CELLS = 2048, 64, 1 << 16, 1 << 22
#: Every so many crc32 values, a run loses a code point.
LOSS = 31


def noisy_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of all whole texts after the loss of a code point in every LOSS-th run, with LEAST_LENGTH code points and LEAST_COUNT occurrences or more.

    Only A-Z become lower case. A null text has no words; a null id counts as the empty string; repeated rows count as
    often as they occur. Occurrences are summed before they are shuffled.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"({LETTERS}{{{LEAST_LENGTH},}})"), F.lit(1))).alias("_run"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    run = runs.select("_id", F.translate("_run", upper, upper.lower()).alias("_run"))
    run = run.select("_run", F.crc32(F.concat_ws(":", "_id", "_run").cast("binary")).alias("_h"), F.char_length("_run").alias("_n"))
    at = F.pmod(F.col("_h"), F.col("_n")).cast("int")
    short = F.concat(F.substr("_run", F.lit(1), at), F.substr("_run", at + 2, F.col("_n")))
    words = run.select(F.when(F.col("_h") % LOSS == 0, short).otherwise(F.col("_run")).alias("word"))
    return words.filter(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _half(lo: Column, hi: Column) -> Column:
    return F.floor((lo + hi) / 2).cast("int")


def _halves(ranges: Column) -> Column:
    """Array of (m, lo, hi): each range as its two halves, one of a single place as it is."""

    def split(r: Column) -> Column:
        mid = _half(r["lo"], r["hi"])
        part = lambda lo, hi: F.struct(r["m"].alias("m"), lo.alias("lo"), hi.alias("hi"))
        return F.when(mid > r["lo"], F.array(part(r["lo"], mid), part(mid, r["hi"]))).otherwise(F.array(r))

    return F.flatten(F.transform(ranges, split))


def _keyed(rows: DataFrame) -> DataFrame:
    """(_key, m, lo, hi, word, n) of rows (_range, word, n)."""
    r = lambda name: F.col(f"_range.{name}")
    length = F.char_length("word")
    shared = F.concat(F.substr("word", F.lit(1), r("lo")), F.substr("word", length - r("m") + r("hi") + 1, r("m") - r("hi")))
    return rows.select(F.concat_ws(":", r("m"), r("lo"), shared).alias("_key"), r("m").alias("m"), r("lo").alias("lo"), r("hi").alias("hi"), "word", "n")


def in_ranges(words: DataFrame, most: int = MOST) -> DataFrame:
    """(_key, m, lo, hi, word, n): each word (lineage cut) under the keys of its ranges, as the longer word of a pair and as the shorter one.

    A key of more than `most` words has its range halved, again and again; the sizes are counted before anything is
    moved, and the hot keys, at most one in `most` rows, are broadcast if they are small.
    """
    length = F.char_length("word").cast("int")
    whole = F.array(*[F.struct((length + more).alias("m"), F.lit(0).alias("lo"), (length + more).alias("hi")) for more in (0, 1)])
    rows, settled = _keyed(words.select(F.explode(_halves(_halves(whole))).alias("_range"), "word", "n")), None
    while True:
        sizes = rows.filter("hi > lo + 1").groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
        hot = cut_lineage(sizes.filter(F.col("_n") > most).select("_key"))
        if hot.isEmpty():
            return rows if settled is None else settled.unionByName(rows)
        size = F.octet_length("_key")
        rest = join_side(rows, hot, "_key", "left_anti", size)
        settled = rest if settled is None else settled.unionByName(rest)
        dense = join_side(rows, hot, "_key", "left_semi", size)
        rows = _keyed(dense.select(F.explode(_halves(F.array(F.struct("m", "lo", "hi")))).alias("_range"), "word", "n"))


class _Rows:
    """Rows of whole keys: code points of their words, and where the ranges lie."""

    def __init__(self, table: pa.Table):
        words = table.column("word").combine_chunks()
        self.length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = words.to_pylist()
        codes = np.frombuffer("".join(self.words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.codes = codes.astype(np.uint8) if not len(codes) or codes.max() < 256 else codes
        self.begin = np.cumsum(self.length) - self.length
        self.m, self.lo, self.hi, self.n = (table.column(c).to_numpy().astype(np.int64) for c in ("m", "lo", "hi", "n"))
        keys = table.column("_key").combine_chunks().dictionary_encode().indices.to_numpy()
        self.start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        self.size = np.diff(np.r_[self.start, len(keys)])

    def _window(self, rows: np.ndarray, first: np.ndarray, step: int, inside: np.ndarray) -> np.ndarray:
        place = np.where(inside, self.begin[rows][:, None] + first[:, None] + step * np.arange(inside.shape[1]), 0)
        return np.where(inside, self.codes[place], 0)

    def matrices(self, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """What follows the shared prefix, and what comes before the shared suffix, read backwards; padded with 0."""
        k, end = np.arange(width), self.length[rows] - self.m[rows] + self.hi[rows]
        front = self._window(rows, self.lo[rows], 1, self.lo[rows][:, None] + k < self.length[rows][:, None])
        return front, self._window(rows, end - 1, -1, end[:, None] - 1 - k >= self.lo[rows][:, None])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows a < b of one key whose words are one edit apart, with a common prefix that ends within the range."""
        out, widths = [(np.empty(0, np.int64),) * 2], (self.hi - self.lo)[self.start]
        for width in np.unique(widths[self.size > 1]).tolist():
            some = (widths == width) & (self.size > 1)
            rows = np.repeat(self.start[some] - np.r_[0, np.cumsum(self.size[some])[:-1]], self.size[some]) + np.arange(self.size[some].sum())
            local = np.zeros(len(self.m), np.int64)
            local[rows] = np.arange(len(rows))
            front, back = self.matrices(rows, width)
            side = max(1, min(SIDE, int((CELLS / width) ** 0.5)))
            for a, na, b, nb in _blocks(self.start[some], self.size[some], side):
                ia, ib = np.minimum(a[:, None] + np.arange(na.max()), len(self.m) - 1), np.minimum(b[:, None] + np.arange(nb.max()), len(self.m) - 1)
                la, lb = local[ia], local[ib]
                prefix, suffix = _common(front[la], front[lb]), _common(back[la], back[lb])
                near = (prefix < width) & (prefix + suffix >= width - 1) & (ia[:, :, None] < ib[:, None, :])
                near &= (np.arange(na.max()) < na[:, None])[:, :, None] & (np.arange(nb.max()) < nb[:, None])[:, None, :]
                long = self.length == self.m  # two words of m - 1 meet elsewhere, as longer ones
                near &= long[ia][:, :, None] | long[ib][:, None, :]
                t, x, y = np.nonzero(near)
                out.append((ia[t, x], ib[t, y]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of every row of a tile with every row of the other."""
    same = a[:, :, None, :] == b[:, None, :, :]
    return np.where(same.all(-1), same.shape[-1], same.argmin(-1))


def _blocks(start: np.ndarray, size: np.ndarray, side: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Tiles (first row, rows, first row, rows), several of like size at once: a small key with itself, the blocks of a larger one in pairs."""
    tiles = [np.stack([start, size, start, size], 1)[size <= side]]
    for first, n in zip(start[size > side].tolist(), size[size > side].tolist(), strict=True):
        at = np.arange(first, first + n, side)
        rows = np.minimum(side, first + n - at)
        i, j = np.triu_indices(len(at))
        tiles.append(np.stack([at[i], rows[i], at[j], rows[j]], 1))
    every = np.concatenate(tiles)
    longest = np.maximum(every[:, 1], every[:, 3])
    kind = np.ceil(np.log2(np.maximum(longest, 1))).astype(int)
    for k in np.unique(kind).tolist():
        of = every[kind == k]
        step = max(1, CELLS // (4**k * 8))
        for at in range(0, len(of), step):
            yield tuple(of[at : at + step].T)


def _summed(table: pa.Table) -> pa.RecordBatch:
    """A row for each row that has near ones: word, n_near, form, form_n; the form is the most frequent, then the least."""
    rows = _Rows(table)
    a, b = rows.pairs()
    own, other = np.r_[a, b], np.r_[b, a]
    some = np.unique(other)
    place = np.empty(len(rows.m), np.int64)
    place[sorted(some.tolist(), key=lambda i: (-rows.n[i], rows.words[i]))] = np.arange(len(some))
    order = np.lexsort((place[other], own))
    own, other = own[order], other[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else own
    counts = np.diff(np.r_[first, len(own)])
    words = table.column("word").combine_chunks()
    columns = [words.take(pa.array(own[first])), pa.array(counts, pa.int64()), words.take(pa.array(other[first])), pa.array(rows.n[other[first]], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["word", "n_near", "form", "form_n"])


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares what shares a key; a partition's rows come in the order of their keys, and whole keys are held only."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < ROWS:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column("_key")
        same = pc.equal(keys, keys[-1])
        stop = pc.index(same, True).as_py()
        if stop:
            yield _summed(table.slice(0, stop))
            held = table.slice(stop).to_batches()
    if held:
        yield _summed(pa.Table.from_batches(held))


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n, n_near, form, form_n) of distinct words (word, n; lineage cut, read more than once).

    n_near counts the words one edit away; form is the most frequent of them (ties: the least by code points). What a
    tile finds is summed for each of its words before it is shuffled, so no pair is.
    """
    found = in_ranges(words, most).repartition("_key").sortWithinPartitions("_key").mapInArrow(_tiled, "word string, n_near long, form string, form_n long")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form"))))
    none = words.select("word", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("form_n"), "n")
    both = none.unionByName(found.withColumn("n", F.lit(None).cast("long"))).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("_best"))
    return both.select("word", "n", "n_near", F.col("_best.form").alias("form"), (-F.col("_best.n")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form; lineage cut): the last of the forms that follow from a word. Forms lead to no circle.

    Each round looks up the end of an end, so a chain halves; the rounds are written to the checkpoint folder.
    """
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        ends = now.select(F.col("word").alias("root"), F.col("root").alias("_far"))
        step = cut_lineage(now.join(ends, "root", "left").select("word", F.coalesce("_far", "root").alias("root"), F.col("_far").isNotNull().alias("_moved")))
        now = step.drop("_moved")
        if step.filter("_moved").isEmpty():
            return now


def spelling_variants(words: DataFrame, ratio: int = RATIO, most: int = MOST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n).

    A row for each distinct word; rows of one word are added up, null words left out, further columns too, whatever
    their names; an empty table gives an empty result. form is null where no near word is `ratio` times as frequent, and
    root is the word itself then. As frequencies rise along a chain of forms, none is endless.
    """
    counted = cut_lineage(words.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    chosen = F.col("form_n") >= F.col("n") * ratio
    near = cut_lineage(near_words(counted, most).select("word", "n", "n_near", F.when(chosen, F.col("form")).alias("form"), F.when(chosen, F.col("form_n")).alias("form_n")))
    ends = roots(near.filter("form IS NOT NULL").select("word", "form"))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    """Variants among the words of all texts; nulls, repeats and empty tables as `noisy_words` and `spelling_variants` have them."""
    return spelling_variants(noisy_words(spark.read.parquet(f"{sf_dir}/documents.parquet")))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Pairs by what is left of a word without one code point: equal at the same place, or equal to the other word.
SQL = {
    "op12_spelling": f"""WITH RECURSIVE {CRC_TABLE},
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{7,}}')) AS run FROM documents),
u AS (SELECT id, translate(run, '{_UPPER}', '{_UPPER.lower()}') AS run FROM r),
h AS (SELECT run, {crc32("id || ':' || run")} AS h FROM u, crc),
k AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
v AS (SELECT word, count(*) AS n FROM k WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
d AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM v)),
p AS (SELECT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.rest = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.rest = v.word),
f AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS form, max(m) AS form_n FROM p GROUP BY word),
g AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM v LEFT JOIN f ON f.word = v.word),
c AS (SELECT word, form AS place FROM g WHERE form IS NOT NULL UNION ALL SELECT c.word, g.form FROM c JOIN g ON g.word = c.place WHERE g.form IS NOT NULL)
SELECT g.word, g.form, coalesce(e.place, g.word) AS root, g.n, g.n_near, g.form_n FROM g LEFT JOIN (SELECT c.word, c.place FROM c JOIN g ON g.word = c.place WHERE g.form IS NULL) e ON e.word = g.word"""
}
