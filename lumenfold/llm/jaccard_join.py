"""N-gram Jaccard join with adaptive multi-match prefixes.

Shingles are ordered from rare to frequent by counts over all documents. Documents that reach the threshold
share at least l shingles among the first n - ceil(t n) + l of each; every document picks the l whose longer prefix
promises the least work, by the estimated frequency of its prefix shingles, and a pair is verified if it shares as many
prefix shingles as the smaller l of the two asks for.

Groups of copies never become pairs: documents of equal sets are one class, and near copies are first linked, exactly,
to the documents of the
most frequent shingles (hubs) that they share most min-hashes with. What these links join already is one cluster, and the
prefix join looks only at shingles, and emits only pairs, that lie across clusters. A link found or left out is always
verified on whole sets, and none between different clusters is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import cut_lineage, hot_keys, join_salted, packed
from lumenfold.llm.components import components
from lumenfold.llm.words import WordHashes, join_side, keyed_texts, row_name, shingle_set

#: Shingle length in words; threshold as a fraction; min-hashes, and how many of them a
#: document shares with the hubs it is compared with first, and how many these
#: are at most; longest choice of l; cost of verifying a candidate, in
#: posting entries.
WORDS, OVER, UNDER, MIN_HASHES, MET, HUBS, MOST_SHARED, VERIFY = 5, 75, 100, 8, 3, 2, 4, 8.0
#: Least bits of a parity bitmap, and bits of the one that goes along with a shingle.
BITS, FOLDED = 2048, 512
#: Documents and shingles of a slice, how many of its documents hold a frequent shingle, and how many frequent shingles
#: are told apart; shingles of the sets that a task hands over at once. Shingles that two documents of a slice hold must
#: count as frequent: long documents that share a passage would otherwise meet on it, all with all.
SLICE, SLICE_SHINGLES, OFTEN, KEPT, HANDED = 4000, 1 << 21, 2, 1 << 18, 1 << 19
_MULTIPLIERS = np.random.default_rng(20).integers(1, 1 << 63, MIN_HASHES, dtype=np.uint64) | np.uint64(1)


def _in_slices(batches: Iterator[pa.RecordBatch], k: int, most_rows: int, most_shingles: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """(keys, sets) of slices of the batches (_key, _text), with at most so many rows, and shingles but for the last set.

    A caller may clear the lists when it is done with them.
    """
    cache = WordHashes()
    for batch in batches:
        keys, sets, held = [], [], 0
        for key, text in keyed_texts(batch):
            keys.append(key)
            sets.append(shingle_set(text, cache, k))
            held += len(sets[-1])
            if len(sets) == most_rows or held >= most_shingles:
                yield keys, sets
                keys, sets, held = [], [], 0
        if sets:
            yield keys, sets


def _frequent(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _in_slices(batches, k, SLICE, SLICE_SHINGLES):
            every = np.concatenate(sets)
            sets.clear()
            every.sort()
            first, last = every[: max(len(every) - OFTEN + 1, 0)], every[OFTEN - 1 :]
            token = np.unique(first[first == last])
            n = np.searchsorted(every, token, "right") - np.searchsorted(every, token, "left")
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    return run


def frequent_shingles(rows: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, counts) of the KEPT most frequent ones, as counted in slices of documents that hold them often.

    Any order of shingles gives the same links. This one only has to put the frequent ones last, so those that no slice
    holds often count as rare, and the table has a fixed size.
    """
    counts = rows.select("_key", "_text").mapInArrow(_frequent(k), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.col("n").desc(), "token").limit(KEPT).toArrow()
    tokens, n = top["token"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(tokens)
    return tokens[order], n[order]


def _counts_of(s: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The counts of the shingles of s; 0 for rare ones."""
    if not len(tokens):
        return np.zeros(len(s), np.int64)
    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
    return np.where(tokens[at] == s, counts[at], 0)


def least_overlap(n: int) -> int:
    """ceil(t * n): what a set of n shingles shares at least with any that reaches the threshold."""
    return -(-OVER * n // UNDER)


def choose_shared(costs: np.ndarray, n: int) -> int:
    """The l, up to MOST_SHARED, of least estimated cost; costs are those of the shingles in order, rare first."""
    most = min(MOST_SHARED, least_overlap(n))
    first = n - least_overlap(n)
    sums = np.cumsum(costs[: first + most])
    tries = np.arange(1, most + 1)
    return int(np.argmin(sums[first + tries - 1] * (1 + VERIFY / tries**2))) + 1


def parity_bits(s: np.ndarray, m: int) -> np.ndarray:
    """m bits, each flipped by the shingles that fall on it: two sets differ in as many shingles as bits at least.

    m is a power of two; the exclusive or of the halves is the bitmap of m / 2 bits.
    """
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) & (m - 1), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def bits_for(n: int) -> int:
    """Bits of the bitmap of a set of n shingles: n at least, as a bitmap of fewer fills up and tells nothing apart."""
    return max(BITS, 1 << (n - 1).bit_length())


_LONGS = pa.list_(pa.int64())
_SIGNED = pa.schema([("_key", pa.int64()), ("n", pa.int32()), ("digest", pa.binary()), ("mins", _LONGS), ("bits", _LONGS), ("fold", _LONGS), ("common", pa.int64()), ("shared", pa.int32()), ("prefix", _LONGS)])


def _sign(k: int, tokens: np.ndarray, counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sets in _in_slices(batches, k, SLICE, HANDED):
            out = []
            for key, s in zip(keys, sets, strict=True):
                n = len(s)
                if not n:
                    out.append((key, 0, None, None, None, None, 0, 0, None))
                    continue
                seen = _counts_of(s, tokens, counts)
                order = np.argsort(seen, kind="stable")  # ties in the order of hashes
                shared = choose_shared(seen[order], n)
                prefix = s[order[: n - least_overlap(n) + shared]]
                mins = [int((s * m).min()) >> 1 for m in _MULTIPLIERS]
                out.append((key, n, xxhash.xxh3_128_digest(s.tobytes()), np.array(mins, np.int64), parity_bits(s, bits_for(n)), parity_bits(s, FOLDED), int(seen.mean()), shared, prefix.view(np.int64)))
            sets.clear()
            yield pa.RecordBatch.from_arrays([pa.array(column, type=field.type) for column, field in zip(zip(*out, strict=True), _SIGNED, strict=True)], schema=_SIGNED)

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sets in _in_slices(batches, k, SLICE, HANDED):
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            values = np.concatenate(sets).view(np.int64)
            sets.clear()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["_key", "set"])

    return run


def _least_difference():
    """Shingles that two sets, of sizes _n1 and _n2 and bitmaps _bits1 and _bits2, differ in at least.

    The sizes alone tell apart sets that can't link. Bitmaps of the others have equal lengths, or one has twice as many.
    """
    x, y = F.col("_bits1"), F.col("_bits2")
    middle = lambda c: (F.size(c) / 2).cast("int")
    half = lambda c: F.zip_with(F.slice(c, F.lit(1), middle(c)), F.slice(c, middle(c) + 1, middle(c)), lambda p, q: p.bitwiseXOR(q))
    short, long = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    long = F.when(F.size(x) == F.size(y), long).otherwise(half(long))
    differ = F.aggregate(F.zip_with(short, long, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda p, q: p + q)
    fits = UNDER * F.least("_n1", "_n2") >= OVER * F.greatest("_n1", "_n2")
    return F.greatest(F.when(fits, differ).otherwise(F.lit(0)), F.abs(F.col("_n1") - F.col("_n2")))


def _compare(rows: DataFrame, reps: DataFrame, pairs: DataFrame, k: int, repeats: bool) -> DataFrame:
    """(a, b, linked, low, high) of the pairs (a, b); low and high bound the Jaccard distance.

    `repeats` tells that a key may be in several of `rows`, all of one text; `reps` has a key once.

    Sizes and parity bitmaps show that most pairs differ in too many shingles. The rest, next to all of them links, are compared
    on their whole sets.
    """
    pairs = cut_lineage(pairs)
    ids = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("_key")).distinct())
    bits = join_side(reps.select("_key", "n", "bits"), ids, "_key", "left_semi", F.lit(16)).repartition("_key")  # dealt once, read twice
    side = lambda t, key, x: t.select(F.col("_key").alias(key), *[F.col(c).alias(f"_{c}{x}") for c in t.columns if c != "_key"])
    hubs = hot_keys(pairs, "a")  # a hub may be compared with a third of all
    near = join_salted(pairs, side(bits, "a", 1), "a", hubs, F.col("b")).join(side(bits, "b", 2), "b")
    near = near.select("a", "b", (F.col("_n1") + F.col("_n2")).alias("_sum"), _least_difference().alias("_differ"))
    near = cut_lineage(near.withColumn("_far", (OVER + UNDER) * F.col("_differ") > (UNDER - OVER) * F.col("_sum")))
    close = near.filter("NOT _far").select("a", "b")
    some = cut_lineage(close.select(F.explode(F.array("a", "b")).alias("_key")).distinct())
    sets = join_side(rows, some, "_key", "left_semi", F.lit(16)).mapInArrow(_sets(k), "_key long, set array<long>")
    sets = sets.dropDuplicates(["_key"]) if repeats else sets.repartition("_key")
    both = join_salted(close.join(side(sets, "b", 2), "b"), side(sets, "a", 1), "a", hot_keys(close, "a"), F.col("b"))
    both = both.withColumn("_both", F.size(F.array_intersect("_set1", "_set2"))).withColumn("_all", F.size("_set1") + F.size("_set2") - F.col("_both"))
    apart = 1 - F.col("_both") / F.col("_all")
    told = both.select("a", "b", (UNDER * F.col("_both") >= OVER * F.col("_all")).alias("linked"), apart.alias("low"), apart.alias("high"))
    return told.union(near.filter("_far").select("a", "b", F.lit(False), 2 * F.col("_differ") / (F.col("_sum") + F.col("_differ")), F.lit(1.0)))


def _nodes(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, DataFrame | None]:
    """(key of a row, its names): the id itself and None, if every row has an id of its own.

    Else the key is a hash of id and text, so that it is the same whenever the rows are read, and only rows that are equal
    in both share it, as is verified; the names are (_key, _id, _rows).
    """
    ids = docs.select(F.col(id_col).cast("long").alias("_id"))
    if ids.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1 OR _id IS NULL").isEmpty():
        return F.col(id_col).cast("long"), None
    seed = 0
    while True:
        key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), row_name(id_col, text_col)), 1)
        named = docs.select(F.col(id_col).cast("long").alias("_id"), key.alias("_key"), row_name(id_col, text_col).alias("_name"))
        names = named.groupBy("_key").agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("_rows"), F.min("_name").alias("_low"), F.max("_name").alias("_high"))
        names = cut_lineage(names)
        if names.filter("_low <> _high").isEmpty():
            return key, names.select("_key", "_id", "_rows")
        seed += 1


def near_groups(docs: DataFrame, k: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n_shingles, component_id (the least id that links reach, its own included).

    A null or empty text has no shingle and no link. Every row is a node: rows without an id, or of the same id, are
    joined by links of their texts only. A null id comes after all others, so it is a component's id only where no other
    is in it. An empty table gives an empty result; further columns are left out.
    """
    key, names = _nodes(docs, id_col, text_col)
    nodes = _linked(docs, k, text_col, key, names)
    if names is not None:
        nodes = docs.select(key.alias("_key")).join(nodes, "_key")
    return nodes.select(F.col("_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("_least").alias("component_id"))


def _linked(docs: DataFrame, k: int, text_col: str, key: Column, names: DataFrame | None) -> DataFrame:
    """(_key, _id, n, _least, _rep) of every node: the least id of its component, and the key of that node."""
    rows = docs.select(key.alias("_key"), F.col(text_col).alias("_text"))
    repeats = names is not None
    tokens, counts = frequent_shingles(rows, k)
    signed = rows.mapInArrow(_sign(k, tokens, counts), "_key long, n int, digest binary, mins array<long>, bits array<long>, fold array<long>, common long, shared int, prefix array<long>")
    signed = cut_lineage(signed.dropDuplicates(["_key"]) if repeats else signed)

    classes = signed.filter("n > 0").groupBy("digest").agg(F.min("_key").alias("rep"))
    copies = cut_lineage(signed.select("_key", "digest").join(classes, "digest").filter("_key <> rep").distinct())
    reps = join_side(signed.filter("n > 0"), copies.select("_key", "digest"), ["_key", "digest"], "left_anti", F.lit(48))

    keys = reps.select("_key", "common", F.posexplode("mins").alias("i", "h"))
    hubs = keys.groupBy("i", "h").agg(F.max(F.struct("common", (-F.col("_key")).alias("k"))).alias("_hub"), F.min("_key").alias("_first"), F.max("_key").alias("_last"))
    hubs = hubs.filter("_first <> _last").select("i", "h", (-F.col("_hub.k")).alias("hub"))
    met = keys.join(hubs, ["i", "h"]).filter("_key <> hub").groupBy("_key", "hub").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= MET)
    best = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("_n", (-F.col("hub")).alias("h"))))), 1, HUBS)  # of MIN_HASHES at most
    near = met.groupBy(F.col("_key").alias("b")).agg(best.alias("_best")).select("b", F.explode("_best").alias("_e")).select((-F.col("_e.h")).alias("a"), "b")
    compared = cut_lineage(_compare(rows, reps, near, k, repeats))
    links = compared.filter("linked").select("a", "b")
    # the hub that a document was compared with, and bounds of their distance; a hub is its own
    hubbed = compared.select(F.col("b").alias("_key"), F.col("a").alias("hub"), "low", "high", F.lit(0).alias("_o")).union(compared.select("a", "a", F.lit(0.0), F.lit(0.0), F.lit(1)))
    hubbed = hubbed.groupBy("_key").agg(F.min(F.struct("_o", "high", "hub", "low")).alias("_h")).select("_key", "_h.hub", "_h.low", "_h.high")
    clusters = components(links).withColumnRenamed("id", "_key")

    # (token, cluster) once each, in one shuffle by token that finds the shingles across clusters and their rows
    tokens = join_side(reps.select("_key", "prefix"), clusters, "_key", "left", F.lit(24)).select("_key", "component", F.posexplode("prefix").alias("pos", "token"))
    members = tokens.filter("component IS NOT NULL")
    held = tokens.filter("component IS NULL").select("token", F.col("_key").alias("cluster"), "pos").union(members.select("token", F.col("component").alias("cluster"), F.lit(0)).distinct()).repartition("token")
    across = held.groupBy("token").agg(F.min("cluster").alias("_low"), F.max("cluster").alias("_high")).filter("_low <> _high").select("token")
    spread = cut_lineage(held.join(across, "token", "left_semi"))
    inside = members.join(spread.select("token", F.col("cluster").alias("component")), ["token", "component"], "left_semi").select("token", "component", "_key", "pos")
    alone = spread.join(clusters, F.col("cluster") == F.col("component"), "left_anti").select("token", F.col("cluster"), F.col("cluster").alias("_key"), "pos")
    lists = alone.union(inside).join(reps.select("_key", "n", "shared", "fold"), "_key").join(hubbed, "_key", "left")
    lists = cut_lineage(lists)
    left = lists.select("token", F.col("_key").alias("a"), F.col("n").alias("_na"), F.col("shared").alias("_la"), F.col("cluster").alias("_ca"), F.col("pos").alias("_pa"), F.col("hub").alias("_ha"), F.col("low").alias("_sa"), F.col("high").alias("_ta"), F.col("fold").alias("_fa"))
    right = lists.select("token", F.col("_key").alias("b"), F.col("n").alias("_nb"), F.col("shared").alias("_lb"), F.col("cluster").alias("_cb"), F.col("pos").alias("_pb"), F.col("hub").alias("_hb"), F.col("low").alias("_sb"), F.col("high").alias("_tb"), F.col("fold").alias("_fb"))
    sized = (UNDER * F.least("_na", "_nb") >= OVER * F.greatest("_na", "_nb")) & (F.col("a") < F.col("b")) & (F.col("_ca") != F.col("_cb"))
    # the distance is a metric: documents whose distances from one hub differ by more than the greatest
    # distance of a link have none
    sized = sized & ~F.coalesce((F.col("_ha") == F.col("_hb")) & (F.greatest(F.col("_sa") - F.col("_tb"), F.col("_sb") - F.col("_ta")) > 1 - OVER / UNDER + 1e-9), F.lit(False))
    # folded bitmaps show most pairs that differ in too many shingles
    differ = sum((F.bit_count(F.col("_fa")[i].bitwiseXOR(F.col("_fb")[i])) for i in range(FOLDED // 64)), F.lit(0))
    sized = sized & ((OVER + UNDER) * differ <= (UNDER - OVER) * (F.col("_na") + F.col("_nb")))
    # the first l shared shingles lie so early in both that what follows can still make up the overlap
    overlap = F.ceil(OVER * (F.col("_na") + F.col("_nb")) / F.lit(OVER + UNDER))
    asked = F.least("_la", "_lb")
    early = (F.col("_pa") <= F.col("_na") - overlap + asked - 1) & (F.col("_pb") <= F.col("_nb") - overlap + asked - 1)
    pairs = left.join(right, (left["token"] == right["token"]) & sized & early).groupBy("a", "b").agg(F.count(F.lit(1)).alias("_n"), F.least(F.min("_la"), F.min("_lb")).alias("_l")).filter("_n >= _l").select("a", "b")
    more = _compare(rows, reps, pairs, k, repeats).filter("linked").select("a", "b")

    # what the first links join is known: each end and its least one stand for them
    ends = components(clusters.select(F.col("component").alias("a"), F.col("_key").alias("b")).union(more).union(copies.select(F.col("rep").alias("a"), F.col("_key").alias("b")))).withColumnRenamed("id", "_key")
    nodes = signed.select("_key", "n")
    if names is None:
        nodes = join_side(nodes, ends, "_key", "left", F.lit(24))
        return nodes.select("_key", F.col("_key").alias("_id"), "n", F.coalesce("component", "_key").alias("_least"), F.coalesce("component", "_key").alias("_rep"))
    first = F.min(F.struct(F.col("_id").isNull().alias("z"), F.col("_id").alias("i"), F.col("_key").alias("k"))).alias("_f")
    firsts = ends.join(names, "_key").groupBy("component").agg(first)
    ends = cut_lineage(ends.join(firsts, "component").select("_key", F.col("_f.i").alias("_first"), F.col("_f.k").alias("_rep")))
    nodes = join_side(nodes.join(names, "_key"), ends, "_key", "left", F.lit(32))
    least = F.when(F.col("_rep").isNull(), F.col("_id")).otherwise(F.col("_first"))
    return nodes.select("_key", "_id", "n", least.alias("_least"), F.coalesce("_rep", "_key").alias("_rep"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS) -> DataFrame:
    """One row of `docs` for each group, that of the least id, with all its columns; rows without shingles all stay.

    Such rows are those of a null or empty text. A null id comes after all others; of rows equal in id and text one
    stays. An empty table gives an empty result; names of columns are free.
    """
    key, names = _nodes(docs, id_col, text_col)
    nodes = _linked(docs, k, text_col, key, names)
    gone = cut_lineage(nodes.filter("_key <> _rep").select("_key"))
    keyed = packed(docs, key.alias("_key"))
    left = join_side(keyed, gone, "_key", "left_anti", F.lit(16))
    if names is not None:
        # rows equal in id and text share a key, and one of them stays
        again = cut_lineage(nodes.filter("_key = _rep AND n > 0").join(names.filter("_rows > 1"), "_key", "left_semi").select("_key"))
        one = join_side(keyed, again, "_key", "left_semi", F.lit(16)).dropDuplicates(["_key"])
        left = join_side(left, again, "_key", "left_anti", F.lit(16)).unionByName(one)
    return left.select("row.*")


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = {
    "op10_jaccard_join": """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS reach FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.reach = e.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, (SELECT min(reach) FROM r WHERE r.id = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)""",
}
