"""Mixing sources to target weights.

Every document gets a hash-random key; within a source, documents lie in the order of that key; distributed prefix
sums of their word counts say where each begins; and the source is cut at its exact budget, after as many whole epochs
as the budget holds. The key's first three hex digits cut a source into 4096 ranges of equal expected size, so no
source is sorted or summed in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import cut_lineage, packed, running_start, word_count
from lumenfold.llm.words import row_name

#: Weights of the sources in code point order, null last, repeating; share of all words that the mix holds; epochs at most.
WEIGHTS, SHARE, EPOCHS, SEED = (5, 2, 1), 1.5, 2, "mix-1"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source.

    Targets share `share` of all sizes by weight; none is above `epochs` times its source. With the sources in the
    order of cap over weight, those up to some place are at their cap and the rest share what is left by weight: the
    fixed point of handing on the excess. Everything is exact but one division and one product a source.
    """
    table = F.array(*[F.lit(w) for w in weights])
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    w = sizes.withColumn("_w", F.element_at(table, (place % len(weights) + 1).cast("int"))).withColumn("_cap", F.col("source_size") * epochs)
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source"))
    every = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    from_here = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    w = w.withColumn("_level", (F.sum("source_size").over(every) * share - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_w").over(from_here))
    # the level of the first place where it holds for all sources from there on; beyond it every source is below its cap
    w = w.withColumn("_at", F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), F.col("_level").alias("level")))).over(every))
    return w.select("source", "source_size", F.when(F.col("_at").isNull(), F.col("_cap").cast("double")).otherwise(F.least(F.col("_cap").cast("double"), F.col("_at.level") * F.col("_w"))).alias("target"))


def key_of(id_col: str, seed: str = SEED) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """A row per document: id, source, size, source_size, target, start, taken.

    start is the words of its source before it in the order of keys; taken counts whole epochs plus what lies before
    the cut, in words. Nulls: a null text has size 0, the null source is a source of its own and last, null ids share
    a key and are ordered by size. Rows that repeat an id are documents of their own, laid side by side. An empty
    table gives an empty result, further columns are left out. The order depends on ids and seed alone, so reruns and
    recomputed partitions agree.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.col(text_col).alias("_text"), F.lit(None).cast("string").alias("_name"))
    return _mixed(rows, weights, share, epochs, seed).select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", "start", "taken")


def _mixed(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """(_id, _name, source, size, source_size, target, start, taken) of rows (_id, _source, _text, _name)."""
    sized = cut_lineage(rows.select("_id", F.col("_source").alias("source"), word_count(F.col("_text")).alias("size"), "_name"))
    keyed = sized.withColumn("_key", key_of("_id", seed)).withColumn("_range", F.substring("_key", 1, 3))
    placed = running_start(keyed, ["source"], "_range", ["_key", "size", "_name"], F.col("size"), "start")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    targets = targets.withColumnRenamed("source", "_source")
    out = placed.join(targets, F.col("source").eqNullSafe(F.col("_source")), "left")
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor("target").cast("long") - whole * F.col("source_size")
    taken = whole * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("start")))
    return out.select("_id", "_name", "source", "size", "source_size", "target", "start", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The rows of `docs` as often as the mix takes them, whole, with all their columns.

    The document that a cut falls into is taken whole. One of no words (a null text too) is taken as often as its
    source has whole epochs, once at least. Null ids and the null source are taken like others. Rows that share an id
    are told apart by their text; rows equal in both are taken as often as all of them together. An empty table gives
    an empty result; names of columns are free.
    """
    name = row_name(id_col, text_col)
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.col(text_col).alias("_text"), name.alias("_name"))
    mixed = _mixed(narrow, **how)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.greatest(F.lit(1), whole)).cast("int")
    taken = mixed.withColumn("_copies", copies).groupBy("_name").agg(F.sum("_copies").cast("int").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    taken = cut_lineage(taken.filter("_copies > 0"))
    picked = packed(docs, name.alias("_name")).join(taken, "_name")
    again = taken.filter("_rows > 1").select("_name")
    if not again.isEmpty():
        one = picked.join(again, "_name", "left_semi").dropDuplicates(["_name"])
        picked = picked.join(again, "_name", "left_anti").unionByName(one)
    return picked.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("row.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


SQL = {
    "op1_mixing": """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(concat_ws(':', 'mix-1', doc_id::VARCHAR)) AS key FROM documents),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * 2 AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
l AS (SELECT *, cap / w AS r, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, cap, w, (SELECT min({'r': r, 'level': level}) FROM l WHERE level * w <= cap).level AS level FROM l),
g AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, level * w) END AS target FROM t)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END * size
   + least(size, greatest(0, floor(target) - CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END * source_size - start)))::BIGINT AS taken
FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source""",
}
