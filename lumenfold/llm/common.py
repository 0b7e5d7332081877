"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but these six characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir.

    Where none is named, a local session gets a temporary one; on a cluster, whose executors could not read it, that is an error.
    """
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() is not None:
        return
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_CLASS + "+")).cast("long")


def whole_text(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """`docs` as one struct column, row, so that no name of theirs clashes with `more`; `select("row.*")` unpacks it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


#: A key with more than one row in so many is hot: there are at most as many such keys.
HOT_PART = 4096


def join_hot(rows: DataFrame, side: DataFrame, key: str, count: str, spread: Column, total: int | None = None) -> DataFrame:
    """Left join of `rows` with `side`, which has each `key` once and the `count` of its rows; neither key nor count stay in the side.

    `total` is the sum of the counts, where it is known; else it is worked out.

    Hot keys, HOT_PART at most, come by a broadcast, and their rows go through the shuffle under a key of their own, as
    `spread` (of the key's type) deals them, so no task gets all of them. Cut the lineage of `side`: it is read three times.
    """
    total = (side.agg(F.sum(count)).first()[0] or 0) if total is None else total
    values = [c for c in side.columns if c not in (key, count)]
    hot = side.filter(F.col(count) * HOT_PART > total).select(F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot"))
    rows = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    rest = side.filter(F.col(count) * HOT_PART <= total).select(F.col(key).alias("_rest_key"), F.struct(*values).alias("_rest"))
    found = rows.join(rest, F.when(F.col("_hot").isNull(), F.col(key)).otherwise(spread) == F.col("_rest_key"), "left")
    chosen = F.when(F.col("_hot").isNotNull(), F.col("_hot")).otherwise(F.col("_rest"))
    return found.withColumn("_found", chosen).drop("_hot_key", "_hot", "_rest_key", "_rest").select("*", *[F.col(f"_found.{v}").alias(v) for v in values]).drop("_found")


#: Copies of a row that is joined to a hot key.
SALTS = 32


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """(_hot): keys that hold more than one in HOT_PART of `rows` (lineage cut, read twice), so HOT_PART of them at most."""
    total = rows.count()
    return rows.groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") * HOT_PART > total).select("_hot")


def join_salted(rows: DataFrame, side: DataFrame, key: str, hot: DataFrame, spread: Column) -> DataFrame:
    """Inner join by `key`, where rows of `hot` keys are dealt by `spread` over SALTS tasks and their partners copied to each; for partners too large to broadcast."""
    known = F.broadcast(hot)
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0).cast("int")
    dealt = rows.join(known, F.col(key) == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot")
    every = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copied = side.join(known, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return dealt.join(copied, [key, "_salt"]).drop("_salt")


def running_start(df: DataFrame, group: list[str], bucket: str, order: list[str], amount: Column, name: str) -> DataFrame:
    """Add `name`: the sum of `amount` over the rows of the same group that come before, in order (bucket, *order).

    No group is gathered in one task: rows are summed within (group, bucket), and the sums of whole buckets, of
    which a group has a fixed number, give each bucket its offset. `df` is read twice, so pass a narrow one whose
    lineage is cut.
    """
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*[f"_g{i}" for i in range(len(group))]).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col(bucket).alias("_b")).agg(F.sum(amount).alias("_sum"))
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    match = F.col(bucket) == F.col("_b")
    for i, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = df.withColumn("_in", F.coalesce(F.sum(amount).over(within), F.lit(0))).join(offsets, match, "left")
    return out.withColumn(name, F.col("_in") + F.col("_offset")).drop("_in", "_offset", "_b", *[f"_g{i}" for i in range(len(group))])
