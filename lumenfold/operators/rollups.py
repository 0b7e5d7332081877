"""Statuses, frequencies, coverage and order of library rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators.quality import bounded, weighted_quality
from lumenfold.operators.relational import latest


def aggregate_quality(rows: DataFrame, keys: list[str], metrics: dict[str, Column], weights: dict[str, float]) -> DataFrame:
    """Mean of each bounded metric over a group, then the weighted quality of the means."""
    means = rows.groupBy(*keys).agg(*[F.avg(bounded(c)).alias(m) for m, c in metrics.items()])
    return means.select(*keys, weighted_quality({m: F.col(m) for m in metrics}, weights).alias("_q")).select(*keys, "_q.overall", "_q.rating")


def run_status(viewports: DataFrame, keys: list[str], status: Column) -> DataFrame:
    """Blocked when all are, complete when all are, partial when any is complete or partial, else failed.

    A null status counts as none of these.
    """
    n = lambda *s: F.count(F.when(status.isin(*s), 1))
    total = F.count(F.lit(1))
    rolled = F.when(n("blocked") == total, "blocked").when(n("complete") == total, "complete").when(n("complete", "partial") > 0, "partial").otherwise("failed")
    return viewports.groupBy(*keys).agg(rolled.alias("status"))


def name_frequency(items: DataFrame, name: str, confidence: str | None, top: int) -> DataFrame:
    """The `top` most frequent names, ties by name, with their mean confidence; null names are left out."""
    mean = [F.round(F.avg(confidence), 4).alias("avg_confidence")] if confidence else []
    counts = items.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n"), *mean)
    return counts.orderBy(F.col("n").desc(), name).limit(top)


def layout_shift(shifts: DataFrame, keys: list[str], value: Column, recent_input: Column) -> DataFrame:
    """Cumulative layout shift without shifts after recent input; a missing value adds nothing."""
    counted = F.when(~F.coalesce(recent_input, F.lit(False)), F.coalesce(value, F.lit(0.0))).otherwise(0.0)
    return shifts.groupBy(*keys).agg(F.round(F.sum(counted), 6).alias("cumulative_layout_shift"))


def coverage(left: DataFrame, right: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Ids in both sets (covered) and in either (total). A member once a side before the sides meet."""
    side = lambda df, flag: df.select(*keys, member).distinct().withColumn(flag, F.lit(1))
    both = side(left, "_l").join(side(right, "_r"), [*keys, member], "full_outer")
    return both.groupBy(*keys).agg(F.count(F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), 1)).alias("covered"), F.count(F.lit(1)).alias("total"))


def by_best_score(rows: DataFrame, scores: DataFrame, groups: list[str], key: str, score_key: str, score: str) -> DataFrame:
    """K3: rows in the order of their best score within a group; ties by key, rows without a score last."""
    best = scores.groupBy(F.col(score_key).alias(key)).agg(F.max(score).alias("best"))
    order = Window.partitionBy(*groups).orderBy(F.col("best").desc_nulls_last(), key)
    return rows.join(best, key, "left").withColumn("rank", F.row_number().over(order))


def unique_urls(urls: DataFrame, key: Column, position: str) -> DataFrame:
    """B2: first position of each key and the number of later ones; null and empty keys are left out."""
    keyed = urls.select(key.alias("key"), position).filter("key <> ''")
    return keyed.groupBy("key").agg(F.min(position).alias(position), (F.count(F.lit(1)) - 1).alias("skipped_duplicate"))


def preferred(rows: DataFrame, keys: list[str], first: Column, *order: Column) -> DataFrame:
    """One row a key: one that meets `first` if there is any, then by order."""
    return latest(rows, keys, F.coalesce(first, F.lit(False)).desc(), *order)


def preferred_viewport(views: DataFrame, keys: list[str], name: str, *order: Column, wanted: str = "desktop") -> DataFrame:
    """One viewport a key: the one of the wanted name, else one whose name holds it in any case, else the first by order."""
    place = F.when(F.col(name) == wanted, 0).when(F.lower(name).contains(wanted.lower()), 1).otherwise(2)
    return latest(views, keys, place, *order)


def count_mismatch(declared: DataFrame, rows: DataFrame, key: str, count: str) -> DataFrame:
    """V4: declared counts that the rows don't bear out."""
    actual = rows.groupBy(key).agg(F.count(F.lit(1)).alias("actual"))
    joined = declared.select(key, F.col(count).alias("declared")).join(actual, key, "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return joined.filter(~F.col("declared").eqNullSafe(F.col("actual")))


def stale_subjects(subjects: DataFrame, existing: DataFrame, key: str, digest: str) -> DataFrame:
    """Subjects without a vector of the same content digest; a null digest is always pending."""
    known = existing.select(key, F.col(digest).alias("_known"))
    return subjects.join(known, key, "left").filter(F.col(digest).isNull() | F.col("_known").isNull() | (F.col(digest) != F.col("_known"))).drop("_known")
