"""Quality, cost and job rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: The ten metrics of a capture and their weights.
WEIGHTS = {
    "subsystem_success": 0.1,
    "geometry_coverage": 0.15,
    "style_coverage": 0.12,
    "screenshot_completeness": 0.12,
    "accessibility_coverage": 0.1,
    "asset_completeness": 0.08,
    "font_completeness": 0.08,
    "network_completion": 0.1,
    "state_restoration": 0.08,
    "scroll_restoration": 0.07,
}


def decimals(x: Column, n: int = 4) -> Column:
    """Rounded half up as the decimal number that is meant: what lies beyond 14 places is noise of binary fractions."""
    return F.round(x.cast("decimal(30,14)"), n).cast("double")


def bounded(x: Column) -> Column:
    """To [0, 1], four decimals; NaN, infinity and null become 0."""
    x = x.cast("double")
    return decimals(F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))), 4)


def weighted_quality(metrics: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """Struct (overall, rating); weights sum up to 1, a metric that isn't given counts as 0."""
    overall = bounded(sum((bounded(metrics.get(m, F.lit(0.0))) * w for m, w in weights.items()), F.lit(0.0)))
    rating = F.when(overall >= 0.95, "excellent").when(overall >= 0.8, "good").when(overall >= 0.5, "partial").otherwise("poor")
    return F.struct(overall.alias("overall"), rating.alias("rating"))


def coverage_metric(have: Column, of: Column) -> Column:
    """G1: part of `of` that is there; an empty whole is covered."""
    return F.when(of > 0, have / of).otherwise(1.0)


#: Model pattern, dollars a million prompt tokens, dollars a million completion tokens; the first that matches counts.
RATES = (("(?i)qwen3\\.7-flash", 0.03, 0.13), ("(?i)gpt-5\\.6-luna", 0.1, 0.6), ("(?i)gemma-4", 0.0, 0.0), ("(?i)nemotron", 0.0, 0.0), ("(?i):free$", 0.0, 0.0))


def stage_cost(model: Column, prompt: Column, completion: Column, cached: Column, rates=RATES, reported: Column | None = None) -> Column:
    """Dollars, eight decimals: none if cached, else as reported, else by the first matching rate; unknown is null."""
    out = F.lit(None).cast("double")
    for pattern, per_in, per_out in reversed(list(rates)):
        out = F.when(model.rlike(pattern), decimals((prompt * per_in + completion * per_out) / 1e6, 8)).otherwise(out)
    return F.when(cached, 0.0).otherwise(out if reported is None else F.coalesce(reported.cast("double"), out))


def cost_rollup(stages: DataFrame, keys: list[str], usd: str, prompt: str | None = None, completion: str | None = None) -> DataFrame:
    """Token sums, and dollars, null unless every part is known."""
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(n) for c, n in ((prompt, "prompt_tokens"), (completion, "completion_tokens")) if c]
    return stages.groupBy(*keys).agg(F.when(F.count(usd) == F.count(F.lit(1)), F.round(F.sum(usd), 8)).alias("usd"), *sums, F.count(F.lit(1)).alias("stages"))


def escalate(items: DataFrame, keys: list[str], confidence: str, parsed: str, threshold: float = 0.55) -> DataFrame:
    """Mean confidence, and whether a stage is asked again: unreadable, without items, or below the threshold on the mean."""
    means = items.groupBy(*keys).agg(F.coalesce(F.avg(confidence), F.lit(0.0)).alias("mean_confidence"), F.count(confidence).alias("items"), F.min(F.coalesce(F.col(parsed), F.lit(False))).alias("_ok"))
    return means.select(*keys, "mean_confidence", (~F.col("_ok") | (F.col("items") == 0) | (F.col("mean_confidence") < threshold)).alias("escalate"))


#: Stages of a capture that are open, and all of them.
OPEN_STAGES = ("queued", "capturing", "analyzing", "verifying", "indexing")
ALL_STAGES = (*OPEN_STAGES, "complete", "failed", "skipped")


def tallies(jobs: DataFrame, keys: list[str], stage: str = "stage", most_failed: int = 20) -> DataFrame:
    """Total, open and counts by stage, and a health level: critical beyond `most_failed` failures, warn for any failed or open one, else ok."""
    n = lambda *s: F.count(F.when(F.col(stage).isin(*s), 1))
    out = jobs.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *[n(s).alias(s) for s in ALL_STAGES], n(*OPEN_STAGES).alias("open"))
    return out.withColumn("health", F.when(F.col("failed") > most_failed, "critical").when((F.col("failed") > 0) | (F.col("open") > 0), "warn").otherwise("ok"))
