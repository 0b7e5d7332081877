"""Scores of model results against golden expectations, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyword_hits(haystacks: Column, keywords: Column) -> Column:
    """Keywords that any of the texts holds, in any case."""
    texts = F.transform(F.filter(haystacks, lambda t: t.isNotNull()), F.lower)
    return F.size(F.filter(keywords, lambda k: F.exists(texts, lambda t: t.contains(F.lower(k)))))


def ratio_points(hits: Column, total: Column, most: float) -> Column:
    """Part of `most`, two decimals; nothing of nothing is 0."""
    return F.when(total > 0, F.floor(hits / total * most * 100 + 0.5) / 100).otherwise(0.0)


def text_score(result: str, golden: str) -> Column:
    """Q1: struct of the points of the seven dimensions (stages 15, patterns 15, elements 15, recipes 20, flow 10, style 15, json 10), total and percent.

    `result` has stages_complete, stages_total, parsed (whether its json was readable) and lists; `golden` the expected lists of the same names.
    """
    r, g = (lambda n: F.col(f"{result}.{n}")), (lambda n: F.col(f"{golden}.{n}"))
    part = lambda name, most: ratio_points(keyword_hits(r(name), g(name)), F.size(g(name)), most)
    elements = ratio_points(keyword_hits(r("ui_elements"), g("ui_elements")), F.least(F.lit(3), F.size(g("ui_elements"))), 15)
    low = lambda c: F.transform(c, F.lower)
    exact = F.size(F.array_intersect(low(r("recipes")), low(g("recipes")))) > 0
    points = {"stages": ratio_points(r("stages_complete"), r("stages_total"), 15), "screen_patterns": part("screen_patterns", 15), "ui_elements": elements}
    points |= {"recipes": F.when(exact, 20.0).otherwise(part("recipes", 10)), "flow_labels": part("flow_labels", 10)}
    points["style"] = ratio_points(keyword_hits(r("style"), g("style")), F.least(F.lit(3), F.size(g("style"))), 15)
    points["json"] = F.when(r("parsed"), 10.0).when(points["stages"] > 0, 4.0).otherwise(0.0)
    total = sum(points.values(), F.lit(0.0))
    return F.struct(*[v.alias(k) for k, v in points.items()], F.round(total, 2).alias("total"), F.round(total, 1).alias("percent"))


def vision_score(result: str, golden: str) -> Column:
    """Q2: struct of heading (30), cta (30), layout (40: places 55 %, contained 20 %, same length 25 %), total and percent; null if skipped."""
    r, g = (lambda n: F.col(f"{result}.{n}")), (lambda n: F.col(f"{golden}.{n}"))
    one = lambda name, most: ratio_points(keyword_hits(F.array(r(name)), g(name)), F.size(g(name)), most)
    want, got = F.transform(g("layout"), F.lower), F.transform(F.coalesce(r("layout"), F.array().cast("array<string>")), F.lower)
    places = F.size(F.filter(F.transform(want, lambda w, i: F.when(F.get(got, i) == w, 1)), lambda x: x.isNotNull())) / F.size(want)
    inside = F.size(F.filter(want, lambda w: F.array_contains(got, w))) / F.size(want)
    layout = F.least(F.lit(40.0), F.floor(40 * (0.55 * places + 0.2 * inside + F.when(F.size(got) == F.size(want), 0.25).otherwise(0.0)) * 100 + 0.5) / 100)
    layout = F.when((F.size(got) > 0) & (F.size(want) > 0), layout).otherwise(0.0)
    points = {"heading": one("heading", 30), "cta": one("cta", 30), "layout": layout}
    total = sum(points.values(), F.lit(0.0))
    return F.when(F.coalesce(r("status"), F.lit("")) != "skipped", F.struct(*[v.alias(k) for k, v in points.items()], F.round(total, 2).alias("total"), F.round(total, 1).alias("percent")))


def combined_percent(*percents: Column) -> Column:
    """Q3: mean of the percents that there are, one decimal; 0 for none."""
    some = F.array_compact(F.array(*percents))
    return F.when(F.size(some) > 0, F.floor(F.aggregate(some, F.lit(0.0), lambda s, x: s + x) / F.size(some) * 10 + 0.5) / 10).otherwise(0.0)


def retrieval_points(rank: Column) -> Column:
    """Q4: 100 for the first place, 50 for the second and third, else 0."""
    return F.when(rank == 1, 100).when(rank <= 3, 50).otherwise(0)
