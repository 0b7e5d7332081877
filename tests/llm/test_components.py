"""Rounds of connected components."""

import random

from pyspark.sql import functions as F

from lumenfold.llm import components as module


def _least(pairs):
    least = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


def test_rounds_end_with_the_labels(spark, monkeypatch):
    """op10: a hub and its copies are settled by one look at the links; no round of labels of labels follows."""
    written = []
    monkeypatch.setattr(module, "cut_lineage", lambda df, cut=module.cut_lineage: written.append(1) or cut(df))
    links = spark.createDataFrame([(0, i) for i in range(1, 50)], "a long, b long")
    got = {r["id"]: r["component"] for r in module.components(links).collect()}
    assert got == dict.fromkeys(range(50), 0)
    assert len(written) == 3


def test_components_by_brute_force(spark):
    rng = random.Random(5)
    order = list(range(200, 212))
    rng.shuffle(order)
    pairs = [*zip(order, order[1:]), *[(-9, i) for i in range(20)], (300, 300), (2, -40), *[(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(30)], (999, 800), *[(999, i) for i in range(801, 840)]]
    got = {r["id"]: r["component"] for r in module.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: v for k, v in _least([p for p in pairs if p[0] != p[1]]).items()}
    assert module.components(spark.createDataFrame([], "a long, b long").select("a", F.col("b"))).count() == 0
