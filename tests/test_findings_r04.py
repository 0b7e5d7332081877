"""The findings of round 4, on small inputs where the code before went wrong."""

import random
from collections import defaultdict

import pytest
from oracle import rows, views
from pyspark.sql import functions as F

from lumenfold.operators import graphs
from lumenfold.plans import registry


def _paths(spark, folder, parts):
    parts.coalesce(1).write.parquet(str(folder / "part.parquet"))
    spark.range(1).select(F.col("id").alias("n_nationkey")).coalesce(1).write.parquet(str(folder / "nation.parquet"))
    got = registry.QUERIES["r23_paths"](spark, str(folder)).toPandas()
    assert rows(got) == rows(views(folder).execute(registry.ORACLES["r23_paths"]).df())
    return {n: (h, p) for n, h, p in got.itertuples(index=False)}


def test_paths_go_on_to_the_end(spark, tmp_path):
    """a chain of 100 hops; query and SQL ended after 60."""
    got = _paths(spark, tmp_path, spark.range(4000).select(F.col("id").alias("p_partkey"), F.lit(1).alias("p_size")))
    assert got == {n: (n, ",".join(map(str, range(n + 1)))) for n in range(101)}


def test_paths_go_forwards_as_in_the_sql(spark, tmp_path):
    """nothing leads to 6 but from 7, so the SQL has no path to it, and none by it to 8; the query went back to it."""
    links = [(n, 7 if n in (5, 7) else 1) for n in range(10)] + [(6, 7)]
    got = _paths(spark, tmp_path, spark.createDataFrame([(40 * n + s, s) for n, s in links], "p_partkey long, p_size int"))
    assert sorted(got) == [0, 1, 2, 3, 4, 5, 7, 9, 10] and got[9] == (7, "0,1,2,3,4,5,7,9")


@pytest.mark.parametrize("directed", [False, True])
@pytest.mark.parametrize(("block", "most"), [(1_000_000, None), (9, None), (9, 4), (1_000_000, 4)])
def test_distances_by_blocks(spark, monkeypatch, block, most, directed):
    """blocks, groups of sources and a limit give what a walk hop by hop gives; a hub's edges are in several blocks."""
    monkeypatch.setattr(graphs, "CELLS", 40)
    rng = random.Random(5)
    links = [(n, n + 1) for n in range(30)] + [(40, n) for n in range(41, 65)] + [(rng.randrange(70), rng.randrange(70)) for _ in range(15)] + [(3, 3), (None, 4)]
    name = lambda n: None if n is None else f"n{n:02d}"
    edges = spark.createDataFrame([tuple(map(name, e)) for e in links], "from_id string, to_id string")
    starts = [0, 17, 40, 99]
    found = graphs.distances(edges, spark.createDataFrame([(name(s),) for s in starts], "i string"), most, directed, block)
    on = defaultdict(set)
    for a, b in links:
        if a is not None and a != b:
            on[a].add(b)
            if not directed:
                on[b].add(a)
    want = set()
    for s in starts:
        at, hop = {s: 0}, 0
        while most is None or hop < most:
            new = {b for a, h in at.items() if h == hop for b in on[a]} - set(at)
            if not new:
                break
            hop += 1
            at |= dict.fromkeys(new, hop)
        want |= {(name(s), name(n), h, name(min((a for a in at if at[a] == h - 1 and n in on[a]), default=None))) for n, h in at.items()}
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("cells", [20, 220, 4_000_000])
def test_paths_of_trees(spark, monkeypatch, cells):
    """paths are the same if a tree is walked in tasks, one or several, as if it has too many nodes for that."""
    monkeypatch.setattr(graphs, "CELLS", cells)
    big = 2**60  # beyond what a float tells apart
    edges = spark.createDataFrame([(big + n, big + n + 1) for n in range(40)] + [(big + 5, big + n) for n in range(50, 60)], "from_id long, to_id long")
    found = graphs.distances(edges, spark.createDataFrame([(big,), (big + 40,), (7,)], "i long"))
    whole = found.select("source", "node").filter("source <> 7")
    want = {(s, n): list(range(s, n + 1)) if s <= n else list(range(s, n - 1, -1)) for s in (0, 40) for n in range(41)}
    want |= {(s, n): [*want[s, 5], n] for s in (0, 40) for n in range(50, 60)}
    got = {(r["source"] - big, r["node"] - big): (r["hops"], [n - big for n in r["path"]]) for r in graphs.paths(found, whole).collect()}
    assert got == {k: (len(p) - 1, p) for k, p in want.items()}
    one = spark.createDataFrame([(7, 7), (big, big + 2), (big, 7)], "source long, node long")
    assert sorted(map(tuple, graphs.paths(found, one).collect())) == [(7, 7, 0, [7]), (big, big + 2, 2, [big, big + 1, big + 2])]
