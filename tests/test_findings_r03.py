"""Cases of the third round's findings, each of which failed before."""

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import looks
from lumenfold.operators import geometry, sections


def test_zone_at_its_limit(spark):
    """900 * 2.2 is more than 1980 in binary fractions."""
    rows = spark.createDataFrame([(1, i, "content", "heading", y) for i, y in enumerate((809.5, 810.0, 1979.5, 1980.0))], "viewport int, section_id int, category string, signature string, y double")
    step = F.struct(F.lit("body").alias("role"), F.lit("a text long enough to count").alias("text"), looks.box(F.lit(0.0), F.col("y"), F.lit(800.0), F.lit(300.0)).alias("box"))
    found = rows.select("viewport", "section_id", "category", "signature", F.array(F.lit("a text long enough to count")).alias("text_signals"), F.lit("heuristic").alias("method"), F.lit(0.8).alias("confidence"), F.array(step).alias("steps"))
    got = sections.spine(found, ["viewport"], F.lit(900.0)).orderBy("section_id").collect()
    assert [r["zone"] for r in got] == ["above_fold", "mid", "mid", "below"]


def _changes(spark, a, b):
    vps = spark.createDataFrame([(1, 1, 400.0, 700.0, 2000.0), (1, 2, 800.0, 700.0, 2000.0)], "capture int, viewport_id int, width double, height double, document_height double")
    rows = spark.createDataFrame([(1, "el", i, True, 0, *box) for i, box in ((1, a), (2, b))], "capture int, element_id string, viewport_id int, rendered boolean, sibling_index int, x double, y double, width double, height double")
    members = rows.withColumn("box", F.struct("x", "y", "width", "height")).withColumn("style", F.create_map(F.lit("display"), F.lit("block"))).drop("x", "y", "width", "height")
    return {r["type"]: r["evidence"] for r in geometry.transformations(geometry.adjacent_pairs(vps, members, ["capture"]), ["capture"]).collect()}


def test_changes_at_their_limits(spark):
    """differences of one size are taken before they are divided, as in the SQL."""
    y = next(y / 100 for y in range(100, 100_000) if (y / 100 + 160) - y / 100 == 160 and (y / 100 + 160) / 2000 - y / 100 / 2000 < 0.08)
    h = next(h / 100 for h in range(100, 50_000) if (h / 100 + 35) - h / 100 == 35 and (h / 100 + 35) / 700 - h / 100 / 700 < 0.05)
    got = _changes(spark, (0.0, y, 0.0, h), (0.0, y + 160, 0.0, h + 35))
    assert set(got) == {"move", "resize"}


@pytest.mark.parametrize("width, want", [(2.84, 0.0036), (4.52, 0.0056)])
def test_deltas_round_as_the_sql(spark, width, want):
    """DuckDB's round(2.84 / 800, 4) and round(4.52 / 800, 4)."""
    got = _changes(spark, (0.0, 0.0, 0.0, 0.0), (0.0, 0.0, width, 700.0))
    assert float(got["resize"]["width"]) == want


def test_profiles_meet_on_sets_of_facets(spark):
    """pairs meet on facets that weigh enough together, each pair once, and none is lost."""
    from itertools import product

    from lumenfold.operators import graphs

    assert ("contrast_mode",) not in graphs._least_sets(0.47) and ("style", "layout", "contrast_mode") in graphs._least_sets(0.47)
    names = list(graphs.FACET_WEIGHTS)
    every = [(i, dict(zip(names, v)), t) for i, (v, t) in enumerate(product(product(("a", "b"), ("a", None), ("a", "b"), ("a", ""), ("a", "b"), ("a", None), ("a",)), (["X", "y"], None)))]
    rows = spark.createDataFrame([(i, *f.values(), t, ["i"] if i % 3 else None) for i, f, t in every], ", ".join(["id long", *[f"{n} string" for n in names], "craft_tags array<string>", "industry_tags array<string>"]))
    screens = rows.select("id", F.struct(*rows.columns[1:]).alias("facets"))
    for least in (0.35, 0.65):
        got = [tuple(r) for r in graphs.facet_profiles(screens, "id", "facets", least)[1].collect()]
        pairs = screens.select(F.col("id").alias("from_id"), F.col("facets").alias("fa")).join(screens.select(F.col("id").alias("to_id"), F.col("facets").alias("fb")), F.col("from_id") <= F.col("to_id"))
        want = pairs.withColumn("score", F.round(graphs.facet_overlap("fa", "fb"), 6)).filter(F.col("score") >= least).select("from_id", "to_id", "score").collect()
        assert sorted(got) == sorted(map(tuple, want))


def test_paths_go_as_far_as_the_sql(spark, tmp_path):
    """parts of a chain longer than the 60 hops of the SQL; the query walked all of it, a job a hop."""
    from oracle import rows, views

    from lumenfold.plans import registry

    spark.range(2800).select(F.col("id").alias("p_partkey"), F.lit(1).alias("p_size")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    spark.range(1).select(F.col("id").alias("n_nationkey")).coalesce(1).write.parquet(str(tmp_path / "nation.parquet"))
    got = registry.QUERIES["r23_paths"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(views(tmp_path).execute(registry.ORACLES["r23_paths"]).df())


@pytest.mark.parametrize("name", ["c9_alignment_groups", "c12_probable_grid", "c15_aligned_edges", "c9_left_edges"])
def test_boxes_are_shuffled_once(spark, name):
    """Boxes are dealt by viewport once, before they become a row an edge; there were three shuffles, two of all edges."""
    from lumenfold.plans import registry

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    before = plan[plan.index("MapInPandas") :]
    before = before[: before.index("FileScan")]
    assert before.count("Exchange") == 1


def test_flow_joins_use_every_task(spark):
    """adaptive joining of partitions left a task with all flows, whose memory grew with the input."""
    from lumenfold.plans import registry

    plan = registry.QUERIES["f14_flow_issues"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    joins = plan[plan.index("LeftAnti") :]
    assert joins.count("REPARTITION_BY_NUM") >= 6


def test_small_tables_are_compared_whole(spark, monkeypatch):
    """a table of more than eight cells was searched in part."""
    import random

    from lumenfold.operators import graphs

    monkeypatch.setattr(graphs, "PER_CELL", 20)
    rng = random.Random(5)
    rows = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)], "id long, v array<double>")
    got = graphs.neighbours(rows, "id", "v", 8, 0.2).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, graphs.nearest(rows, "id", "v", 8, 0.2, rows).collect()))


def test_briefs_carry_columns_of_references(spark):
    """References were joined by id again, all of them, for what they say of those that a brief has."""
    from lumenfold.operators import briefs

    refs = spark.createDataFrame([("r1", "c1", "screen", 1, ["t"], "A", None), ("r2", "c1", "section", 2, [], "B", "x"), ("r3", "c2", "section", 1, ["t"], "B", None)], "reference_id string, capture_id string, scope string, indexed_at int, craft_tags array<string>, type_image_mode string, composition_energy string")
    asks = spark.createDataFrame([(1, "reference", 0, "r3"), (1, "capture", 1, "c1"), (1, "capture", 2, "c2")], "brief int, kind string, place int, id string")
    chosen = briefs.brief_references(asks, refs, keep=("scope", "craft_tags", *briefs.MODULE_FACETS))[0]
    pages = spark.createDataFrame([("c2", "dark")], "capture_id string, contrast_mode string").withColumns({n: F.lit(None).cast("string") for n in briefs.PAGE_FACETS[1:]}).withColumn("craft_tags", F.array().cast("array<string>"))
    assert [tuple(r) for r in chosen.orderBy("place").select("place", "reference_id", "capture_id", "source_kind", "scope").collect()] == [(1, "r3", "c2", "reference", "section"), (2, "r1", "c1", "capture", "screen"), (3, "r2", "c1", "capture", "section")]
    held = briefs.craft_constraints(chosen, refs.filter("false"), pages).first()["constraints"]
    assert held == ["contrast_mode:dark", "craft_tag:t", "module_type_image_mode:B", "module_type_image_mode:A", "module_composition_energy:x"]
    assert briefs.module_blueprint(chosen, refs.select("reference_id", "scope").filter("false")).count() == 3


def test_word_codes_without_patterns(monkeypatch):
    """op6: words of letters and one mark go without patterns, and get the shapes that patterns give; a full table is begun anew."""
    import re

    from lumenfold.llm import quality

    def by_patterns(word):
        shape = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "a", word)
        return re.sub(r"(.)\1+", r"\1\1", re.sub(r"\d+", "9", shape))[:12]

    words = ["a", "A", "AB", "Ab", "ab,", "AB.", "A!", "B,,", ",", "..", "x1", "12", "a_b", "İ", "ª", "x²", "中文", "ab...", "e-mail:", "'tis", "9.5%", "ÀÉ;"]
    assert [quality.shape_of(w) for w in words] == [by_patterns(w) for w in words]
    assert quality.Features().codes.of(["a", "b,", "a"]).shape == (3, 3)
    monkeypatch.setattr(quality, "_CACHED", 3)
    texts = [" ".join(words[i : i + 5]) for i in range(len(words))] * 2
    few = quality.Features()
    for text in texts:
        for got, want in zip(few.of(text), quality.Features().of(text), strict=True):
            assert got.tolist() == want.tolist()


def test_embedding_holds_no_table_of_cells(spark, monkeypatch):
    """no aggregate over (id, cell); rows of one id, or of none, are merged in sorted order."""
    import hashlib

    from lumenfold.functions import vectors

    monkeypatch.setattr(vectors, "_TOGETHER", 2)
    data = [(1, "alpha beta beta"), (2, None), (1, "gamma"), (None, "x yy zz"), (3, "alpha"), (None, "yy"), (1, "a ! b"), (2, "beta alpha")]
    out = vectors.hashing_embedding(spark.createDataFrame(data, "id long, text string"), "id", "text")
    assert "Aggregate" not in out._jdf.queryExecution().executedPlan().toString()
    want: dict = {}
    for i, text in data:
        for w in [w for w in (text or "").split() if len(w) > 1] or [None]:
            h = hashlib.sha256((w or "").encode()).digest()
            cell, v = (0, 1.0) if w is None else (int.from_bytes(h[:4], "big") % 384, (1 if h[4] % 2 else -1) * (1 + h[5] % 5 / 5))
            want.setdefault(i, {}).setdefault(cell, []).append(v)
    want = {(i, c): sum(v) / sum(sum(x) ** 2 for x in cells.values()) ** 0.5 for i, cells in want.items() for c, v in cells.items()}
    got = {(r["id"], r["cell"]): r["value"] for r in out.collect()}
    assert got == pytest.approx(want)
    assert vectors.hashing_embedding(spark.createDataFrame([], "id long, text string"), "id", "text").count() == 0


def test_fit_takes_no_rated_rows_to_the_driver(spark, monkeypatch):
    """Pipeline, driver's memory: the rated rows came to the driver, which fitted them there."""
    import numpy as np
    from pyspark.sql.classic.dataframe import DataFrame

    from lumenfold.llm import quality

    texts = [(i, ("good plain words here" if i % 2 else "bad words JUNK 11 !!") + f" {i % 7}") for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    ratings = spark.createDataFrame([(i, 2 * (i % 2)) for i in range(400)], "doc_id long, grade int")
    features, grades = quality.Features(), np.array([2 * (i % 2) for i in range(400)])
    want = quality.fit([(c, x.astype("<f4").astype(float)) for c, x in (features.of(t) for _, t in texts)], grades)

    def refuse(*_):
        raise AssertionError("rows are collected")

    for name in ("toPandas", "toArrow", "collect"):
        monkeypatch.setattr(DataFrame, name, refuse)
    monkeypatch.setattr(DataFrame, "first", lambda self, taken=DataFrame.take: refuse() if "text" in self.columns else next(iter(self.limit(1).toLocalIterator()), None))
    got = quality.train(docs, ratings)
    assert np.array_equal(got.weights, want.weights) and np.array_equal(got.thresholds, want.thresholds) and got.weights.any()
    none = quality.train(docs, ratings.filter("false"))
    assert not none.weights.any() and len(none.thresholds) == quality.GRADES - 1


def test_addresses_of_html_are_resolved_once(spark):
    """within functions of array items every mention of the resolved address was worked out anew."""
    from lumenfold.functions import keys

    rows = spark.createDataFrame([(1, '<a HREF = "/x?t=1#f">y</a><img src=\'\'><a href="#p"><a href="?q=1"><a href="//O.example:443/z"><a href="./d">', "https://a.example/b/c?u=2"), (2, '<a href="d">', "no url"), (3, '<a href="d">', None), (4, None, "https://a.example/")], "id int, html string, url string")
    out = rows.select("id", keys.redact_html(F.col("html"), F.col("url")).alias("h"))
    q = keys.REDACTED_VALUE
    first = f'<a HREF="https://a.example/x?t={q}">y</a><img src=\'https://a.example/b/c?u={q}\'><a href="https://a.example/b/c?u={q}"><a href="https://a.example/b/c?q={q}"><a href="https://o.example/z"><a href="https://a.example/b/d">'
    assert {r["id"]: r["h"] for r in out.collect()} == {1: first, 2: '<a href="[invalid-url]">', 3: '<a href="[invalid-url]">', 4: None}
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract(") < 100


def test_ancestors_of_pages_come_from_the_parser(spark, tmp_path, monkeypatch):
    """ancestors of page nodes were found by joins, round by round, though the parser has them."""
    from lumenfold.operators import nodes
    from lumenfold.plans import registry

    html = [(1, "<main><ul><li>a<li><b>b</ul></x><form><label>n<input></label><p id=q><br></form></main>"), (2, "<b>" * 90), (3, ""), (4, None)]
    spark.createDataFrame(html, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    pages = spark.read.parquet(f"{tmp_path}/pages.parquet")
    want = sorted(map(tuple, nodes.ancestors(nodes.page_nodes(pages)).collect()))
    plain = nodes.page_nodes(pages)
    rel = nodes.relationships(nodes.with_parents(nodes.entities(plain), nodes.ancestors(plain)), plain, nodes.ancestors(plain))
    rel = sorted(map(tuple, rel.collect()))

    monkeypatch.setattr(nodes, "_PATHS", 50)
    monkeypatch.setattr(nodes, "ancestors", None)
    assert sorted(map(tuple, nodes.page_ancestors(nodes.page_nodes(pages, paths=True)).collect())) == want
    assert sorted(map(tuple, registry.QUERIES["d7_relationships"](spark, str(tmp_path)).collect())) == rel
    assert {r[2] for r in rel} == {"contains", "implements", "labels"}
