"""Packs under a budget, comparisons, viewports, lists and decorations on small rows."""

import json

from pyspark.sql import functions as F

from lumenfold.functions import keys
from lumenfold.operators import flows, graphs, nodes, relational, rollups, search, sections


def test_packs_never_exceed_their_budget(spark):
    texts = ["é" * 300, 'a "quoted" \\ text ' * 20, "short", "x" * 121, "😀" * 200, None, "word " * 60]
    rows = [(p, i, f"r{p}{i}", t) for p in range(5) for i, t in enumerate(texts[p:] + texts[:p])] + [(9, 0, "k" * 400, "text")]
    df = spark.createDataFrame(rows, "pack int, place int, reference_id string, look string")
    for most in (100, 190, 420, 2000):
        found = search.fitted_packs(df, "pack", "place", ["reference_id"], "look", most).collect()
        packs: dict = {}
        for r in found:
            item = {"reference_id": r["reference_id"]} | ({"look": r["look"]} if r["look"] is not None else {})
            assert r["bytes"] == len(json.dumps(item, ensure_ascii=False, separators=(",", ":")).encode())
            packs.setdefault(r["pack"], []).append(r)
        assert set(packs) == {0, 1, 2, 3, 4, 9}
        for p, items in packs.items():
            total = sum(r["bytes"] + 1 for r in items) + 1
            assert [r["place"] for r in sorted(items, key=lambda r: r["place"])] == list(range(len(items)))
            assert (total <= most) != (p == 9 and most < 430) and items[0]["over"] == (p == 9 and most < 430)
            whole = [r for r in rows if r[0] == p]
            if len(items) > 1:  # nothing is clipped where references could go instead
                assert all(r["look"] == whole[r["place"]][3] for r in items)


def test_compared_nodes(spark):
    n = spark.createDataFrame([(1, "a", {"x": "1", "y": "2"}), (2, "a", {"x": "1", "z": "3"}), (3, "b", None)], "node_id long, type string, properties map<string,string>")
    e = spark.createDataFrame([(1, 10), (10, 2), (1, 11), (2, 11), (1, 2), (3, 12)], "from_id long, to_id long")
    got = {(r["left_id"], r["right_id"]): (r["same_type"], r["differing_properties"], r["shared_neighbours"]) for r in flows.compare_nodes(spark.createDataFrame([(1, 2), (1, 2), (1, 3), (1, 99)], "left_id long, right_id long"), n, e).collect()}
    assert got == {(1, 2): (True, ["y", "z"], [10, 11]), (1, 3): (False, ["x", "y"], [])}


def test_preferred_viewports(spark):
    v = spark.createDataFrame([("a", "mobile", 0), ("a", "Desktop XL", 1), ("a", "desktop", 2), ("b", "mobile", 0), ("b", "wide DESKTOP", 1), ("c", "tablet", 1), ("c", "mobile", 0)], "page string, name string, at int")
    assert {r["page"]: r["name"] for r in rollups.preferred_viewport(v, ["page"], "name", F.col("at")).collect()} == {"a": "desktop", "b": "wide DESKTOP", "c": "mobile"}


def test_lists_and_counts(spark):
    rows = spark.createDataFrame([(1, "b", ["a", None, ""]), (1, "b", None), (2, None, []), (3, "", ["z"])], "k int, one string, many array<string>")
    assert {r["k"]: r["avoid"] for r in relational.avoid_union(rows, ["k"], "one", "many").collect()} == {1: ["a", "b"], 2: [], 3: ["z"]}
    members = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert {r["k"]: r["members"] for r in relational.member_counts(rows.select("k").distinct(), members, "k").collect()} == {1: 2, 2: 0, 3: 0}
    assert sorted(r["k"] for r in relational.unmatched(rows.select("k").distinct(), members, ["k"]).collect()) == [2, 3]
    sizes = graphs.community_sizes(spark.createDataFrame([("x",), ("y",), ("y",), (None,), ("a",)], "c string"), "c")
    assert [(r["c"], r["n"]) for r in sizes.orderBy("rank").collect()] == [("y", 2), ("a", 1), ("x", 1)]
    trimmed = spark.createDataFrame([([" a ", "A", "1b", "b ", ""],)], "v array<string>").select(keys.unique_first(F.col("v"), 3)).first()[0]
    assert trimmed == ["a", "1b", "b"]


def test_clusters_show_four_signals(spark):
    rows = [("s", "c", "t", "desktop", ["d", "a"]), ("s", "c", "t", "mobile", ["b", "e", "c", "a"]), ("u", "c", "t", "mobile", None)]
    got = {r["signature"]: (r["count"], r["viewport_names"], r["example_text_signals"]) for r in sections.composition_clusters(spark.createDataFrame(rows, "signature string, category string, taxonomy_id string, viewport_name string, text_signals array<string>")).collect()}
    assert got == {"s": (2, ["desktop", "mobile"], ["a", "b", "c", "d"]), "u": (1, ["mobile"], [])}


def test_decoration_and_sticky_headers(spark):
    n = spark.createDataFrame([(1, 0, "element", "header", "sticky"), (1, 1, "element", "header", "static"), (1, 2, "pseudo", "nav", None), (1, 3, "pseudo", "", None)], "capture int, node_id int, node_type string, tag string, position string").withColumns({"ordinal": F.col("node_id"), "rendered": F.lit(True), "attributes": F.create_map().cast("map<string,string>")})
    terms: dict = {}
    for r in nodes.entities(n).collect():
        terms.setdefault(r["node_id"], set()).add(r["taxonomy_id"])
    assert terms == {0: {"dig:region.banner", "dig:pattern.sticky_header"}, 1: {"dig:region.banner"}, 2: {"dig:element.decorative"}, 3: {"dig:element.decorative"}}
