from pyspark.sql import functions as F

from lumenfold.operators import library


def test_palette(spark):
    rows = [("v", "#000000ff", ["background"], 50), ("v", "#ffffffff", ["foreground"], 40), ("v", "#ff0000ff", ["background"], 30), ("v", "#ff000080", ["border"], 20), ("v", "#00000000", ["background"], 10), ("v", "#808080ff", ["border"], 5), ("w", "#808080ff", ["vector"], 2), ("w", "#e0e0e0ff", ["vector"], 1)]
    colors = spark.createDataFrame(rows, "vp string, hex string, roles array<string>, occurrences long")
    got = {}
    for r in library.palette(colors, ["vp"]).orderBy("vp", "place").collect():
        got.setdefault(r["vp"], []).append((r["hex_rgb"], r["role"], r["occurrences"]))
    assert got["v"] == [("#000000", "bg", 50), ("#ffffff", "ink", 40), ("#ff0000", "accent", 30), ("#808080", "border", 5)]
    assert got["w"] == [("#808080", "bg", 2), ("#e0e0e0", "ink", 1)]


def test_type_roles(spark):
    rows = [("v", "A", "16px", "400", "", 10), ("v", "A", "40px", "700", "", 2), ("v", "B", "12px", "400", "", 3), ("v", "B", "18px", "600", "", 1)]
    types = spark.createDataFrame(rows, "vp string, font_family string, font_size string, font_weight string, line_height string, occurrences long")
    got = {r["role"]: (r["size_px"], r["weight"]) for r in library.type_roles(types, ["vp"]).collect()}
    assert got == {"body": (16.0, 400), "display": (40.0, 700), "emphasis": (40.0, 700), "small": (12.0, 400)}


def test_vocabulary(spark):
    match = lambda t: spark.range(1).select(library.vocabulary_match(F.lit(t), ["grid", "card grid", "ui"])).first()[0]
    assert match("a Card_Grid of things") == "card grid" and match("GRID") == "grid" and match("ui kit") is None and match(None) is None
    kind = lambda t: spark.range(1).select(library.category_of(F.lit(t), ["typography", "color"], {"font": "typography"})).first()[0]
    assert (kind(" Font "), kind("color mood"), kind("Typography"), kind("x")) == ("typography", "color", "typography", None)


def test_delete_by_url(spark):
    captures = spark.createDataFrame([(1, "https://www.a.example/x/"), (2, "http://a.example/x"), (3, "https://a.example/y")], "id int, url string")
    children = {"sections": spark.createDataFrame([(1, "s"), (3, "t")], "id int, s string")}
    left, gone, rest = library.delete_by_url(captures, spark.createDataFrame([("a.example/x",)], "u string"), children, "id", "url")
    assert [r["id"] for r in left.collect()] == [3] and sorted(r["id"] for r in gone.collect()) == [1, 2]
    assert [r["s"] for r in rest["sections"].collect()] == ["t"]


def test_homepages_and_seeds(spark):
    rows = spark.createDataFrame([(1, "http://b.example/deep?x=1"), (2, "b.example"), (3, "https://known.example/"), (4, "x.gov"), (5, "c.example")], "i int, url string")
    got = {r["host"]: r["url"] for r in library.homepages(rows, spark.createDataFrame([("known.example",)], "h string"), ["c.example"], F.col("i")).collect()}
    assert got == {"b.example": "https://b.example/"}
    pages = spark.createDataFrame([("s", "https://a.example/", 1, "https://a.example/b/"), ("s", "https://a.example/", 2, "https://a.example/b"), ("s", "https://a.example/", 3, "https://a.example/c")], "scan string, root string, i int, url string")
    assert [r["url"] for r in library.seed_urls(pages, "scan", "root", "url", F.col("i"), most=2).orderBy("place").collect()] == ["https://a.example/", "https://a.example/b/"]


def test_references_fall_back(spark):
    row = lambda *ids: spark.createDataFrame([(i, f"r{i}") for i in ids], "c int, reference_id string")
    got = {r["c"]: (r["reference_id"], r["origin"]) for r in library.references_or(row(1), row(1, 2), row(1, 2, 3), "c").collect()}
    assert got == {1: ("r1", "stored"), 2: ("r2", "derived"), 3: ("screen_3", "synthetic")}
