"""Queries over boxes, sections and styles, which Spark derives from line items, parts and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfold.functions import looks
from lumenfold.operators import geometry, sections, tokens
from lumenfold.plans.base import query

_BOXES = """b AS (SELECT l_orderkey AS viewport, l_suppkey % 2 AS parent, ordinal, l_quantity * 20 AS x, ordinal * 40.0::DOUBLE AS y, round(l_discount * 1000) + 20 AS width, round(l_tax * 1000) + 20 AS height
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS ordinal FROM lineitem)),
p AS (SELECT a.viewport, a.parent, a.ordinal AS oa, b.ordinal AS ob, a.x AS ax, b.x AS bx, a.y AS a_y, b.y AS b_y, a.width AS aw, b.width AS bw, a.height AS ah, b.height AS bh,
least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x) AS vx, least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y) AS vy FROM b a JOIN b b ON a.viewport = b.viewport AND a.parent = b.parent AND a.ordinal < b.ordinal)"""


def boxes(t):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    rows = t("lineitem").withColumn("ordinal", F.row_number().over(order).cast("long"))
    return rows.select(F.col("l_orderkey").alias("viewport"), (F.col("l_suppkey") % 2).alias("parent"), "ordinal", (F.col("l_quantity") * 20).alias("x"), (F.col("ordinal") * 40.0).alias("y"), (F.round(F.col("l_discount") * 1000) + 20).alias("width"), (F.round(F.col("l_tax") * 1000) + 20).alias("height"))


@query("c11_spacing_scale", f"""WITH {_BOXES}, g AS (SELECT viewport, greatest(a_y, b_y) - CASE WHEN a_y <= b_y THEN a_y + ah ELSE b_y + bh END AS gap, 'vertical' AS d FROM p WHERE vx > 0 UNION ALL SELECT viewport, greatest(ax, bx) - CASE WHEN ax <= bx THEN ax + aw ELSE bx + bw END, 'horizontal' FROM p WHERE vy > 0)
SELECT viewport, floor(gap * 2 + 0.5) / 2 AS value, count(*) AS n, string_agg(DISTINCT d, ',' ORDER BY d) AS directions FROM g WHERE gap BETWEEN 0 AND 512 GROUP BY ALL HAVING count(*) >= 2""")
def _(t):
    return geometry.spacing_scale(boxes(t), ["viewport", "parent"], ["viewport"])


@query("c14_relations", f"""WITH {_BOXES} SELECT viewport, parent, CASE WHEN vx > 0 AND vy > 0 OR vx > 0 AND a_y <= b_y OR vx <= 0 AND ax <= bx THEN oa ELSE ob END AS from_ordinal, CASE WHEN vx > 0 AND vy > 0 OR vx > 0 AND a_y <= b_y OR vx <= 0 AND ax <= bx THEN ob ELSE oa END AS to_ordinal,
CASE WHEN vx > 0 AND vy > 0 THEN 'overlaps' WHEN vy > 0 THEN 'left_of' ELSE 'above' END AS relation, CASE WHEN vx > 0 AND vy > 0 THEN NULL WHEN vy > 0 THEN round(-vx, 3) + 0.0 ELSE round(-vy, 3) + 0.0 END AS gap,
CASE WHEN vx > 0 AND vy > 0 THEN round(vx, 3) END AS overlap_width, CASE WHEN vx > 0 AND vy > 0 THEN round(vy, 3) END AS overlap_height FROM p WHERE vx > 0 OR vy > 0""")
def _(t):
    return geometry.relations(boxes(t), ["viewport", "parent"])


@query("c8_clusters")
def _(t):
    return geometry.clusters_1d(boxes(t), ["viewport"], "x", "ordinal")


#: x are multiples of 20, so a cluster of left edges is a value.
_LEFT = "SELECT viewport, x AS center, count(*) AS n, list(ordinal ORDER BY ordinal) AS ids FROM b GROUP BY viewport, x HAVING count(*) >= 2"


@query("c9_left_edges", f"WITH {_BOXES}, c AS ({_LEFT}) SELECT viewport, 'x' AS axis, 'start' AS edge, center, n, array_to_string(ids, ',') AS members FROM c")
def _(t):
    found = geometry.alignment_groups(boxes(t), ["viewport"], edges=[("x", "start")])
    return found.select("viewport", "axis", "edge", "center", "n", F.array_join("ids", ",").alias("members"))


@query("c9_alignment_groups")
def _(t):
    return geometry.alignment_groups(boxes(t), ["viewport"]).withColumn("ids", F.array_join("ids", ","))


@query("c12_probable_grid", f"""WITH {_BOXES}, c AS ({_LEFT}), n AS (SELECT viewport, count(*) AS boxes FROM b GROUP BY viewport)
SELECT c.viewport, count(*) AS column_count, string_agg(center::INT, ',' ORDER BY center) AS column_starts, round(least(0.95::DOUBLE, 0.55::DOUBLE + sum(n) / max(boxes) * 0.4::DOUBLE), 4) AS confidence FROM c JOIN n ON n.viewport = c.viewport GROUP BY c.viewport HAVING count(*) >= 2""")
def _(t):
    b = boxes(t)
    grid = geometry.probable_grid(geometry.alignment_groups(b, ["viewport"], edges=[("x", "start")]), b, ["viewport"])
    return grid.withColumn("column_starts", F.array_join(F.transform("column_starts", lambda c: c.cast("int")), ","))


@query("c15_aligned_edges", f"WITH {_BOXES}, c AS ({_LEFT}) SELECT viewport, 'x' AS axis, 'start' AS edge, center AS coordinate, ids[1] AS from_id, unnest(ids[2:]) AS to_id FROM c")
def _(t):
    return geometry.aligned_edges(geometry.alignment_groups(boxes(t), ["viewport"], edges=[("x", "start")]), ["viewport"])


@query("c13_layout_containers", """WITH n AS (SELECT l_orderkey AS capture, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS node_id, l_returnflag, l_suppkey FROM lineitem),
m AS (SELECT *, CASE WHEN node_id > 1 THEN node_id // 2 END AS parent_id, CASE l_returnflag WHEN 'A' THEN 'grid' WHEN 'N' THEN 'inline-flex' ELSE 'block' END AS display FROM n),
k AS (SELECT capture, parent_id AS node_id, string_agg(node_id, ',' ORDER BY node_id) AS child_ids FROM m WHERE parent_id IS NOT NULL GROUP BY ALL)
SELECT m.capture, m.node_id, CASE WHEN display = 'grid' THEN 'grid' ELSE 'flex' END AS mode, child_ids, CASE WHEN display = 'grid' THEN 2 ELSE 0 END::INT AS columns, CASE WHEN display <> 'grid' THEN 'row' ELSE '' END AS direction, '8px' AS gap FROM m JOIN k ON m.capture = k.capture AND m.node_id = k.node_id WHERE display <> 'block'""")
def _(t):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    n = t("lineitem").select(F.col("l_orderkey").alias("capture"), F.row_number().over(order).cast("long").alias("node_id"), "l_returnflag")
    display = F.when(F.col("l_returnflag") == "A", "grid").when(F.col("l_returnflag") == "N", "inline-flex").otherwise("block")
    style = F.create_map(F.lit("display"), display, F.lit("grid-template-columns"), F.lit("1fr minmax(10px, 2fr)"), F.lit("row-gap"), F.lit("8px"))
    nodes = n.select("capture", "node_id", F.when(F.col("node_id") > 1, F.floor(F.col("node_id") / 2)).alias("parent_id"), F.col("node_id").alias("ordinal"), F.lit(True).alias("rendered"), F.lit(True).alias("has_box"), style.alias("style"))
    out = geometry.layout_containers(nodes, ["capture"])
    return out.select("capture", "node_id", "mode", F.array_join("child_ids", ",").alias("child_ids"), F.coalesce("columns", F.lit(0)).alias("columns"), F.coalesce("direction", F.lit("")).alias("direction"), "gap")


def _viewports(t):
    """A customer is a capture, and its orders are viewports of rising width of one element."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = t("orders").withColumn("v", F.row_number().over(order).cast("long"))
    viewports = o.select(F.col("o_custkey").alias("capture"), F.col("v").alias("viewport_id"), (F.col("v") * 400.0).alias("width"), F.lit(700.0).alias("height"), F.lit(2000.0).alias("document_height"))
    box = looks.box(F.col("o_totalprice") % 300, F.col("o_totalprice") % 1500, F.col("o_totalprice") % 350, F.col("o_totalprice") % 700)
    style = F.create_map(F.lit("display"), F.when(F.col("o_orderstatus") == "F", "grid").otherwise("block"))
    members = o.select(F.col("o_custkey").alias("capture"), F.lit("el").alias("element_id"), F.col("v").alias("viewport_id"), (F.col("o_orderstatus") != "P").alias("rendered"), (F.col("o_orderkey") % 4).alias("sibling_index"), style.alias("style"), box.alias("box"))
    return viewports, members


_PAIRS = """o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS v FROM orders),
m AS (SELECT o_custkey AS capture, v, v * 400.0::DOUBLE AS vw, o_orderstatus AS st, o_orderkey % 4 AS si, o_totalprice % 300 AS x, o_totalprice % 1500 AS y, o_totalprice % 350 AS w, o_totalprice % 700 AS h FROM o),
q AS (SELECT a.capture, a.v AS from_viewport, b.v AS to_viewport, a.st AS ast, b.st AS bst, a.si AS asi, b.si AS bsi, b.w / b.vw - a.w / a.vw AS dw, (b.h - a.h) / 700.0 AS dh, b.x / b.vw - a.x / a.vw AS dx, (b.y - a.y) / 2000.0 AS dy FROM m a JOIN m b ON a.capture = b.capture AND b.v = a.v + 1)"""


@query("c2_transformations", f"""WITH {_PAIRS}, r AS (SELECT *, unnest([CASE WHEN (ast <> 'P') <> (bst <> 'P') THEN CASE WHEN bst <> 'P' THEN 'show' ELSE 'hide' END END, CASE WHEN asi <> bsi THEN 'reorder' END,
CASE WHEN ast <> 'P' AND bst <> 'P' AND (abs(dw) >= 0.05 OR abs(dh) >= 0.05) THEN 'resize' END, CASE WHEN ast <> 'P' AND bst <> 'P' AND (abs(dx) >= 0.05 OR abs(dy) >= 0.08) THEN 'move' END, CASE WHEN (ast = 'F') <> (bst = 'F') THEN 'layout_mode_change' END]) AS type FROM q)
SELECT capture, from_viewport, to_viewport, type, CASE type WHEN 'reorder' THEN 0.95 WHEN 'resize' THEN 0.92 WHEN 'move' THEN 0.88 ELSE 1 END::DOUBLE AS confidence FROM r WHERE type IS NOT NULL""")
def _(t):
    pairs = geometry.adjacent_pairs(*_viewports(t), ["capture"])
    return geometry.transformations(pairs, ["capture"]).select("capture", "from_viewport", "to_viewport", "type", "confidence")


@query("c4_resize", f"WITH {_PAIRS} SELECT capture, from_viewport, to_viewport, round(dw, 4) AS width_delta, round(dh, 4) AS height_delta FROM q WHERE ast <> 'P' AND bst <> 'P' AND (abs(dw) >= 0.05 OR abs(dh) >= 0.05)")
def _(t):
    found = geometry.transformations(geometry.adjacent_pairs(*_viewports(t), ["capture"]), ["capture"]).filter("type = 'resize'")
    return found.select("capture", "from_viewport", "to_viewport", F.col("evidence")["width"].cast("double").alias("width_delta"), F.col("evidence")["height"].cast("double").alias("height_delta"))


@query("c7_responsive_graph", f"WITH {_PAIRS}, r AS (SELECT * FROM q WHERE asi <> bsi) SELECT capture, from_viewport, 'reorder' AS type, printf('rgr_%06d', row_number() OVER (PARTITION BY capture ORDER BY from_viewport)) AS edge_id FROM r")
def _(t):
    found = geometry.transformations(geometry.adjacent_pairs(*_viewports(t), ["capture"]), ["capture"]).filter("type = 'reorder'")
    return geometry.responsive_graph(found, ["capture"], F.col("from_viewport")).select("capture", "from_viewport", "type", "edge_id")


@query("c1_logical_elements", """WITH n AS (SELECT o_custkey AS capture, o_orderkey % 3 AS viewport_id, o_orderkey, o_orderpriority FROM orders),
f AS (SELECT capture, o_orderpriority, viewport_id, min(o_orderkey) AS node_id FROM n GROUP BY ALL)
SELECT capture, 'stable_anchor' AS method, 0.98::DOUBLE AS confidence, sha256('div|id:' || o_orderpriority) AS fingerprint_hash, string_agg(viewport_id || ':' || node_id, ',' ORDER BY viewport_id) AS members FROM f GROUP BY capture, o_orderpriority HAVING count(*) >= 2""")
def _(t):
    anchor = F.create_map(F.lit("id"), F.col("o_orderpriority"))
    nodes = t("orders").select(F.col("o_custkey").alias("capture"), (F.col("o_orderkey") % 3).alias("viewport_id"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderkey").alias("node_id"), F.lit("element").alias("node_type"), F.lit("div").alias("tag"), anchor.alias("anchor"), F.lit("/body/div").alias("dom_path"), F.lit("x").alias("text"))
    found = geometry.logical_elements(nodes, ["capture"])
    return found.select("capture", "method", "confidence", "fingerprint_hash", F.array_join(F.transform("members", lambda m: F.concat_ws(":", m["viewport_id"], m["node_id"])), ",").alias("members"))


#: Line items of an order are the blocks of a section, in the order of their numbers.
_STEPS = """l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS n FROM lineitem),
s AS (SELECT l_orderkey, n, CASE l_returnflag WHEN 'A' THEN 'heading' WHEN 'N' THEN 'media' ELSE 'body' END AS role FROM l WHERE n <= 12),
k AS (SELECT *, lag(role) OVER (PARTITION BY l_orderkey ORDER BY n) IS DISTINCT FROM role AS first FROM s),
g AS (SELECT l_orderkey, string_agg(role, '>' ORDER BY n) FILTER (first) AS signature, count(*) AS steps FROM k GROUP BY l_orderkey)"""


def _blocks(t):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    n = F.row_number().over(order).cast("long")
    tag = F.when(F.col("l_returnflag") == "A", "h2").when(F.col("l_returnflag") == "N", "img").otherwise("p")
    rows = t("lineitem").select("l_orderkey", n.alias("ordinal"), tag.alias("tag"), F.col("l_linestatus").alias("text"))
    box = looks.box(F.lit(0.0), F.col("ordinal") * 30.0, F.lit(100.0), F.lit(20.0))
    return rows.withColumn("box", box).select("l_orderkey", "ordinal", sections.block_role(F.col("tag"), F.lit(None).cast("string"), F.create_map(F.lit("x"), F.lit("y")), F.col("box"), F.col("text"), F.lit(False)).alias("role"), "text", "box")


@query("d14_recipes", f"WITH {_STEPS} SELECT l_orderkey, signature, steps, (steps - 1) * 10 AS gap_total FROM g")
def _(t):
    out = sections.recipes(_blocks(t), ["l_orderkey"])
    return out.select("l_orderkey", "signature", F.size("steps").cast("long").alias("steps"), F.aggregate("gap_px", F.lit(0).cast("long"), lambda a, b: a + b).alias("gap_total"))


@query("d17_composition_clusters", f"""WITH {_STEPS}, x AS (SELECT DISTINCT signature, l_linestatus AS said FROM g JOIN l ON l.l_orderkey = g.l_orderkey WHERE n <= 6), y AS (SELECT signature, string_agg(said, ',' ORDER BY said) AS said FROM x GROUP BY signature)
SELECT g.signature, 'content' AS category, count(*) AS count, any_value(said) AS said FROM g JOIN y ON y.signature = g.signature GROUP BY g.signature""")
def _(t):
    found = sections.recipes(_blocks(t), ["l_orderkey"]).select("*", F.lit("content").alias("category"), F.lit("dig:section.generic").alias("taxonomy_id"), F.lit("desktop").alias("viewport_name"))
    return sections.composition_clusters(found).select("signature", "category", "count", F.array_join("example_text_signals", ",").alias("said"))


def _sections(t):
    rows = _blocks(t)
    found = sections.recipes(rows, ["l_orderkey"])
    o = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority", "o_totalprice", "o_orderstatus")
    y = F.col("o_totalprice") % 4000
    steps = F.array(F.struct(F.lit("body").alias("role"), F.lit("a text long enough to count").alias("text"), looks.box(F.lit(0.0), y, F.lit(800.0), F.lit(300.0)).alias("box")))
    category = F.when(F.col("o_orderstatus") == "F", "content").when(F.col("o_orderstatus") == "O", "hero").otherwise("cookie_consent")
    sig = F.when(F.col("o_orderpriority") == "5-LOW", "body").otherwise(F.col("signature"))
    return o.join(found.select("l_orderkey", "signature"), "l_orderkey").select(F.col("o_custkey").alias("viewport"), F.col("l_orderkey").alias("section_id"), category.alias("category"), sig.alias("signature"), F.array(F.lit("a text long enough to count")).alias("text_signals"), F.lit("heuristic").alias("method"), F.lit(0.8).alias("confidence"), steps.alias("steps"))


_SPINE = f"""{_STEPS}, c AS (SELECT o_custkey AS viewport, o_orderkey AS section_id, CASE o_orderstatus WHEN 'F' THEN 'content' WHEN 'O' THEN 'hero' ELSE 'cookie_consent' END AS category, CASE WHEN o_orderpriority = '5-LOW' THEN 'body' ELSE signature END AS signature, o_totalprice % 4000 AS y FROM orders JOIN g ON g.l_orderkey = o_orderkey),
d AS (SELECT *, lag(category) OVER w IS NOT DISTINCT FROM category AND lag(signature) OVER w IS NOT DISTINCT FROM signature AND signature = 'body' AS same FROM c WHERE category <> 'cookie_consent' WINDOW w AS (PARTITION BY viewport ORDER BY y, section_id)),
e AS (SELECT viewport, row_number() OVER (PARTITION BY viewport ORDER BY y, section_id) AS band, section_id, category, signature, CASE WHEN y < 810 THEN 'above_fold' WHEN y < 1980 THEN 'mid' ELSE 'below' END AS zone, y, 300.0::DOUBLE AS height, 0.8::DOUBLE AS confidence FROM d WHERE NOT same QUALIFY band <= 12)"""


@query("d19_spine", f"WITH {_SPINE} SELECT * FROM e")
def _(t):
    return sections.spine(_sections(t), ["viewport"], F.lit(900.0)).withColumn("height", F.round("height", 3))


@query("d19_spine_summary", f"""WITH {_SPINE}, f AS (SELECT viewport, category, min(band) AS first FROM e GROUP BY ALL), a AS (SELECT viewport, string_agg(category, ' → ' ORDER BY first) AS page_arc FROM f GROUP BY viewport) SELECT viewport, page_arc FROM a""")
def _(t):
    return sections.spine_summary(sections.spine(_sections(t), ["viewport"], F.lit(900.0)), ["viewport"]).select("viewport", "page_arc")


@query("d18_demotion", "SELECT o_orderkey AS section_id, 'cookie_consent' AS reason FROM orders WHERE o_orderstatus = 'P' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def _(t):
    why = sections.demotion(F.col("category"), F.col("signature"), F.col("text_signals"), F.lit(300.0), F.col("method"), F.col("confidence"))
    return _sections(t).select("section_id", why.alias("reason")).filter("reason IS NOT NULL")


@query("d10_section_roots")
def _(t):
    b = boxes(t).select("viewport", F.col("ordinal").alias("node_id"), F.when(F.col("ordinal") % 2 == 0, "section").otherwise("div").alias("tag"), F.lit(True).alias("rendered"), "x", "y", (F.col("width") * 4).alias("width"), (F.col("height") * 4).alias("height"))
    return sections.section_roots(b, ["viewport"], F.lit(900.0))


@query("d22_preferred_viewport", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, name FROM (SELECT *, CASE WHEN l_returnflag = 'A' AND l_linenumber % 2 = 0 THEN 'desktop' WHEN l_returnflag = 'R' THEN 'Wide Desktop' ELSE 'mobile' END AS name FROM lineitem)
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE name WHEN 'desktop' THEN 0 WHEN 'Wide Desktop' THEN 1 ELSE 2 END, l_linenumber, l_partkey, l_suppkey) = 1""")
def _(t):
    from lumenfold.operators import rollups

    name = F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") % 2 == 0), "desktop").when(F.col("l_returnflag") == "R", "Wide Desktop").otherwise("mobile")
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", name.alias("name"))
    return rollups.preferred_viewport(rows, ["l_orderkey"], "name", F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"))


@query("d32_measured_insights", f"""WITH {_STEPS}, o AS (SELECT o_custkey AS page, o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'desktop' ELSE 'mobile' END AS vp, CASE o_orderstatus WHEN 'F' THEN 'hero' ELSE 'content' END AS category, signature FROM orders JOIN g ON g.l_orderkey = o_orderkey),
c AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY o_orderkey) AS step FROM (SELECT *, max(vp = 'desktop') OVER (PARTITION BY page) AS any_desktop FROM o) WHERE vp = 'desktop' OR NOT any_desktop),
d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY page, category, signature ORDER BY step) = 1)
SELECT page, row_number() OVER (PARTITION BY page ORDER BY step) AS place, signature, category FROM d QUALIFY place <= 8""")
def _(t):
    return sections.measured_recipes(_recipes_of_pages(t), ["page"])[0].select("page", "place", "signature", "category")


@query("d32_measured_steps", f"""WITH {_STEPS}, o AS (SELECT o_custkey AS page, o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'desktop' ELSE 'mobile' END AS vp, CASE o_orderstatus WHEN 'F' THEN 'hero' ELSE 'content' END AS category, signature FROM orders JOIN g ON g.l_orderkey = o_orderkey)
SELECT page, row_number() OVER (PARTITION BY page ORDER BY o_orderkey) AS step, category || ' · ' || signature AS section_label FROM (SELECT *, max(vp = 'desktop') OVER (PARTITION BY page) AS any_desktop FROM o) WHERE vp = 'desktop' OR NOT any_desktop QUALIFY step <= 12""")
def _(t):
    return sections.measured_recipes(_recipes_of_pages(t), ["page"])[1].select("page", "step", "section_label")


def _recipes_of_pages(t):
    """An order is a section of its customer's page; every third order is seen on a desktop."""
    found = sections.recipes(_blocks(t), ["l_orderkey"]).withColumnRenamed("l_orderkey", "section_id")
    k = F.col("o_orderkey")
    o = t("orders").select(F.col("o_custkey").alias("page"), k.alias("section_id"), k.alias("ordinal"), F.when(k % 3 == 0, "desktop").otherwise("mobile").alias("viewport_name"), F.when(F.col("o_orderstatus") == "F", "hero").otherwise("content").alias("category"), F.lit("dig:section.generic").alias("taxonomy_id"))
    return o.join(found, "section_id")


@query("d27_crop_reason", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' AND h >= 1200 THEN 'page_wrapper' WHEN w < 160 THEN 'too_narrow' WHEN h < 80 THEN 'too_short' WHEN h > 2400 THEN 'too_tall' ELSE 'selected_geometry' END AS reason FROM (SELECT *, l_quantity * 60 AS h, l_extendedprice % 800 AS w FROM lineitem)""")
def _(t):
    frame = looks.box(F.lit(0.0), F.lit(0.0), F.col("l_extendedprice") % 800, F.col("l_quantity") * 60)
    sig = F.when(F.col("l_returnflag") == "R", "body").otherwise("heading>media")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", sections.crop_reason(sig, F.lit("content"), frame).alias("reason"))


def _styles(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    color = F.concat(F.lit("rgb("), (k % 5 * 50).cast("string"), F.lit(", "), (s % 3 * 100).cast("string"), F.lit(", 0)"))
    props = F.create_map(F.lit("color"), color, F.lit("font-family"), F.col("p_brand"), F.lit("font-size"), F.concat((s % 4 + 12).cast("string"), F.lit("px")), F.lit("border-top-left-radius"), F.concat((s % 6).cast("string"), F.lit("px")), F.lit("box-shadow"), F.lit("none"))
    return t("part").select(F.col("p_type").alias("viewport"), F.col("p_partkey").alias("node_id"), props.alias("properties"))


@query("e1_color_usage", "SELECT p_type AS viewport, printf('#%02x%02x00ff', p_partkey % 5 * 50, p_size % 3 * 100) AS hex, count(*) AS occurrences, 'color' AS properties, count(*) AS nodes, 'foreground' AS roles FROM part GROUP BY ALL")
def _(t):
    out = tokens.color_usage(_styles(t), ["viewport"])
    return out.select("viewport", "hex", "occurrences", F.array_join("properties", ",").alias("properties"), "nodes", F.array_join(tokens.color_roles(F.col("properties")), ",").alias("roles"))


@query("e3_typography", "SELECT p_type AS viewport, p_brand AS font_family, (p_size % 4 + 12) || 'px' AS font_size, '' AS font_weight, '' AS line_height, '' AS letter_spacing, count(*) AS occurrences FROM part GROUP BY ALL")
def _(t):
    return tokens.typography(_styles(t), ["viewport"])


@query("e4_shape_values", "SELECT p_type AS viewport, 'radius' AS kind, (p_size % 6) || 'px' AS value, count(*) AS occurrences FROM part WHERE p_size % 6 > 0 GROUP BY ALL")
def _(t):
    return tokens.shape_values(_styles(t), ["viewport"])


@query("e5_imagery", "SELECT l_orderkey, coalesce(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END, 'unknown') AS type, count(*) AS total, count(*) FILTER (l_discount > 0 AND l_tax > 0) AS intrinsic_dimensioned FROM lineitem GROUP BY ALL")
def _(t):
    assets = t("lineitem").select("l_orderkey", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("type"), F.col("l_discount").alias("width"), F.col("l_tax").alias("height"))
    return tokens.imagery(assets, ["l_orderkey"])


@query("e6_composition", f"WITH {_BOXES.split('p AS')[0].rstrip().rstrip(',')} SELECT viewport, round(sum(width * height) / 1000000.0::DOUBLE, 4) AS estimated_box_coverage, 1.0::DOUBLE AS document_aspect_ratio FROM b GROUP BY viewport")
def _(t):
    return tokens.composition(boxes(t).withColumns({"dw": F.lit(1000.0), "dh": F.lit(1000.0)}), ["viewport"], "dw", "dh")


@query("e7_motion", "SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'view') AS declarations, count(*) FILTER (event_type <> 'view') AS runtime_instances, count(*) FILTER (event_type <> 'view' AND value > 5) AS compositor_friendly_runtime_instances, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS animated_properties FROM events GROUP BY user_id")
def _(t):
    rows = t("events").select("user_id", F.when(F.col("event_type") == "view", "computed_css").otherwise(F.col("event_type")).alias("source"), (F.col("value") > 5).alias("compositor_friendly"), F.array("event_type").alias("animated_properties"))
    return tokens.motion(rows, ["user_id"]).withColumn("animated_properties", F.array_join("animated_properties", ","))


@query("e8_hypotheses", """WITH c AS (SELECT user_id, count(DISTINCT event_type) AS colors, count(*) FILTER (event_type = 'error') AS shapes, count(*) FILTER (event_type = 'click') AS motions FROM events GROUP BY user_id),
r AS (SELECT user_id, unnest([CASE WHEN colors <= 4 AND shapes <= 3 THEN {'c': 'visual_character', 'v': 'restrained', 's': 0.62} END, CASE WHEN colors >= 8 OR shapes >= 7 THEN {'c': 'visual_character', 'v': 'expressive', 's': 0.62} END, CASE WHEN motions > 0 THEN {'c': 'motion_personality', 'v': 'animated', 's': 0.70} ELSE {'c': 'motion_personality', 'v': 'static', 's': 0.80} END]) AS h FROM c)
SELECT user_id, h.c AS category, h.v AS value, h.s::DOUBLE AS confidence FROM r WHERE h IS NOT NULL""")
def _(t):
    n = lambda k: F.count(F.when(F.col("event_type") == k, 1))
    counts = t("events").groupBy("user_id").agg(F.count_distinct("event_type").alias("colors"), n("error").alias("shapes"), n("click").alias("motions"))
    return tokens.hypotheses(counts, ["user_id"])


@query("e11_radius_scale")
def _(t):
    return tokens.radius_scale(tokens.shape_values(_styles(t), ["viewport"]), ["viewport"])
