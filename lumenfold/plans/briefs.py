"""Queries over players, collections and briefs, from orders and line items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfold.operators import briefs
from lumenfold.plans.base import query

_FLOW = """p AS (SELECT o_custkey AS flow, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place, o_orderkey AS screen_id, o_orderpriority AS url, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS to_id, o_totalprice FROM orders),
e AS (SELECT flow, screen_id AS from_id, to_id, CASE screen_id % 3 WHEN 0 THEN round(o_totalprice % 1000, 2) WHEN 1 THEN 0.5 END AS x FROM p WHERE to_id IS NOT NULL)"""


def _flow(t):
    """A customer's orders are the screens of a flow, each leads to the next one; two of three links have a hotspot, in pixels or in parts."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = t("orders").select(F.col("o_custkey").alias("flow"), (F.row_number().over(w) - 1).cast("long").alias("place"), F.col("o_orderkey").alias("screen_id"), F.col("o_orderpriority").alias("url"), F.lead("o_orderkey").over(w).alias("to_id"), "o_totalprice")
    k = F.col("screen_id") % 3
    x = F.when(k == 0, F.round(F.col("o_totalprice") % 1000, 2)).when(k == 1, 0.5)
    side = F.when(k == 0, 200.0).otherwise(0.25)
    spot = F.when(x.isNotNull(), F.struct(x.alias("x"), x.alias("y"), side.alias("width"), side.alias("height"), F.when(k == 0, "document").alias("space")))
    edges = rows.filter("to_id IS NOT NULL").select("flow", F.col("place").alias("position"), F.col("screen_id").cast("string").alias("edge_id"), F.col("screen_id").alias("from_id"), "to_id", F.lit("href_join").alias("method"), F.lit(None).cast("string").alias("activation"), spot.alias("hotspot"))
    return rows.drop("to_id", "o_totalprice"), edges


@query("f12_flow_list", f"WITH {_FLOW} SELECT p.flow, count(*) AS screen_count, count(*) FILTER (to_id IS NOT NULL) AS edge_count, CASE WHEN p.flow % 2 = 0 THEN 'b,a' ELSE '' END AS actions, min(screen_id) AS preview_screen_id, arg_min(url, screen_id) AS preview_url FROM p GROUP BY p.flow")
def _(t):
    places, edges = _flow(t)
    c = t("customer").filter("c_custkey % 2 = 0")
    actions = c.select(F.col("c_custkey").alias("flow"), F.lit(1).alias("ordinal"), F.lit("b").alias("action_id")).unionByName(c.select(F.col("c_custkey").alias("flow"), F.lit(2).alias("ordinal"), F.lit("a").alias("action_id")))
    return briefs.flow_list(places, edges, actions, "flow").withColumn("actions", F.array_join("flow_action_ids", ",")).drop("flow_action_ids")


@query("f12_player_steps", f"WITH {_FLOW} SELECT p.flow, p.place, p.screen_id, CASE WHEN p.screen_id % 5 = 0 THEN 'shot' ELSE url END AS primary_url, CASE WHEN p.screen_id % 5 = 0 THEN 'i' || p.screen_id END AS image_ref, e.from_id IS NOT NULL AND x IS NULL AS advance_anywhere, round(CASE WHEN x > 1 THEN x / 1440 ELSE CASE WHEN p.screen_id % 3 = 0 THEN x / 1440 ELSE x END END, 8) AS x, CASE WHEN p.screen_id % 3 = 0 AND x IS NOT NULL THEN 0.04 WHEN x IS NOT NULL THEN 0.25 END::DOUBLE AS height FROM p LEFT JOIN e ON e.from_id = p.screen_id")
def _(t):
    places, edges = _flow(t)
    media = t("orders").filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("screen_id"), F.lit("shot").alias("url"), F.concat(F.lit("i"), "o_orderkey").alias("image_ref"))
    out = briefs.player_steps(places, edges, media, "flow")
    spot = F.get("hotspots", F.lit(0))["box"]
    return out.select("flow", "place", "screen_id", "primary_url", "image_ref", "advance_anywhere", F.round(spot["x"], 8).alias("x"), spot["height"].alias("height"))


@query("f12_screen_neighbours", f"WITH {_FLOW} SELECT flow, to_id AS screen_id, 'inbound' AS direction, from_id AS other_id, x IS NOT NULL AS has_hotspot FROM e UNION ALL SELECT flow, from_id, 'outbound', to_id, x IS NOT NULL FROM e")
def _(t):
    return briefs.screen_neighbours(_flow(t)[1], "flow").select("flow", "screen_id", "direction", "other_id", "has_hotspot")


@query("r30_collection_detail", "SELECT c_custkey AS collection_id, c_name, o.o_orderkey AS capture_id, o.o_totalprice, CASE WHEN o.o_orderkey IS NOT NULL THEN row_number() OVER (PARTITION BY c_custkey ORDER BY o.o_orderdate DESC, o.o_orderkey) END AS rank FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON o.o_custkey = c_custkey")
def _(t):
    members = t("orders").select(F.col("o_custkey").alias("collection_id"), F.col("o_orderkey").alias("capture_id"), F.col("o_orderdate").alias("added_at"))
    captures = t("orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("capture_id"), "o_totalprice")
    out = briefs.collection_detail(t("customer").select(F.col("c_custkey").alias("collection_id"), "c_name"), members, captures)
    return out.drop("added_at")


def _refs(t):
    """Line items are references of their order; they are named by what tells them apart."""
    name = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor(F.col("l_extendedprice") * 100))
    return t("lineitem").select(name.alias("reference_id"), F.col("l_orderkey").alias("capture_id"), F.when(F.col("l_returnflag") == "A", "screen").otherwise("section").alias("scope"), F.col("l_shipdate").alias("indexed_at"), F.array("l_linestatus").alias("craft_tags"), F.col("l_returnflag").alias("type_image_mode"), F.lit(None).cast("string").alias("composition_energy"))


_NAMED = "r AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice * 100)::BIGINT) AS reference_id, l_orderkey AS capture_id, l_returnflag AS flag, l_linestatus AS tag, l_shipdate AS seen FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY CASE WHEN flag = 'A' THEN 0 ELSE 1 END, seen DESC, reference_id) AS rank FROM r)"


@query("r27_capture_references", f"WITH {_NAMED} SELECT reference_id, capture_id, rank FROM k WHERE rank <= 2")
def _(t):
    return briefs.capture_references(_refs(t), t("orders").select("o_orderkey"), 2).select("reference_id", "capture_id", F.col("rank").cast("long").alias("rank"))


#: A customer's brief asks for the captures of its orders, the latest key first, and for the first reference of its least one.
_BRIEF = f"""{_NAMED}, d AS (SELECT o_custkey AS brief, k.reference_id, k.capture_id, 0 AS source, 0 AS a, 0 AS b FROM (SELECT o_custkey, min(o_orderkey) AS o FROM orders GROUP BY o_custkey) m JOIN k ON k.capture_id = m.o AND k.rank = 1
UNION ALL SELECT o_custkey, k.reference_id, k.capture_id, 1, -o_orderkey, rank FROM orders JOIN k ON k.capture_id = o_orderkey WHERE rank <= 4), f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY brief, reference_id ORDER BY source, a, b) = 1),
c AS (SELECT *, row_number() OVER (PARTITION BY brief ORDER BY source, a, b, reference_id) AS place FROM f QUALIFY place <= 8)"""


def _chosen(t, *keep):
    refs = _refs(t)
    least = t("orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o"))
    # ids of captures are numbers, ids of references texts
    whole = t("orders").select(F.col("o_custkey").alias("brief"), F.lit("capture").alias("kind"), (-F.col("o_orderkey")).alias("place"), F.col("o_orderkey").cast("string").alias("id"))
    named = refs.withColumn("capture_id", F.col("capture_id").cast("string"))
    first = briefs.capture_references(named, least.select(F.col("o").cast("string")), 1).select(F.col("capture_id").cast("long").alias("o"), F.col("reference_id").alias("id"))
    direct = least.join(first, "o").select(F.col("o_custkey").alias("brief"), F.lit("reference").alias("kind"), F.lit(0).cast("long").alias("place"), "id")
    return named, briefs.brief_references(direct.unionByName(whole), named, keep=keep)[0]


@query("r33_brief_references", f"WITH {_BRIEF} SELECT brief, place, reference_id, capture_id::VARCHAR AS capture_id, CASE source WHEN 0 THEN 'reference' ELSE 'capture' END AS source_kind FROM c")
def _(t):
    return _chosen(t)[1]


@query("r33_constraints", f"""WITH {_BRIEF}, t AS (SELECT brief, (capture_id % 3)::VARCHAR AS mode FROM c WHERE place = 1), u AS (SELECT brief, 0 AS place, 0 AS spot, 'contrast_mode:' || mode AS said FROM t UNION ALL SELECT c.brief, place, 1, 'craft_tag:' || k.tag FROM c JOIN k ON k.reference_id = c.reference_id UNION ALL SELECT c.brief, place, 2, 'module_type_image_mode:' || k.flag FROM c JOIN k ON k.reference_id = c.reference_id),
w AS (SELECT brief, said, min(place * 10 + spot) AS first FROM u GROUP BY ALL) SELECT brief, string_agg(said, ',' ORDER BY first) AS constraints FROM w GROUP BY brief""")
def _(t):
    refs, chosen = _chosen(t, "craft_tags", *briefs.MODULE_FACETS)
    none = F.lit(None).cast("string")
    page = t("orders").select(F.col("o_orderkey").cast("string").alias("capture_id"), (F.col("o_orderkey") % 3).cast("string").alias("contrast_mode"), *[none.alias(n) for n in briefs.PAGE_FACETS[1:]], F.array().cast("array<string>").alias("craft_tags"))
    return briefs.craft_constraints(chosen, refs, page).withColumn("constraints", F.array_join("constraints", ","))


@query("r33_blueprint", f"WITH {_BRIEF} SELECT brief, 'mod_' || place AS module_id, c.reference_id, CASE WHEN k.flag = 'A' THEN 'screen' ELSE 'section' END AS scope FROM c JOIN k ON k.reference_id = c.reference_id WHERE place <= 6")
def _(t):
    refs, chosen = _chosen(t, "scope")
    return briefs.module_blueprint(chosen, refs.select("reference_id", "scope")).select("brief", "module_id", "reference_id", "scope")
