"""Queries over catalogs, screens, entities and labels, which Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfold.functions import keys
from lumenfold.operators import library, tokens
from lumenfold.plans.base import ORACLES, query
from lumenfold.plans.layout import _styles


@query("k5_one_screen_each", "SELECT l_orderkey, l_returnflag FROM (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'N' DESC, l_returnflag) = 1")
def _(t):
    return library.one_screen_each(t("lineitem").select("l_orderkey", "l_returnflag").distinct(), "l_orderkey", "l_returnflag", primary="N")


@query("k8_homepages", f"""WITH k AS ({ORACLES['b13_host_key']}), g AS (SELECT host, min(page_id) AS page_id FROM k WHERE page_id % 4 <> 0 AND host <> '' AND host NOT IN (SELECT host FROM k WHERE page_id % 4 = 0) AND NOT regexp_matches(host, '\\.(gov|edu|mil)$') GROUP BY host) SELECT host, page_id FROM g""")
def _(t):
    pages = t("pages").select("page_id", "url")
    known = pages.filter("page_id % 4 = 0").select(keys.host_key(F.col("url")).alias("h")).filter("h <> ''")
    return library.homepages(pages.filter("page_id % 4 <> 0"), known, [], F.col("page_id")).select("host", "page_id")


@query("a16_seed_urls", f"""WITH j AS ({ORACLES['b4_join_key']}), s AS (SELECT page_id % 7 AS scan, page_id, key FROM j WHERE key IS NOT NULL), f AS (SELECT scan, key, min(page_id) AS first FROM s GROUP BY ALL)
SELECT scan, first AS page_id, row_number() OVER (PARTITION BY scan ORDER BY first) AS place FROM f QUALIFY place <= 24""")
def _(t):
    pages = t("pages").filter(keys.join_key(F.col("url")).isNotNull()).select((F.col("page_id") % 7).alias("scan"), "page_id", "url")
    first = F.first("url").over(Window.partitionBy("scan").orderBy("page_id"))
    found = library.seed_urls(pages.withColumn("root", first), "scan", "root", "url", F.col("page_id"))
    back = pages.groupBy("scan", "url").agg(F.min("page_id").alias("page_id"))
    return found.join(back, ["scan", "url"]).select("scan", "page_id", F.col("place").cast("long").alias("place"))


@query("e14_vocabulary_match", "SELECT p_partkey, CASE WHEN contains(p_name, 'small ring') THEN 'small ring' WHEN contains(p_name, 'small') THEN 'small' ELSE 'other' END AS term FROM part")
def _(t):
    return t("part").select("p_partkey", F.coalesce(library.vocabulary_match(F.upper("p_name"), ["small", "Small-Ring"]), F.lit("other")).alias("term")).withColumn("term", F.lower(F.replace("term", F.lit("-"), F.lit(" "))))


@query("e19_flat_styles", "SELECT l_orderkey, l_returnflag AS name, min_by(l_partkey, l_linenumber * 1000000 + l_partkey)::VARCHAR AS value FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL")
def _(t):
    rules = t("lineitem").select("l_orderkey", (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("pos"), F.col("l_returnflag").alias("name"), F.col("l_partkey").cast("string").alias("value"))
    return library.flat_styles(rules, "l_orderkey", "pos", ["A", "R"])


@query("d9_unique_ids", "SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 THEN o_custkey::VARCHAR ELSE 'ont_' || substr(sha256(o_orderkey || '|' || o_custkey || '|rekey'), 1, 20) END AS new_id FROM orders")
def _(t):
    return library.unique_ids(t("orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey", "ont", F.col("o_orderkey")).select("o_orderkey", "new_id")


@query("g5_findings", """SELECT l_orderkey, round(count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'F') / count(*) FILTER (l_returnflag <> 'R' OR l_linestatus = 'F'), 4) AS viewport_coverage, sum(l_linenumber)::BIGINT AS responsive_complexity, round(1.0 / count(DISTINCT l_suppkey) FILTER (l_linestatus = 'F'), 4) AS visual_consistency
FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (l_linestatus = 'F') > 0""")
def _(t):
    rows = t("lineitem").select("l_orderkey", (F.col("l_returnflag") != "R").alias("has_ontology"), (F.col("l_linestatus") == "F").alias("has_visual"), F.col("l_suppkey").alias("signature"), F.col("l_linenumber").alias("transformations"))
    return library.findings(rows, ["l_orderkey"]).filter("visual_consistency > 0")


@query("g6_semantic_inputs", "SELECT 'visual_language' AS source, l_orderkey AS source_id, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL UNION ALL SELECT 'ontology', l_orderkey, count(*) FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL")
def _(t):
    rows = t("lineitem").select("l_orderkey", "l_returnflag", F.col("l_orderkey").alias("hypothesis_id"), F.col("l_orderkey").alias("entity_id"), F.col("l_linenumber").alias("viewport_id"), F.lit(0.5).alias("confidence"), F.lit("m").alias("method"), F.lit("L3").alias("layer"))
    return library.semantic_inputs(rows.filter("l_returnflag = 'A'"), rows.filter("l_returnflag = 'N'")).groupBy("source", "source_id").agg(F.count(F.lit(1)).alias("n"))


@query("f11_filter_flows", "SELECT o_custkey::VARCHAR AS flow_id FROM orders GROUP BY o_custkey HAVING bool_or(o_orderstatus = 'F') AND contains(o_custkey::VARCHAR, '2') ORDER BY flow_id LIMIT 20")
def _(t):
    action = F.when(F.col("o_orderstatus") == "F", "dig:flow.checkout").otherwise("dig:flow.searching")
    flows = t("orders").groupBy(F.col("o_custkey").cast("string").alias("flow_id")).agg(F.collect_set(action).alias("action_ids"), F.lit("s").alias("app_scope_id"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("notes"))
    return library.filter_flows(flows, "Payment", "s", "2").select("flow_id")


@query("f13_screen_media", "SELECT o_orderkey, (SELECT first(l_partkey ORDER BY l_returnflag = 'N' DESC, l_returnflag, l_partkey)::VARCHAR FROM lineitem WHERE l_orderkey = o_orderkey) AS image_ref FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def _(t):
    views = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag").agg(F.min("l_partkey").cast("string").alias("settled_path"))
    views = views.select("o_orderkey", F.when(F.col("l_returnflag") == "N", "desktop").otherwise(F.concat(F.lit("x"), "l_returnflag")).alias("name"), "settled_path", F.lit(None).cast("string").alias("full_page_path"))
    return library.screen_media(t("orders").select("o_orderkey"), views, "o_orderkey").filter("image_ref IS NOT NULL")


@query("a15_subjects", "SELECT c_custkey AS capture, 'customer' AS kind, c_custkey::VARCHAR AS subject_id, c_name AS content_text FROM customer UNION ALL SELECT s_suppkey, 'supplier', s_suppkey::VARCHAR, s_name FROM supplier")
def _(t):
    c = t("customer").select(F.col("c_custkey").alias("capture"), F.col("c_custkey").alias("key"), F.col("c_name").alias("text"))
    s = t("supplier").select(F.col("s_suppkey").alias("capture"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("text"))
    return library.subjects({"customer": c, "supplier": s}, "capture", "key", "text")


@query("b37_clean_labels", "SELECT l_orderkey, l_returnflag AS kind, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_partkey, l_suppkey) AS rank FROM lineitem WHERE l_returnflag IN ('A', 'R') QUALIFY rank <= CASE l_returnflag WHEN 'A' THEN 1 ELSE 2 END")
def _(t):
    items = t("lineitem").select("l_orderkey", F.col("l_returnflag").alias("kind"), F.col("l_partkey").cast("string").alias("name"), (F.col("l_quantity") - 10).alias("confidence"), "l_partkey", "l_suppkey")
    return library.clean_labels(items, ["l_orderkey"], {"A": 1, "R": 2}, F.col("l_partkey"), F.col("l_suppkey")).select("l_orderkey", "kind", "l_partkey", F.col("rank").cast("long").alias("rank"))


@query("b38_category", "SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'promo' WHEN p_type = 'ECONOMY' THEN 'cheap' WHEN p_type = 'STANDARD' THEN 'stand' ELSE 'none' END AS category FROM part")
def _(t):
    return t("part").select("p_partkey", F.coalesce(library.category_of(F.col("p_type"), ["promo", "cheap", "stand"], {"economy": "cheap"}), F.lit("none")).alias("category"))


@query("d37_flow_steps", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS step, role AS label FROM conversations")
def _(t):
    items = t("conversations").select("conv_id", F.lit("page_flow").alias("kind"), F.col("turn").alias("step_index"), F.col("turn").alias("ordinal"), F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise("").alias("label"), F.col("role").alias("name"))
    return library.flow_steps(items, ["conv_id"]).withColumn("step", F.col("step").cast("long"))


@query("r38_references_or", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'stored' WHEN o_orderkey % 3 = 1 THEN 'derived' ELSE 'synthetic' END AS origin FROM orders")
def _(t):
    o = t("orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("reference_id"))
    return library.references_or(o.filter("o_orderkey % 3 = 0"), o.filter("o_orderkey % 3 <> 2"), o, "o_orderkey").select("o_orderkey", "origin")


@query("e9_palette")
def _(t):
    used = tokens.color_usage(_styles(t), ["viewport"])
    return library.palette(used.withColumn("roles", tokens.color_roles(F.col("properties"))), ["viewport"])


@query("e10_type_roles", """WITH g AS (SELECT p_type AS viewport, p_brand AS font_family, (p_size % 4 + 12)::DOUBLE AS px, count(*) AS n FROM part GROUP BY ALL)
SELECT viewport, 'body' AS role, font_family, px AS size_px, n AS occurrences FROM g QUALIFY row_number() OVER (PARTITION BY viewport ORDER BY n DESC, px DESC, font_family) = 1""")
def _(t):
    return library.type_roles(tokens.typography(_styles(t), ["viewport"]), ["viewport"]).filter("role = 'body'").drop("weight")


@query("r6_knowledge_graph", """SELECT 'contains' AS type, count(DISTINCT o_custkey || '|' || o_orderpriority) AS n FROM orders UNION ALL SELECT 'captured_in', count(DISTINCT o_orderpriority || '|' || o_orderkey) FROM orders UNION ALL
SELECT 'observed_at', (SELECT count(DISTINCT l_orderkey || '|' || l_suppkey) FROM lineitem)""")
def _(t):
    captures = t("orders").select(F.col("o_orderkey").alias("capture_run_id"), F.concat(F.lit("s"), "o_custkey").alias("site_id"), F.lit("d").alias("domain"), F.concat(F.lit("p"), "o_orderpriority").alias("page_id"), F.lit("/").alias("route"), F.col("o_orderstatus").alias("status"))
    views = t("lineitem").select(F.col("l_orderkey").alias("capture_run_id"), F.col("l_suppkey").alias("viewport_id"), F.lit("desktop").alias("name"))
    none = t("part").limit(0).select(F.col("p_partkey").alias("viewport_id"), F.col("p_name").alias("entity_id"), F.col("p_name").alias("label"), F.col("p_type").alias("taxonomy_id"), F.col("p_brand").alias("parent_entity_id"))
    return library.knowledge_graph(captures, views, none)[1].groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("a12_delete_by_url", f"WITH k AS ({ORACLES['b1_capture_key']}) SELECT page_id FROM k WHERE key NOT IN (SELECT key FROM k WHERE page_id % 10 = 0)")
def _(t):
    pages = t("pages").select("page_id", "url")
    return library.delete_by_url(pages, pages.filter("page_id % 10 = 0").select("url"), {}, "page_id", "url")[0].select("page_id")


@query("a14_design_export", "SELECT o_custkey, count(*) AS frames FROM orders GROUP BY o_custkey")
def _(t):
    views = t("orders").select("o_custkey", F.col("o_orderkey").alias("viewport"), F.col("o_totalprice").alias("width"))
    parts = t("lineitem").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select("o_custkey", F.col("l_orderkey").alias("viewport"), F.col("l_linenumber").alias("y"), F.col("l_partkey").alias("section_id"), F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("signature"))
    return library.design_export(views, parts, "o_custkey").select("o_custkey", F.json_array_length("frames").cast("long").alias("frames"))


@query("r29_hotspots", "SELECT o_orderkey AS section_id, count(*) AS n, round(sum(o_totalprice / 1207), 4) AS x FROM orders GROUP BY o_orderkey")
def _(t):
    b = F.struct(F.col("o_totalprice").alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("width"), F.lit(1.0).alias("height"))
    rows = t("orders").select(F.col("o_orderkey").alias("section_id"), F.lit("content").alias("category"), F.lit("").alias("signature"), b.alias("root_box"), F.array().cast("array<struct<role:string,box:struct<x:double,y:double,width:double,height:double>>>").alias("steps"), F.lit(0.0).alias("document_width"), F.lit(0.0).alias("document_height"), F.lit(1207.0).alias("viewport_width"), F.lit(800.0).alias("viewport_height"))
    return library.hotspots(rows).groupBy("section_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("normalized.x"), 4).alias("x"))


@query("j7_wide_nodes", """WITH b AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS width FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL), s AS (SELECT l_orderkey, l_linenumber, min(l_tax) AS opacity FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)
SELECT l.l_orderkey, l.l_linenumber, l_partkey, l_suppkey, width, opacity FROM lineitem l LEFT JOIN b ON b.l_orderkey = l.l_orderkey AND b.l_linenumber = l.l_linenumber LEFT JOIN s ON s.l_orderkey = l.l_orderkey AND s.l_linenumber = l.l_linenumber""")
def _(t):
    lines, on = t("lineitem"), ["l_orderkey", "l_linenumber"]
    boxes = lines.filter("l_returnflag = 'A'").groupBy(*on).agg(F.max("l_quantity").alias("width"))
    styles = lines.filter("l_linestatus = 'F'").groupBy(*on).agg(F.min("l_tax").alias("opacity"))
    return library.wide_nodes(lines.select(*on, "l_partkey", "l_suppkey"), boxes, styles, ["l_orderkey"], "l_linenumber")


@query("j16_logical_ids", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, n_name AS element_id FROM lineitem LEFT JOIN nation ON n_nationkey = l_suppkey % 50 AND n_regionkey = l_linenumber % 5")
def _(t):
    members = t("nation").select(F.col("n_regionkey").alias("viewport_id"), F.col("n_nationkey").alias("node_id"), F.col("n_name").alias("element_id"))
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_linenumber") % 5).alias("viewport_id"), (F.col("l_suppkey") % 50).alias("node_id"))
    return library.with_logical_ids(rows, members).drop("viewport_id", "node_id")
