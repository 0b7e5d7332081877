"""Queries over library tables: joins, top rows, quality, cost, search, graphs, flows and checks.

Orders stand for captures (o_orderkey) of sites (o_custkey), line items for viewports and their items, parts for
design references, customers for projects.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfold.operators import evaluation, flows, graphs, quality, relational, rollups, search
from lumenfold.plans.base import query
from lumenfold.sources import packages
from lumenfold.streaming import jobs

_M = {"subsystem_success": "l_quantity / 47", "geometry_coverage": "l_discount * 9.7", "style_coverage": "l_tax * 12.3"}
_MSQL = {"subsystem_success": "l_quantity / 47", "geometry_coverage": "l_discount * 9.7::DOUBLE", "style_coverage": "l_tax * 12.3::DOUBLE"}
_bound = lambda x: f"round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, {x}))::DECIMAL(30,14), 4)::DOUBLE"
_rated = "CASE WHEN overall >= 0.95 THEN 'excellent' WHEN overall >= 0.8 THEN 'good' WHEN overall >= 0.5 THEN 'partial' ELSE 'poor' END AS rating"
_overall = lambda of: _bound(" + ".join(f"{of(m)} * {quality.WEIGHTS[m]}::DOUBLE" for m in _M))


@query("g2_quality", f"WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_overall(lambda m: _bound(_MSQL[m]))} AS overall FROM lineitem) SELECT *, {_rated} FROM q")
def _(t):
    q = quality.weighted_quality({m: F.expr(x) for m, x in _M.items()})
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return t("lineitem").select(*keys, q.alias("q")).select(*keys, "q.overall", "q.rating")


@query("g3_aggregate_quality", f"WITH m AS (SELECT l_orderkey, {', '.join(f'avg({_bound(x)}) AS {m}' for m, x in _MSQL.items())} FROM lineitem GROUP BY l_orderkey), q AS (SELECT l_orderkey, {_overall(lambda m: f'round({m}::DECIMAL(30,14), 4)::DOUBLE')} AS overall FROM m) SELECT *, {_rated} FROM q")
def _(t):
    return rollups.aggregate_quality(t("lineitem"), ["l_orderkey"], {m: F.expr(x) for m, x in _M.items()}, quality.WEIGHTS)


@query("g1_coverage", "SELECT o_orderkey, CASE WHEN count(l_orderkey) > 0 THEN count(*) FILTER (l_returnflag = 'A') / count(l_orderkey) ELSE 1 END::DOUBLE AS coverage FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def _(t):
    both = t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_orderkey")
    return both.agg(quality.coverage_metric(F.count(F.when(F.col("l_returnflag") == "A", 1)), F.count("l_orderkey")).cast("double").alias("coverage"))


@query("g11_cost_rollup", """WITH c AS (SELECT l_orderkey, CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 0.0::DOUBLE WHEN l_returnflag IN ('A', 'N') THEN round(((l_quantity * 0.03::DOUBLE + l_extendedprice * 0.13::DOUBLE) / 1e6::DOUBLE)::DECIMAL(30,14), 8)::DOUBLE END AS usd, l_quantity FROM lineitem)
SELECT l_orderkey, CASE WHEN count(usd) = count(*) THEN round(sum(usd), 8) END AS usd, sum(l_quantity) AS prompt_tokens, count(*) AS stages FROM c GROUP BY l_orderkey""")
def _(t):
    usd = quality.stage_cost(F.col("l_returnflag"), F.col("l_quantity"), F.col("l_extendedprice"), (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A"), [("^[AN]$", 0.03, 0.13)])
    return quality.cost_rollup(t("lineitem").withColumn("usd", usd), ["l_orderkey"], "usd", "l_quantity")


@query("g10_stage_cost", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN round(((l_quantity * 0.03::DOUBLE + l_extendedprice * 0.13::DOUBLE) / 1e6::DOUBLE)::DECIMAL(30,14), 8)::DOUBLE WHEN 'N' THEN 0.0::DOUBLE END AS usd FROM lineitem""")
def _(t):
    model = F.when(F.col("l_returnflag") == "A", "vendor/Qwen3.7-Flash").when(F.col("l_returnflag") == "N", "some/model:free").otherwise("other")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", quality.stage_cost(model, F.col("l_quantity"), F.col("l_extendedprice"), F.lit(False)).alias("usd"))


@query("g12_escalate", "SELECT l_orderkey, round(avg(l_discount * 10), 6) AS mean_confidence, avg(l_discount * 10) < 0.55 OR bool_or(l_returnflag = 'R') AS escalate FROM lineitem GROUP BY l_orderkey")
def _(t):
    items = t("lineitem").select("l_orderkey", (F.col("l_discount") * 10).alias("c"), (F.col("l_returnflag") != "R").alias("ok"))
    return quality.escalate(items, ["l_orderkey"], "c", "ok").withColumn("mean_confidence", F.round("mean_confidence", 6))


_JOBS = "j AS (SELECT event_id, user_id AS job_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'capturing' WHEN 'click' THEN 'indexing' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'failed' END AS stage, ts FROM events)"
_COUNTS = ", ".join(f"count(*) FILTER (stage = '{s}') AS {s}" for s in quality.ALL_STAGES)


@query("g13_tallies", f"WITH {_JOBS}, n AS (SELECT job_id, count(*) AS total, {_COUNTS}, count(*) FILTER (stage IN ('queued', 'capturing', 'analyzing', 'verifying', 'indexing')) AS open FROM j GROUP BY job_id) SELECT *, CASE WHEN failed > 20 THEN 'critical' WHEN failed > 0 OR open > 0 THEN 'warn' ELSE 'ok' END AS health FROM n")
def _(t):
    return quality.tallies(jobs.job_events(t("events")), ["job_id"])


@query("g9_project_counters", "SELECT c_custkey, count(o_orderkey) AS captures, 0::BIGINT + (SELECT count(*) FROM supplier WHERE s_suppkey = c_custkey) AS \"references\", max(o_orderdate) AS last_activity FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def _(t):
    caps = t("orders").withColumnRenamed("o_custkey", "c_custkey")
    refs = t("supplier").withColumnRenamed("s_suppkey", "c_custkey")
    return relational.project_counters(t("customer"), caps, refs, "c_custkey", "o_orderdate")


@query("g14_grouped_items", "SELECT l_orderkey, coalesce(string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey) FILTER (l_returnflag = 'A'), '') AS a, coalesce(string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey) FILTER (l_returnflag = 'R'), '') AS r FROM lineitem GROUP BY l_orderkey")
def _(t):
    out = relational.grouped_items(t("lineitem"), ["l_orderkey"], "l_returnflag", ["A", "R"], "l_partkey", "l_linenumber", "l_partkey")
    return out.select("l_orderkey", F.array_join("A", ",").alias("a"), F.array_join("R", ",").alias("r"))


@query("g15_host_tags", """WITH f AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY first) AS rn FROM f)
SELECT o_custkey::VARCHAR AS host, string_agg(o_orderpriority, ',' ORDER BY rn) AS tags FROM r WHERE rn <= 3 GROUP BY o_custkey""")
def _(t):
    rows = t("orders").select(F.col("o_custkey").cast("string").alias("host"), F.col("o_orderpriority").alias("tag"), "o_orderkey")
    return relational.host_tags(rows, "host", "tag", F.col("o_orderkey")).withColumn("tags", F.array_join("tags", ","))


@query("g17_community_sizes", "SELECT label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label) AS rank FROM embeddings WHERE label IS NOT NULL GROUP BY label")
def _(t):
    return graphs.community_sizes(t("embeddings"), "label")


@query("j1_screens", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey, o_orderstatus FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def _(t):
    views = t("lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", "l_suppkey")
    return relational.with_captures(views, t("orders").select(F.col("o_orderkey").alias("k"), "o_custkey", "o_orderstatus"), "k").withColumnRenamed("k", "l_orderkey")


@query("j2_analyses", "SELECT o_orderkey, o_custkey, o_totalprice, c_name, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey")
def _(t):
    captures = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return relational.with_captures(t("orders").select("o_orderkey", "o_custkey", "o_totalprice"), captures, "o_custkey")


@query("j14_flow_sections", "SELECT o_orderkey, o_custkey, o_orderpriority, (SELECT min(s.o_orderkey) FROM orders s WHERE s.o_custkey = o.o_custkey AND s.o_orderpriority = o.o_orderpriority AND s.o_orderstatus = 'F') AS matched FROM orders o")
def _(t):
    """A step of a page's flow and the page's first section of the same signature."""
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    sections_ = t("orders").filter("o_orderstatus = 'F'").select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("section_id"))
    return relational.first_match(o, sections_, ["o_custkey", "o_orderpriority"], "section_id")


@query("j4_pending_vectors", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F') AND o_orderkey % 3 <> 0")
def _(t):
    o = t("orders").select("o_orderkey", "o_orderdate")
    done = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_linestatus") == "F", "complete").otherwise("open").alias("status"))
    return relational.pending_vectors(o, done, o.filter("o_orderkey % 3 = 0"), "o_orderkey")


@query("j12_first_match", "SELECT c_custkey, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS matched FROM customer")
def _(t):
    caps = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return relational.first_match(t("customer").select("c_custkey"), caps, ["c_custkey"], "o_orderkey")


@query("j15_two_step_match", """WITH n AS (SELECT n_regionkey, min(n_name) AS a FROM nation GROUP BY 1), r AS (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0)
SELECT s_suppkey, coalesce(r.n_name, n.a) AS crop FROM supplier LEFT JOIN r ON r.n_nationkey = s_nationkey LEFT JOIN n ON n.n_regionkey = s_nationkey % 5""")
def _(t):
    others = t("nation").select(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey")).alias("id"), F.col("n_regionkey").alias("grp"), F.col("n_name").alias("crop"))
    rows = t("supplier").select("s_suppkey", F.col("s_nationkey").alias("id"), (F.col("s_nationkey") % 5).alias("grp"))
    return relational.two_step_match(rows, others, "id", ["grp"], "crop").select("s_suppkey", "crop")


@query("j23_merged_jobs", "SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 4 = 0 THEN 'memory' ELSE 'stored' END AS origin FROM orders")
def _(t):
    o = t("orders").select(F.col("o_orderkey").alias("job_id"))
    return jobs.merged_jobs(o.filter("job_id % 4 = 0").withColumn("origin", F.lit("memory")), o.withColumn("origin", F.lit("stored")))


@query("j24_cache_split", "SELECT p_partkey, p_partkey % 5 = 0 AS hit, CASE WHEN p_partkey % 5 = 0 THEN p_name END AS parsed FROM part")
def _(t):
    p = t("part")
    cache = p.filter("p_partkey % 5 = 0").select("p_partkey", F.col("p_name").alias("parsed"))
    return relational.cache_split(p.select("p_partkey"), cache, ["p_partkey"]).select("p_partkey", "hit", "parsed")


@query("j26_batch_intake", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(t):
    o = t("orders")
    return relational.avoid_keys(t("customer").select("c_custkey"), "c_custkey", o.filter("o_orderstatus = 'F'").select("o_custkey"), o.filter("o_orderstatus = 'P'").select("o_custkey"))


@query("j18_tagged_captures", """WITH f AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY first) AS rn FROM f), g AS (SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY rn) AS tags FROM r WHERE rn <= 3 GROUP BY o_custkey)
SELECT c_custkey, coalesce(tags, '') AS tags FROM customer LEFT JOIN g ON o_custkey = c_custkey""")
def _(t):
    rows = t("orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").cast("string").alias("host"), F.col("o_orderpriority").alias("tag"), "o_orderkey")
    index = relational.host_tags(rows, "host", "tag", F.col("o_orderkey"))
    caps = t("customer").select("c_custkey", F.col("c_custkey").cast("string").alias("host"))
    return relational.with_host_tags(caps, index, "host").select("c_custkey", F.array_join("tags", ",").alias("tags"))


@query("a13_scope", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN 'given' END, CASE WHEN o_orderkey % 4 = 1 THEN 'stored' END, c_mktsegment) AS scope FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def _(t):
    rows = t("orders").select("o_orderkey", F.col("o_custkey").alias("project_id"), F.when(F.col("o_orderkey") % 4 == 0, "given").alias("given_scope"), F.when(F.col("o_orderkey") % 4 == 1, "stored").alias("stored_scope"))
    return relational.resolve_scope(rows, t("customer").select(F.col("c_custkey").alias("project_id"), F.col("c_mktsegment").alias("scope"))).select("o_orderkey", "scope")


@query("k4_module_gallery", """WITH b AS (SELECT l_orderkey, l_returnflag, l_extendedprice, l_partkey FROM lineitem WHERE l_returnflag IN ('R', 'A') QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_extendedprice DESC, l_partkey) = 1)
SELECT l_returnflag, l_orderkey, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_partkey) AS rank, CASE l_returnflag WHEN 'R' THEN 1 ELSE 2 END::BIGINT AS category_order FROM b QUALIFY rank <= 12""")
def _(t):
    out = relational.best_then_top(t("lineitem").select("l_orderkey", "l_returnflag", "l_extendedprice", "l_partkey"), "l_orderkey", "l_returnflag", "l_extendedprice", 12, ["R", "A"], F.col("l_partkey"))
    return out.select("l_returnflag", "l_orderkey", "l_extendedprice", F.col("rank").cast("long").alias("rank"), F.col("category_order").cast("long").alias("category_order"))


@query("s1_merge_edges", "SELECT o_orderkey AS edge_id, CASE WHEN o_orderkey % 2 = 0 THEN 'first' ELSE 'second' END AS source FROM orders")
def _(t):
    o = t("orders").select(F.col("o_orderkey").alias("edge_id"))
    return flows.merge_edges([o.filter("edge_id % 2 = 0").withColumn("source", F.lit("first")), o.withColumn("source", F.lit("second"))])


@query("s3_first_distinct", """WITH f AS (SELECT l_orderkey, l_suppkey, min(l_linenumber * 1000000 + l_partkey) AS place FROM lineitem GROUP BY ALL) SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY place, l_suppkey) AS rank FROM f QUALIFY rank <= 8""")
def _(t):
    rows = t("lineitem").select("l_orderkey", "l_suppkey", (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("place"))
    return relational.first_distinct(rows, ["l_orderkey"], "l_suppkey", 8, F.col("place"), F.col("l_suppkey")).select("l_orderkey", "l_suppkey", F.col("rank").cast("long").alias("rank"))


@query("s4_avoid_union", "WITH u AS (SELECT l_orderkey, l_returnflag AS e FROM lineitem UNION SELECT l_orderkey, l_linestatus FROM lineitem UNION SELECT l_orderkey, unnest(['x', l_returnflag || l_linestatus]) FROM lineitem) SELECT l_orderkey, string_agg(e, ',' ORDER BY e) AS avoid FROM u GROUP BY l_orderkey")
def _(t):
    lists = t("lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", F.array(F.lit("x"), F.concat("l_returnflag", "l_linestatus"), F.lit("")).alias("more"))
    return relational.avoid_union(lists, ["l_orderkey"], "l_returnflag", "l_linestatus", "more").withColumn("avoid", F.array_join("avoid", ","))


def _nodes(t):
    p = t("part")
    return p.select(F.col("p_partkey").alias("node_id"), F.col("p_type").alias("type"), F.col("p_name").alias("label"), F.create_map(F.lit("brand"), "p_brand").alias("properties"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("taxonomy_id"))


@query("r1_search_nodes", "SELECT p_partkey AS node_id, p_type AS type, p_name AS label FROM part WHERE p_type = 'PROMO' AND contains(lower(p_partkey || ' ' || p_type || ' ' || p_name || ' ' || p_brand), 'brand#1') ORDER BY node_id LIMIT 20")
def _(t):
    return graphs.search_nodes(_nodes(t), " Brand#1", 20, "PROMO").select("node_id", "type", "label")


def _edges(t):
    return t("orders").select(F.col("o_custkey").alias("from_id"), (F.col("o_orderkey") % 500).alias("to_id"), F.col("o_orderkey").alias("edge_id"))


@query("r2_incident", "SELECT c_custkey AS node_id, o_orderkey AS edge_id FROM customer JOIN orders ON o_custkey = c_custkey OR o_orderkey % 500 = c_custkey WHERE c_custkey % 50 = 0")
def _(t):
    return graphs.incident(_edges(t), t("customer").filter("c_custkey % 50 = 0").select("c_custkey")).select("node_id", "edge_id")


@query("r5_recommend", """WITH n AS (SELECT p_partkey, p_type, CASE WHEN p_size > 25 THEN p_brand END AS x FROM part), s AS (SELECT * FROM n WHERE p_partkey % 50 = 0)
SELECT s.p_partkey AS seed_id, n.p_partkey AS node_id, row_number() OVER (PARTITION BY s.p_partkey ORDER BY n.p_partkey) AS rank FROM s JOIN n ON n.p_partkey <> s.p_partkey AND CASE WHEN s.x IS NOT NULL THEN n.x = s.x ELSE n.p_type = s.p_type END QUALIFY rank <= 5""")
def _(t):
    n = _nodes(t)
    return graphs.recommend(n, n.filter("node_id % 50 = 0"), 5).withColumn("rank", F.col("rank").cast("long"))


#: Customers of a nation link it with one of forty hubs; parts of a chain, each with the next but one of its size.
_HUBS = """e AS (SELECT DISTINCT c_nationkey AS a, 100 + c_custkey % 40 AS b FROM customer), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"""
_CHAIN = """e AS (SELECT DISTINCT p_partkey // 40 AS a, p_partkey // 40 + 1 + (p_size = 7)::INT AS b FROM part), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT 0::BIGINT AS node, 0 AS hops UNION SELECT u.b, r.hops + 1 FROM r JOIN u ON u.a = r.node WHERE u.b > r.node),
h AS (SELECT node, min(hops) AS hops FROM r GROUP BY node), p AS (SELECT h.node, h.hops, min(u.a) AS before FROM h JOIN u ON u.b = h.node JOIN h g ON g.node = u.a AND g.hops = h.hops - 1 GROUP BY ALL)"""


def _chain(t):
    at = F.floor(F.col("p_partkey") / 40)
    return t("part").select(at.alias("from_id"), (at + 1 + (F.col("p_size") == 7).cast("long")).alias("to_id"))


@query("r23_distances", f"""WITH RECURSIVE {_HUBS}, r AS (SELECT 0 AS node, 0 AS hops UNION SELECT u.b, r.hops + 1 FROM r JOIN u ON u.a = r.node WHERE r.hops < 8)
SELECT 0 AS source, node::BIGINT AS node, min(hops)::INT AS hops FROM r GROUP BY node""")
def _(t):
    e = t("customer").select(F.col("c_nationkey").cast("long").alias("from_id"), (100 + F.col("c_custkey") % 40).cast("long").alias("to_id"))
    start = t("nation").filter("n_nationkey = 0").select(F.col("n_nationkey").cast("long"))
    return graphs.distances(e, start).select(F.col("source").cast("int").alias("source"), "node", "hops")


@query("r23_paths", f"""WITH RECURSIVE {_CHAIN}, w AS (SELECT node AS goal, before AS place, before || ',' || node AS path, hops FROM p UNION ALL SELECT w.goal, p.before, p.before || ',' || w.path, w.hops FROM w JOIN p ON p.node = w.place)
SELECT goal AS node, hops, path FROM w WHERE place = 0 UNION ALL SELECT 0, 0, '0'""")
def _(t):
    start = t("nation").filter("n_nationkey = 0").select(F.col("n_nationkey").cast("long").alias("source"))
    found = graphs.distances(_chain(t), start, directed=True)  # parts of larger keys only, as in the SQL
    return graphs.paths(found, found.select("source", "node")).select("node", "hops", F.array_join("path", ",").alias("path"))


@query("r37_induced", "SELECT o_orderkey AS edge_id FROM orders WHERE contains(o_custkey::VARCHAR, '1') AND contains((o_orderkey % 500)::VARCHAR, '1') AND o_orderkey % 500 IN (SELECT c_custkey FROM customer)")
def _(t):
    n = t("customer").select(F.col("c_custkey").alias("node_id"), F.lit("").alias("label"))
    return graphs.induced(n, _edges(t), "1")[1].select("edge_id")


def _screens(t):
    p = t("part")
    facets = F.struct(F.col("p_type").alias("style"), F.col("p_brand").alias("layout"), F.lit(None).cast("string").alias("imagery_density"), (F.col("p_size") % 3).cast("string").alias("type_scale"), F.lit(None).cast("string").alias("type_image_mode"), (F.col("p_size") % 2).cast("string").alias("contrast_mode"), F.lit(None).cast("string").alias("composition_energy"), F.lit(None).cast("string").alias("chrome_weight"), F.split("p_name", " ").alias("craft_tags"), F.array("p_type").alias("industry_tags"), F.array("p_brand").alias("modules"), F.lit("content").alias("page_type"), F.lit("").alias("typography"), F.lit("").alias("color_mood"), F.lit("").alias("above_fold_job"))
    return p.select("p_partkey", "p_retailprice", F.when(F.col("p_size") % 5 > 0, facets).alias("facets"), F.when(F.col("p_size") % 7 > 0, "complete").alias("status"))


@query("r10_screens", "SELECT p_partkey FROM part WHERE p_size % 5 > 0 AND p_type = 'PROMO' AND list_contains(string_split(p_name, ' '), 'ring') ORDER BY p_retailprice DESC, p_partkey LIMIT 50")
def _(t):
    match = search.facets_match("facets", style="PROMO", craft_tags=["RING "])
    return search.list_screens(_screens(t), ("complete",), match, [F.col("p_retailprice").desc(), F.col("p_partkey")], 50).select("p_partkey")


@query("r11_facets_match", "SELECT p_partkey, p_size % 5 > 0 AND contains(lower('content ' || p_type || ' ' || p_brand || ' ' || p_type || ' ' || p_brand || ' ' || p_name), 'brand#2') AND p_size % 2 = 1 AS matches FROM part")
def _(t):
    return _screens(t).select("p_partkey", search.facets_match("facets", text="Brand#2", contrast_mode="1").alias("matches"))


@query("r17_ranked_screens", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS best FROM customer")
def _(t):
    scores = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return search.ranked_screens(t("customer").select("c_custkey"), scores, "c_custkey", "o_totalprice", F.col("c_custkey"))


@query("r21_facet_profiles", """WITH f AS (SELECT DISTINCT p_type, p_brand, p_size % 3 AS s, p_size % 2 AS c, p_name FROM part WHERE p_size % 5 > 0), n AS (SELECT p_type, p_brand, p_size % 3 AS s, p_size % 2 AS c, p_name, min(p_partkey) AS id FROM part WHERE p_size % 5 > 0 GROUP BY ALL),
p AS (SELECT a.id AS from_id, b.id AS to_id, CASE WHEN a.p_type = b.p_type THEN 0.22 ELSE 0 END + CASE WHEN a.p_brand = b.p_brand THEN 0.14 ELSE 0 END + CASE WHEN a.c = b.c THEN 0.2 ELSE 0 END + CASE WHEN a.s = b.s THEN 0.12 ELSE 0 END
 + 0.12::DOUBLE * len(list_intersect(list_distinct(string_split(a.p_name, ' ')), list_distinct(string_split(b.p_name, ' ')))) / greatest(len(list_distinct(string_split(a.p_name, ' '))), len(list_distinct(string_split(b.p_name, ' ')))) + CASE WHEN a.p_type = b.p_type THEN 0.06 ELSE 0 END AS score FROM n a JOIN n b ON a.id <= b.id)
SELECT from_id, to_id, round(score, 6) AS score FROM p WHERE round(score, 6) >= 0.65""")
def _(t):
    return graphs.facet_profiles(_screens(t).filter("facets IS NOT NULL"), "p_partkey", "facets", 0.65)[1]


def _references(t):
    p = t("part")
    return p.select(F.col("p_partkey").alias("reference_id"), F.col("p_type").alias("category"), F.col("p_brand").alias("signature"), F.col("p_name").alias("look_summary"), F.col("p_name").alias("stack_summary"), F.split("p_name", " ").alias("craft_tags"), F.array("p_brand").alias("screen_patterns"), F.array("p_type").alias("style_labels"), (F.col("p_size") % 3).cast("string").alias("type_scale"), F.col("p_retailprice").alias("indexed_at"))


_SCORE = "CASE WHEN list_contains(string_split(p_name, ' '), 'ring') THEN 5 ELSE 0 END + CASE WHEN contains(lower(p_brand), 'brand#1') THEN 4 ELSE 0 END + CASE WHEN p_type = 'PROMO' THEN 3 ELSE 0 END + CASE WHEN p_size % 3 = 1 THEN 2 ELSE 0 END + CASE WHEN contains(p_name, 'small') THEN 2 ELSE 0 END"


@query("r25_facet_score", f"SELECT p_partkey, {_SCORE} AS score FROM part")
def _(t):
    score = search.reference_score(["Ring"], ["brand#1"], "PROMO", "small", type_scale="1")
    return _references(t).select(F.col("reference_id").alias("p_partkey"), score.alias("score"))


@query("r24_search_references", f"SELECT p_partkey AS reference_id, {_SCORE} AS score FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'small') AND p_size % 3 = 1 ORDER BY score DESC, p_retailprice DESC, reference_id LIMIT 20")
def _(t):
    score = search.reference_score(["Ring"], ["brand#1"], "PROMO", "small", type_scale="1")
    return search.search_references(_references(t), {}, None, "small", F.col("type_scale") == "1", score, F.col("indexed_at"), 20).select("reference_id", "score")


@query("r7_section_search", "SELECT p_partkey, p_retailprice FROM part WHERE p_type = 'PROMO' AND (contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring')) ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 200")
def _(t):
    return search.search_rows(t("part"), {"p_type": "PROMO", "p_brand": ""}, "RING", [F.col("p_name"), F.col("p_brand")], [F.col("p_retailprice").desc(), F.col("p_partkey").desc()], 200).select("p_partkey", "p_retailprice")


@query("r8_node_search", "SELECT s_suppkey, s_acctbal FROM supplier WHERE contains(lower(s_name), '1') ORDER BY s_acctbal DESC NULLS LAST, s_suppkey DESC LIMIT 200")
def _(t):
    return search.search_rows(t("supplier"), {}, "1", [F.col("s_name")], [F.col("s_acctbal").desc_nulls_last(), F.col("s_suppkey").desc()], 200).select("s_suppkey", "s_acctbal")


@query("r9_captures", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def _(t):
    return search.search_rows(t("orders"), {"o_orderstatus": "F"}, None, [], [F.col("o_orderdate").desc(), F.col("o_orderkey")], 100).select("o_orderkey", "o_orderdate")


@query("r13_vector_search", """SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS rank
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 QUALIFY rank <= 10""")
def _(t):
    e = t("embeddings")
    return graphs.nearest(e, "vec_id", "embedding", 10, -1.0, e.filter("vec_id % 50 = 0")).withColumn("rank", F.col("rank").cast("long"))


@query("r26_similar_references", """WITH n AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY score DESC, b.vec_id) <= 20)
SELECT a, b AS reference_id, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, CASE WHEN p.p_brand = o.p_brand THEN 0 ELSE 1 END, p.p_type, b) AS rank FROM n JOIN part p ON p.p_partkey = b LEFT JOIN part o ON o.p_partkey = a QUALIFY rank <= 10""")
def _(t):
    e = t("embeddings")
    near = graphs.nearest(e, "vec_id", "embedding", 20, -1.0, e.filter("vec_id % 50 = 0"))
    return search.by_similarity(near, _references(t), 10).select("a", "reference_id", "score", F.col("rank").cast("long").alias("rank"))


@query("r31_pack", "SELECT p_partkey AS reference_id, p_type AS category FROM part WHERE p_partkey IN (SELECT s_suppkey FROM supplier)")
def _(t):
    return search.pack(_references(t), t("supplier").select("s_suppkey"))[0].select("reference_id", "category")


_LOOKS = "r AS (SELECT l_orderkey AS pack, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place, l_partkey::VARCHAR AS reference_id, trim(repeat('\u00e9tude ', l_quantity::INT)) AS look FROM lineitem)".replace("\\u00e9", "é")


@query("r32_fitted_packs", f"""WITH {_LOOKS}, z AS (SELECT *, strlen(to_json({{'reference_id': reference_id, 'look': look}})::VARCHAR) AS size FROM r),
k AS (SELECT *, sum(size + 1) OVER (PARTITION BY pack ORDER BY place) + 1 AS used FROM z), c AS (SELECT *, CASE WHEN used > 260 AND length(look) > 120 THEN rtrim(left(look, 119)) || '…' ELSE look END AS short FROM k WHERE used <= 260 OR place = 1)
SELECT pack, place, reference_id, short AS look, strlen(to_json({{'reference_id': reference_id, 'look': short}})::VARCHAR) AS bytes FROM c""")
def _(t):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = t("lineitem").select(F.col("l_orderkey").alias("pack"), F.row_number().over(order).cast("long").alias("place"), F.col("l_partkey").cast("string").alias("reference_id"), F.trim(F.repeat(F.lit("étude "), F.col("l_quantity").cast("int"))).alias("look"))
    return search.fitted_packs(rows, "pack", "place", ["reference_id"], "look", 260).drop("over")


@query("r32_under_budget", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS used FROM lineitem QUALIFY used <= 100")
def _(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return search.under_budget(rows, "l_orderkey", F.col("l_quantity"), 100, F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")).drop("l_quantity")


@query("q6_recall", """WITH t AS (SELECT c_nationkey AS q, c_custkey AS i FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 10), f AS (SELECT c_nationkey AS q, c_custkey AS i FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal + c_custkey % 7 * 100 DESC, c_custkey) <= 10)
SELECT t.q AS c_nationkey, round(count(f.i) / count(*), 6) AS recall FROM t LEFT JOIN f ON f.q = t.q AND f.i = t.i GROUP BY t.q""")
def _(t):
    c = t("customer")
    top = lambda *o: relational.top_n(c, ["c_nationkey"], 10, *o)
    out = search.recall_at(top((F.col("c_acctbal") + F.col("c_custkey") % 7 * 100).desc(), F.col("c_custkey")), top(F.col("c_acctbal").desc(), F.col("c_custkey")), "c_nationkey", "c_custkey", 10)
    return out.withColumn("recall", F.round("recall", 6))


@query("q3_combined_percent", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'N' THEN floor(l_quantity * 10 + 0.5) / 10 ELSE floor((l_quantity + l_tax * 100) / 2 * 10 + 0.5) / 10 END AS percent FROM lineitem")
def _(t):
    two = F.when(F.col("l_returnflag") != "N", F.col("l_tax") * 100)
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", evaluation.combined_percent(F.col("l_quantity"), two).alias("percent"))


@query("q4_retrieval", "SELECT p_type, p_partkey, CASE WHEN r = 1 THEN 100 WHEN r <= 3 THEN 50 ELSE 0 END AS points FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS r FROM part)")
def _(t):
    ranked = relational.top_n(t("part").select("p_type", "p_partkey", "p_retailprice"), ["p_type"], 1 << 30, F.col("p_retailprice").desc(), F.col("p_partkey"))
    return ranked.select("p_type", "p_partkey", evaluation.retrieval_points(F.col("rank")).alias("points"))


def _flow_edges(t):
    """The orders of a customer are a flow's screens; a step leads to the order after it, and back to the first one from every third."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = relational.spread(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey").select(F.col("o_custkey").alias("flow"), F.col("o_orderkey").alias("from_id"), F.lead("o_orderkey").over(w).alias("to_id"), (F.col("o_totalprice") % 100 / 100).alias("confidence"))
    return o.filter("to_id IS NOT NULL").withColumn("edge_id", F.concat_ws("-", "from_id", "to_id")).withColumn("activation", F.when(F.col("from_id") % 2 == 0, "inferred_href_only").otherwise("observed"))


@query("f3_activated_edges", "SELECT 'fe_' || substr(sha256('activate|' || o_orderkey || '|' || o_custkey || '|' || o_orderpriority), 1, 16) AS edge_id, o_orderkey AS from_id, o_custkey AS to_id, 1.0::DOUBLE AS confidence FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 5 <> 0")
def _(t):
    c = t("orders").select(F.col("o_orderkey").alias("from_id"), F.col("o_custkey").alias("to_id"), F.col("o_orderpriority").alias("candidate_id"), F.when(F.col("o_orderstatus") == "O", "allow_activate").otherwise("forbid").alias("safety"), F.when(F.col("o_orderkey") % 5 == 0, "action_unsafe").otherwise("internal_path").alias("destination_class"))
    return flows.activated_edges(c).select("edge_id", "from_id", "to_id", "confidence")


@query("f4_imported_edges", "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'e' || o_orderkey ELSE 'fe_' || substr(sha256('import|' || o_orderkey || '|' || o_orderkey || '|' || o_custkey), 1, 16) END AS edge_id, o_orderkey AS from_id, round(least(0.99::DOUBLE, o_totalprice % 2), 4) AS confidence FROM orders")
def _(t):
    e = t("orders").select(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("e"), "o_orderkey")).otherwise("").alias("edge_id"), F.col("o_orderkey").alias("position"), F.col("o_orderkey").alias("from_id"), F.col("o_custkey").alias("to_id"), (F.col("o_totalprice") % 2).alias("confidence"))
    return flows.imported_edges(e).select("edge_id", "from_id", "confidence")


@query("f5_touching", "SELECT o_orderkey AS edge_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 = 0) OR o_orderkey % 500 IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 = 0)")
def _(t):
    return flows.touching(_edges(t), t("customer").filter("c_custkey % 9 = 0").select("c_custkey")).select("edge_id")


@query("f7_merge_actions", """SELECT o_custkey AS flow, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'dig:flow.checkout' ELSE 'dig:flow.unknown' END AS action_id, CASE WHEN bool_or(o_orderstatus = 'F') THEN max(CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 0.9 ELSE 0.75 END END) ELSE 0.4 END::DOUBLE AS confidence FROM orders GROUP BY o_custkey""")
def _(t):
    o = t("orders").select(F.col("o_custkey").alias("flow"), F.when(F.col("o_orderstatus") == "F", "dig:flow.checkout").otherwise("dig:flow.unknown").alias("action_id"), F.when(F.col("o_orderkey") % 2 == 0, 0.9).otherwise(0.75).alias("confidence"), F.lit("m").alias("method"), "o_orderkey")
    sure, guessed = o.filter("o_orderkey % 2 = 0").drop("o_orderkey"), o.filter("o_orderkey % 2 = 1").drop("o_orderkey")
    return flows.merge_actions(sure, guessed, "flow").select("flow", "action_id", "confidence")


@query("f9_screen_order", "SELECT o_custkey AS flow, o_orderkey AS capture_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders")
def _(t):
    screens = t("orders").select(F.col("o_custkey").alias("flow"), F.col("o_orderkey").alias("capture_id"), F.when(F.col("o_custkey") % 2 == 0, F.lit(None)).otherwise(F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("long").alias("ordinal"))
    return flows.order_screens(screens, _flow_edges(t), "flow")


def _places(t):
    return relational.spread(t("orders").select("o_custkey", "o_orderkey"), "o_custkey").select(F.col("o_custkey").alias("flow"), F.col("o_orderkey").alias("capture_id"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("long").alias("place"))


@query("f10_flow_ids", "SELECT o_custkey AS flow, 'flow_' || substr(sha256('scope|' || o_custkey || '|' || string_agg(o_orderkey, '|' ORDER BY o_orderkey)), 1, 16) AS flow_id FROM orders GROUP BY o_custkey")
def _(t):
    return flows.flow_ids(_places(t), "flow", F.lit("scope"))


@query("f10_flow_edges", "WITH e AS (SELECT o_custkey AS flow, o_orderkey AS from_id, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS to_id FROM orders) SELECT flow, from_id, to_id FROM e WHERE to_id IS NOT NULL AND from_id % 10 <> 0 AND to_id % 10 <> 0")
def _(t):
    return flows.flow_edges(_flow_edges(t), _places(t).filter("capture_id % 10 <> 0"), "flow").select("flow", "from_id", "to_id")


@query("f14_flow_issues", """WITH e AS (SELECT o_custkey AS flow, o_orderkey AS from_id, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS to_id FROM orders)
SELECT flow, 'missing_from_id' AS code, count(*) AS n FROM e WHERE to_id IS NOT NULL AND from_id % 10 = 0 GROUP BY flow UNION ALL SELECT flow, 'missing_to_id', count(*) FROM e WHERE to_id IS NOT NULL AND to_id % 10 = 0 GROUP BY flow""")
def _(t):
    w = Window.partitionBy("flow").orderBy("capture_id")
    kept = _places(t).filter("capture_id % 10 <> 0").withColumn("place", (F.row_number().over(w) - 1).cast("long"))
    actions = t("orders").select(F.col("o_custkey").alias("flow"), F.lit("dig:flow.checkout").alias("action_id"))
    return flows.flow_issues(actions, kept, _flow_edges(t), "flow").groupBy("flow", "code").agg(F.count(F.lit(1)).alias("n"))


@query("f8_evidence_fingerprint")
def _(t):
    screens = t("orders").select(F.col("o_custkey").alias("flow"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderkey").cast("string").alias("capture_id"), F.lit("https://a.example/x").alias("url"))
    return flows.evidence_fingerprint(screens, _flow_edges(t), "flow")


@query("v2_duplicate_issues", "SELECT l_orderkey AS package, 'duplicate_node_id' AS code, l_suppkey::VARCHAR AS item FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1")
def _(t):
    return packages.duplicate_issues(t("lineitem"), "l_orderkey", "l_suppkey", "duplicate_node_id")


@query("v3_dangling_issues", "SELECT l_orderkey AS package, 'box_node_missing' AS code, l_suppkey::VARCHAR AS item FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey = a.l_suppkey AND b.l_returnflag = 'A')")
def _(t):
    lines = t("lineitem")
    return packages.dangling_issues(lines, lines.filter("l_returnflag = 'A'"), "l_orderkey", "l_suppkey", "l_suppkey", "box_node_missing")


@query("v4_count_issues", "SELECT o_orderkey AS package, 'node_count_mismatch' AS code, '4 is ' || count(l_orderkey) AS item FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING count(l_orderkey) <> 4")
def _(t):
    declared = t("orders").select(F.col("o_orderkey").alias("package"), F.lit(4).cast("long").alias("n"))
    return packages.count_issues(declared, t("lineitem").withColumnRenamed("l_orderkey", "package"), "package", "n", "node_count_mismatch")


@query("v6_layer_issues", """WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'L3' ELSE 'L2' END AS layer, l_quantity / 45 AS confidence, CASE WHEN l_linestatus = 'F' THEN 'm' ELSE '' END AS method FROM lineitem)
SELECT l_orderkey AS package, 'l3_confidence' AS code, l_linenumber::VARCHAR AS item FROM r WHERE layer = 'L3' AND confidence >= 1 UNION ALL SELECT l_orderkey, 'l3_method_missing', l_linenumber::VARCHAR FROM r WHERE layer = 'L3' AND method = ''""")
def _(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "A", "L3").otherwise("L2").alias("layer"), (F.col("l_quantity") / 45).alias("confidence"), F.when(F.col("l_linestatus") == "F", "m").otherwise("").alias("method"))
    return packages.layer_issues(rows, "l_orderkey", "l_linenumber")


@query("v8_schema_issues", """SELECT l_orderkey AS package, 'schema' AS code, l_linenumber || ': ' || unnest(list_filter([CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'value of l_returnflag' END, CASE WHEN l_tax > 0.07 THEN 'range of l_tax' END], lambda x: x IS NOT NULL)) AS item FROM lineitem""")
def _(t):
    return packages.schema_issues(t("lineitem"), "l_orderkey", "l_linenumber", ["l_partkey"], {"l_returnflag": ["A", "N"]}, {"l_tax": (0.0, 0.07)})
