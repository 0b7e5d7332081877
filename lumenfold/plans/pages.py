"""Queries over the elements of web pages. SQL can't read html; tests compare them with brute force on small pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfold.functions import keys
from lumenfold.functions.lineage import written
from lumenfold.operators import flows, nodes
from lumenfold.plans.base import query
from lumenfold.plans.urls import _PARTS


def _pages(t):
    return nodes.page_nodes(t("pages"))


def _stored_pages(t):
    """For queries that read the nodes and their ancestors more than once: html is parsed once."""
    return written(nodes.page_nodes(t("pages"), paths=True).drop("text"))


@query("u7_page_nodes")
def _(t):
    n = _pages(t)
    return n.select("capture", "node_id", "parent_id", "ordinal", "tag", F.sha2("text", 256).alias("text_sha256"), "rendered")


@query("b7_redact_attributes")
def _(t):
    n = _pages(t).filter(F.map_contains_key("attributes", "href") | F.map_contains_key("attributes", "src"))
    base = t("pages").select(F.col("page_id").alias("capture"), "url")
    clean = n.join(base, "capture").withColumn("a", keys.redact_attributes(F.col("tag"), F.col("attributes"), F.col("url")))
    return clean.select("capture", "node_id", F.coalesce(F.col("a")["href"], F.col("a")["src"]).alias("address"))


@query("c10_ancestors")
def _(t):
    return nodes.page_ancestors(nodes.page_nodes(t("pages"), paths=True)).groupBy("capture", "node_id").agg(F.max("depth").alias("depth"))


#: Line items of an order are the nodes of a tree: the parent of one is at half its place, of every 40th order at the place before.
_TREE = """n AS (SELECT l_orderkey AS capture, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS node_id FROM lineitem),
m AS (SELECT capture, node_id, CASE WHEN node_id > 1 THEN CASE WHEN capture % 40 = 0 THEN node_id - 1 ELSE node_id // 2 END END AS parent_id FROM n)"""


@query("c10_line_ancestors", f"WITH RECURSIVE {_TREE}, a AS (SELECT capture, node_id, parent_id AS ancestor_id, 1 AS depth FROM m WHERE parent_id IS NOT NULL UNION ALL SELECT a.capture, a.node_id, m.parent_id, a.depth + 1 FROM a JOIN m ON m.capture = a.capture AND m.node_id = a.ancestor_id WHERE m.parent_id IS NOT NULL) SELECT * FROM a")
def _(t):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    n = t("lineitem").select(F.col("l_orderkey").alias("capture"), F.row_number().over(order).cast("long").alias("node_id"))
    parent = F.when(F.col("capture") % 40 == 0, F.col("node_id") - 1).otherwise(F.floor(F.col("node_id") / 2))
    return nodes.ancestors(n.withColumn("parent_id", F.when(F.col("node_id") > 1, parent)))


@query("d1_entities")
def _(t):
    return nodes.entities(_pages(t))


@query("d5_page_types")
def _(t):
    return nodes.page_types(nodes.entities(_pages(t)))


@query("d6_entity_parents")
def _(t):
    n = _stored_pages(t)
    return nodes.with_parents(nodes.entities(n), nodes.page_ancestors(n)).select("capture", "entity_id", "taxonomy_id", "parent_entity_id")


@query("d7_relationships")
def _(t):
    n = _stored_pages(t)
    closure = nodes.page_ancestors(n)
    found = written(nodes.with_parents(nodes.entities(n), closure))  # read five times
    return nodes.relationships(found, n, closure)


#: Controls that every page has here: node, parent, tag, attributes, text, top, width and height of its box.
_CONTROLS = (
    (0, None, "body", {}, "", None), (1, 0, "nav", {}, "", None), (2, 0, "main", {}, "", (0.0, 900.0, 1000.0)), (3, 0, "div", {"role": "contentinfo"}, "", None),
    (5, 2, "a", {"href": "/login"}, "Sign in", None), (6, 2, "button", {}, "Buy now", (20.0, 100.0, 30.0)), (7, 2, "button", {"type": "submit"}, "Send", None),
    (8, 3, "a", {"href": "https://other.example/x"}, "Privacy", None), (9, 2, "span", {"role": "link"}, "no way", None), (10, 2, "a", {"href": "#part"}, "", None),
)


def _controls(t):
    """Pages with these controls, and a link to the next page in their navigation."""
    box = "struct<x:double,y:double,width:double,height:double>"
    rows = [(n, p, tag, attrs, text, None if b is None else (0.0, *b)) for n, p, tag, attrs, text, b in _CONTROLS]
    fixed = t("pages").sparkSession.createDataFrame(rows, f"node_id long, parent_id long, tag string, attributes map<string,string>, text string, box {box}")
    pages = t("pages").select(F.col("page_id").alias("capture"), "url")
    every = pages.select("capture").join(F.broadcast(fixed), F.col("capture").isNotNull())
    after = t("pages").select((F.col("page_id") - 1).alias("capture"), F.col("url").alias("_next"))
    link = pages.join(after, "capture").select("capture", F.lit(4).cast("long").alias("node_id"), F.lit(1).cast("long").alias("parent_id"), F.lit("a").alias("tag"), F.create_map(F.lit("href"), "_next").alias("attributes"), F.lit("Next page").alias("text"), F.struct(F.lit(0.0).alias("x"), F.lit(10.0).alias("y"), F.lit(100.0).alias("width"), F.lit(50.0).alias("height")).alias("box"))
    return every.unionByName(link).withColumn("rendered", F.lit(True)), pages


def _candidates(t):
    n, pages = _controls(t)
    return flows.flow_candidates(n, nodes.ancestors(n), pages)


#: A page and the next one by id; what the link between them is to the first.
_NEXT = f"""{_PARTS}, y AS (SELECT *, CASE WHEN s IN ('http', 'https') THEN s || '://' || h || port || short_path END AS key FROM x),
o AS (SELECT a.page_id, a.key, b.key AS next_key, CASE WHEN a.s = b.s AND a.h = b.h AND a.port = b.port THEN CASE WHEN a.full_path = b.full_path THEN CASE WHEN b.f <> '' AND b.q = '' THEN 'fragment' ELSE 'internal_same_origin' END ELSE 'internal_path' END ELSE 'external' END AS class FROM y a JOIN y b ON b.page_id = a.page_id + 1),
c AS (SELECT page_id, 4 AS node_id, 'nav_item' AS kind, class, 'href_join_only' AS safety, round(0.7 + CASE class WHEN 'internal_path' THEN 0.28 WHEN 'internal_same_origin' THEN 0.12 WHEN 'fragment' THEN 0.08 ELSE -0.12 END, 4) AS score FROM o
UNION ALL SELECT page_id, unnest([5, 6, 7, 8, 10]), unnest(['link', 'button', 'submit', 'link', 'link']), unnest(['internal_path', 'action_unsafe', 'unknown', 'external', 'fragment']), unnest(['href_join_only', 'forbid', 'href_join_only', 'href_join_only', 'href_join_only']), unnest([0.93, 0.4, 0.57, 0.0, 0.67]) FROM pages)"""


@query("d35_flow_candidates", f"WITH {_NEXT} SELECT page_id AS capture, node_id, kind AS control_kind, class AS destination_class, safety, score::DOUBLE AS score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, node_id::VARCHAR) AS rank FROM c")
def _(t):
    return _candidates(t).select("capture", "node_id", "control_kind", "destination_class", "safety", "score", "rank")


@query("f1_href_edges", f"""WITH {_NEXT} SELECT o.page_id AS from_id, (SELECT min(page_id) FROM y WHERE y.key = o.next_key AND y.page_id <> o.page_id) AS to_id, round(least(0.95::DOUBLE, 0.55::DOUBLE + score::DOUBLE * 0.4::DOUBLE), 4) AS confidence
FROM o JOIN c ON c.page_id = o.page_id AND c.node_id = 4 WHERE o.class <> 'fragment' AND to_id IS NOT NULL""")
def _(t):
    """Links of pages to the next page of the table."""
    screens = t("pages").select(F.col("page_id").alias("capture_id"), "url")
    return flows.href_edges(screens, _candidates(t).withColumnRenamed("capture", "capture_id")).select("from_id", "to_id", "confidence")


@query("f6_flow_actions")
def _(t):
    """Actions of each host's pages, as one flow."""
    found = nodes.entities(_pages(t)).groupBy(F.col("capture").alias("page_id")).agg(F.max(F.col("taxonomy_id") == "dig:component.form").alias("has_form"), F.max(F.col("taxonomy_id") == "dig:region.navigation").alias("has_nav"))
    screens = t("pages").select("page_id", "url", keys.host_of(F.col("url")).alias("flow")).join(found, "page_id", "left").withColumn("ordinal", F.col("page_id"))
    return flows.detect_actions(screens, "flow")
