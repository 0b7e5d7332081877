"""Nodes of captured pages: html to rows, ancestors, ontology entities and their relationships.

Nodes have capture (a page or viewport), node_id, parent_id, ordinal (document order), tag, attributes (a map), text.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.keys import stable_id
from lumenfold.functions.lineage import written

#: Elements without an end, and those whose text isn't shown.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
UNSEEN = frozenset(("script", "style", "template", "noscript"))


class _Elements(HTMLParser):
    """Elements in document order: [parent, tag, attributes, text parts]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []

    def handle_starttag(self, tag, attrs):
        self.rows.append([self.open[-1] if self.open else None, tag, {k: v or "" for k, v in attrs}, []])
        if tag not in VOID:
            self.open.append(len(self.rows) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[i]][1] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if self.open and data.strip():
            self.rows[self.open[-1]][3].append(data)


#: Rows, and ancestors of these rows, that a task hands over at once.
_ROWS, _PATHS = 20_000, 1 << 19


def page_nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", paths: bool = False) -> DataFrame:
    """A row per element of each page: capture, node_id, parent_id, ordinal, tag, attributes, text (its own), rendered.

    A null page has none; broken html gives what can be read. Node ids are places in the page. Nothing is shuffled. With
    `paths` there is also path, the ancestors from the parent to the root, which page_ancestors() reads.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            held = 0
            for capture, html in zip(pdf["_id"], pdf["_html"], strict=True):
                parser = _Elements()
                parser.feed(html or "")
                parser.close()
                hidden: set[int] = set()
                for i, (parent, tag, attrs, text) in enumerate(parser.rows):
                    if tag in UNSEEN or tag in ("head", "title", "meta", "link") or "hidden" in attrs or parent in hidden:
                        hidden.add(i)
                    out.append((capture, i, parent, i, tag, attrs, " ".join(" ".join(text).split()), i not in hidden))
                    if paths:
                        path = []
                        while parent is not None:
                            path.append(parent)
                            parent = parser.rows[parent][0]
                        out[-1] += (path,)
                        held += len(path)
                        if held > _PATHS:
                            yield _frame(out, paths)
                            out, held = [], 0
                if len(out) > _ROWS:
                    yield _frame(out, paths)
                    out, held = [], 0
            yield _frame(out, paths)

    schema = f"capture {kind}, node_id long, parent_id long, ordinal long, tag string, attributes map<string,string>, text string, rendered boolean" + ", path array<long>" * paths
    return pages.select(F.col(id_col).alias("_id"), F.col(html_col).alias("_html")).mapInPandas(run, schema)


def _frame(rows: list[tuple], paths: bool = False) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["capture", "node_id", "parent_id", "ordinal", "tag", "attributes", "text", "rendered", *["path"] * paths])
    return out.astype({"parent_id": "Int64"})


def page_ancestors(nodes: DataFrame) -> DataFrame:
    """What ancestors() gives, of page_nodes() with paths: the parser has them, so nothing is joined or shuffled."""
    every = nodes.select("capture", "node_id", F.posexplode("path").alias("_d", "ancestor_id"))
    return every.select("capture", "node_id", "ancestor_id", (F.col("_d") + 1).alias("depth"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """(capture, node_id, ancestor_id, depth) of every node and each of its ancestors up to the root; depth 1 is the parent.

    Doubles: ancestors 1 to d and those of the one at depth d give 1 to 2d, so a round halves what is left, and ends when
    no node has more. Every level is written once. Parents that form a circle are an error.
    """
    known, reach, most = written(nodes.filter("parent_id IS NOT NULL").select("capture", "node_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("depth"))), 1, None
    while True:
        far = known.filter(F.col("depth") == reach).select("capture", "node_id", F.col("ancestor_id").alias("_mid"))
        more = far.join(known.select("capture", F.col("node_id").alias("_mid"), "ancestor_id", F.col("depth").alias("_d")), ["capture", "_mid"])
        more = written(more.select("capture", "node_id", "ancestor_id", (F.col("_d") + reach).alias("depth")))
        if more.isEmpty():
            return known
        known, reach = known.unionByName(more), reach * 2
        if reach >= 1024:
            most = most if most is not None else nodes.groupBy("capture").count().agg(F.max("count")).first()[0]
            if reach > 2 * most:
                raise ValueError("parents form a circle")


#: Rules (term, confidence, method, tags, roles): a node with one of the tags or roles has the term.
RULES = (
    ("region.banner", 0.99, "html_landmark", ("header",), ("banner",)),
    ("region.navigation", 0.99, "html_landmark", ("nav",), ("navigation",)),
    ("component.navigation", 0.98, "navigation_semantics", ("nav",), ("navigation",)),
    ("pattern.navigation", 0.98, "navigation_semantics", ("nav",), ("navigation",)),
    ("region.main", 0.99, "html_landmark", ("main",), ("main",)),
    ("region.complementary", 0.99, "html_landmark", ("aside",), ("complementary",)),
    ("region.contentinfo", 0.99, "html_landmark", ("footer",), ("contentinfo",)),
    ("section.generic", 0.98, "section_element", ("section",), ()),
    ("section.article", 0.99, "article_element", ("article",), ()),
    ("component.form", 0.99, "form_element", ("form",), ()),
    ("pattern.form", 0.97, "form_semantics", ("form",), ()),
    ("component.form_control", 0.99, "form_control_element", ("input", "select", "textarea"), ()),
    ("component.button", 0.99, "button_semantics", ("button",), ("button",)),
    ("component.link", 0.99, "link_semantics", ("a",), ("link",)),
    ("component.media", 0.98, "media_element", ("img", "svg", "video", "canvas"), ()),
    ("component.embed", 0.99, "iframe_element", ("iframe",), ()),
    ("pattern.embedded_content", 0.98, "iframe_element", ("iframe",), ()),
    ("component.list", 0.98, "list_semantics", ("ul", "ol"), ("list",)),
    ("component.list_item", 0.98, "list_item_semantics", ("li",), ("listitem",)),
    ("component.table", 0.98, "table_semantics", ("table",), ("table", "grid")),
    ("component.dialog", 0.99, "dialog_semantics", ("dialog",), ("dialog", "alertdialog")),
    ("pattern.modal", 0.9, "dialog_semantics", ("dialog",), ("dialog", "alertdialog")),
    ("component.disclosure", 0.99, "details_element", ("details",), ()),
    ("component.tabs", 0.99, "aria_tablist", (), ("tablist",)),
    ("pattern.tabs", 0.99, "aria_tablist", (), ("tablist",)),
    ("component.figure", 0.99, "figure_element", ("figure",), ()),
    ("content.heading", 0.99, "heading_element", ("h1", "h2", "h3", "h4", "h5", "h6"), ()),
    ("content.body_text", 0.96, "paragraph_element", ("p",), ()),
    ("content.label", 0.99, "label_element", ("label",), ()),
    ("content.caption", 0.99, "caption_element", ("figcaption", "caption"), ()),
    ("content.quote", 0.99, "quote_element", ("blockquote", "q"), ()),
    ("content.code", 0.98, "code_element", ("code", "pre"), ()),
)
#: Terms that are hypotheses (L3), not measured facts (L2).
GUESSED = ("pattern.hero", "pattern.modal", "pattern.accordion", "pattern.card_grid", "pattern.primary_action")


def entities(nodes: DataFrame) -> DataFrame:
    """(capture, entity_id, node_id, ordinal, taxonomy_id, confidence, method), once for each node and term.

    Rules by tag or role, then search forms and breadcrumbs by their label, and headers whose position is sticky. Only
    rendered nodes; pseudo nodes are decoration and nothing else. `nodes` may have node_type and position. One pass, no
    shuffle.
    """
    pseudo = F.coalesce(F.col("node_type") == "pseudo", F.lit(False)) if "node_type" in nodes.columns else F.lit(False)
    sticky = F.col("position") == "sticky" if "position" in nodes.columns else F.lit(False)
    role = F.col("attributes")["role"]
    label = F.lower(F.coalesce(F.col("attributes")["aria-label"], F.lit("")))
    hit = lambda when, term, sure, method: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit("dig:" + term).alias("taxonomy_id"), F.lit(sure).alias("confidence"), F.lit(method).alias("method")))
    rules = [hit(F.col("tag").isin(*tags) | F.coalesce(role.isin(*roles), F.lit(False)), term, sure, method) for term, sure, method, tags, roles in RULES]
    search = (F.col("tag") == "form") & ((role == "search") | label.contains("search"))
    rules += [hit(search, "component.search", 0.96, "search_form_semantics"), hit(search, "pattern.search", 0.96, "search_form_semantics")]
    rules.append(hit(((F.col("tag") == "nav") | F.coalesce(role == "navigation", F.lit(False))) & label.contains("breadcrumb"), "pattern.breadcrumb", 0.98, "breadcrumb_aria_label"))
    rules.append(hit((F.col("tag") == "header") & sticky, "pattern.sticky_header", 0.97, "sticky_header_geometry"))
    rules = [F.when(~pseudo, r) for r in rules] + [hit(pseudo, "element.decorative", 0.9, "pseudo_element")]
    flat = nodes.filter(F.col("rendered") & (pseudo | (F.col("tag") != ""))).select("capture", "node_id", "ordinal", F.explode(F.array_compact(F.array(*rules))).alias("_e")).select("capture", "node_id", "ordinal", "_e.*")
    return _named(flat)


def _named(rows: DataFrame) -> DataFrame:
    guessed = F.col("taxonomy_id").isin(*["dig:" + t for t in GUESSED])
    return rows.select("capture", stable_id("ont", F.col("capture"), F.col("node_id"), F.col("taxonomy_id")).alias("entity_id"), "node_id", "ordinal", "taxonomy_id", "confidence", "method", F.when(guessed, "L3").otherwise("L2").alias("layer"))


def heroes(nodes: DataFrame, closure: DataFrame, boxes: DataFrame, fold: Column) -> DataFrame:
    """Sections that hold an h1 and begin above 1.2 viewport heights (`fold`): `boxes` has capture, node_id, y."""
    holders = closure.join(nodes.filter("tag = 'h1'").select("capture", "node_id"), ["capture", "node_id"]).select("capture", F.col("ancestor_id").alias("node_id")).distinct()
    top = nodes.filter("rendered AND tag = 'section'").join(holders, ["capture", "node_id"]).join(boxes, ["capture", "node_id"]).filter(F.col("y") < fold * 1.2)
    return _named(top.select("capture", "node_id", "ordinal", F.lit("dig:pattern.hero").alias("taxonomy_id"), F.lit(0.86).alias("confidence"), F.lit("top_section_with_h1").alias("method")))


def repeated_groups(nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """D3: sections and divs over two details or more (accordion), grid and flex nodes over three articles or items or more (card grid).

    `nodes` has display as well. Descendants are counted by ancestor before they meet it.
    """
    inner = nodes.filter("tag IN ('details', 'article', 'li')").select("capture", "node_id", F.col("tag").alias("_tag"))
    counts = closure.join(inner, ["capture", "node_id"]).groupBy("capture", F.col("ancestor_id").alias("node_id")).agg(F.count(F.when(F.col("_tag") == "details", 1)).alias("_details"), F.count(F.when(F.col("_tag") != "details", 1)).alias("_cards"))
    seen = nodes.filter("rendered").join(counts, ["capture", "node_id"])
    hit = lambda when, term, sure, method: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(term).alias("taxonomy_id"), F.lit(sure).alias("confidence"), F.lit(method).alias("method")))
    rules = F.array_compact(F.array(hit(F.col("tag").isin("section", "div") & (F.col("_details") >= 2), "dig:pattern.accordion", 0.88, "repeated_disclosure_group"), hit(F.col("display").rlike("grid|flex") & (F.col("_cards") >= 3), "dig:pattern.card_grid", 0.8, "repeated_items_in_layout_context")))
    return _named(seen.select("capture", "node_id", "ordinal", F.explode(rules).alias("_e")).select("capture", "node_id", "ordinal", "_e.*"))


def primary_actions(nodes: DataFrame, closure: DataFrame, hero: DataFrame) -> DataFrame:
    """Links and buttons inside a hero."""
    inside = closure.join(hero.select("capture", F.col("node_id").alias("ancestor_id")), ["capture", "ancestor_id"]).select("capture", "node_id").distinct()
    found = nodes.filter("tag IN ('a', 'button')").join(inside, ["capture", "node_id"])
    return _named(found.select("capture", "node_id", "ordinal", F.lit("dig:pattern.primary_action").alias("taxonomy_id"), F.lit(0.78).alias("confidence"), F.lit("interactive_element_in_hero").alias("method")))


def page_types(found: DataFrame) -> DataFrame:
    """A row a capture: landing where there are a hero and a form, else content."""
    both = F.max(F.col("taxonomy_id") == "dig:pattern.hero") & F.max(F.col("taxonomy_id") == "dig:component.form")
    landing = found.groupBy("capture").agg(both.alias("_l"))
    pick = lambda a, b: F.when(F.col("_l"), a).otherwise(b)
    return landing.select("capture", stable_id("ont", F.col("capture"), F.lit("page"), F.lit("dig:page.unknown")).alias("entity_id"), pick("dig:page.landing", "dig:page.content").alias("taxonomy_id"), pick(0.82, 0.72).alias("confidence"))


def with_parents(found: DataFrame, closure: DataFrame) -> DataFrame:
    """Entities with the region, section or component of the nearest ancestor as parent_entity_id, else the page's id."""
    holders = found.filter(F.col("taxonomy_id").rlike(r"^dig:(region|section|component)\.")).groupBy("capture", F.col("node_id").alias("ancestor_id"))
    holders = holders.agg(F.min(F.struct(_rule_place(F.col("taxonomy_id")).alias("p"), "entity_id")).alias("_m")).select("capture", "ancestor_id", F.col("_m.entity_id").alias("_parent"))
    near = closure.join(holders, ["capture", "ancestor_id"]).groupBy("capture", "node_id").agg(F.min(F.struct("depth", "_parent")).alias("_n"))
    page = stable_id("ont", F.col("capture"), F.lit("page"), F.lit("dig:page.unknown"))
    return found.join(near, ["capture", "node_id"], "left").withColumn("parent_entity_id", F.coalesce("_n._parent", page)).drop("_n")


def _rule_place(term: Column) -> Column:
    """Place of a term among the rules, the order in which a node gets its entities."""
    return F.coalesce(F.array_position(F.array(*[F.lit("dig:" + r[0]) for r in RULES]), term), F.lit(len(RULES) + 1))


def relationships(found: DataFrame, nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """Contains (parent to entity), implements (component to pattern of one node) and labels (label to the control it is for, or its first one)."""
    edge = lambda df, kind, a, b, sure: df.select("capture", stable_id("rel", a, F.lit(kind), b).alias("relationship_id"), F.lit(kind).alias("type"), a.alias("from_entity_id"), b.alias("to_entity_id"), sure.alias("confidence"))
    out = edge(found, "contains", F.col("parent_entity_id"), F.col("entity_id"), F.least(F.lit(1.0), F.col("confidence")))
    of = lambda kind, s: found.filter(F.col("taxonomy_id").startswith(f"dig:{kind}.")).select("capture", "node_id", F.col("entity_id").alias(f"e{s}"), F.col("confidence").alias(f"c{s}"))
    out = out.unionByName(edge(of("component", 1).join(of("pattern", 2), ["capture", "node_id"]), "implements", F.col("e1"), F.col("e2"), F.least("c1", "c2")))
    controls = nodes.filter("tag IN ('input', 'select', 'textarea')").select("capture", F.col("node_id").alias("_control"), "ordinal")
    labels = nodes.filter("tag = 'label'").select("capture", "node_id", F.col("attributes")["for"].alias("_for"))
    ids = nodes.filter(F.col("attributes")["id"].isNotNull()).groupBy("capture", F.col("attributes")["id"].alias("_for")).agg(F.min(F.struct("ordinal", "node_id")).alias("_m")).select("capture", "_for", F.col("_m.node_id").alias("_control"))
    by_for = labels.filter("_for <> ''").join(ids, ["capture", "_for"]).select("capture", "node_id", "_control")
    inner = closure.select("capture", F.col("node_id").alias("_control"), F.col("ancestor_id").alias("node_id"), "depth").join(labels.filter("coalesce(_for, '') = ''").select("capture", "node_id"), ["capture", "node_id"])
    inner = inner.join(controls, ["capture", "_control"]).groupBy("capture", "node_id").agg(F.min(F.struct("depth", "ordinal", "_control")).alias("_m")).select("capture", "node_id", F.col("_m._control").alias("_control"))
    named = lambda term, key, name: found.filter(F.col("taxonomy_id") == term).select("capture", F.col("node_id").alias(key), F.col("entity_id").alias(name))
    met = by_for.unionByName(inner).join(named("dig:content.label", "node_id", "e1"), ["capture", "node_id"]).join(named("dig:component.form_control", "_control", "e2"), ["capture", "_control"])
    return out.unionByName(edge(met, "labels", F.col("e1"), F.col("e2"), F.lit(1.0))).dropDuplicates(["relationship_id"])
