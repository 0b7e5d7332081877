"""Rows of the library: catalogs, screens, entities, findings, labels and the knowledge graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.keys import bound, capture_key, host_key, is_blocked, is_home, join_key, origin_of, stable_id, words_key
from lumenfold.functions.looks import alpha_of, luminance, pixels, rgb_of
from lumenfold.operators.flows import ACTIONS, PREFIX
from lumenfold.operators.relational import latest, top_n


def one_screen_each(screens: DataFrame, capture: str, name: str, devices: tuple[str, ...] = (), device: str | None = None, primary: str = "desktop") -> DataFrame:
    """K5: a capture's primary screen, else its first by name. With `devices`, instead all screens of these, or of `device` alone."""
    if devices:
        return screens.filter(F.col(name).isin(*devices)) if device is None else screens.filter(F.col(name) == device)
    return latest(screens, [capture], (F.col(name) == primary).desc(), F.col(name))


def homepages(rows: DataFrame, known: DataFrame, blocked: list[str], *order: Column) -> DataFrame:
    """K8: the first row of each host that neither `known` (one column of hosts) nor a blocklist has; deep urls become the homepage of their host."""
    url = F.trim("url")
    url = F.when(url.startswith("http://"), F.concat(F.lit("https://"), F.substring(url, 8, 1 << 20))).when(url.startswith("https://"), url).otherwise(F.concat(F.lit("https://"), url))
    named = rows.filter("trim(url) <> ''").withColumn("url", url).withColumn("host", host_key(F.col("url")))
    free = named.filter(~is_blocked(F.col("host"), blocked)).join(known.toDF("_known").distinct(), F.col("host") == F.col("_known"), "left_anti")
    home = F.when(is_home(F.col("url")), F.col("url")).otherwise(F.concat(origin_of(F.col("url")), F.lit("/")))
    return latest(free, ["host"], *order).withColumn("url", home)


def seed_urls(pages: DataFrame, scan: str, root: str, url: str, *order: Column, most: int = 24) -> DataFrame:
    """(scan, url, place): a scan's root first, then its samples in order, once for each join key, at most `most`."""
    roots = pages.select(scan, F.trim(root).alias("url"), F.lit(0).alias("_first"), F.lit(0).cast("long").alias("_at")).distinct()
    rn = F.row_number().over(Window.partitionBy(scan).orderBy(*order)).cast("long")
    every = roots.unionByName(pages.select(scan, F.trim(url).alias("url"), F.lit(1).alias("_first"), rn.alias("_at"))).filter("url <> ''")
    keyed = every.withColumn("_key", F.coalesce(join_key(F.col("url")), F.lower("url")))
    first = latest(keyed, [scan, "_key"], F.col("_first"), F.col("_at"))
    return top_n(first, [scan], most, F.col("_first"), F.col("_at")).select(scan, "url", F.col("rank").alias("place"))


def vocabulary_match(text: Column, vocabulary: list[str]) -> Column:
    """The term that equals the text, else the longest one of four characters or more within it; null for none."""
    key = lambda t: " ".join(t.lower().replace("_", " ").replace("|", " ").replace("/", " ").replace("-", " ").split())

    def match(hay: Column) -> Column:
        exact, inside = F.lit(None).cast("string"), F.lit(None).cast("string")
        for term in reversed(vocabulary):
            exact = F.when(hay == key(term), term).otherwise(exact)
        for term in sorted(reversed(vocabulary), key=lambda t: len(key(t))):
            if len(key(term)) >= 4:
                inside = F.when(hay.contains(key(term)), term).otherwise(inside)
        return F.coalesce(exact, inside)

    return bound(words_key(text), match)


def flat_styles(rules: DataFrame, node: str, position: str, properties: list[str]) -> DataFrame:
    """(node, property, value): the first value by position of each property that is asked for; `rules` has name and value."""
    known = rules.filter(F.col("name").isin(*properties) & F.col("value").isNotNull())
    return known.groupBy(node, "name").agg(F.min_by("value", position).alias("value"))


def unique_ids(entities: DataFrame, viewport: str, entity: str, prefix: str, *order: Column) -> DataFrame:
    """Entities with new_id: the first viewport of an id keeps it, others get one made of viewport and id."""
    first = F.row_number().over(Window.partitionBy(entity).orderBy(*order)) == 1
    return entities.withColumn("_first", first).withColumn("new_id", F.when(F.col("_first"), F.col(entity).cast("string")).otherwise(stable_id(prefix, F.col(viewport), F.col(entity), F.lit("rekey")))).drop("_first")


def with_logical_ids(entities: DataFrame, members: DataFrame) -> DataFrame:
    """The logical element of each entity's node, null for none; keys viewport_id, node_id."""
    return entities.join(members.select("viewport_id", "node_id", "element_id").dropDuplicates(["viewport_id", "node_id"]), ["viewport_id", "node_id"], "left")


def wide_nodes(nodes: DataFrame, boxes: DataFrame, styles: DataFrame, viewport: list[str], key: str = "node_id") -> DataFrame:
    """Nodes with their box and style, where they have one."""
    on = [*viewport, key]
    return nodes.join(boxes, on, "left").join(styles, on, "left")


def hotspots(sections: DataFrame) -> DataFrame:
    """(section_id, label, role, box, normalized): the root box, and each step that has one; normalised to the document's size, else the viewport's, null without any."""
    size = lambda d, v: F.when(F.col(d) > 0, F.col(d)).when(F.col(v) > 0, F.col(v))
    w, h = size("document_width", "viewport_width"), size("document_height", "viewport_height")
    root = F.struct(F.when(F.col("signature") != "", F.col("signature")).otherwise(F.col("category")).alias("label"), F.lit("section").alias("role"), F.col("root_box").alias("box"))
    steps = F.transform("steps", lambda s: F.struct(s["role"].alias("label"), s["role"].alias("role"), s["box"].alias("box")))
    flat = sections.select("section_id", w.alias("_w"), h.alias("_h"), F.explode(F.filter(F.concat(F.array(root), steps), lambda s: s["box"].isNotNull())).alias("s"))
    part = lambda f, of: (F.col(f"s.box.{f}") / F.col(of)).alias(f)
    inside = F.when(F.col("_w").isNotNull() & F.col("_h").isNotNull(), F.struct(part("x", "_w"), part("y", "_h"), part("width", "_w"), part("height", "_h")))
    return flat.select("section_id", "s.*", inside.alias("normalized"))


def findings(viewports: DataFrame, keys: list[str]) -> DataFrame:
    """Viewport coverage, responsive complexity and visual consistency (1 / distinct signatures) of a run, four decimals.

    `viewports` has has_ontology, has_visual, signature and transformations.
    """
    n = F.count(F.when(F.col("has_ontology") | F.col("has_visual"), 1))
    both, visual = F.count(F.when(F.col("has_ontology") & F.col("has_visual"), 1)), F.count(F.when(F.col("has_visual"), 1))
    kinds = F.count_distinct(F.when(F.col("has_visual"), F.col("signature")))
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 4)).otherwise(0.0)
    return viewports.groupBy(*keys).agg(ratio(both, n).alias("viewport_coverage"), F.sum("transformations").alias("responsive_complexity"), ratio(F.when(visual > 0, 1).otherwise(0), kinds).alias("visual_consistency"))


def semantic_inputs(hypotheses: DataFrame, entities: DataFrame) -> DataFrame:
    """Hypotheses and L3 entities as (source, source_id, viewport_id, confidence, method)."""
    row = lambda df, source, key: df.select(F.lit(source).alias("source"), F.col(key).alias("source_id"), "viewport_id", "confidence", "method")
    return row(hypotheses, "visual_language", "hypothesis_id").unionByName(row(entities.filter("layer = 'L3'"), "ontology", "entity_id"))


def filter_flows(graphs: DataFrame, action: str | None = None, scope: str | None = None, text: str | None = None, limit: int = 20) -> DataFrame:
    """flows (flow_id, title, notes, app_scope_id, action_ids) with an action, by id, label or alias, of a scope, that hold the text."""
    out, action = graphs, (action or "").strip().lower()
    if action and not action.startswith(PREFIX):
        action = next((PREFIX + i for i, label, aliases, _ in ACTIONS if action in label.lower() or any(action in a for a in aliases)), action)
    if scope and scope.strip():
        out = out.filter(F.col("app_scope_id") == scope.strip())
    if action:
        out = out.filter(F.exists("action_ids", lambda a: F.lower(a).contains(action)))
    if text and text.strip():
        out = out.filter(F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("notes", F.lit("")), "flow_id")).contains(text.strip().lower()))
    return out.orderBy("flow_id").limit(max(1, min(50, limit)))


def screen_media(screens: DataFrame, viewports: DataFrame, capture: str) -> DataFrame:
    """screens with the screenshot of their capture's best viewport: desktop, else the first by name; the settled one, else the full page."""
    best = latest(viewports, [capture], (F.col("name") == "desktop").desc(), F.col("name"))
    return screens.join(best.select(capture, F.coalesce("settled_path", "full_page_path").alias("image_ref")), capture, "left")


def subjects(parts: dict[str, DataFrame], capture: str, key: str, text: str) -> DataFrame:
    """(capture, kind, subject_id, content_text) of several sources; empty texts and repeated subjects are left out."""
    out = None
    for kind, rows in parts.items():
        some = rows.select(capture, F.lit(kind).alias("kind"), F.col(key).cast("string").alias("subject_id"), F.trim(text).alias("content_text"))
        out = some if out is None else out.unionByName(some)
    return latest(out.filter("content_text <> ''"), [capture, "kind", "subject_id"], F.col("content_text"))


def module_subjects(looks: DataFrame, categories: list[str], capture: str) -> DataFrame:
    """Looks of completed captures of module categories other than content and body, the first of each section."""
    category = F.lower(F.trim("category"))
    kept = looks.filter((F.col("status") == "complete") & category.isin(*[c for c in categories if c not in ("content", "body")]) & (F.trim("section_id") != ""))
    return latest(kept.withColumn("category", category), [capture, "section_id"], F.col("ordinal"))


def clean_labels(items: DataFrame, keys: list[str], caps: dict[str, int], *order: Column) -> DataFrame:
    """Labels (kind, name, confidence) without blank names, confidence in [0, 1], up to the cap of each kind in order."""
    limits = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    named = items.filter(F.col("kind").isin(*caps) & (F.trim("name") != "")).withColumn("name", F.trim("name"))
    named = named.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("confidence"), F.lit(0.5)))))
    rank = F.row_number().over(Window.partitionBy(*keys, "kind").orderBy(*order))
    return named.withColumn("rank", rank).filter(F.col("rank") <= limits[F.col("kind")])


def category_of(text: Column, categories: list[str], aliases: dict[str, str]) -> Column:
    """A category by its name, by an alias, else one that holds the text or is held by it, the first in order; null for none."""
    value, held = F.regexp_replace(F.lower(F.trim(text)), r"[\s-]+", "_"), F.lit(None).cast("string")
    for c in reversed(categories):
        held = F.when(value.contains(c) | (F.lit(c).contains(value) & (value != "")), c).otherwise(held)
    for alias, c in aliases.items():
        held = F.when(value == alias, c).otherwise(held)
    return F.when(value.isin(*categories), value).otherwise(held)


def flow_steps(items: DataFrame, keys: list[str]) -> DataFrame:
    """Page-flow items in the order of their steps; a step without a label is named by its name."""
    w = Window.partitionBy(*keys).orderBy(F.coalesce("step_index", F.lit(0)), "ordinal")
    return items.filter("kind = 'page_flow'").select(*keys, F.row_number().over(w).alias("step"), F.coalesce(F.when(F.col("label") != "", F.col("label")), F.col("name")).alias("label"))


def references_or(stored: DataFrame, derived: DataFrame, captures: DataFrame, capture: str) -> DataFrame:
    """A capture's stored references, else the derived ones, else one reference of its screen."""
    done = stored.withColumn("origin", F.lit("stored"))
    more = derived.join(stored.select(capture), capture, "left_anti").withColumn("origin", F.lit("derived"))
    rest = captures.select(capture).join(stored.select(capture), capture, "left_anti").join(derived.select(capture), capture, "left_anti")
    rest = rest.select(capture, F.concat(F.lit("screen_"), F.col(capture).cast("string")).alias("reference_id"), F.lit("synthetic").alias("origin"))
    return done.unionByName(more).unionByName(rest)


def palette(colors: DataFrame, viewport: list[str], most: int = 8) -> DataFrame:
    """(viewport, place, hex_rgb, role, occurrences): up to `most` colours by use, each with a role that depends on those before it.

    `colors` has hex, roles and occurrences; a fold over a viewport's colours remembers whether background and ink are
    taken. Without a background the darkest colour is it, without ink the lightest other one.
    """
    one = F.struct(F.col("hex"), F.col("roles"), F.col("occurrences"), alpha_of(F.col("hex")).alias("a"), luminance(F.col("hex")).alias("lum"), rgb_of(F.col("hex")).alias("rgb"))
    lists = colors.groupBy(*viewport).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("occurrences")).alias("_o"), "hex", one.alias("c")))), lambda s: s["c"]).alias("_c"))
    has = lambda c, r: F.array_contains(c["roles"], r)

    def role(s: Column, c: Column) -> Column:
        bg, fg, edge, a, lum = has(c, "background"), has(c, "foreground"), has(c, "border"), c["a"], c["lum"]
        return (
            F.when(a < 0.08, "transparent")
            .when(s["bg"].isNull() & bg & (lum < 0.25) & (a > 0.85), "bg")
            .when(s["ink"].isNull() & fg & (lum > 0.75) & (a > 0.85), "ink")
            .when(edge & ~bg & (lum > 0.35) & (lum < 0.85), "border")
            .when((lum > 0.15) & (lum < 0.85) & (a > 0.5) & (fg | bg), "accent")
            .when(a < 0.85, "muted")
            .when(s["bg"].isNull() & bg & (lum < 0.35), "bg")
            .when(s["ink"].isNull() & fg & (lum > 0.65), "ink")
            .when(edge, "border")
            .otherwise("muted")
        )

    start = F.struct(F.lit(None).cast("string").alias("bg"), F.lit(None).cast("string").alias("ink"), F.array().cast("array<struct<rgb:string,role:string,n:bigint,lum:double>>").alias("out"))

    def step(s: Column, c: Column) -> Column:
        r = role(s, c)
        full = (F.size(s["out"]) >= most) | (r == "transparent")
        again = F.exists(s["out"], lambda o: o["rgb"] == c["rgb"])
        item = F.array(F.struct(c["rgb"].alias("rgb"), r.alias("role"), c["occurrences"].cast("bigint").alias("n"), c["lum"].alias("lum")))
        return F.struct(
            F.when(~full & (r == "bg") & s["bg"].isNull(), c["rgb"]).otherwise(s["bg"]).alias("bg"),
            F.when(~full & (r == "ink") & s["ink"].isNull(), c["rgb"]).otherwise(s["ink"]).alias("ink"),
            F.when(full | again, s["out"]).otherwise(F.concat(s["out"], item)).alias("out"),
        )

    folded = lists.select(*viewport, F.aggregate("_c", start, step).alias("_s"))
    darkest = F.array_min(F.transform("_s.out", lambda o: F.struct(o["lum"], o["rgb"])))["rgb"]
    lightest = F.array_max(F.transform("_s.out", lambda o: F.struct(o["lum"], o["rgb"])))["rgb"]
    flat = folded.select(*viewport, "_s", darkest.alias("_d"), lightest.alias("_l"), F.posexplode("_s.out").alias("place", "o"))
    is_bg = F.col("_s.bg").isNull() & (F.col("o.rgb") == F.col("_d"))
    is_ink = F.col("_s.ink").isNull() & (F.col("o.rgb") == F.col("_l")) & ~is_bg & (F.col("o.role") != "bg")
    return flat.select(*viewport, "place", F.col("o.rgb").alias("hex_rgb"), F.when(is_bg, "bg").when(is_ink, "ink").otherwise(F.col("o.role")).alias("role"), F.col("o.n").alias("occurrences"))


def type_roles(typography: DataFrame, viewport: list[str]) -> DataFrame:
    """Body (most used), display (largest of four pixels above the body or more), emphasis (first of weight 600 or more), small (first below the body).

    `typography` has font_family, font_size, font_weight, line_height, occurrences.
    """
    size, weight = pixels(F.col("font_size")), F.coalesce(F.col("font_weight").try_cast("int"), F.lit(400))
    rows = typography.select(*viewport, "font_family", "line_height", "occurrences", size.alias("_px"), weight.alias("weight"))
    order = Window.partitionBy(*viewport).orderBy(F.col("occurrences").desc(), F.coalesce("_px", F.lit(0.0)).desc(), "font_family", "weight", "line_height")
    ranked = rows.withColumn("_rn", F.row_number().over(order))
    body = F.coalesce(F.max(F.when(F.col("_rn") == 1, F.col("_px"))).over(Window.partitionBy(*viewport)), F.lit(16.0))
    ranked = ranked.withColumn("_body", body)
    px = F.coalesce("_px", F.lit(0.0))

    def pick(role: str, when: Column, default: float, *by: Column) -> DataFrame:
        return latest(ranked.filter(when), viewport, *by, F.col("_rn")).select(*viewport, F.lit(role).alias("role"), "font_family", F.coalesce("_px", F.lit(default)).alias("size_px"), "weight", "occurrences")

    out = pick("body", F.col("_rn") == 1, 16.0).unionByName(pick("display", px >= F.col("_body") + 4, 24.0, px.desc()))
    out = out.unionByName(pick("emphasis", F.col("weight") >= 600, 16.0))
    return out.unionByName(pick("small", F.coalesce("_px", F.lit(99.0)) < F.col("_body"), 14.0))


def knowledge_graph(captures: DataFrame, viewports: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of sites, pages, runs, viewports and ontology entities.

    `captures` has capture_run_id, site_id, domain, page_id, route, status; `viewports` capture_run_id, viewport_id,
    name; `entities` viewport_id, entity_id, label, taxonomy_id, parent_entity_id. A node that several rows name is one.
    """
    node = lambda df, key, kind, label, **more: df.select(key.cast("string").alias("node_id"), F.lit(kind).alias("type"), label.cast("string").alias("label"), (F.create_map(*[x for k, v in more.items() for x in (F.lit(k), v.cast("string"))]) if more else F.create_map().cast("map<string,string>")).alias("properties"))
    view = F.concat(F.lit("viewport_"), F.col("viewport_id").cast("string"))
    nodes = node(captures, F.col("site_id"), "site", F.col("domain"))
    for more in (
        node(captures, F.col("page_id"), "page", F.col("route")),
        node(captures, F.col("capture_run_id"), "capture_run", F.col("capture_run_id"), status=F.col("status")),
        node(viewports, view, "viewport", F.col("name")),
        node(entities, F.col("entity_id"), "ontology_entity", F.col("label"), taxonomy_id=F.col("taxonomy_id")),
    ):
        nodes = nodes.unionByName(more)
    nodes = nodes.dropDuplicates(["node_id"])
    edge = lambda df, kind, a, b: df.select(F.lit(kind).alias("type"), a.cast("string").alias("from_id"), b.cast("string").alias("to_id"))
    edges = edge(captures, "contains", F.col("site_id"), F.col("page_id"))
    for more in (
        edge(captures, "captured_in", F.col("page_id"), F.col("capture_run_id")),
        edge(viewports, "observed_at", F.col("capture_run_id"), view),
        edge(entities, "observed_at", F.col("entity_id"), view),
        edge(entities.filter("parent_entity_id IS NOT NULL"), "contains", F.col("parent_entity_id"), F.col("entity_id")),
    ):
        edges = edges.unionByName(more)
    edges = edges.distinct()
    return nodes, edges.select(stable_id("kge", F.col("type"), F.col("from_id"), F.col("to_id")).alias("edge_id"), "type", "from_id", "to_id")


def delete_by_url(captures: DataFrame, urls: DataFrame, children: dict[str, DataFrame], key: str, url: str) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """(captures left, their victims, children left) after the deletion of all captures whose url identity is among `urls` (one column)."""
    asked = urls.select(capture_key(F.col(urls.columns[0])).alias("_asked")).filter("_asked <> ''").distinct()
    named = captures.withColumn("_key", capture_key(F.col(url)))
    gone = named.join(asked, F.col("_key") == F.col("_asked"), "left_semi").drop("_key")
    ids = gone.select(key)
    return named.join(asked, F.col("_key") == F.col("_asked"), "left_anti").drop("_key"), gone, {n: c.join(ids, key, "left_anti") for n, c in children.items()}


def design_export(viewports: DataFrame, sections: DataFrame, capture: str) -> DataFrame:
    """A json tree a capture: its viewports by name, each with its sections from top to bottom."""
    inner = sections.groupBy(capture, "viewport").agg(F.array_sort(F.collect_list(F.struct("y", "section_id", "category", "signature"))).alias("children"))
    frames = viewports.join(inner, [capture, "viewport"], "left").withColumn("children", F.coalesce("children", F.array().cast(inner.schema["children"].dataType)))
    return frames.groupBy(capture).agg(F.to_json(F.array_sort(F.collect_list(F.struct("viewport", "width", "children")))).alias("frames"))
