"""Geometry of boxes: sibling pairs, spacing, alignment, containers, and changes between viewports.

Boxes have the columns of `group` (viewport and parent), ordinal (their place in the document), x, y, width, height.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.keys import half_up
from lumenfold.functions.looks import track_count

BOX = ("x", "y", "width", "height")
#: Height or width of a band: siblings are compared only with those of a band that both lie in.
BAND = 512.0


def _over(at: str, size: str) -> Column:
    return F.least(F.col(f"{at}_a") + F.col(f"{size}_a"), F.col(f"{at}_b") + F.col(f"{size}_b")) - F.greatest(f"{at}_a", f"{at}_b")


def _in_bands(boxes: DataFrame, at: str, size: str, band: float) -> DataFrame:
    first, last = F.floor(F.col(at) / band), F.floor((F.col(at) + F.greatest(F.lit(0.0), F.col(size))) / band)
    return boxes.withColumn("_band", F.explode(F.sequence(first, last)))


def sibling_pairs(boxes: DataFrame, group: list[str], axis: str = "x", band: float = BAND) -> DataFrame:
    """Pairs a < b of a parent's boxes that overlap on `axis`, once each.

    The join is on the parent and a band of that axis, and a pair is kept in the first band that both lie in, so far
    apart children of a large parent never meet.
    """
    at, size = ("x", "width") if axis == "x" else ("y", "height")
    cut = _in_bands(boxes, at, size, band)
    side = lambda s: cut.select(*group, "_band", *[F.col(c).alias(f"{c}_{s}") for c in ("ordinal", *BOX)])
    pairs = side("a").join(side("b"), [*group, "_band"]).filter("ordinal_a < ordinal_b").filter(_over(at, size) > 0)
    return pairs.filter(F.col("_band") == F.floor(F.greatest(f"{at}_a", f"{at}_b") / band)).drop("_band")


def spacing_scale(boxes: DataFrame, group: list[str], viewport: list[str], most: float = 512) -> DataFrame:
    """Gaps between siblings that share a row (horizontal) or a column (vertical), to half a pixel, with counts of two or more.

    One scale for each viewport. Boxes without an area are left out.
    """
    seen = boxes.filter("width > 0 AND height > 0")

    def gaps(axis: str, at: str, size: str, direction: str) -> DataFrame:
        gap = F.greatest(F.col(f"{at}_a"), F.col(f"{at}_b")) - F.when(F.col(f"{at}_a") <= F.col(f"{at}_b"), F.col(f"{at}_a") + F.col(f"{size}_a")).otherwise(F.col(f"{at}_b") + F.col(f"{size}_b"))
        return sibling_pairs(seen, group, axis).select(*viewport, gap.alias("gap"), F.lit(direction).alias("direction"))

    flat = gaps("x", "y", "height", "vertical").unionByName(gaps("y", "x", "width", "horizontal")).filter(F.col("gap").between(0, most))
    return flat.groupBy(*viewport, (half_up(F.col("gap") * 2) / 2).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("direction")), ",").alias("directions")).filter("n >= 2")


def relations(boxes: DataFrame, group: list[str]) -> DataFrame:
    """C14: overlaps, left_of or above for siblings that overlap on an axis at least; from is the nearer one, gap or overlap to three decimals."""
    x, y = F.round(_over("x", "width"), 3), F.round(_over("y", "height"), 3)

    def rows(pairs: DataFrame, name: str, first: Column, gap: Column, over_x: Column, over_y: Column) -> DataFrame:
        pick = lambda yes, no: F.when(first, F.col(yes)).otherwise(F.col(no))
        return pairs.select(*group, pick("ordinal_a", "ordinal_b").alias("from_ordinal"), pick("ordinal_b", "ordinal_a").alias("to_ordinal"), F.lit(name).alias("relation"), gap.alias("gap"), over_x.alias("overlap_width"), over_y.alias("overlap_height"))

    none = F.lit(None).cast("double")
    in_column, in_row = sibling_pairs(boxes, group, "x"), sibling_pairs(boxes, group, "y")
    both = rows(in_column.filter(_over("y", "height") > 0), "overlaps", F.lit(True), none, x, y)
    left = rows(in_row.filter(_over("x", "width") <= 0), "left_of", F.col("x_a") <= F.col("x_b"), F.round(-_over("x", "width"), 3) + 0.0, none, none)
    above = rows(in_column.filter(_over("y", "height") <= 0), "above", F.col("y_a") <= F.col("y_b"), F.round(-_over("y", "height"), 3) + 0.0, none, none)
    return both.unionByName(left).unionByName(above)


#: The six edges that boxes align on.
EDGES = {("x", "start"): "x", ("x", "center"): "x + width / 2", ("x", "end"): "x + width", ("y", "start"): "y", ("y", "center"): "y + height / 2", ("y", "end"): "y + height"}


def _cluster(group: list[str], within: float, parts: dict[int, list]):
    """Rows sorted by group and coordinate; one pass that holds the open clusters of one group.

    The mean of a cluster moves by new, greater values only, so one that lies further back than the reach stays closed.
    Where `parts` are given, the group's last column is a number that stands for some columns.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, done, live = None, [], []  # a cluster: sum, count, ids

        def close(some: list) -> None:
            named = (*key[:-1], *parts[key[-1]]) if parts and key else key
            done.extend((*named, float(int((s / n * 2 + 0.5) // 1) / 2), n, ids) for s, n, ids in some if n >= 2)

        for pdf in batches:
            for *now, value, one in zip(*(pdf[c].tolist() for c in pdf.columns)):
                if now != key:
                    close(live)
                    key, live = now, []
                elif live:
                    over = [c for c in live if value - c[0] / c[1] > within]
                    if over:
                        close(over)
                        live = [c for c in live if value - c[0] / c[1] <= within]
                # equal values may part where the first of them moves the mean, so they join one by one
                for c in live:
                    if abs(c[0] / c[1] - value) <= within:
                        c[0], c[1] = c[0] + value, c[1] + 1
                        c[2].append(one)
                        break
                else:
                    live.append([value, 1, [one]])
            yield pd.DataFrame(done, columns=[*group, "center", "n", "ids"])
            done.clear()
        close(live)
        yield pd.DataFrame(done, columns=[*group, "center", "n", "ids"])

    return run


def _clustered(rows: DataFrame, sort: list[str], names: list[str], kinds: str, id_type: str, within: float, parts: dict[int, list] | None = None) -> DataFrame:
    """Clusters of rows (group, _v, _id) that are dealt by a part of their group: sorted where they are, and read in one pass."""
    return rows.sortWithinPartitions(*sort, "_v", "_id").select(*sort, "_v", "_id").mapInPandas(_cluster(names, within, parts or {}), f"{kinds}, center double, n long, ids array<{id_type}>")


def clusters_1d(values: DataFrame, group: list[str], value: str, id_col: str, within: float = 2.0) -> DataFrame:
    """Ascending values join the earliest cluster whose running mean is within reach; clusters of two or more, with their ids.

    center is rounded to half a pixel. Equal values join in the order of their ids. One shuffle, none where `values` are
    dealt by the group already.
    """
    kinds = ", ".join(f"{c} {values.schema[c].dataType.simpleString()}" for c in group)
    rows = values.filter(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v"), F.col(id_col).alias("_id"))
    return _clustered(rows.repartition(*group), group, group, kinds, values.schema[id_col].dataType.simpleString(), within)


def alignment_groups(boxes: DataFrame, viewport: list[str], id_col: str = "ordinal", within: float = 2.0, edges: list[tuple[str, str]] | None = None) -> DataFrame:
    """Clusters on the six edges of a viewport's boxes with an area, or on some `edges`: axis, edge, center, n, ids.

    Boxes are shuffled once, by viewport, not at all where they are dealt by it already, and before each of them becomes
    a row an edge; an edge's name is a number until its clusters are there.
    """
    asked = dict(enumerate(edges or EDGES))
    at = F.array(*[F.struct(F.lit(i).alias("_edge"), F.expr(EDGES[e]).cast("double").alias("_v")) for i, e in asked.items()])
    seen = boxes.filter("width > 0 AND height > 0").repartition(*viewport)
    flat = seen.select(*viewport, F.col(id_col).alias("_id"), F.explode(at).alias("_e")).select(*viewport, "_e._edge", "_e._v", "_id").filter("_v IS NOT NULL")
    kinds = ", ".join([*[f"{c} {boxes.schema[c].dataType.simpleString()}" for c in viewport], "axis string", "edge string"])
    return _clustered(flat, [*viewport, "_edge"], [*viewport, "axis", "edge"], kinds, boxes.schema[id_col].dataType.simpleString(), within, {i: list(e) for i, e in asked.items()})


def aligned_edges(groups: DataFrame, viewport: list[str]) -> DataFrame:
    """From the first member of an alignment group to each other one."""
    return groups.select(*viewport, "axis", "edge", F.col("center").alias("coordinate"), F.col("ids")[0].alias("from_id"), F.explode(F.slice("ids", 2, 1 << 30)).alias("to_id"))


def probable_grid(groups: DataFrame, boxes: DataFrame, viewport: list[str]) -> DataFrame:
    """Viewports with two left-edge clusters or more: column_count, column_starts, confidence."""
    total = boxes.filter("width > 0 AND height > 0").groupBy(*viewport).agg(F.count(F.lit(1)).alias("_boxes"))
    left = groups.filter("axis = 'x' AND edge = 'start'").groupBy(*viewport).agg(F.count(F.lit(1)).alias("column_count"), F.array_sort(F.collect_list("center")).alias("column_starts"), F.sum("n").alias("_in"))
    sure = F.round(F.least(F.lit(0.95), 0.55 + F.col("_in") / F.greatest(F.lit(1), F.col("_boxes")) * 0.4), 4)
    return left.filter("column_count >= 2").join(total, viewport).select(*viewport, "column_count", "column_starts", sure.alias("confidence"))


def layout_containers(nodes: DataFrame, viewport: list[str]) -> DataFrame:
    """Rendered flex and grid nodes with rendered children that have boxes.

    `nodes` has node_id, parent_id, ordinal, rendered, has_box and style (a map). Children are listed in document order.
    """
    seen = nodes.filter("rendered AND has_box")
    display = F.coalesce(F.col("style")["display"], F.lit("block"))
    mode = F.when(display.contains("grid"), "grid").when(display.contains("flex"), "flex")
    boxes = seen.withColumn("mode", mode).filter("mode IS NOT NULL").select(*viewport, "node_id", "mode", "style")
    children = seen.filter("parent_id IS NOT NULL").groupBy(*viewport, F.col("parent_id").alias("node_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "node_id"))), lambda c: c["node_id"]).alias("child_ids"))
    some = lambda n: F.when(F.col("style")[n] != "", F.col("style")[n])
    return boxes.join(children, [*viewport, "node_id"]).select(
        *viewport,
        "node_id",
        "mode",
        "child_ids",
        F.when(F.col("mode") == "grid", track_count(F.col("style")["grid-template-columns"])).alias("columns"),
        F.when(F.col("mode") == "grid", track_count(F.col("style")["grid-template-rows"])).alias("rows"),
        F.when(F.col("mode") == "flex", F.coalesce(F.col("style")["flex-direction"], F.lit("row"))).alias("direction"),
        F.coalesce(some("gap"), some("row-gap"), some("column-gap")).alias("gap"),
    )


def adjacent_pairs(viewports: DataFrame, members: DataFrame, capture: list[str]) -> DataFrame:
    """Members of an element in viewports that are next to each other by width, as structs a and b.

    `viewports` has viewport_id, width, height, document_height; `members` has element_id, viewport_id and what is compared.
    """
    w = Window.partitionBy(*capture).orderBy("width", "viewport_id")
    steps = viewports.withColumn("_to", F.lead(F.struct("viewport_id", "width", "height", "document_height")).over(w)).filter("_to IS NOT NULL")
    steps = steps.select(*capture, F.struct("viewport_id", "width", "height", "document_height").alias("from_vp"), F.col("_to").alias("to_vp"))
    rest = [c for c in members.columns if c not in (*capture, "element_id", "viewport_id")]
    side = lambda s, vp: members.select(*capture, "element_id", F.col("viewport_id").alias(f"_{vp}"), F.struct(*rest).alias(s))
    pairs = steps.withColumn("_from", F.col("from_vp.viewport_id")).join(side("a", "from"), [*capture, "_from"])
    return pairs.withColumn("_to", F.col("to_vp.viewport_id")).join(side("b", "to"), [*capture, "element_id", "_to"]).drop("_from", "_to")


#: Properties that make a layout mode.
LAYOUT_PROPERTIES = ("display", "flex-direction", "flex-wrap", "grid-auto-flow")


def transformations(pairs: DataFrame, capture: list[str]) -> DataFrame:
    """A row for each way in which an element differs between two viewports: type, evidence (a map of text), confidence.

    a and b hold rendered, sibling_index, style (a map) and box (a struct or null). One pass, no shuffle.
    """
    a, b, text = F.col("a"), F.col("b"), lambda c: c.cast("string")
    row = lambda when, kind, sure, **facts: F.when(when, F.struct(F.lit(kind).alias("type") if isinstance(kind, str) else kind.alias("type"), F.create_map(*[x for k, v in facts.items() for x in (F.lit(k), text(v))]).alias("evidence"), F.lit(sure).cast("double").alias("confidence")))

    def change(side: str, of: str, least: float | None = None) -> Column:
        """Difference of the parts of the viewport; of one size, the difference is taken before it is divided, so that a limit isn't missed by a fraction's noise."""
        was, now = (F.col(vp)[of] if least is None else F.greatest(F.lit(least), F.col(vp)[of]) for vp in ("from_vp", "to_vp"))
        return F.when(was == now, (b["box"][side] - a["box"][side]) / was).otherwise(b["box"][side] / now - a["box"][side] / was)

    w, h, x, y = change("width", "width"), change("height", "height"), change("x", "width"), change("y", "document_height", 1.0)
    measured = a["box"].isNotNull() & b["box"].isNotNull() & a["rendered"] & b["rendered"]
    order = lambda s: F.coalesce(s["style"]["order"], F.lit("0"))
    changed = F.array_compact(F.array(*[F.when(~a["style"][p].eqNullSafe(b["style"][p]), F.struct(F.lit(p).alias("k"), F.concat_ws(" to ", F.coalesce(a["style"][p], F.lit("")), F.coalesce(b["style"][p], F.lit(""))).alias("v"))) for p in LAYOUT_PROPERTIES]))
    tracks = [track_count(s["style"]["grid-template-columns"]) for s in (a, b)]
    changed = F.concat(changed, F.when(tracks[0] != tracks[1], F.array(F.struct(F.lit("grid-column-count").alias("k"), F.concat_ws(" to ", text(tracks[0]), text(tracks[1])).alias("v")))).otherwise(F.array().cast("array<struct<k:string,v:string>>")))
    r = lambda c: F.round(c * 10_000) / 10_000  # noqa: E731  as the SQL rounds: the product, not the number's shortest text
    rows = F.array_compact(
        F.array(
            row(a["rendered"] != b["rendered"], F.when(b["rendered"], "show").otherwise("hide"), 1, from_rendered=a["rendered"], to_rendered=b["rendered"]),
            row(a["sibling_index"] != b["sibling_index"], "reorder", 0.95, from_sibling_index=a["sibling_index"], to_sibling_index=b["sibling_index"]),
            row(order(a) != order(b), "reorder", 1, from_css_order=order(a), to_css_order=order(b)),
            row(measured & ((F.abs(w) >= 0.05) | (F.abs(h) >= 0.05)), "resize", 0.92, width=r(w), height=r(h)),
            row(measured & ((F.abs(x) >= 0.05) | (F.abs(y) >= 0.08)), "move", 0.88, x=r(x), y=r(y)),
            F.when(F.size(changed) > 0, F.struct(F.lit("layout_mode_change").alias("type"), F.map_from_entries(changed).alias("evidence"), F.lit(1.0).alias("confidence"))),
        )
    )
    return pairs.select(*capture, "element_id", F.col("from_vp.viewport_id").alias("from_viewport"), F.col("to_vp.viewport_id").alias("to_viewport"), F.explode(rows).alias("t")).select(*capture, "element_id", "from_viewport", "to_viewport", "t.*")


def responsive_graph(changes: DataFrame, capture: list[str], *order: Column) -> DataFrame:
    """Edge ids by place within a capture."""
    w = Window.partitionBy(*capture).orderBy(*order)
    return changes.withColumn("edge_id", F.format_string("rgr_%06d", F.row_number().over(w)))


#: Attributes that name an element, in this order; those that support a place in the document.
STRONG, SUPPORTING = ("id", "data-testid", "data-test", "name"), ("aria-label", "role", "href")


def fingerprints(nodes: DataFrame) -> DataFrame:
    """`nodes` (node_type, tag, anchor, dom_path, text) with fingerprint, method and confidence; without one, left out."""
    named = [F.when(F.trim(F.col("anchor")[n]) != "", F.concat(F.col("tag"), F.lit(f"|{n}:"), F.trim(F.col("anchor")[n]))) for n in STRONG]
    support = F.array_compact(F.array(*[F.when(F.col("anchor")[n] != "", F.concat(F.lit(f"{n}:"), F.col("anchor")[n])) for n in SUPPORTING]))
    text = F.substring(F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))), 1, 160)
    path = F.when(F.col("dom_path") != "", F.col("dom_path"))
    row = lambda value, method, sure: F.when(value.isNotNull(), F.struct(value.alias("fingerprint"), F.lit(method).alias("method"), F.lit(sure).alias("confidence")))
    placed = F.when((text != "") | (F.size(support) > 0), F.concat(F.col("tag"), F.lit("|"), path, F.lit("|"), F.array_join(support, "|"), F.lit("|"), text))
    found = F.coalesce(row(F.coalesce(*named), "stable_anchor", 0.98), row(placed, "structure_and_text", 0.9), row(F.concat(F.col("tag"), F.lit("|"), path), "structure", 0.8))
    return nodes.filter("node_type = 'element' AND tag <> ''").withColumn("_f", found).filter("_f IS NOT NULL").select(*nodes.columns, "_f.*")


def logical_elements(nodes: DataFrame, capture: list[str]) -> DataFrame:
    """Elements that two viewports or more share: element_id, method, confidence, members (viewport_id, node_id).

    Of a viewport's nodes with one fingerprint the first in document order (ordinal) is the member.
    """
    first = fingerprints(nodes).groupBy(*capture, "fingerprint", "viewport_id").agg(F.min(F.struct("ordinal", "node_id", "method", "confidence")).alias("_m"))
    groups = first.groupBy(*capture, "fingerprint").agg(F.array_sort(F.collect_list(F.struct("viewport_id", F.col("_m.node_id").alias("node_id")))).alias("members"), F.min("_m.method").alias("method"), F.min("_m.confidence").alias("confidence"))
    named = groups.filter(F.size("members") >= 2)
    return named.select(*capture, F.concat(F.lit("lel_"), F.substring(F.sha2(F.concat_ws("|", *capture, "fingerprint"), 256), 1, 20)).alias("element_id"), "method", "confidence", F.sha2("fingerprint", 256).alias("fingerprint_hash"), "members")
