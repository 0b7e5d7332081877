"""Visual language of viewports: colours, type, shape, imagery, motion.

`styles` has viewport columns, node_id and properties (a map of computed values).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.keys import half_up
from lumenfold.functions.looks import hex8, parse_rgb, pixels

ROLES = {"foreground": lambda p: p == "color", "background": lambda p: p.contains("background"), "border": lambda p: p.contains("border"), "vector": lambda p: p.rlike("fill|stroke")}


def color_usage(styles: DataFrame, viewport: list[str]) -> DataFrame:
    """(viewport, hex, occurrences, properties, nodes): colours of properties that end in color, fill or stroke."""
    flat = styles.select(*viewport, "node_id", F.explode("properties").alias("property", "value")).filter(F.col("property").rlike("(?i)(color|fill|stroke)$"))
    named = flat.withColumn("_c", parse_rgb(F.col("value"))).filter("_c IS NOT NULL").withColumn("hex", hex8(F.col("_c")))
    return named.groupBy(*viewport, "hex").agg(F.count(F.lit(1)).alias("occurrences"), F.array_sort(F.collect_set("property")).alias("properties"), F.count_distinct("node_id").alias("nodes"))


def color_roles(properties: Column) -> Column:
    """Roles of a colour from the properties that use it, the first that fits each; sorted."""
    role = F.lit(None).cast("string")

    def of(p: Column) -> Column:
        out = role
        for name, test in reversed(list(ROLES.items())):
            out = F.when(test(p), name).otherwise(out)
        return out

    return F.array_sort(F.array_distinct(F.filter(F.transform(properties, of), lambda r: r.isNotNull())))


TYPE = ("font-family", "font-size", "font-weight", "line-height", "letter-spacing")


def typography(styles: DataFrame, viewport: list[str]) -> DataFrame:
    """Occurrences of each combination of the five type properties; styles without a family are left out."""
    columns = [F.coalesce(F.col("properties")[p], F.lit("")).alias(p.replace("-", "_")) for p in TYPE]
    return styles.filter("coalesce(properties['font-family'], '') <> ''").groupBy(*viewport, *columns).agg(F.count(F.lit(1)).alias("occurrences"))


def shape_values(styles: DataFrame, viewport: list[str]) -> DataFrame:
    """Occurrences of radius, shadow and border width values other than none and 0px."""
    flat = styles.select(*viewport, F.explode("properties").alias("property", "value"))
    kind = F.when(F.col("property").contains("radius"), "radius").when(F.col("property") == "box-shadow", "shadow").when(F.col("property").rlike("border-.*-width"), "border_width")
    return flat.withColumn("kind", kind).filter("kind IS NOT NULL AND coalesce(value, '') NOT IN ('', 'none', '0px')").groupBy(*viewport, "kind", "value").agg(F.count(F.lit(1)).alias("occurrences"))


def imagery(assets: DataFrame, viewport: list[str]) -> DataFrame:
    """E5: assets by type, and how many have a size of their own: asset type, width, height."""
    kind = F.coalesce("type", F.lit("unknown")).alias("type")
    return assets.groupBy(*viewport, kind).agg(F.count(F.lit(1)).alias("total"), F.count(F.when((F.col("width") > 0) & (F.col("height") > 0), 1)).alias("intrinsic_dimensioned"))


def composition(boxes: DataFrame, viewport: list[str], width: str, height: str) -> DataFrame:
    """Part of the document that the boxes cover (overlaps count again), and its aspect; four decimals."""
    area = F.sum(F.greatest(F.lit(0.0), F.coalesce("width", F.lit(0.0))) * F.greatest(F.lit(0.0), F.coalesce("height", F.lit(0.0))))
    document = F.max(F.col(width) * F.col(height))
    return boxes.groupBy(*viewport).agg(F.round(area / F.greatest(F.lit(1.0), document), 4).alias("estimated_box_coverage"), F.round(F.max(width) / F.greatest(F.lit(1.0), F.max(height)), 4).alias("document_aspect_ratio"))


def motion(records: DataFrame, viewport: list[str]) -> DataFrame:
    """Total, declarations, runtime instances, those that a compositor runs, and animated properties."""
    source = F.coalesce("source", F.lit("unknown"))
    declared = F.count(F.when(source == "computed_css", 1))
    counts = records.groupBy(*viewport).agg(
        F.count(F.lit(1)).alias("total"),
        declared.alias("declarations"),
        (F.count(F.lit(1)) - declared).alias("runtime_instances"),
        F.count(F.when((source != "computed_css") & F.coalesce(F.col("compositor_friendly"), F.lit(False)), 1)).alias("compositor_friendly_runtime_instances"),
    )
    # a property once for each viewport, before any are gathered
    names = records.select(*viewport, F.explode("animated_properties").alias("_p")).groupBy(*viewport).agg(F.array_sort(F.collect_set("_p")).alias("animated_properties"))
    return counts.join(names, viewport, "left").withColumn("animated_properties", F.coalesce("animated_properties", F.array().cast("array<string>")))


def hypotheses(counts: DataFrame, viewport: list[str]) -> DataFrame:
    """Visual character and motion of a viewport, from colors, shapes and motions (counts)."""
    row = lambda when, category, value, sure: F.when(when, F.struct(F.lit(category).alias("category"), F.lit(value).alias("value"), F.lit(sure).alias("confidence")))
    rows = [
        row((F.col("colors") <= 4) & (F.col("shapes") <= 3), "visual_character", "restrained", 0.62),
        row((F.col("colors") >= 8) | (F.col("shapes") >= 7), "visual_character", "expressive", 0.62),
        row(F.col("motions") > 0, "motion_personality", "animated", 0.7),
        row(F.col("motions") == 0, "motion_personality", "static", 0.8),
    ]
    return counts.select(*viewport, F.explode(F.array_compact(F.array(*rows))).alias("h")).select(*viewport, "h.*")


def radius_scale(shapes: DataFrame, viewport: list[str]) -> DataFrame:
    """(viewport, role, value_px, occurrences): radii of 1 to 64 px, those within 1.5 px of a kept one joined to it, the four least as sm to xl; 50% and 100% as pill.

    Kept values are a fold over a viewport's sorted values, of which css gives few.
    """
    radii = shapes.filter("kind = 'radius'").withColumn("_px", pixels(F.col("value")))
    values = radii.filter("_px BETWEEN 1 AND 64").groupBy(*viewport).agg(F.array_sort(F.collect_list(F.struct(F.col("_px").alias("px"), F.col("occurrences").alias("n")))).alias("_v"))

    def step(kept: Column, v: Column) -> Column:
        near = F.filter(F.transform(kept, lambda k, i: F.when(F.abs(k["px"] - v["px"]) < 1.5, i)), lambda i: i.isNotNull())
        joined = F.transform(kept, lambda k, i: F.struct(k["px"].alias("px"), F.when(i == F.get(near, F.lit(0)), k["n"] + v["n"]).otherwise(k["n"]).alias("n")))
        return F.when(F.size(near) > 0, joined).otherwise(F.concat(kept, F.array(F.struct(half_up(v["px"]).cast("double").alias("px"), v["n"].alias("n")))))

    kept = F.slice(F.aggregate("_v", F.slice(F.col("_v"), 1, 0), step), 1, 4)
    names = F.array(*[F.lit(r) for r in ("sm", "md", "lg", "xl")])
    scale = values.select(*viewport, F.posexplode(kept).alias("_i", "_k")).select(*viewport, F.get(names, F.col("_i")).alias("role"), F.col("_k.px").alias("value_px"), F.col("_k.n").alias("occurrences"))
    pill = radii.filter("value IN ('50%', '100%')").groupBy(*viewport).agg(F.max_by("occurrences", F.struct("occurrences", "value")).alias("occurrences"))
    return scale.unionByName(pill.select(*viewport, F.lit("pill").alias("role"), F.lit(999.0).alias("value_px"), "occurrences"))
