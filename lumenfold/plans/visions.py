"""Queries over looks and rhythms, from line items and from the bands of `plans.bands`."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import sections, visions
from lumenfold.plans.bands import _MERGED, _merged
from lumenfold.plans.base import query
from lumenfold.plans.layout import _SPINE, _sections

_LOOKS = """l AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id, CASE l_suppkey % 5 WHEN 0 THEN 'hero' WHEN 1 THEN 'social_proof' WHEN 2 THEN 'commerce' WHEN 3 THEN 'content' ELSE 'cookie_consent' END AS category,
CASE l_partkey % 4 WHEN 0 THEN 'body' WHEN 1 THEN 'media' WHEN 2 THEN 'heading>media' ELSE 'heading>body' END AS sig, 0.5 + l_discount * 4 AS sure, CASE l_returnflag WHEN 'A' THEN 'trusted by' WHEN 'N' THEN 'buy it' ELSE 'words' END AS said, CASE WHEN l_quantity > 10 THEN 'c' || l_partkey END AS path FROM lineitem)"""
_GATE = "CASE WHEN path IS NULL THEN 'no_crop' WHEN category = 'cookie_consent' THEN 'consent_overlay' WHEN sig IN ('media', 'body') THEN 'thin_signature' WHEN sure < 0.7 THEN 'low_confidence' WHEN category IN ('hero', 'commerce') THEN CASE WHEN sig LIKE '%media%' THEN 'high_value_media' ELSE 'high_value_category' END ELSE 'text_css_sufficient' END"


def _looks(t):
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    pick = lambda by, n, *values: F.element_at(F.array(*map(F.lit, values)), (F.col(by) % n + 1).cast("int"))
    n = F.row_number().over(order).cast("long")
    said = F.when(F.col("l_returnflag") == "A", "trusted by").when(F.col("l_returnflag") == "N", "buy it").otherwise("words")
    rows = t("lineitem").select(F.col("l_orderkey").alias("page"), n.alias("section_id"), n.alias("ordinal"), pick("l_suppkey", 5, "hero", "social_proof", "commerce", "content", "cookie_consent").alias("category"), pick("l_partkey", 4, "body", "media", "heading>media", "heading>body").alias("signature"), (0.5 + F.col("l_discount") * 4).alias("confidence"), said.alias("said"), F.when(F.col("l_quantity") > 10, F.concat(F.lit("c"), "l_partkey")).alias("path"))
    none = F.lit(None).cast("array<struct<role:string,notes:string>>")
    return rows.withColumns({"look_summary": F.concat(F.lit("look of "), "section_id"), "stack_summary": F.lit("stack"), "media_role": F.lit(None).cast("string"), "role_notes": none, "evidence_refs": F.array(F.lit("e"))})


@query("d29_settled_categories", f"WITH {_LOOKS} SELECT page, id AS section_id, CASE WHEN sig = 'body' AND (category = 'social_proof' AND said <> 'trusted by' OR category = 'commerce' AND said <> 'buy it') THEN 'content' ELSE category END AS category FROM l")
def _(t):
    return _looks(t).select("page", "section_id", visions.settled_category(F.col("category"), F.col("signature"), F.array("said")).alias("category"))


@query("d30_vision_gate", f"WITH {_LOOKS} SELECT page, id AS section_id, {_GATE} AS reason FROM l")
def _(t):
    looks = _looks(t)
    return looks.select("page", "section_id", visions.vision_gate(looks, F.col("path"))["reason"].alias("reason"))


@query("d36_gated_looks", f"WITH {_LOOKS}, g AS (SELECT *, {_GATE} AS reason FROM l) SELECT page, id AS section_id, reason AS gate_reason, row_number() OVER (PARTITION BY page ORDER BY id) AS rank FROM g WHERE reason IN ('thin_signature', 'low_confidence', 'high_value_media', 'high_value_category') QUALIFY rank <= 2")
def _(t):
    looks = _looks(t)
    crops = looks.filter("path IS NOT NULL").select("page", "section_id", "path")
    return visions.gated_looks(looks.drop("path"), crops, ["page"], 2).select("page", "section_id", "gate_reason", "rank")


@query("d31_merged_looks", f"""WITH {_LOOKS} SELECT page, id AS section_id, 'look of ' || id || CASE WHEN path IS NOT NULL AND id % 3 <> 0 THEN ' Vision: wide Media: ' || said ELSE '' END AS look_summary, CASE WHEN path IS NOT NULL AND id % 3 <> 0 THEN 'e,crop:' || path || ',vision_section' ELSE 'e' END AS refs,
round(CASE WHEN path IS NOT NULL AND id % 3 <> 0 THEN least(0.95::DOUBLE, greatest(sure, 0.8::DOUBLE) + 0.03::DOUBLE) ELSE sure END, 6) AS confidence FROM l""")
def _(t):
    looks = _looks(t)
    seen = looks.filter("path IS NOT NULL").select("page", "section_id", F.when(F.col("section_id") % 3 == 0, "failed").otherwise("complete").alias("status"), F.lit("wide").alias("composition"), F.lit("").alias("atmosphere"), F.col("said").alias("media_subject"), F.lit(None).cast("string").alias("overlay"), F.lit(None).cast("string").alias("cta_chrome"), F.col("path").alias("crop_path"), F.lit(0.8).alias("confidence"))
    out = visions.merge_visions(looks, seen, ["page"])
    return out.select("page", "section_id", "look_summary", F.array_join("evidence_refs", ",").alias("refs"), F.round("confidence", 6).alias("confidence"))


_AVOID = """concat_ws(';', CASE WHEN hero IS NOT NULL AND NOT contains(hero, 'grid') AND NOT contains(hero, 'card') THEN 'card grid in the hero;short marketing-kit banner instead of the measured opening' END, CASE WHEN above >= 0.28 THEN 'collapse the above-fold into a compact card row' END, CASE WHEN n >= 3 THEN 'single-column card kit for the whole page' END,
CASE WHEN nav AND hero IS NOT NULL THEN 'bury navigation inside the hero' END, CASE WHEN headline AND media THEN 'replace the cinematic opening with a text-only hero' END, CASE WHEN contains(page_arc, 'hero') AND contains(page_arc, 'feature') THEN 'feature grid inside the hero' END)"""


@query("d20_vision_rhythm", f"""WITH {_MERGED}, t AS (SELECT *, CASE WHEN height > 0 THEN floor(least(1.0::DOUBLE, height) * 1000 + 0.5) / 1000 ELSE 0 END AS h FROM g QUALIFY row_number() OVER (PARTITION BY page ORDER BY y, place) <= 10),
u AS (SELECT page, count(*) AS n, lower(first(label ORDER BY y, place) FILTER (category = 'hero')) AS hero, FALSE AS nav, coalesce(sum(h) FILTER (y < 0.2), 0) AS above, coalesce(bool_or(category = 'hero') FILTER (y < 0.2), FALSE) AS headline, coalesce(bool_or(category = 'hero') FILTER (y < 0.2), FALSE) AS media FROM t GROUP BY page),
a AS (SELECT page, string_agg(category, ' → ' ORDER BY y, place) AS page_arc FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY page, category ORDER BY y, place) = 1) GROUP BY page)
SELECT u.page, page_arc, CASE WHEN headline THEN 'media,headline' ELSE 'other' END AS ingredients, round(CASE WHEN above > 0 THEN floor(least(1.0::DOUBLE, above) * 1000 + 0.5) / 1000 END, 6) AS above_height, {_AVOID} AS avoid FROM u JOIN a ON a.page = u.page""")
def _(t):
    out = visions.vision_rhythm(_merged(t), ["page"])
    return out.select("page", "page_arc", F.array_join("ingredients", ",").alias("ingredients"), F.round("above_height", 6).alias("above_height"), F.array_join("avoid", ";").alias("avoid"))


@query("d20_spine_rhythm", f"""WITH {_SPINE}, firsts AS (SELECT viewport, category, min(band) AS first FROM e GROUP BY ALL), arcs AS (SELECT viewport, string_agg(category, ' → ' ORDER BY first) AS page_arc FROM firsts GROUP BY viewport), spans AS (SELECT viewport, greatest(max(y + height), 1) AS span FROM e GROUP BY viewport),
parts AS (SELECT e.*, floor(least(1.0::DOUBLE, height / span) * 1000 + 0.5) / 1000 AS h FROM e JOIN spans s ON s.viewport = e.viewport WHERE band <= 10) SELECT t.viewport, page_arc, count(*) AS bands, round(sum(h), 6) AS total FROM parts t JOIN arcs a ON a.viewport = t.viewport GROUP BY ALL""")
def _(t):
    spine = sections.spine(_sections(t), ["viewport"], F.lit(900.0))
    out = visions.spine_rhythm(spine, sections.spine_summary(spine, ["viewport"]), ["viewport"])
    total = F.aggregate("bands", F.lit(0.0), lambda n, b: n + b["height"])
    return out.select("viewport", "page_arc", F.size("bands").cast("long").alias("bands"), F.round(total, 6).alias("total"))
