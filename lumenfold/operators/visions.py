"""What vision adds to the looks of sections, and the rhythm of a page from its bands.

Looks have section_id, ordinal, category, signature, confidence, stack_summary, look_summary, text_signals, media_role,
role_notes (array of role and notes) and evidence_refs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.keys import bound, clip, is_consent_section, is_consent_text

#: What a thin section has to speak of to be social proof, or to sell.
SOCIAL_CUE = "testimonial|review|customer|kunde|quote|trusted by|as seen|logo marquee|partner"
SHOP_CUE = r"price|pricing|plan|€|\$|cart|shop|buy|kaufen|warenkorb|commerce"
#: Sections of a capture that vision looks at; confidence below which it does; categories that are worth it.
MOST_VISIONS, UNSURE, WORTH = 8, 0.7, "hero|feature|conversion|commerce"
#: Gain of confidence, its greatest value, characters of a summary and of a note, references and notes that are kept.
GAIN, MOST_SURE, MOST_LOOK, MOST_NOTE, MOST_REFS, MOST_NOTES = 0.03, 0.95, 900, 220, 16, 10
#: Bands of a rhythm, ends of its zones, height above the fold that is an opening.
MOST_RHYTHM, FOLD, MIDDLE, OPENING = 10, 0.2, 0.55, 0.28

_NOTES = "array<struct<role:string,notes:string>>"


def settled_category(category: Column, signature: Column, texts: Column) -> Column:
    """Thin social proof or commerce that speaks of neither is content; `texts` is an array."""
    said, thin = F.lower(F.array_join(texts, " ")), signature.isin("body", "unknown")
    quiet = ((category == "social_proof") & ~said.rlike(SOCIAL_CUE)) | (category.isin("commerce", "conversion") & ~said.rlike(SHOP_CUE))
    return F.when(F.coalesce(thin & quiet, F.lit(False)), "content").otherwise(category)


def vision_gate(looks: DataFrame, crop: Column) -> Column:
    """Struct (ok, reason) of a look whose crop has the path `crop`: vision runs where a look is thin, unsure or worth it."""
    said = F.concat(F.array("signature", "look_summary", "stack_summary"), F.transform(F.coalesce("role_notes", F.array().cast(_NOTES)), lambda n: n["notes"]))
    consent = is_consent_section(F.lit(""), F.coalesce("category", F.lit("")), F.array_compact(said))
    sig, worth = F.lower(F.coalesce("signature", F.lit(""))), F.coalesce(F.lower("category").rlike(WORTH), F.lit(False))
    media = sig.contains("media") | F.coalesce(F.col("media_role").isin("hero", "background", "inline"), F.lit(False))
    row = lambda ok, reason: F.struct(F.lit(ok).alias("ok"), F.lit(reason).alias("reason"))
    return (
        F.when(F.coalesce(crop, F.lit("")) == "", row(False, "no_crop")).when(consent, row(False, "consent_overlay")).when(sig.isin("media", "body", "unknown", "media_large"), row(True, "thin_signature"))
        .when(F.col("confidence") < UNSURE, row(True, "low_confidence")).when(worth & media, row(True, "high_value_media")).when(worth, row(True, "high_value_category")).otherwise(row(False, "text_css_sufficient"))
    )


def gated_looks(looks: DataFrame, crops: DataFrame, keys: list[str], most: int = MOST_VISIONS) -> DataFrame:
    """(look columns, path, gate_reason, rank): the first eight looks of a capture, in their order, that pass the gate."""
    rows = looks.join(crops.select(*keys, "section_id", "path"), [*keys, "section_id"], "left")
    rows = rows.withColumn("_g", vision_gate(looks, F.col("path"))).filter("_g.ok")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("ordinal", "section_id")).cast("long")
    return rows.withColumns({"gate_reason": F.col("_g.reason"), "rank": rank}).drop("_g").filter(F.col("rank") <= most)


def settled_visions(visions: DataFrame) -> DataFrame:
    """Complete results that show a consent overlay are skipped, with the reason; `visions` has status, gate_reason, visible_text (array), cta_chrome, composition, media_subject."""
    said = F.concat(F.coalesce("visible_text", F.array().cast("array<string>")), F.array("cta_chrome", "composition", "media_subject"))
    shown = (F.col("status") == "complete") & F.exists(F.array_compact(said), is_consent_text)
    return visions.withColumns({"status": F.when(shown, "skipped").otherwise(F.col("status")), "gate_reason": F.when(shown, "consent_overlay_vision").otherwise(F.col("gate_reason"))})


def merge_visions(looks: DataFrame, visions: DataFrame, keys: list[str]) -> DataFrame:
    """Looks with what a complete vision of their section saw in look_summary, role_notes, evidence_refs and confidence; others as they are.

    `visions` has keys, section_id, status, composition, atmosphere, media_subject, overlay, cta_chrome, crop_path, confidence.
    """
    fields = ("composition", "atmosphere", "media_subject", "overlay", "cta_chrome", "crop_path", F.col("confidence").alias("sure"))
    seen = visions.filter("status = 'complete'").select(*keys, "section_id", F.struct(*fields).alias("_v"))
    rows = looks.join(seen, [*keys, "section_id"], "left")
    v = lambda n: F.when(F.col(f"_v.{n}") != "", F.col(f"_v.{n}"))
    labelled = lambda label, n: F.concat(F.lit(label + ": "), v(n))
    sentence = F.trim(F.concat_ws(" ", v("composition"), labelled("Atmosphere", "atmosphere"), labelled("Media", "media_subject"), labelled("Overlay", "overlay"), labelled("CTA", "cta_chrome")))
    note = lambda role, n: F.when(v(n).isNotNull(), F.struct(F.lit(role).alias("role"), F.substring(F.concat(F.lit("vision:"), v(n)), 1, MOST_NOTE).alias("notes")))
    notes = F.concat(F.coalesce("role_notes", F.array().cast(_NOTES)), F.array_compact(F.array(note("media", "media_subject"), note("cta", "cta_chrome"))))
    refs = F.concat(F.coalesce("evidence_refs", F.array().cast("array<string>")), F.array_compact(F.array(F.concat(F.lit("crop:"), v("crop_path")))), F.array(F.lit("vision_section")))
    surer = F.least(F.lit(MOST_SURE), F.greatest(F.col("confidence"), F.coalesce("_v.sure", "confidence")) + GAIN)
    new = {
        "look_summary": F.when(sentence != "", F.substring(F.concat("look_summary", F.lit(" Vision: "), sentence), 1, MOST_LOOK)).otherwise(F.col("look_summary")),
        "role_notes": F.slice(notes, 1, MOST_NOTES), "evidence_refs": F.slice(refs, 1, MOST_REFS), "confidence": surer,
    }
    has = F.col("_v").isNotNull()
    return rows.withColumns({n: F.when(has, c).otherwise(F.col(n)) for n, c in new.items()}).select(*looks.columns)


def _part(x: Column) -> Column:
    return F.when(x > 0, F.floor(F.least(F.lit(1.0), x) * 1000 + 0.5) / 1000).otherwise(0.0)


def _avoided(bands: Column, arc: Column, above: Column, ingredients: Column) -> Column:
    """What a page must not become, by its bands (zone, category, signature, height); texts are fixed values."""
    has = lambda c: F.exists(bands, lambda b: b["category"] == c)
    hero = F.lower(F.coalesce(F.filter(bands, lambda b: b["category"] == "hero")[0]["signature"], F.lit("")))
    plain = has("hero") & ~hero.contains("grid") & ~hero.contains("card")
    rules = [
        (plain, "card grid in the hero"), (plain, "short marketing-kit banner instead of the measured opening"), (above >= OPENING, "collapse the above-fold into a compact card row"), (F.size(bands) >= 3, "single-column card kit for the whole page"),
        (has("nav") & has("hero"), "bury navigation inside the hero"), (has("footer"), "omit a distinct footer band"), (F.array_contains(ingredients, "media") & F.array_contains(ingredients, "headline"), "replace the cinematic opening with a text-only hero"), (arc.contains("hero") & arc.contains("feature"), "feature grid inside the hero"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), text) for when, text in rules]))


def _rhythm(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, page_arc, ingredients, summary, above_height, bands, avoid of pages with _bands, page_arc, ingredients and summary."""
    above = F.aggregate(F.filter("_bands", lambda b: b["zone"] == "above_fold"), F.lit(0.0), lambda n, b: n + b["height"])
    rows = pages.withColumn("_above", above)
    return rows.select(*keys, "page_arc", "ingredients", F.coalesce(clip(F.col("summary"), 120), F.lit("unknown")).alias("summary"), F.when(F.col("_above") > 0, _part(F.col("_above"))).alias("above_height"), F.col("_bands").alias("bands"), _avoided(F.col("_bands"), F.col("page_arc"), F.col("_above"), F.col("ingredients")).alias("avoid"))


def spine_rhythm(bands: DataFrame, summaries: DataFrame, keys: list[str], most: int = MOST_RHYTHM) -> DataFrame:
    """The rhythm of pages from their spine (D19) and its summary; heights are parts of the span of its bands, twelve at most."""
    row = F.struct("band", "zone", "category", F.substring("signature", 1, 48).alias("signature"), "height")
    lists = bands.groupBy(*keys).agg(F.greatest(F.max(F.col("y") + F.col("height")), F.lit(1.0)).alias("_span"), F.array_sort(F.collect_list(row)).alias("_all"))
    span = F.col("_span")
    cut = F.transform(F.slice("_all", 1, most), lambda b: F.struct(b["zone"].alias("zone"), b["category"].alias("category"), b["signature"].alias("signature"), _part(b["height"] / span).alias("height")))
    return _rhythm(lists.select(*keys, cut.alias("_bands")).join(summaries, keys), keys)


def vision_rhythm(bands: DataFrame, keys: list[str], most: int = MOST_RHYTHM) -> DataFrame:
    """The rhythm of pages without a spine, from the bands that vision saw (D23, D24), twelve at most."""
    zone = F.when(F.col("y") < FOLD, "above_fold").when(F.col("y") < MIDDLE, "mid").otherwise("below")
    row = F.struct("y", "place", zone.alias("zone"), "category", clip(F.col("label"), 48).alias("signature"), _part(F.col("height")).alias("height"))
    lists = bands.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(row)), 1, most).alias("_all"))
    rows = lists.select(*keys, F.transform("_all", lambda b: F.struct(b["zone"].alias("zone"), b["category"].alias("category"), b["signature"].alias("signature"), b["height"].alias("height"))).alias("_bands"))
    top = F.filter("_bands", lambda b: b["zone"] == "above_fold")
    kinds = lambda a: F.transform(a, lambda b: b["category"])

    def ingredients(a: Column) -> Column:
        has = lambda c: F.exists(a, lambda b: b["category"] == c)
        shown = F.exists(a, lambda b: (b["category"] == "hero") | F.coalesce(F.lower(b["signature"]).contains("media"), F.lit(False)))
        some = F.array_compact(F.array(F.when(has("nav"), "chrome"), F.when(shown, "media"), F.when(has("hero"), "headline")))
        return bound(some, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit("other"))))

    summary = F.when(F.size(top) > 0, F.array_join(kinds(top), " → ")).otherwise(F.col("_bands")[0]["category"])
    arc = F.array_join(F.slice(F.array_distinct(kinds(F.col("_bands"))), 1, 8), " → ")
    return _rhythm(rows.withColumns({"page_arc": arc, "ingredients": bound(top, ingredients), "summary": summary}), keys)
