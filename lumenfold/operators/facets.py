"""Facets of a page: terms of closed vocabularies from what a vision model wrote, a prose summary of it, and the way back.

A page has the text columns page_type, above_fold_job, above_the_fold, layout_system, spacing_feel, vertical_rhythm,
overall_atmosphere, color_mood, typography_feel, media_strategy, interaction_chrome, rebuild_hints, and of its craft
type_image_relationship, typography_composition, imagery_craft, spatial_craft, chrome_vs_content; notable_modules and
ux_flow, ux_strengths, ux_risks are arrays. A null or missing text says nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.keys import bound, clip, collapse, unique_first, words_key
from lumenfold.operators.library import vocabulary_match

#: Vocabularies.
INDUSTRIES = ["automotive", "insurance", "finance", "manufacturing", "marketing_agency", "luxury", "ecommerce", "media", "tech", "healthcare", "travel", "food", "fashion", "real_estate", "nonprofit", "government", "other"]
PAGE_TYPES = ["corporate_homepage", "corporate_landing", "marketing_landing", "article", "legal", "portal", "newsroom", "product", "blank", "other"]
STYLES = ["minimal", "editorial", "high-energy", "luxury-dark", "corporate", "playful", "brutalist", "photographic"]
LAYOUTS = ["full-bleed stacks", "split columns", "card grid", "single column", "mixed"]
#: Other words for industries, and words of a page that are none.
INDUSTRY_ALIASES = {
    "agency": "marketing_agency", "marketing agency": "marketing_agency", "marketing home": "marketing_agency", "advertising": "marketing_agency", "creative": "marketing_agency", "auto": "automotive", "car": "automotive", "bank": "finance",
    "insurance": "insurance", "insurtech": "insurance", "reinsurance": "insurance", "versicherung": "insurance", "assurance": "insurance", "takaful": "insurance", "manufacturing": "manufacturing", "industrial": "manufacturing", "engineering": "manufacturing",
    "fintech": "finance", "shop": "ecommerce", "retail": "ecommerce", "commerce": "ecommerce", "news": "media", "publishing": "media", "software": "tech", "saas": "tech", "technology": "tech", "ai technology": "tech", "hospital": "healthcare", "medical": "healthcare",
    "hotel": "travel", "airline": "travel", "restaurant": "food", "grocery": "food", "apparel": "fashion", "clothing": "fashion", "property": "real_estate", "housing": "real_estate", "charity": "nonprofit", "ngo": "nonprofit",
    "government": "government", "gov": "government", "civic": "government", "municipality": "government", "ministry": "government", "public sector": "government", "governance": "government", "city": "government",
}
NOISE = ["cannes", "lions", "sustainability", "b corp", "bcorp", "hero", "ticker", "carousel", "footer", "nav", "cta", "grid", "card"]
#: The first phrase that a label holds gives its term, before the vocabulary is asked.
STYLE_PHRASES = (("luxury", "luxury-dark"), ("high energy", "high-energy"), ("editorial", "editorial"), ("minimal", "minimal"), ("playful", "playful"), ("brutal", "brutalist"), ("photo", "photographic"), ("corporate", "corporate"))
LAYOUT_PHRASES = (("full bleed", "full-bleed stacks"), ("full width", "full-bleed stacks"), ("stacks", "full-bleed stacks"), ("split", "split columns"), ("two column", "split columns"), ("grid", "card grid"), ("cards", "card grid"))
PAGE_PHRASES = (
    ("blank", ("blank", "empty canvas")), ("legal", ("legal", "terms", "policy")), ("article", ("article", "archive", "guide")), ("newsroom", ("newsroom", "news hub", "news")), ("portal", ("portal", "directory", "intranet")), ("product", ("product showcase", "pdp", "product")),
)
#: Facets of craft: the fields that are read, terms by their phrases in this order, and the term where none is found.
CRAFT = {
    "imagery_density": (("media_strategy", "above_the_fold", "imagery_craft", "notable_modules"), (
        ("none", ("text only", "no image", "without image", "type only")),
        ("low", ("few images", "little imagery", "single image", "one image", "single render", "single architectural", "grayscale reprise", "secondary imagery")),
        ("high", ("gallery", "many images", "image wall", "collage", "multiple photos", "repeated images")),
        ("medium", ("hero image", "photo", "photograph", "portrait", "render", "architectural", "video", "imagery", "lifestyle")),
    ), None),
    "type_scale": (("typography_feel", "above_the_fold", "typography_composition"), (
        ("monumental", ("massive", "huge", "giant", "monumental", "80 100px", "oversized")), ("large", ("large", "display", "bold editorial", "big headline")), ("small", ("small", "compact", "tiny")),
    ), "medium"),
    "type_image_mode": (("above_the_fold", "type_image_relationship", "rebuild_hints"), (
        ("through_image", ("cuts through", "through image", "inside image", "knock out")),
        ("overlap", ("overlap", "layered", "behind the top edge", "on the image", "overlay", "superimposed", "over the hero", "over the photograph")),
        ("adjacent", ("beside", "alongside", "flanked by", "side by side")),
    ), "separate"),
    "contrast_mode": (("color_mood", "overall_atmosphere", "imagery_craft"), (
        ("monochrome", ("monochrome", "black and white", "grayscale", "monochrome slate")), ("low_contrast", ("muted", "soft contrast", "low contrast")), ("saturated", ("vibrant", "saturated", "neon", "bright accent", "colorful")),
    ), "mixed"),
    "composition_energy": (("vertical_rhythm", "layout_system", "spatial_craft", "style"), (
        ("dynamic", ("dynamic", "asymmetric", "broken grid", "high energy", "motion blur")), ("calm", ("minimal", "calm", "quiet", "single column", "airy")),
    ), "balanced"),
    "chrome_weight": (("interaction_chrome", "chrome_vs_content"), (
        ("minimal", ("tiny nav", "minimal chrome", "simple icons", "reduced to tiny text", "pill", "minimalist")), ("interface_heavy", ("dashboard", "dense ui", "toolbar heavy", "interface heavy", "many controls")),
    ), "balanced"),
}
#: Tags of craft by phrases, the fields that are read, and tags of a page.
CRAFT_TAGS = (
    ("editorial_type", ("editorial", "display caps", "massive display")), ("stats_column", ("stats column", "stats are right aligned", "key statistics")), ("split_wordmark", ("split wordmark", "city arcade")), ("inverted_card", ("black cards", "alternating white and black cards", "inverted feature")),
    ("grayscale_reprise", ("grayscale reprise", "black and white", "desaturated", "grayscale")), ("low_imagery", ("few images", "little imagery", "single image", "single render", "single architectural", "secondary imagery")), ("type_over_image", ("overlap", "layered behind", "overlay")),
    ("minimal_chrome", ("minimal chrome", "tiny nav", "simple icons", "pill shaped")), ("motion_blur", ("motion blur", "blur")), ("monochrome", ("monochrome", "black and white", "grayscale")),
)
TAG_FIELDS = ("overall_atmosphere", "typography_feel", "color_mood", "media_strategy", "interaction_chrome", "type_image_relationship", "typography_composition", "imagery_craft", "spatial_craft", "chrome_vs_content")
MOST_TAGS, MOST_INDUSTRIES, MOST_SUMMARY = 12, 3, 1800
#: Labels of a summary in their order.
LABELS = {"above_fold_job": "Above the fold job:", "layout": "Layout:", "rhythm": "Rhythm:", "look": "Look:", "media_strategy": "Media:", "type_image_relationship": "Type/image:", "typography_composition": "Type craft:", "ux": "UX flow:", "chrome": "chrome:"}


def _any(hay: Column, phrases) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | hay.contains(p)
    return out


def _first(hay: Column, rules, otherwise: Column) -> Column:
    """The term of the first rule (term, phrases) of which the text holds a phrase."""
    out = otherwise
    for term, phrases in reversed(rules):
        out = F.when(_any(hay, phrases), term).otherwise(out)
    return out


def industry_tags(raw: Column) -> Column:
    """Up to three industries of an array of labels, in their order; labels with words of a page's parts are left out."""

    def one(item: Column, hay: Column) -> Column:
        alias = F.lit(None).cast("string")
        for word, term in reversed(INDUSTRY_ALIASES.items()):
            alias = F.when(hay == word, term).otherwise(alias)
        return F.when((hay != "") & ~_any(hay, NOISE), F.coalesce(alias, vocabulary_match(item, INDUSTRIES)))

    found = F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda item: bound(words_key(item), lambda hay: one(item, hay)))
    return F.slice(F.array_distinct(F.array_compact(found)), 1, MOST_INDUSTRIES)


def style_label(raw: Column) -> Column:
    """E15."""
    rules = [(term, (phrase,)) for phrase, term in STYLE_PHRASES]
    dark = lambda hay: hay.contains("dark") & hay.contains("premium")
    return bound(words_key(raw), lambda hay: F.when(dark(hay), "luxury-dark").otherwise(_first(hay, rules, vocabulary_match(hay, STYLES))))


def layout_label(raw: Column) -> Column:
    """E15."""
    return bound(words_key(raw), lambda hay: _first(hay, [(term, (phrase,)) for phrase, term in LAYOUT_PHRASES], vocabulary_match(hay, LAYOUTS)))


def page_type(raw: Column) -> Column:
    """Null for no text, other for what is no known type."""

    def of(hay: Column) -> Column:
        home = _any(hay, ("homepage", "home page")) | hay.endswith(" home") | (hay == "home")
        last = F.coalesce(vocabulary_match(hay, PAGE_TYPES), F.lit("other"))
        corporate = F.when(hay.contains("corporate") & hay.contains("landing"), "corporate_landing").when(hay.contains("landing"), "marketing_landing").when(hay.contains("corporate"), "corporate_homepage").otherwise(last)
        return F.when(hay != "", _first(hay, PAGE_PHRASES, F.when(home, "corporate_homepage").otherwise(corporate)))

    return bound(words_key(clip(raw, 48)), of)


def _joined(pages: DataFrame, fields) -> Column:
    """The fields' texts as one, in lower case; empty where none says anything."""
    arrays = {name for name, kind in pages.dtypes if kind.startswith("array")}
    parts = [F.array_join(n, " ") if n in arrays else F.col(n).cast("string") for n in fields if n in pages.columns]
    return words_key(F.concat_ws(" ", *[F.when(p != "", p) for p in parts]))


def craft_tag(module: Column) -> Column:
    """A module's name as a tag of at most 48 characters; null for none."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(words_key(module), r"[^a-z0-9\s]", " "), r"\s+", "_"), "^_+|_+$", "")
    return F.when(out != "", F.substring(out, 1, 48))


def craft(pages: DataFrame) -> dict[str, Column]:
    """The six facets of craft, null where a page says nothing of them, and craft_tags, twelve at most: modules first, then phrases."""
    out = {}
    for facet, (fields, rules, otherwise) in CRAFT.items():
        out[facet] = bound(_joined(pages, fields), lambda hay, rules=rules, otherwise=otherwise: F.when(hay != "", _first(hay, rules, F.lit(otherwise).cast("string"))))
    modules = F.transform(F.coalesce("notable_modules", F.array().cast("array<string>")), craft_tag) if "notable_modules" in pages.columns else F.array().cast("array<string>")
    tags = lambda hay: F.concat(modules, F.array(*[F.when(_any(hay, phrases), tag) for tag, phrases in CRAFT_TAGS]))
    out["craft_tags"] = bound(_joined(pages, TAG_FIELDS), lambda hay: F.when(hay != "", F.slice(F.array_distinct(F.array_compact(tags(hay))), 1, MOST_TAGS)).otherwise(F.array().cast("array<string>")))
    return out


def summary(pages: DataFrame) -> Column:
    """What a page's fields say, as prose with labels, 1800 characters at most."""
    has = lambda n: n in pages.columns
    text = lambda n: F.when(F.col(n) != "", F.col(n)) if has(n) else F.lit(None).cast("string")
    several = lambda sep, *names: F.concat_ws(sep, *[text(n) for n in names])
    listed = lambda n, sep: F.when(F.size(n) > 0, F.array_join(n, sep)) if has(n) else F.lit(None).cast("string")
    said = lambda label, value, end="": F.concat(F.lit(label + " "), value, F.lit(end))
    layout = several("; ", "layout_system", "spacing_feel")
    parts = [
        said("This reads as a", text("page_type"), "."),
        F.coalesce(said("Above the fold job:", text("above_fold_job")), said("Above the fold:", text("above_the_fold"))),
        F.when(layout != "", said("Layout:", layout, ".")),
        said("Rhythm:", text("vertical_rhythm")),
        said("Look:", several("; ", "overall_atmosphere", "color_mood", "typography_feel"), "."),
        said("Media:", text("media_strategy")),
        said("Type/image:", text("type_image_relationship")),
        said("Type craft:", text("typography_composition")),
        said("UX flow:", listed("ux_flow", " → "), "."),
        said("Strengths:", listed("ux_strengths", "; "), "."),
        said("Risks:", listed("ux_risks", "; "), "."),
    ]
    return F.substring(collapse(F.concat_ws(" ", *parts)), 1, MOST_SUMMARY)


def summary_slice(text: Column, label: str) -> Column:
    """What follows a label up to the next one of those after it; empty for none."""
    names = list(LABELS.values())
    later = "|".join([*names[names.index(label) + 1 :], r"\z"])
    found = F.regexp_extract(text, rf"(?is){label}(.*?)(?:{later})", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(found, r"^[—\-\s]+", ""), r"[.;]+$", ""))


def summary_fields(text: Column) -> dict[str, Column]:
    """Fields of a page from its labelled summary, the inverse of `summary`; empty texts for what it doesn't say."""
    text = F.trim(F.coalesce(text, F.lit("")))
    cut = {n: summary_slice(text, label) for n, label in LABELS.items() if n not in ("ux", "chrome")}
    look = F.filter(F.transform(F.split(cut["look"], ";"), lambda p: F.trim(p)), lambda p: p != "")
    part = lambda i: F.coalesce(F.get(look, F.lit(i)), F.lit(""))
    rhythm = F.when(cut["rhythm"] != "", cut["rhythm"]).otherwise(cut["layout"])
    chrome = F.when(text.rlike("(?i)minimal(?:ist)? chrome|tiny nav"), "minimal chrome").when(text.rlike("(?i)interface heavy|dense ui|dashboard"), "interface heavy").otherwise("")
    return {
        "page_type": F.trim(F.regexp_extract(text, r"(?i)This reads as an?\s+([^.]+)\.", 1)), "layout_system": F.trim(F.split(cut["layout"], ";")[0]), "vertical_rhythm": rhythm, "overall_atmosphere": part(0), "color_mood": F.when(F.size(look) > 1, part(1)).otherwise(cut["look"]),
        "typography_feel": F.when(part(2) != "", part(2)).otherwise(cut["typography_composition"]), "media_strategy": cut["media_strategy"], "above_fold_job": cut["above_fold_job"], "above_the_fold": cut["above_fold_job"], "type_image_relationship": cut["type_image_relationship"],
        "typography_composition": cut["typography_composition"], "imagery_craft": cut["media_strategy"], "spatial_craft": rhythm, "chrome_vs_content": chrome,
    }


def build_facets(pages: DataFrame, keys: list[str], host_tags: Column | None = None) -> DataFrame:
    """Keys, page_type, industry_tags, style, layout, color_mood, typography, above_fold_job, section_categories, modules, the facets of craft, craft_tags, has_signal.

    Besides its fields a page may have design_summary, which fills the fields that it lacks, visual_style_labels,
    screen_pattern_labels, category_tags and band_categories (arrays); `host_tags` are the industries of its host. One
    expression a facet, nothing is shuffled.
    """
    none = F.array().cast("array<string>")
    array = lambda n: F.coalesce(F.col(n), none) if n in pages.columns else none
    said = F.col("design_summary") if "design_summary" in pages.columns else F.lit(None).cast("string")
    fields = summary_fields(said)
    # generated rather than projected, so that a summary is taken apart once
    told = pages.select("*", F.explode(F.array(F.struct(*[v.alias(n) for n, v in fields.items()]))).alias("_told"))
    for n in fields:
        spoken = F.when(F.trim(F.coalesce(said, F.lit(""))) != "", F.col(f"_told.{n}"))
        told = told.withColumn(n, F.coalesce(n, spoken) if n in pages.columns else spoken)
    label = F.filter(array("visual_style_labels"), lambda x: F.trim(x) != "")
    told = told.withColumn("style", F.coalesce(style_label(F.col("overall_atmosphere")), style_label(F.get(label, F.lit(0)))))
    named = F.concat(array("category_tags"), F.array(F.coalesce("page_type", F.lit(""))), array("screen_pattern_labels"), F.array(F.coalesce(said, F.lit(""))))
    industry = unique_first(F.concat(F.coalesce(host_tags if host_tags is not None else none, none), industry_tags(named)), MOST_INDUSTRIES)
    short = lambda n, most: F.when(collapse(F.col(n)) != "", clip(F.col(n), most)) if n in told.columns else F.lit(None).cast("string")
    values = {
        "page_type": page_type(F.col("page_type")), "industry_tags": industry, "style": F.col("style"), "layout": F.coalesce(layout_label(F.col("layout_system")), layout_label(F.col("vertical_rhythm"))), "color_mood": short("color_mood", 48), "typography": short("typography_feel", 40),
        "above_fold_job": F.coalesce(short("above_fold_job", 120), short("above_the_fold", 120)), "section_categories": unique_first(array("band_categories"), 12), "modules": unique_first(array("notable_modules"), 6),
    } | craft(told)
    out = told.select(*keys, *[v.alias(n) for n, v in values.items()])
    arrays = ("industry_tags", "section_categories", "craft_tags")
    quiet = [F.col(n).isNull() | (F.col(n) == "") for n in values if n not in (*arrays, "modules")] + [F.size(n) <= 0 for n in arrays]
    signal = F.lit(False)
    for q in quiet:
        signal = signal | ~q
    return out.withColumn("has_signal", signal)
