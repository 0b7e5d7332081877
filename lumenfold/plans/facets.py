"""Queries over facets of pages, whose texts Spark puts together from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import facets
from lumenfold.plans.base import query

#: What a part's page says, by size, key and brand.
_SAYS = {
    "media_strategy": ("p_size", ("Text only", "a single image", "photo gallery", "one portrait", "nothing of note", "")),
    "typography_feel": ("p_partkey", ("oversized caps", "bold editorial", "tiny labels", "plain")),
    "above_the_fold": ("p_size + p_partkey", ("text beside a render", "type layered on it", "headline cuts through", "a claim", "")),
    "color_mood": ("p_partkey", ("black and white", "soft contrast", "neon", "brown", "")),
    "vertical_rhythm": ("p_size", ("asymmetric blocks", "quiet bands", "rows")),
    "interaction_chrome": ("p_size + p_partkey", ("tiny nav", "toolbar-heavy", "some links", "")),
    "overall_atmosphere": ("p_partkey", ("Luxury hotel", "dark and premium", "High-energy", "photo essay", "corporate", "soft")),
    "layout_system": ("p_size", ("full_bleed", "split in two", "bento grid", "single column", "free")),
    "page_type": ("p_partkey", ("Terms", "news hub", "product page", "brand home", "corporate landing", "landing", "corporate", "thing", "")),
}


def _pages(t):
    def said(by: str, texts) -> F.Column:
        return F.element_at(F.array(*[F.lit(x) for x in texts]), (F.expr(by) % len(texts) + 1).cast("int"))

    return t("part").select("p_partkey", *[said(by, texts).alias(n) for n, (by, texts) in _SAYS.items()], F.array(F.col("p_type"), F.lit("stats column")).alias("notable_modules"))


_PAGES = "p AS (SELECT p_partkey, " + ", ".join(f"lower(replace(replace([{', '.join(repr(x) for x in texts)}][({by}) % {len(texts)} + 1], '-', ' '), '_', ' ')) AS {n}" for n, (by, texts) in _SAYS.items()) + ", lower(p_type) || ' stats column' AS notable_modules FROM part)"


def _craft_sql(facet: str) -> str:
    fields, rules, otherwise = facets.CRAFT[facet]
    known = [f for f in fields if f in _SAYS or f == "notable_modules"]
    hay = f"concat_ws(' ', {', '.join(f'nullif({f}, {chr(39)*2})' for f in known)})"
    # the style is the last thing that the energy of a composition is read from
    hay = hay if facet != "composition_energy" else f"concat_ws(' ', {hay}, replace(style, '-', ' '))"
    cases = " ".join(f"WHEN {' OR '.join(f'contains({hay}, {chr(39)}{p}{chr(39)})' for p in phrases)} THEN '{term}'" for term, phrases in rules)
    rest = f"'{otherwise}'" if otherwise else "NULL"
    return f"CASE WHEN {hay} = '' THEN NULL {cases} ELSE {rest} END AS {facet}"


_STYLE = "CASE WHEN contains(overall_atmosphere, 'luxury') OR contains(overall_atmosphere, 'dark') AND contains(overall_atmosphere, 'premium') THEN 'luxury-dark' WHEN contains(overall_atmosphere, 'high energy') THEN 'high-energy' WHEN contains(overall_atmosphere, 'photo') THEN 'photographic' WHEN contains(overall_atmosphere, 'corporate') THEN 'corporate' END"


@query("e15_labels", f"""WITH {_PAGES} SELECT p_partkey, {_STYLE} AS style, CASE WHEN contains(layout_system, 'full bleed') THEN 'full-bleed stacks' WHEN contains(layout_system, 'split') THEN 'split columns' WHEN contains(layout_system, 'grid') THEN 'card grid' WHEN contains(layout_system, 'single column') THEN 'single column' END AS layout,
CASE WHEN page_type = '' THEN NULL WHEN contains(page_type, 'terms') THEN 'legal' WHEN contains(page_type, 'news') THEN 'newsroom' WHEN contains(page_type, 'product') THEN 'product' WHEN page_type LIKE '% home' THEN 'corporate_homepage' WHEN page_type LIKE '%corporate%landing%' THEN 'corporate_landing' WHEN contains(page_type, 'landing') THEN 'marketing_landing' WHEN contains(page_type, 'corporate') THEN 'corporate_homepage' ELSE 'other' END AS page_type FROM p""")
def _(t):
    return _pages(t).select("p_partkey", facets.style_label(F.col("overall_atmosphere")).alias("style"), facets.layout_label(F.col("layout_system")).alias("layout"), facets.page_type(F.col("page_type")).alias("page_type"))


@query("e16_craft_facets", f"WITH {_PAGES}, q AS (SELECT *, {_STYLE} AS style FROM p) SELECT p_partkey, {', '.join(_craft_sql(f) for f in facets.CRAFT)} FROM q")
def _(t):
    pages = _pages(t)
    found = facets.craft(pages.withColumn("style", facets.style_label(F.col("overall_atmosphere"))))
    rows = pages.withColumn("style", facets.style_label(F.col("overall_atmosphere")))
    return rows.select("p_partkey", *[found[f].alias(f) for f in facets.CRAFT])


@query("e17_summary_fields", f"""WITH {_PAGES} SELECT p_partkey, page_type, layout_system, CASE WHEN vertical_rhythm = '' THEN layout_system ELSE vertical_rhythm END AS vertical_rhythm, overall_atmosphere, media_strategy FROM p""")
def _(t):
    """The fields, from the summary of a page that says no more than its type, layout, rhythm, atmosphere and media."""
    pages = _pages(t).select("p_partkey", *[F.regexp_replace(F.lower(n), "[-_]", " ").alias(n) for n in ("page_type", "layout_system", "vertical_rhythm", "overall_atmosphere", "media_strategy")])
    text = pages.select("p_partkey", facets.summary(pages).alias("s"))
    found = facets.summary_fields(F.col("s"))
    # a full stop before a space stays
    stopped = [F.regexp_replace(found[n], r"\.$", "").alias(n) for n in ("layout_system", "overall_atmosphere")]
    return text.select("p_partkey", *[found[n].alias(n) for n in ("page_type", "vertical_rhythm")], *stopped, found["media_strategy"].alias("media_strategy"))


@query("e18_facets", f"""WITH {_PAGES} SELECT p_partkey, {_STYLE} AS style, CASE WHEN color_mood = '' THEN NULL ELSE color_mood END AS color_mood, typography_feel AS typography, CASE WHEN above_the_fold = '' THEN NULL ELSE above_the_fold END AS above_fold_job, 2 AS modules, TRUE AS has_signal FROM p""")
def _(t):
    out = facets.build_facets(_pages(t), ["p_partkey"])
    return out.select("p_partkey", "style", "color_mood", "typography", "above_fold_job", F.size("modules").alias("modules"), "has_signal")


@query("e22_summary", f"WITH {_PAGES} SELECT p_partkey, starts_with(s, 'This reads as a') AS typed, length(s) AS length FROM (SELECT p_partkey, trim(concat_ws(' ', CASE WHEN page_type <> '' THEN 'This reads as a ' || page_type || '.' END, 'Above the fold: ' || nullif(above_the_fold, ''), 'Layout: ' || layout_system || '.', 'Rhythm: ' || vertical_rhythm, 'Look: ' || concat_ws('; ', overall_atmosphere, nullif(color_mood, ''), typography_feel) || '.', 'Media: ' || nullif(media_strategy, ''))) AS s FROM p)")
def _(t):
    pages = _pages(t)
    s = facets.summary(pages)
    return pages.select("p_partkey", s.startswith("This reads as a").alias("typed"), F.length(s).cast("long").alias("length"))
