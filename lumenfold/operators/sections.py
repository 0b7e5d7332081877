"""Sections of captured pages: roots, block roles, recipes, spine and rhythm.

A recipe is array<struct<role, text, box>> in reading order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.keys import half_up, is_consent_section
from lumenfold.functions.looks import union_box

#: Sections of a viewport, steps of a recipe, least size of large media, bands of a spine.
MOST_SECTIONS, MOST_STEPS, LARGE_HEIGHT, LARGE_WIDTH, MOST_BANDS = 24, 12, 180, 240, 12
TAGGED = ("section", "article", "header", "footer", "main", "aside")
BLOCKS = ("div", "section", "article", "main")
MEDIA = ("img", "picture", "video", "canvas", "svg", "iframe")


def root_candidates(nodes: DataFrame, viewport: list[str], height: Column) -> DataFrame:
    """D10, the part that needs no order: tagged nodes and large blocks with a box, without page shells where a viewport has a semantic band.

    `nodes` has node_id, tag, rendered and x, y, width, height (null without a box).
    """
    boxed = nodes.filter("rendered AND tag <> '' AND x IS NOT NULL")
    large = F.col("tag").isin(*BLOCKS) & (F.col("height") >= F.least(F.lit(220.0), height * 0.28)) & (F.col("width") >= 280)
    shell = (F.col("height") >= F.greatest(F.lit(1600.0), height * 1.8)) & F.col("tag").isin(*BLOCKS)
    found = boxed.filter(F.col("tag").isin(*TAGGED) | large).withColumn("_shell", shell)
    band = F.max(F.col("tag").isin("section", "article", "header", "footer") & ~F.col("_shell")).over(Window.partitionBy(*viewport))
    score = F.when(F.col("tag").isin("section", "article"), 2).when(F.col("tag").isin("header", "footer"), 1).otherwise(0)
    return found.withColumn("_band", band).filter("NOT (_band AND _shell)").withColumn("_score", score).drop("_shell", "_band")


def _roots(viewport: list[str], most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, chosen = None, []
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                now = tuple(row[: len(viewport)])
                if now != key:
                    key, chosen = now, []
                if len(chosen) >= most:
                    continue
                x, y, right, bottom, area = row.x, row.y, row.x + row.width, row.y + row.height, max(0, row.width) * max(0, row.height)
                if any(y >= c[1] - 2 and bottom <= c[3] + 2 and x >= c[0] - 2 and right <= c[2] + 2 and area < c[4] * 0.92 for c in chosen):
                    continue
                chosen.append((x, y, right, bottom, area))
                out.append((*now, row.node_id, len(chosen)))
            yield pd.DataFrame(out, columns=[*viewport, "node_id", "place"])

    return run


def section_roots(nodes: DataFrame, viewport: list[str], height: Column, most: int = MOST_SECTIONS) -> DataFrame:
    """(viewport, node_id, place): candidates from top to bottom, semantic ones first, without those inside a chosen one; 24 at most.

    Sorted within partitions, so a viewport is one pass that holds the chosen boxes only.
    """
    found = root_candidates(nodes, viewport, height)
    ordered = found.repartition(*viewport).sortWithinPartitions(*viewport, "y", F.col("_score").desc(), F.col("height").desc(), "node_id")
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*viewport, "node_id"))
    return ordered.select(*viewport, "node_id", "x", "y", "width", "height").mapInPandas(_roots(viewport, most), f"{schema}, place long")


def direct_children(roots: DataFrame, nodes: DataFrame, viewport: list[str]) -> DataFrame:
    """(viewport, root_id, node_id): rendered children with boxes; where there are less than two, each is replaced by its own children, if they are two or more, or one of media."""
    seen = nodes.filter("rendered").select(*viewport, "node_id", "parent_id", "tag", F.col("x").isNotNull().alias("_boxed"))
    child = roots.select(*viewport, F.col("node_id").alias("root_id")).join(seen.withColumnRenamed("parent_id", "root_id"), [*viewport, "root_id"])
    counts = child.groupBy(*viewport, "root_id").agg(F.count(F.when(F.col("_boxed"), 1)).alias("_n"))
    child = child.join(counts, [*viewport, "root_id"])
    wide = child.filter("_n >= 2 AND _boxed").select(*viewport, "root_id", "node_id")
    thin = child.filter("_n < 2 AND (_boxed OR _n = 0)").select(*viewport, "root_id", F.col("node_id").alias("_child"), "_boxed")
    grand = thin.join(seen.filter("_boxed").select(*viewport, "node_id", F.col("parent_id").alias("_child"), F.col("tag").isin(*MEDIA, "figure").alias("_media")), [*viewport, "_child"])
    per = grand.groupBy(*viewport, "root_id", "_child").agg(F.count(F.lit(1)).alias("_g"), F.max("_media").alias("_m")).filter("_g >= 2 OR _m")
    inner = grand.join(per, [*viewport, "root_id", "_child"], "left_semi").select(*viewport, "root_id", "node_id")
    rest = thin.filter("_boxed").join(per, [*viewport, "root_id", "_child"], "left_anti").select(*viewport, "root_id", F.col("_child").alias("node_id"))
    return wide.unionByName(inner).unionByName(rest)


def preview(text: Column, label: Column, most: int = 80) -> Column:
    """Collapsed text, else the label; null for none."""
    out = F.trim(F.regexp_replace(F.coalesce(text, label, F.lit("")), r"\s+", " "))
    return F.when(out != "", F.substring(out, 1, most))


def block_role(tag: Column, role: Column, style: Column, box: Column, text: Column, pseudo: Column) -> Column:
    """One of twelve roles."""
    tag = F.lower(F.coalesce(tag, F.lit("")))
    tall, wide = box["height"] >= LARGE_HEIGHT, box["width"] >= LARGE_WIDTH
    image = F.coalesce(style["background-image"], F.lit("none"))
    drawn = (image != "") & (image != "none")
    return (
        F.when((tag == "nav") | F.coalesce(role == "navigation", F.lit(False)), "nav")
        .when((tag == "form") | F.coalesce(role == "form", F.lit(False)), "form")
        .when(tag.isin("ul", "ol", "dl"), "list")
        .when(tag.isin(*MEDIA), F.when(tall & wide, "media_large").otherwise("media"))
        .when(tag == "figure", F.when(tall, "media_large").otherwise("media"))
        .when(tag.isin("h1", "h2", "h3"), "heading")
        .when(tag.isin("h4", "h5", "h6"), "subheading")
        .when(tag.isin("p", "span", "figcaption"), F.when(F.length(text) > 0, "body").otherwise("unknown"))
        .when(tag.isin("button", "a") | F.coalesce(role == "button", F.lit(False)), "cta")
        .when(F.coalesce(pseudo, F.lit(False)), "decorative")
        .when(drawn & tall, "media_large")
        .otherwise("unknown")
    )


def merge_cta_pairs(steps: Column) -> Column:
    """Two calls to action in a row, near or side by side, become one cta_pair; an item joins one pair at most."""

    def near(a: Column, b: Column) -> Column:
        gap = F.abs(b["box"]["y"] - (a["box"]["y"] + a["box"]["height"]))
        level = F.abs(b["box"]["y"] - a["box"]["y"]) < F.greatest(a["box"]["height"], b["box"]["height"]) * 0.7
        return (a["role"] == "cta") & (b["role"] == "cta") & ((gap < 48) | level)

    def pair(a: Column, b: Column) -> Column:
        return F.struct(F.lit("cta_pair").alias("role"), F.substring(F.concat_ws(" | ", F.when(a["text"] != "", a["text"]), F.when(b["text"] != "", b["text"])), 1, 100).alias("text"), a["box"].alias("box"))

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        return F.when((F.size(done) > 0) & near(F.when(F.size(done) > 0, last), s), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(pair(last, s)))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(steps, F.slice(steps, 1, 0), step)


def signature(steps: Column) -> Column:
    """Roles in order, large media as media, subheadings as headings, pairs as one; no decoration, no role twice in a row; unknown if none is left.

    The role before a decoration doesn't end a run of its own.
    """
    plain = F.transform(steps, lambda s: F.when(s["role"] == "media_large", "media").when(s["role"] == "subheading", "heading").when(s["role"] == "cta_pair", "cta").otherwise(s["role"]))
    kept = F.filter(F.transform(plain, lambda r, i: F.when((r != "decorative") & ((i == 0) | (r != F.get(plain, i - 1))), r)), lambda r: r.isNotNull())
    return F.when(F.size(kept) > 0, F.array_join(kept, ">")).otherwise("unknown")


def gaps(steps: Column) -> Column:
    """Whole pixels between a step and the next one, 0 at least."""
    ends = F.slice(steps, 1, F.greatest(F.lit(0), F.size(steps) - 1))
    return F.zip_with(ends, F.slice(steps, 2, 1 << 20), lambda a, b: F.greatest(F.lit(0), half_up(b["box"]["y"] - (a["box"]["y"] + a["box"]["height"]))).cast("long"))


def text_signals(steps: Column, most: int = 6) -> Column:
    return F.slice(F.filter(F.transform(steps, lambda s: s["text"]), lambda t: F.length(t) > 0), 1, most)


def recipes(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Steps, signature, gap_px, text_signals of every section, from its blocks (role, text, box), top to bottom, the first twelve.

    Unknown blocks without text are left out before pairs are merged.
    """
    w = Window.partitionBy(*keys).orderBy("box.y", "box.x", "ordinal")
    first = blocks.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= MOST_STEPS)
    lists = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", F.struct("role", "text", "box").alias("s")))), lambda s: s["s"]).alias("_s"))
    known = lists.withColumn("steps", merge_cta_pairs(F.filter("_s", lambda s: (s["role"] != "unknown") | (F.length(s["text"]) > 0)))).drop("_s")
    return known.select(*keys, "steps", signature(F.col("steps")).alias("signature"), gaps(F.col("steps")).alias("gap_px"), text_signals(F.col("steps")).alias("text_signals"))


def composition_clusters(sections: DataFrame) -> DataFrame:
    """Sections of one signature, category and term: count, viewport names, up to four of their text signals, the least ones.

    Signals are made distinct and numbered within a cluster, so that four of each are gathered and no cluster's texts meet.
    """
    keys = ["signature", "category", "taxonomy_id"]
    counts = sections.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_set("viewport_name")).alias("viewport_names"))
    flat = sections.select(*keys, F.explode("text_signals").alias("_t")).distinct()
    first = flat.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_t"))).filter("_n <= 4")
    some = first.groupBy(*keys).agg(F.array_sort(F.collect_list("_t")).alias("example_text_signals"))
    return counts.join(some, keys, "left").withColumn("example_text_signals", F.coalesce("example_text_signals", F.array().cast("array<string>")))


def hint_score(signature_parts: Column, hint_parts: Column) -> Column:
    """Part of a hint's roles that a signature has in order, roles it lacks being passed over, and 0.15 for all of them."""
    plain = F.transform(hint_parts, lambda r: F.when(r == "media_large", "media").when(r == "cta_pair", "cta").otherwise(r))

    def step(found: Column, role: Column) -> Column:
        at = F.array_position(F.slice(signature_parts, found["next"] + 1, F.greatest(F.lit(0), F.size(signature_parts) - found["next"])), role).cast("int")
        return F.struct((found["n"] + F.when(at > 0, 1).otherwise(0)).alias("n"), (found["next"] + at).alias("next"))

    n = F.aggregate(plain, F.struct(F.lit(0).alias("n"), F.lit(0).alias("next")), step)["n"]
    some = (F.size(hint_parts) > 0) & (F.size(signature_parts) > 0)
    return F.when(some, n / F.size(hint_parts) + F.when(n == F.size(hint_parts), 0.15).otherwise(0.0)).otherwise(0.0)


#: What a section's texts speak of.
SPEAKS = {
    "quotes": "testimonial|review|customer|kunde|quote|partner logo|trusted by|as seen",
    "shop": r"cart|checkout|inventory|in stock|out of stock|add to (cart|bag)|kaufen|warenkorb|preis|price|€|\$|buy now|shop now",
    "contact": "sign|log|email|subscribe|newsletter|demo|contact",
    "faq": "faq|häufig|questions",
    "prices": r"price|pricing|plan|€|\$|monat|month",
    "consent": "cookie|consent|einwilligung|zustimmung|datenschutz.*einstell|alle akzeptieren|accept all cookies|manage cookies|cmp",
}
#: Least score of a hint; confidence of a hint that holds nothing and of one that holds all; its greatest value.
LEAST_HINT, HINT_BASE, HINT_SHARE, HINT_MOST = 0.66, 0.55, 0.35, 0.9


def _features(height: Column) -> dict[str, Column]:
    """What the rules of D16 ask, of columns tag, box, media_box, signature and text_signals."""
    tag, sig, y = F.lower(F.coalesce("tag", F.lit(""))), F.col("signature"), F.col("box.y")
    said = F.lower(F.array_join(F.coalesce("text_signals", F.array().cast("array<string>")), " "))
    media = F.coalesce("media_box", "box")
    roles = F.filter(F.split(sig, ">"), lambda r: r != "")
    has_media = F.array_contains(roles, "media")
    top = lambda least, share: y <= F.greatest(F.lit(least), height * share)
    return {
        "tag": tag, "said": said, "y": y, "tall": F.col("box.height"), "roles": roles,
        "above": top(64.0, 0.32), "near_top": top(80.0, 0.45),
        "media": has_media, "heading": sig.contains("heading"), "cta": sig.contains("cta"), "form": sig.contains("form"), "list": sig.contains("list"), "body": sig.contains("body"),
        "nav": sig.contains("nav") | tag.isin("nav", "header"), "leads_with_media": sig.startswith("media"),
        "media_only": (F.size(roles) > 0) & F.forall(roles, lambda r: r.isin("media", "media_large")),
        "tall_media": has_media & (media["height"] >= F.greatest(F.lit(260.0), height * 0.32)),
        "full_bleed": has_media & (media["width"] >= F.greatest(F.lit(880.0), height * 0.92)) & (media["height"] >= F.greatest(F.lit(320.0), height * 0.42)),
    } | {k: said.rlike(v) for k, v in SPEAKS.items()}


def _decisions(f: dict[str, Column], height: Column) -> list[tuple[Column, Column, str, Column, str | Column]]:
    """(condition, term, category, confidence, method), the first that holds counts; terms and confidences are fixed values."""
    pick = lambda *pairs: F.coalesce(*[F.when(c, v) for c, v in pairs[:-1]], F.lit(pairs[-1]))
    says = lambda words: f["said"].rlike(words)
    lead = pick((says("newsletter|subscribe"), "cta_newsletter"), (says("demo"), "cta_demo"), (says("contact"), "contact"), "lead_form")
    either = f["heading"] | f["cta"]
    bleeding = pick((f["heading"] & f["cta"] & f["leads_with_media"], "hero_media_above"), (f["heading"] & f["cta"], "hero_split_cta"), (f["media_only"] | f["leads_with_media"], "hero_media_above"), (f["cta"], "hero"), "hero_centered")
    headed = pick((f["media"] & f["leads_with_media"], "hero_media_above"), (f["media"], "hero_split_cta"), (f["cta"], "hero"), "hero_centered")
    sure = F.lit
    return [
        ((f["tag"] == "header") | (f["nav"] & f["near_top"] & (f["tall"] < 160)), F.lit("global_nav"), "nav", sure(0.9), "header_nav_heuristic"),
        ((f["tag"] == "footer") | (f["nav"] & (f["y"] > height)), F.lit("footer"), "nav", sure(0.88), "footer_heuristic"),
        (f["form"] & f["contact"], lead, "form", sure(0.82), "form_text_heuristic"),
        (f["faq"] & f["list"], F.lit("faq"), "content", sure(0.84), "faq_heuristic"),
        (f["prices"] & (f["list"] | f["cta"]), F.lit("pricing"), "commerce", sure(0.83), "pricing_heuristic"),
        (f["quotes"], F.lit("testimonials"), "social_proof", sure(0.8), "testimonial_heuristic"),
        (f["consent"], F.lit("cookie_consent"), "cookie_consent", sure(0.9), "cookie_consent_text_heuristic"),
        (f["above"] & f["full_bleed"], bleeding, "hero", F.when(either, 0.86).otherwise(0.8), F.when(either, "hero_position_heuristic").otherwise("hero_tall_media_heuristic")),
        (f["above"] & f["heading"] & f["media"] & f["cta"], headed, "hero", sure(0.86), "hero_position_heuristic"),
        (f["near_top"] & f["tall_media"] & ~f["full_bleed"], F.when(either, "feature_spotlight").otherwise("feature_grid"), "feature", sure(0.74), "near_top_media_card_heuristic"),
        (f["media"] & f["heading"] & f["cta"], F.lit("feature_spotlight"), "feature", sure(0.78), "media_heading_cta_heuristic"),
        (f["tall_media"] & f["media_only"], F.lit("feature_spotlight"), "feature", sure(0.72), "tall_media_block_heuristic"),
        (f["heading"] & f["list"] & ~f["form"], F.lit("feature_grid"), "feature", sure(0.74), "heading_list_heuristic"),
        (f["heading"] & f["cta"] & ~f["media"], F.lit("cta_band"), "conversion", sure(0.76), "heading_cta_heuristic"),
        (f["heading"] & f["body"] & ~f["media"] & ~f["cta"] & ~f["form"], F.lit("content_block"), "content", sure(0.7), "heading_body_heuristic"),
    ]


_SITUATION = ("signature", "_broad", "_above", "_quotes", "_shop")


def _best_hints(situations: DataFrame, hints: DataFrame) -> DataFrame:
    """(situation, _entry): the best entry of the catalog for each kind of section; of equal ones the first."""
    thin = F.col("signature").isin("body", "unknown")
    wide = lambda *roles: F.forall("_all", lambda h: (F.size(h) == 1) & h[0].isin(*roles))
    entries = hints.filter("entity_type IN ('section', 'pattern')").groupBy("entry_id", "category", "place").agg(F.collect_list("hint").alias("_all")).withColumns({"_media": wide("media", "media_large"), "_body": wide("body")})
    plain = F.explode(F.array_distinct(F.flatten("_all")))
    named = lambda r: F.when(r == "media_large", "media").when(r == "cta_pair", "cta").otherwise(r)
    by_role = entries.select("*", plain.alias("_role")).withColumn("_role", named(F.col("_role"))).withColumnRenamed("category", "_category")
    met = situations.select(*_SITUATION, F.explode(F.array_distinct(F.split("signature", ">"))).alias("_role")).join(by_role, "_role").drop("_role").dropDuplicates([*_SITUATION, "entry_id"])
    proof = F.col("_category") == "social_proof"
    barred = (F.col("_media") & F.col("_broad") & proof) | (proof & thin & ~F.col("_quotes"))
    barred = barred | (F.col("_body") & thin & (((F.col("_category") == "commerce") & ~F.col("_shop")) | (F.col("_category") == "feedback"))) | ((F.col("_category") == "hero") & ~F.col("_above"))
    roles = F.filter(F.split("signature", ">"), lambda r: r != "")
    scored = met.filter(~barred).withColumn("_score", F.array_max(F.transform("_all", lambda h: hint_score(roles, h)))).filter(F.col("_score") >= LEAST_HINT)
    best = F.min(F.struct((-F.col("_score")).alias("s"), F.col("place"), F.col("entry_id"), F.col("_category").alias("category")))
    return scored.groupBy(*_SITUATION).agg(best.alias("_entry"))


def classify_sections(sections: DataFrame, viewport_height: Column, hints: DataFrame | None = None) -> DataFrame:
    """Sections with taxonomy_id, category, confidence and method.

    The rules by position, roles and words come first, in their order; then the best entry of a catalog (`hints`:
    entry_id, entity_type, category, place, hint as an array of roles, a row a hint); then the tag; then a content block.
    Entries meet the kinds of sections, not the sections, and only where they share a role. `sections` has tag, box,
    media_box (null without large media), signature and text_signals.
    """
    f = _features(viewport_height)
    way = lambda when, term, kind, sure, method: F.when(F.coalesce(when, F.lit(False)), F.struct(term.alias("taxonomy_id"), F.lit(kind).alias("category"), sure.cast("double").alias("confidence"), (F.lit(method) if isinstance(method, str) else method).alias("method")))
    prefixed = lambda term: F.concat(F.lit("dig:section."), term)
    rules = F.coalesce(*[way(c, prefixed(term), kind, sure, method) for c, term, kind, sure, method in _decisions(f, viewport_height)])
    last = F.coalesce(way(f["tag"] == "article", F.lit("dig:section.article"), "content", F.lit(0.8), "article_tag"), way(F.lit(True), F.lit("dig:section.content_block"), "content", F.lit(0.55), "fallback_content_block"))
    flags = {"_broad": f["tall_media"] | f["near_top"], "_above": f["above"], "_quotes": f["quotes"], "_shop": f["shop"]}
    rows = sections.withColumns({"_rule": rules, "_last": last} | {k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    hinted = F.lit(None).cast("struct<taxonomy_id:string,category:string,confidence:double,method:string>")
    if hints is not None:
        found = _best_hints(rows.filter("_rule IS NULL").select(*_SITUATION).distinct(), hints)
        rows = rows.join(found, list(_SITUATION), "left")
        by_hint = F.struct(F.col("_entry.entry_id").alias("taxonomy_id"), F.col("_entry.category").alias("category"), F.least(F.lit(HINT_MOST), HINT_BASE - F.col("_entry.s") * HINT_SHARE).alias("confidence"), F.lit("catalog_composition_hint").alias("method"))
        hinted = F.when(F.col("_entry").isNotNull(), by_hint)
    return rows.withColumn("_c", F.coalesce("_rule", hinted, "_last")).select(*sections.columns, "_c.*")


#: Sections that are looked at, heroes among them, distance of two of a kind, height of a wrapper and of a strip.
MOST_LOOKS, MOST_HEROES, APART, WRAPPER, STRIP = 14, 1, 120, 2800, 120
#: What words in a category, roles in a signature and the viewport add to a section's confidence.
CATEGORY_POINTS = (("hero", 2.0), ("feature", 1.0), ("cta|conversion|pricing|commerce", 0.8), ("nav|form", 0.5), ("social_proof", -0.35))
ROLE_POINTS = (("media", 0.6), ("cta", 0.5), ("heading", 0.35))
VIEWPORT_POINTS = (("desktop", 1.2), ("tablet", 0.2), ("mobile", -0.3))


def look_scores(sections: DataFrame, keys: list[str]) -> DataFrame:
    """Sections with score, skip (page wrappers and consent overlays), band_y and kind (their signature with plain media)."""
    frame = union_box(F.transform("steps", lambda s: s["box"]))
    tall = F.coalesce(frame["height"], F.lit(0.0))
    thin = F.col("signature").isin("body", "unknown")
    wrapper = thin & (tall >= WRAPPER)
    consent = is_consent_section(F.col("taxonomy_id"), F.col("category"), F.concat(F.coalesce("text_signals", F.array().cast("array<string>")), F.array("signature")))
    roles = F.filter(F.split("signature", ">"), lambda r: r != "")
    early = F.row_number().over(Window.partitionBy(*keys).orderBy("ordinal", "section_id")) <= 3
    category = F.lower("category")
    points = [(category.rlike(words), p) for words, p in CATEGORY_POINTS[:4]] + [(F.col("signature").contains(role), p) for role, p in ROLE_POINTS]
    points += [(early, 0.4), (category.rlike(CATEGORY_POINTS[4][0]), CATEGORY_POINTS[4][1]), (F.size(roles) >= 3, 0.45), ((F.size(roles) == 1) & thin, -0.5)]
    points += [((tall > 0) & (tall < STRIP), -1.2), (tall >= WRAPPER, -1.5), (wrapper, -2.0), (consent, -3.0)]
    points += [(F.col("viewport_name") == name, p) for name, p in VIEWPORT_POINTS]
    score = F.col("confidence")
    for when, p in points:
        score = score + F.when(when, p).otherwise(0.0)
    kind = F.array_join(F.transform(roles, lambda r: F.when(r == "media_large", "media").otherwise(r)), ">")
    return sections.withColumns({"score": F.round(score, 9), "skip": F.coalesce(wrapper | consent, F.lit(False)), "band_y": F.when(F.size("steps") > 0, F.get("steps", F.lit(0))["box"]["y"]), "kind": kind})


def _picked(keys: list[str], most: int):
    """One pass over the sections of each page, best first, that holds what is picked only."""
    per_category, per_kind = max(2, -(-most // 3)), max(2, -(-most // 5))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, chosen = None, []
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                now = tuple(r[: len(keys)])
                if now != page:
                    page, chosen = now, []
                if len(chosen) >= most:
                    continue
                category, hero, y = (r.category or "").lower() or "unknown", "hero" in (r.category or "").lower(), r.band_y
                alike = [c for c in chosen if c[0] == r.section_id]
                near = (hero or r.kind == "media") and y == y and y is not None and any(c[4] is not None and abs(c[4] - y) < APART for c in chosen)
                full = sum(c[1] == category for c in chosen) >= per_category or sum(c[2] == r.kind for c in chosen) >= per_kind
                if alike or near or full or (hero and sum(c[3] for c in chosen) >= MOST_HEROES):
                    continue
                chosen.append((r.section_id, category, r.kind, hero, y if y == y else None))
                out.append((*now, r.section_id, len(chosen), r.score))
            yield pd.DataFrame(out, columns=[*keys, "section_id", "pick", "score"])

    return run


def pick_sections(sections: DataFrame, keys: list[str], most: int = MOST_LOOKS) -> DataFrame:
    """(keys, section_id, pick, score): up to `most` sections of a page by score, of many kinds.

    One hero, a third of the picks from one category and a fifth with one signature at most (two at least), and heroes
    or media only 120 pixels from all that is picked. `sections` has section_id, ordinal (order of the page),
    category, taxonomy_id, signature, text_signals, confidence, viewport_name and steps.
    """
    ranked = look_scores(sections, keys).filter("NOT skip")
    kinds = dict(sections.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, "section_id"))
    ordered = ranked.repartition(*keys).sortWithinPartitions(*keys, F.col("score").desc(), "ordinal", "section_id")
    return ordered.select(*keys, "section_id", "category", "kind", "band_y", "score").mapInPandas(_picked(keys, most), f"{schema}, pick long, score double")


#: Fixed value: words that show that a thin section means something.
CUE = r"model|produkt|product|preis|€|\$|shop|konfigur|entdeck|kaufen|anmeld|cta|mehr erfahren|warenkorb|cart|login"


def demotion(category: Column, sig: Column, signals: Column, height: Column, method: Column, confidence: Column) -> Column:
    """Why a section is only a wrapper; null if it isn't."""
    thin = F.coalesce(F.when(sig != "", sig), F.lit("unknown")).isin("body", "unknown")
    blob = F.lower(F.array_join(signals, " "))
    cue = blob.rlike(CUE)
    return (
        F.when(category == "cookie_consent", "cookie_consent")
        .when(thin & (height > 0) & (height < 100), "thin_short_body")
        .when(thin & category.isin("commerce", "conversion", "feedback") & ~cue, "thin_commerce_without_cues")
        .when(thin & (category == "content") & (F.length(blob) < 24), "thin_empty_content")
        .when((method == "catalog_composition_hint") & thin & (confidence >= 0.88) & ~cue & (F.length(blob) < 40), "catalog_body_overmatch")
    )


def spine(sections: DataFrame, keys: list[str], viewport_height: Column, most: int = MOST_BANDS) -> DataFrame:
    """The bands of each viewport from top to bottom: band, section_id, category, signature, zone, y, height, confidence.

    Wrappers are demoted, a run of body bands of one category is its first one, and the first twelve stay. `sections`
    has section_id, category, signature, text_signals, method, confidence and steps.
    """
    frame = union_box(F.transform("steps", lambda s: s["box"]))
    boxed = sections.withColumn("_b", frame).withColumn("y", F.coalesce("_b.y", F.lit(0.0))).withColumn("height", F.coalesce("_b.height", F.lit(0.0)))
    kept = boxed.filter(demotion(F.col("category"), F.col("signature"), F.col("text_signals"), F.col("height"), F.col("method"), F.col("confidence")).isNull())
    w = Window.partitionBy(*keys).orderBy("y", "section_id")
    same = (F.lag("category").over(w) == F.col("category")) & (F.lag("signature").over(w) == F.col("signature")) & (F.col("signature") == "body")
    first = kept.withColumn("_same", F.coalesce(same, F.lit(False))).filter("NOT _same").withColumn("band", F.row_number().over(w)).filter(F.col("band") <= most)
    # whole tenths: 900 * 2.2 is a little more than 1980
    zone = F.when(F.col("y") < viewport_height * 9 / 10, "above_fold").when(F.col("y") < viewport_height * 22 / 10, "mid").otherwise("below")
    return first.select(*keys, F.col("band").cast("long").alias("band"), "section_id", "category", "signature", zone.alias("zone"), "y", "height", "confidence")


#: Fixed value: ingredients of what is above the fold, in this order.
INGREDIENTS = ("media", "brand", "headline", "cta", "chrome", "other")


def spine_summary(bands: DataFrame, keys: list[str]) -> DataFrame:
    """page_arc (up to eight categories in order) and ingredients of the bands above the fold, else of the first two."""
    lists = bands.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("band", "category", "signature", "zone"))).alias("_b"))
    above = F.filter("_b", lambda b: b["zone"] == "above_fold")
    top = F.when(F.size(above) > 0, above).otherwise(F.slice("_b", 1, 2))
    has = lambda f: F.exists(top, f)
    found = {"media": has(lambda b: b["signature"].contains("media")), "headline": has(lambda b: b["signature"].contains("heading") | (b["category"] == "hero")), "cta": has(lambda b: b["signature"].contains("cta") | (b["category"] == "conversion")), "chrome": has(lambda b: b["category"] == "nav")}
    some = F.array_compact(F.array(*[F.when(found[i], i) for i in INGREDIENTS if i in found]))
    arc = F.array_join(F.slice(F.array_distinct(F.transform("_b", lambda b: b["category"])), 1, 8), " → ")
    return lists.select(*keys, arc.alias("page_arc"), F.when(F.size(some) > 0, some).otherwise(F.array(F.lit("other"))).alias("ingredients"), F.array_join(F.transform(top, lambda b: F.concat(b["category"], F.lit("("), b["signature"], F.lit(")"))), " → ").alias("summary"))


#: Crop limits (least width and height, greatest height, greatest height of a wrapper).
CROP = (160, 80, 2400, 1200)


def crop_reason(sig: Column, category: Column, frame: Column, limits: tuple[int, int, int, int] = CROP) -> Column:
    """selected_geometry, or why a section gives no crop."""
    width, height, most, wrapper = limits
    return (
        F.when(frame.isNull(), "no_geometry")
        .when(sig.isin("body", "unknown") & (frame["height"] >= wrapper), "page_wrapper")
        .when(frame["width"] < width, "too_narrow")
        .when(frame["height"] < height, "too_short")
        .when(frame["height"] > most, "too_tall")
        .when((F.lower(category) == "nav") & (frame["height"] < 160) & ~sig.contains("cta"), "nav_chrome")
        .otherwise("selected_geometry")
    )


#: Insights and steps of a page that only measures tell of, roles of a chain, characters of an interpretation.
MOST_INSIGHTS, MOST_FLOW, MOST_CHAIN, MOST_TOLD = 8, 12, 6, 160


def measured_recipes(sections: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(insights, steps) of pages from their sections alone, desktop ones where there are any.

    insights: keys, place, signature, category, interpretation, evidence_refs, the first eight by category and
    signature; steps: keys, step, section_label, signature, the first twelve. `sections` has ordinal, viewport_name,
    category, signature, taxonomy_id, text_signals, steps (role) and gap_px.
    """
    desktop = F.col("viewport_name") == "desktop"
    known = F.max(F.coalesce(desktop, F.lit(False))).over(Window.partitionBy(*keys))
    chosen = sections.withColumn("_any", known).filter(~F.col("_any") | desktop).withColumn("step", F.row_number().over(Window.partitionBy(*keys).orderBy("ordinal", "section_id")).cast("long"))
    steps = chosen.filter(F.col("step") <= MOST_FLOW).select(*keys, "step", F.concat_ws(" · ", "category", "signature").alias("section_label"), "signature")
    first = chosen.withColumn("_again", F.row_number().over(Window.partitionBy(*keys, "category", "signature").orderBy("step"))).filter("_again = 1")
    first = first.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("step")).cast("long")).filter(F.col("place") <= MOST_INSIGHTS)
    roles = F.slice(F.transform("steps", lambda s: s["role"]), 1, MOST_CHAIN)
    chain = F.when(F.size(roles) > 0, F.array_join(roles, " → ")).otherwise("section stack")
    mean = half_up(F.aggregate("gap_px", F.lit(0.0), lambda a, g: a + g) / F.size("gap_px"))
    hint = F.when(F.size("gap_px") > 0, F.concat(F.lit("gaps ~"), mean.cast("string"), F.lit("px"))).otherwise("measured stack")
    refs = F.concat(F.array("taxonomy_id"), F.slice(F.coalesce("text_signals", F.array().cast("array<string>")), 1, 2))
    return first.select(*keys, "place", "signature", "category", F.substring(F.concat_ws("; ", chain, hint), 1, MOST_TOLD).alias("interpretation"), refs.alias("evidence_refs")), steps
