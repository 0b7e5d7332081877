"""Facets by plain loops, and summaries there and back."""

import random

from pyspark.sql import functions as F

from lumenfold.operators import facets

PAGE = "id int, page_type string, above_fold_job string, above_the_fold string, layout_system string, spacing_feel string, vertical_rhythm string, overall_atmosphere string, color_mood string, typography_feel string, media_strategy string, interaction_chrome string, type_image_relationship string, typography_composition string, imagery_craft string, spatial_craft string, chrome_vs_content string, notable_modules array<string>, ux_flow array<string>"
NAMES = [c.split()[0] for c in PAGE.split(", ")]


def _pages(spark, rows):
    return spark.createDataFrame([tuple(r.get(n) for n in NAMES) for r in rows], PAGE)


def test_labels(spark):
    def one(f, text, kind="string"):
        return spark.createDataFrame([(text,)], f"t {kind}").select(f(F.col("t"))).first()[0]

    assert [one(facets.style_label, t) for t in ("Dark premium look", "High-Energy collage", "minimal editorial", "photo wall", "corporate", "nothing", None)] == ["luxury-dark", "high-energy", "editorial", "photographic", "corporate", None, None]
    assert [one(facets.layout_label, t) for t in ("Full_bleed sections", "a split of two", "bento grid", "single-column", "mixed", "odd", None)] == ["full-bleed stacks", "split columns", "card grid", "single column", "mixed", None, None]
    types = {"Home": "corporate_homepage", "brand home": "corporate_homepage", "Terms of use": "legal", "news hub": "newsroom", "corporate landing page": "corporate_landing", "landing": "marketing_landing", "Corporate": "corporate_homepage", "guide": "article", "pdp": "product", "zzz": "other", "  ": None, None: None}
    assert {t: one(facets.page_type, t) for t in types} == types
    assert one(facets.industry_tags, ["Hero", "SaaS", "insurance broker", "tech", "City", "bank"], "array<string>") == ["tech", "insurance", "government"]
    assert one(facets.industry_tags, None, "array<string>") == []


def by_loops(page):
    key = lambda t: " ".join("".join(" " if c in "_|/-" else c for c in t.lower()).split())
    said = lambda fields: key(" ".join(" ".join(v) if isinstance(v, list) else v for f in fields if (v := page.get(f))))
    out = {}
    for facet, (fields, rules, otherwise) in facets.CRAFT.items():
        hay = said(fields)
        out[facet] = next((term for term, phrases in rules if any(p in hay for p in phrases)), otherwise) if hay else None
    hay, tags = said(facets.TAG_FIELDS), []
    for tag in [*[key(m).replace(" ", "_") for m in page.get("notable_modules") or []], *[t for t, phrases in facets.CRAFT_TAGS if any(p in hay for p in phrases)]]:
        if tag and tag not in tags:
            tags.append(tag)
    out["craft_tags"] = tags[:12] if hay else []
    return out


def test_craft_by_plain_loops(spark):
    rng = random.Random(4)
    phrases = [p for _, rules, _ in facets.CRAFT.values() for _, ps in rules for p in ps] + [p for _, ps in facets.CRAFT_TAGS for p in ps] + ["plain words", "other"]
    rows = []
    for i in range(300):
        page: dict = {"id": i}
        for n in NAMES[1:-2]:
            if rng.random() < 0.35:
                page[n] = rng.choice(["", rng.choice(phrases), rng.choice(phrases).upper().replace(" ", "-") + " and " + rng.choice(phrases)])
        if rng.random() < 0.4:
            page["notable_modules"] = rng.choices(["Stats column", "logo wall", "", "Hero", "motion blur"], k=rng.randint(0, 14))
        rows.append(page)
    df = _pages(spark, rows)
    got = df.select("id", *[v.alias(n) for n, v in facets.craft(df).items()]).collect()
    for r in got:
        assert {n: r[n] for n in (*facets.CRAFT, "craft_tags")} == by_loops(rows[r["id"]]), rows[r["id"]]


def test_a_summary_there_and_back(spark):
    page = {"id": 1, "page_type": "landing page", "above_fold_job": "sell one thing", "layout_system": "card grid", "spacing_feel": "airy", "vertical_rhythm": "three bands", "overall_atmosphere": "calm", "color_mood": "muted blue", "typography_feel": "large display", "media_strategy": "few images", "type_image_relationship": "beside", "typography_composition": "tight caps", "ux_flow": ["see", "buy"]}
    df = _pages(spark, [page, {"id": 2}])
    text = df.select("id", facets.summary(df).alias("s"))
    got = {r["id"]: r["s"] for r in text.collect()}
    assert got[1] == "This reads as a landing page. Above the fold job: sell one thing Layout: card grid; airy. Rhythm: three bands Look: calm; muted blue; large display. Media: few images Type/image: beside Type craft: tight caps UX flow: see → buy."
    assert got[2] == "Look: ."
    back = text.filter("id = 1").select(*[v.alias(n) for n, v in facets.summary_fields(F.col("s")).items()]).first().asDict()
    assert back | {"vertical_rhythm": "three bands"} == {n: page[n] for n in ("page_type", "layout_system", "vertical_rhythm", "overall_atmosphere", "color_mood", "typography_feel", "media_strategy", "above_fold_job", "type_image_relationship", "typography_composition")} | {"above_the_fold": "sell one thing", "imagery_craft": "few images", "spatial_craft": "three bands", "chrome_vs_content": "", "typography_feel": "large display."}


def test_facets_of_pages_and_of_summaries(spark):
    full = {"id": 1, "page_type": "Landing", "layout_system": "split", "overall_atmosphere": "editorial calm", "color_mood": " muted  blue ", "media_strategy": "gallery", "notable_modules": ["Stats column", "stats column"]}
    df = _pages(spark, [full, {"id": 2}, {"id": 3}]).withColumn("design_summary", F.when(F.col("id") == 3, "This reads as a news hub. Layout: full bleed; x. Look: brutal; neon; huge. Media: text only"))
    got = {r["id"]: r for r in facets.build_facets(df, ["id"]).collect()}
    one, three = got[1], got[3]
    assert (one["page_type"], one["style"], one["layout"], one["color_mood"], one["imagery_density"], one["modules"]) == ("marketing_landing", "editorial", "split columns", "muted blue", "high", ["Stats column"])
    assert "stats_column" in one["craft_tags"] and one["has_signal"] and not got[2]["has_signal"] and got[2]["craft_tags"] == []
    assert (three["page_type"], three["style"], three["layout"], three["type_scale"], three["contrast_mode"], three["imagery_density"]) == ("newsroom", "brutalist", "full-bleed stacks", "monumental", "saturated", "none")
