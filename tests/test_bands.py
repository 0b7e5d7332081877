"""Bands, picks and classes of sections against plain loops and worked examples."""

import random

from pyspark.sql import functions as F

from lumenfold.functions import looks
from lumenfold.operators import bands, sections

SCHEMA = "page long, place long, band_id string, label string, category string, confidence double, y double, height double"


def made(spark, rows):
    return spark.createDataFrame([(p, i, f"b{i}", label, kind, sure, y, h) for i, (p, label, kind, sure, y, h) in enumerate(rows)], SCHEMA)


def listed(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy("page", "place").collect()]


def test_a_chain_of_overlaps_is_held_against_the_last_that_stays(spark):
    rows = [(1, "a", "hero", 0.5, 0.0, 0.3), (1, "b", "hero", 0.9, 0.1, 0.3), (1, "c", "nav", 0.7, 0.25, 0.3), (1, "d", "hero", 0.9, 0.6, 0.2), (1, "Cookie settings", "nav", 1.0, 0.0, 0.9), (1, "e", "nav", 0.9, 0.62, 0.2), (2, "f", "hero", 0.1, 0.5, 0.1)]
    # b is surer than a; c overlaps b by half, and is less sure; d is apart; e begins close to d, as sure and as high
    assert listed(bands.merge_bands(made(spark, rows), ["page"]), "page", "label", "category") == [(1, "b", "hero"), (1, "d", "feature"), (2, "f", "hero")]
    many = [(3, str(i), "nav", 0.5, i / 40, 0.02) for i in range(40)]
    # each begins close to the one before, but every other one not to the last that stays
    assert [x for (x,) in listed(bands.merge_bands(made(spark, many), ["page"]), "label")] == [str(i) for i in range(0, 24, 2)]
    apart = [(3, str(i), "nav", 0.5, i / 20, 0.02) for i in range(20)]
    assert [x for (x,) in listed(bands.merge_bands(made(spark, apart), ["page"]), "label")] == [str(i) for i in range(12)]


def test_normalised_bands(spark):
    raw = spark.createDataFrame(
        [(1, 1, None, "  ", "HERO", None, 0.5, 0.2), (1, 2, "x y", "Cookie consent", "nav", "1", 0.0, 0.5), (1, 3, "a  b", None, "hero", "7", 0.9, 0.4), (1, 4, "n", "n", "odd", "x", float("nan"), 0.06), (1, 5, "low", "low", "nav", "1", 0.2, 0.049), (2, 1, "n", "z" * 100, None, "-1", -3.0, 9.0)],
        "page long, ordinal long, id string, label string, category string, confidence string, y double, height double",
    ).withColumn("confidence", F.expr("try_cast(confidence AS DOUBLE)"))
    got = listed(bands.normalise_bands(raw, ["page"]), "page", "band_id", "label", "category", "confidence", "y", "height")
    assert [(*g[:5], round(g[5], 6), round(g[6], 6)) for g in got] == [(1, "n", "n", "other", 0.6, 0.0, 0.06), (1, "band_1", "Band 1", "hero", 0.6, 0.5, 0.2), (1, "a_b", "a  b", "feature", 1.0, 0.9, 0.1), (2, "n", "z" * 80, "other", 0.0, 0.0, 1.0)]


def refined(found):
    """The refinement by plain loops over [y, height]."""
    cut = lambda v: max(0.0, min(1.0, v))
    out = [list(b) for b in sorted(found, key=lambda b: (b[0], -b[1]))]
    if 0 < out[0][0] <= bands.CHROME:
        out[0] = [0.0, cut(out[0][1] + out[0][0])]
    for a, b in zip(out, out[1:], strict=False):
        gap = b[0] - (a[0] + a[1])
        if 0 < gap <= bands.SNAP:
            if a[1] <= b[1]:
                a[1] = cut(a[1] + gap)
            else:
                b[:] = [cut(a[0] + a[1]), cut(b[1] + gap)]
    rest = 1 - sum(out[-1])
    if 0 < rest <= bands.SNAP:
        out[-1][1] = cut(out[-1][1] + rest)
    kept = []
    for b in out:
        if b[1] < bands.SLIVER and kept:
            kept[-1][1] = cut(max(sum(kept[-1]), sum(b)) - kept[-1][0])
        else:
            kept.append(b)
    if len(kept) > 1 and kept[0][1] < bands.SLIVER:
        a, b = kept[:2]
        top = min(a[0], b[0])
        kept[:2] = [[top, cut(max(sum(a), sum(b)) - top)]]
    for i, b in enumerate(kept):
        lack = bands.LEAST - b[1]
        if lack <= 0:
            continue
        if i + 1 < len(kept) and kept[i + 1][1] > bands.LEAST + lack:
            end = sum(kept[i + 1])
            b[1] = bands.LEAST
            kept[i + 1] = [b[0] + bands.LEAST, cut(end - (b[0] + bands.LEAST))]
        elif i and kept[i - 1][1] > bands.LEAST + lack:
            start, bottom = max(kept[i - 1][0] + bands.LEAST, b[0] - lack), sum(b)
            kept[i - 1][1] = cut(start - kept[i - 1][0])
            b[:] = [start, cut(max(bands.LEAST, bottom - start))]
    for a, b in zip(kept, kept[1:], strict=False):
        over = sum(a) - b[0]
        if over > 0 and a[1] >= b[1]:
            a[1] = max(bands.SLIVER, a[1] - over)
        elif over > 0:
            bottom = sum(b)
            b[:] = [sum(a), max(bands.SLIVER, bottom - sum(a))]
    return [(round(cut(y), 9), round(cut(h), 9)) for y, h in kept]


def test_refined_bands_by_plain_loops(spark):
    rng = random.Random(5)
    pages = {}
    for p in range(300):
        y, found = rng.choice([0.0, 0.05, 0.2]), []
        for _ in range(rng.randint(1, 12)):
            h = rng.choice([0.01, 0.02, 0.03, 0.039, 0.05, 0.12, 0.2])
            found.append((round(y, 4), h))
            y += h + rng.choice([-0.05, 0, 0, 0.01, 0.04, 0.1])
            y = min(max(y, 0.0), 1.0)
        pages[p] = found
    got: dict = {}
    for r in bands.refine_bands(made(spark, [(p, "x", "nav", 0.5, y, h) for p, f in pages.items() for y, h in f]), ["page"]).orderBy("page", "place").collect():
        got.setdefault(r["page"], []).append((round(r["y"], 9), round(r["height"], 9)))
        assert r["band_id"] == f"band_{len(got[r['page']])}" and r["place"] == len(got[r["page"]])
    assert got == {p: refined(f) for p, f in pages.items()}
    assert bands.refine_bands(made(spark, []), ["page"]).collect() == []


def test_looks_of_bands(spark):
    b = made(spark, [(1, "Top", "hero", 0.9, 0.0, 0.5), (1, "End", "footer", 0.9, 0.5, 0.5)])
    crops = spark.createDataFrame([(1, "b0", "c/0.webp")], "page long, band_id string, path string")
    rows = {r["section_id"]: r for r in bands.band_looks(b, ["page"], crops).collect()}
    assert rows["b0"]["evidence_refs"] == ["c/0.webp", "vision_layout:b0"] and rows["b0"]["media_notes"] == "crop c/0.webp" and rows["b0"]["media_role"] == "hero"
    assert rows["b1"]["evidence_refs"] == ["vision_layout:b1"] and rows["b1"]["look_summary"] == 'Vision-detected footer section labeled "End". Full-width band y=0.50 h=0.50.'


def picked(rows, most):
    """Greedy choice over (id, category, signature, y, score, ordinal)."""
    out = []
    for r in sorted(rows, key=lambda r: (-r[4], r[5])):
        hero = "hero" in r[1]
        if len(out) >= most or any(o[0] == r[0] for o in out) or (hero and any("hero" in o[1] for o in out)):
            continue
        if sum(o[1] == r[1] for o in out) >= max(2, -(-most // 3)) or sum(o[2] == r[2] for o in out) >= max(2, -(-most // 5)):
            continue
        if (hero or r[2] == "media") and any(abs(o[3] - r[3]) < 120 for o in out):
            continue
        out.append(r)
    return [o[0] for o in out]


def _sections(spark, rows):
    schema = "page long, section_id string, ordinal long, category string, taxonomy_id string, signature string, text_signals array<string>, confidence double, viewport_name string, steps array<struct<role:string,text:string,box:struct<x:double,y:double,width:double,height:double>>>"
    return spark.createDataFrame(rows, schema)


def test_picks_by_plain_loops(spark):
    rng = random.Random(2)
    rows = []
    for page in range(40):
        for i in range(rng.randint(0, 40)):
            box = {"x": 0.0, "y": float(rng.randint(0, 60) * 50), "width": 900.0, "height": 400.0}
            rows.append((page, f"s{rng.randint(0, 30)}", i, rng.choice(["hero", "feature", "content", "pricing", "nav"]), "dig:section.generic", rng.choice(["media", "heading>body", "media>heading>cta", "list", "media_large>cta"]), ["words"], rng.choice([0.5, 0.7, 0.9]), rng.choice(["desktop", "mobile"]), [("body", "x", box)]))
    df = _sections(spark, rows)
    scored = {(r["page"], r["ordinal"]): (r["section_id"], r["category"], r["kind"], r["band_y"], r["score"], r["ordinal"]) for r in sections.look_scores(df, ["page"]).collect()}
    for most in (3, 14):
        got: dict = {}
        for r in sections.pick_sections(df, ["page"], most).orderBy("page", "pick").collect():
            got.setdefault(r["page"], []).append(r["section_id"])
        want = {p: picked([v for (q, _), v in scored.items() if q == p], most) for p in range(40)}
        assert got == {p: w for p, w in want.items() if w}


def test_scores_and_skips(spark):
    box = lambda y, h: [("body", "x", {"x": 0.0, "y": y, "width": 900.0, "height": h})]
    rows = [(1, "a", 0, "hero", "dig:section.hero", "media>heading>cta", ["hi"], 0.8, "desktop", box(0.0, 600.0)), (1, "b", 1, "content", "t", "body", ["x"], 0.5, "mobile", box(600.0, 3000.0)), (1, "c", 2, "content", "t", "body", ["accept all cookies"], 0.5, "tablet", box(0.0, 80.0)), (1, "d", 3, "social_proof", "t", "list", None, 0.5, None, [])]
    got = {r["section_id"]: (r["score"], r["skip"]) for r in sections.look_scores(_sections(spark, rows), ["page"]).collect()}
    assert got["a"] == (6.3, False)
    assert got["b"][1] and got["c"][1] and got["d"] == (0.15, False)


def test_every_rule_of_the_classifier(spark):
    b = lambda y, w, h: {"x": 0.0, "y": float(y), "width": float(w), "height": float(h)}
    cases = [
        ("header", b(0, 900, 80), "body", "", ("global_nav", "nav", 0.9)), ("div", b(100, 900, 80), "nav", "", ("global_nav", "nav", 0.9)), ("footer", b(3000, 900, 80), "body", "", ("footer", "nav", 0.88)), ("div", b(1000, 900, 300), "nav>list", "", ("footer", "nav", 0.88)),
        ("div", b(500, 900, 300), "form", "Subscribe now", ("cta_newsletter", "form", 0.82)), ("div", b(500, 900, 300), "form", "get a demo by email", ("cta_demo", "form", 0.82)), ("div", b(500, 900, 300), "form", "contact", ("contact", "form", 0.82)), ("div", b(500, 900, 300), "form", "log in", ("lead_form", "form", 0.82)),
        ("div", b(500, 900, 300), "heading>list", "Häufige FAQ", ("faq", "content", 0.84)), ("div", b(500, 900, 300), "heading>cta", "9 € a month", ("pricing", "commerce", 0.83)), ("div", b(500, 900, 300), "body", "Trusted by all", ("testimonials", "social_proof", 0.8)), ("div", b(500, 900, 300), "body", "Alle akzeptieren", ("cookie_consent", "cookie_consent", 0.9)),
        ("div", b(0, 1200, 600), "media>heading>cta", "", ("hero_media_above", "hero", 0.86)), ("div", b(0, 1200, 600), "heading>media>cta", "", ("hero_split_cta", "hero", 0.86)), ("div", b(0, 1200, 600), "media", "", ("hero_media_above", "hero", 0.8)), ("div", b(0, 1200, 600), "body>media>cta", "", ("hero", "hero", 0.86)), ("div", b(0, 1200, 600), "body>media", "", ("hero_centered", "hero", 0.8)),
        ("div", b(0, 500, 200), "heading>media>cta", "", ("hero_split_cta", "hero", 0.86)), ("div", b(300, 500, 300), "media>heading", "", ("feature_spotlight", "feature", 0.74)), ("div", b(300, 500, 300), "media", "", ("feature_grid", "feature", 0.74)), ("div", b(900, 500, 100), "media>heading>cta", "", ("feature_spotlight", "feature", 0.78)), ("div", b(900, 500, 300), "media", "", ("feature_spotlight", "feature", 0.72)),
        ("div", b(900, 500, 300), "heading>list", "", ("feature_grid", "feature", 0.74)), ("div", b(900, 500, 300), "heading>cta", "", ("cta_band", "conversion", 0.76)), ("div", b(900, 500, 300), "heading>body", "", ("content_block", "content", 0.7)), ("article", b(900, 500, 300), "unknown", "", ("article", "content", 0.8)), (None, b(900, 500, 300), "unknown", None, ("content_block", "content", 0.55)),
    ]
    schema = "i int, tag string, box struct<x:double,y:double,width:double,height:double>, media_box struct<x:double,y:double,width:double,height:double>, signature string, text_signals array<string>"
    df = spark.createDataFrame([(i, tag, box, None, sig, None if said is None else [said]) for i, (tag, box, sig, said, _) in enumerate(cases)], schema)
    got = {r["i"]: (r["taxonomy_id"].removeprefix("dig:section."), r["category"], r["confidence"]) for r in sections.classify_sections(df, F.lit(900.0)).collect()}
    assert got == {i: c[-1] for i, c in enumerate(cases)}


def test_hints_of_a_catalog(spark):
    hints = spark.createDataFrame([("dig:a", "section", "social_proof", 1, ["media"]), ("dig:b", "section", "hero", 2, ["media", "body"]), ("dig:c", "pattern", "content", 3, ["media_large", "body"]), ("dig:d", "component", "content", 0, ["media", "body"]), ("dig:e", "section", "commerce", 4, ["body"])], "entry_id string, entity_type string, category string, place int, hint array<string>")
    box = lambda y, h: {"x": 0.0, "y": float(y), "width": 100.0, "height": float(h)}
    schema = "i int, tag string, box struct<x:double,y:double,width:double,height:double>, media_box struct<x:double,y:double,width:double,height:double>, signature string, text_signals array<string>"
    df = spark.createDataFrame([(0, "div", box(0, 100), None, "media>body", ["x"]), (1, "div", box(900, 100), None, "media>body", ["x"]), (2, "div", box(900, 100), None, "media", ["x"]), (3, "div", box(900, 100), None, "body", ["x"]), (4, "div", box(900, 100), None, "body", ["warenkorb"])], schema)
    got = {r["i"]: (r["taxonomy_id"], round(r["confidence"], 6)) for r in sections.classify_sections(df, F.lit(900.0), hints).collect()}
    # a hero only above the fold; media alone is social proof only further down; a bare body is commerce only if it says so
    assert got == {0: ("dig:b", 0.9), 1: ("dig:a", 0.9), 2: ("dig:a", 0.9), 3: ("dig:section.content_block", 0.55), 4: ("dig:e", 0.9)}
    score = lambda sig, hint: spark.range(1).select(sections.hint_score(F.split(F.lit(sig), ">"), F.split(F.lit(hint), ">"))).first()[0]
    assert abs(score("a>c", "a>b>c") - 2 / 3) < 1e-9 and score("media>cta", "media_large>cta_pair") == 1.15 and score("b>a", "a>b") == 0.5
