"""What vision adds to looks, and rhythms, on small rows."""

from pyspark.sql import functions as F

from lumenfold.operators import visions

LOOK = "page int, section_id string, ordinal int, category string, signature string, confidence double, stack_summary string, look_summary string, media_role string, role_notes array<struct<role:string,notes:string>>, evidence_refs array<string>"


def _look(i, category="content", signature="heading>body", sure=0.9, look="a look", role=None, notes=None, refs=None):
    return (1, f"s{i}", i, category, signature, sure, "stack", look, role, notes, refs if refs is not None else ["e"])


def test_gate(spark):
    cases = [(_look(0), None, "no_crop"), (_look(1, look="Accept all cookies"), "p", "consent_overlay"), (_look(2, notes=[("x", "manage cookies")]), "p", "consent_overlay"), (_look(3, signature="Media"), "p", "thin_signature"), (_look(4, sure=0.6), "p", "low_confidence"), (_look(5, "Hero band", role="inline"), "p", "high_value_media"), (_look(6, "pricing conversion"), "p", "high_value_category"), (_look(7), "p", "text_css_sufficient"), (_look(8, None, None, None), "p", "text_css_sufficient")]
    looks = spark.createDataFrame([c[0] for c in cases], LOOK)
    crops = spark.createDataFrame([(1, c[0][1], c[1]) for c in cases], "page int, section_id string, path string")
    rows = looks.join(crops, ["page", "section_id"]).select("section_id", visions.vision_gate(looks, F.col("path")).alias("g")).collect()
    assert {r["section_id"]: r["g"]["reason"] for r in rows} == {c[0][1]: c[2] for c in cases}
    chosen = visions.gated_looks(looks, crops, ["page"], 3).orderBy("rank").collect()
    assert [(r["section_id"], r["rank"]) for r in chosen] == [("s3", 1), ("s4", 2), ("s5", 3)]


def test_merge(spark):
    looks = spark.createDataFrame([_look(0, notes=[("a", "b")] * 9, refs=["r"] * 15), _look(1, look="x" * 950), _look(2), _look(3, sure=0.94)], LOOK)
    seen = spark.createDataFrame([(1, "s0", "complete", "wide", "calm", "a car", None, "pill", "c/0", 0.5), (1, "s1", "complete", "w", None, None, None, None, None, None), (1, "s2", "failed", "w", None, None, None, None, "c", 0.1), (1, "s3", "complete", "", "", None, None, None, "", 0.99)], "page int, section_id string, status string, composition string, atmosphere string, media_subject string, overlay string, cta_chrome string, crop_path string, confidence double")
    got = {r["section_id"]: r for r in visions.merge_visions(looks, seen, ["page"]).collect()}
    assert got["s0"]["look_summary"] == "a look Vision: wide Atmosphere: calm Media: a car CTA: pill" and len(got["s0"]["role_notes"]) == 10 and tuple(got["s0"]["role_notes"][9]) == ("media", "vision:a car")
    assert got["s0"]["evidence_refs"] == ["r"] * 15 + ["crop:c/0"] and abs(got["s0"]["confidence"] - 0.93) < 1e-9
    assert len(got["s1"]["look_summary"]) == 900 and got["s1"]["evidence_refs"] == ["e", "vision_section"]
    assert (got["s2"]["look_summary"], got["s2"]["evidence_refs"], got["s2"]["confidence"]) == ("a look", ["e"], 0.9)
    assert got["s3"]["look_summary"] == "a look" and got["s3"]["confidence"] == 0.95
    v = spark.createDataFrame([("complete", "g", ["Alle akzeptieren"], None, None, None), ("complete", "g", None, None, "wide", None), ("failed", "g", ["cookie"], None, None, None)], "status string, gate_reason string, visible_text array<string>, cta_chrome string, composition string, media_subject string")
    assert sorted(tuple(r)[:2] for r in visions.settled_visions(v).collect()) == [("complete", "g"), ("failed", "g"), ("skipped", "consent_overlay_vision")]


def test_rhythms(spark):
    bands = spark.createDataFrame([(1, 1, "Nav", "nav", 0.0, 0.05), (1, 2, "Card wall", "hero", 0.05, 0.4), (1, 3, "Features", "feature", 0.5, 0.2), (1, 4, "End", "footer", 0.9, 0.1), (2, 1, "Media top", "content", 0.1, 0.1)], "page int, place int, label string, category string, y double, height double")
    got = {r["page"]: r for r in visions.vision_rhythm(bands, ["page"]).collect()}
    one, two = got[1], got[2]
    assert (one["page_arc"], one["ingredients"], one["summary"], one["above_height"]) == ("nav → hero → feature → footer", ["chrome", "media", "headline"], "nav → hero", 0.45)
    assert one["avoid"] == ["collapse the above-fold into a compact card row", "single-column card kit for the whole page", "bury navigation inside the hero", "omit a distinct footer band", "replace the cinematic opening with a text-only hero", "feature grid inside the hero"]
    assert [b["zone"] for b in one["bands"]] == ["above_fold", "above_fold", "mid", "below"]
    assert (two["ingredients"], two["avoid"], two["summary"]) == (["media"], [], "content")
    spine = spark.createDataFrame([(1, 1, "hero", "media>cta", "above_fold", 0.0, 600.0), (1, 2, "content", "body", "below", 600.0, 400.0)], "page int, band long, category string, signature string, zone string, y double, height double")
    told = spark.createDataFrame([(1, "hero → content", ["media", "headline"], "hero(media>cta)")], "page int, page_arc string, ingredients array<string>, summary string")
    r = visions.spine_rhythm(spine, told, ["page"]).first()
    assert [b["height"] for b in r["bands"]] == [0.6, 0.4] and r["above_height"] == 0.6 and r["avoid"][:2] == ["card grid in the hero", "short marketing-kit banner instead of the measured opening"]


def test_settled_categories(spark):
    rows = [("social_proof", "body", ["Reviews"]), ("social_proof", "body", ["x"]), ("commerce", "unknown", []), ("commerce", "heading", []), ("conversion", "body", ["5 €"]), (None, "body", ["x"])]
    df = spark.createDataFrame(rows, "c string, s string, t array<string>")
    assert [r[0] for r in df.select(visions.settled_category(F.col("c"), F.col("s"), F.col("t"))).collect()] == ["social_proof", "content", "content", "commerce", "conversion", None]
