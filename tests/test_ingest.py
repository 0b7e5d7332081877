"""Packages as rows of the library: all tables, and the replacement of what a capture had."""

import json

from pyspark.sql import functions as F

from lumenfold.sources import library, packages
from lumenfold.streaming import jobs


def _package(root, name, sections=("hero", "feature"), design=True, ontology=True, **change):
    folder = root / name
    (folder / "derived").mkdir(parents=True, exist_ok=True)
    file = {"path": "a.json", "sha256": "sha256:0", "bytes": 3, "media_type": "application/json"}
    manifest = {"schema_version": "0.1.0", "capture_run_id": f"cap_{name}", "status": "complete", "requested_url": f"https://{name}.example/", "canonical_url": None, "started_at": "2024-01-01T00:00:00Z", "completed_at": "2024-01-01T00:01:00Z", "run_artifacts": {"a": file, "b": file | {"path": "b.json"}}, "errors": [], "interventions": [], "site": {"site_id": "s", "domain": f"{name}.example"}, "page": {"page_id": "p", "route": "/"}, "viewport_captures": [{"viewport_capture_id": f"v_{name}", "name": "desktop", "status": "complete", "node_count": 2, "title": "T", "viewport": {"width": 1200, "height": 800}, "document": {"width": 1200, "height": 3000}, "artifacts": {"viewport_screenshot": file | {"path": "s.png"}}}]}
    (folder / "manifest.json").write_text(json.dumps(manifest | change))
    (folder / "quality.json").write_text(json.dumps({"overall": 0.9, "rating": "good"}))
    box = {"x": 0, "y": 10, "width": 100, "height": 50}
    step = lambda role, y: {"kind": "role", "role": role, "node_id": "n", "box": box | {"y": y}}
    rows = [{"section_id": f"sec_{i}", "viewport_capture_id": f"v_{name}", "viewport_name": "desktop", "root_node_id": "n", "taxonomy_id": f"dig:section.{c}", "category": c, "signature": "heading>body", "confidence": 0.8, "method": "m", "recipe": [step("heading", 10), {"kind": "gap", "gap_px": 24}, step("body", 84), {"kind": "gap", "gap_px": 31}], "text_signals": ["a", "b", "c"]} for i, c in enumerate(sections)]
    document = folder / "derived" / "section-compositions.json"
    document.write_text(json.dumps({"viewports": [{"viewport_capture_id": f"v_{name}", "viewport_name": "desktop", "sections": rows}]}))
    if design:
        said = {"screen_patterns": [{"name": "Landing", "confidence": 0.8, "evidence_refs": ["x"]}], "visual_style_labels": [{"name": "calm", "confidence": 0.5, "evidence_refs": []}], "section_descriptions": [{"section_id": "sec_0", "signature": "heading>body", "category": "hero", "stack_summary": "stack", "look_summary": "look", "interaction_summary": "", "color_notes": None, "confidence": 0.6, "evidence_refs": ["r"]}]}
        (folder / "derived" / "llm-design.json").write_text(json.dumps({"model": "m", "status": "complete", "design_summary": "A calm page", "hypotheses": ["h", "i"], "mobbin": said}))
    else:
        (folder / "derived" / "llm-design.json").unlink(missing_ok=True)
    if ontology:
        entity = {"ontology_entity_id": "ont_1", "source_node_id": "n1", "taxonomy_id": "dig:content.heading", "label": "Heading", "entity_type": "content", "confidence": 0.9, "attributes": {"text": " Hi ", "bbox": box}, "evidence": [{"value": "v"}]}
        (folder / "derived" / "ontology.json").write_text(json.dumps({"viewports": [{"viewport_capture_id": f"v_{name}", "entities": [entity, entity | {"ontology_entity_id": "ont_2", "attributes": {}}, entity | {"label": "Later"}]}]}))


def _library(spark, out):
    return {n: sorted(map(str, (r.asDict() for r in library.stored(spark, out, n).drop("part").collect()))) for n in ("captures", "viewports", "sections", "llm_analyses", "llm_items", "design_nodes", "artifacts", "embeddings", "projects")}


def test_rows_of_a_package(spark, tmp_path):
    _package(tmp_path, "one")
    (tmp_path / "bare").mkdir()
    (tmp_path / "bare" / "manifest.json").write_text(json.dumps({"capture_run_id": "cap_bare", "run_artifacts": {}, "viewport_captures": []}))
    scope = spark.createDataFrame([("cap_one", "p1", "q1")], "capture_run_id string, project_id string, platform_project_id string")
    found = packages.manifests(spark, f"{tmp_path}/*")
    got = {n: df.collect() for n, df in library.tables(found, f"{tmp_path}/*", scope).items()}
    assert {r["capture_run_id"]: (r["quality_overall"], r["quality_rating"], r["project_id"]) for r in got["captures"]} == {"cap_one": (0.9, "good", "p1"), "cap_bare": (None, None, None)}
    (v,) = got["viewports"]
    assert (v["settled_screenshot_path"], v["full_page_screenshot_path"], v["document_height"], v["node_count"]) == ("s.png", None, 3000.0, 2)
    assert [(s["section_id"], s["viewport_width"], tuple(s["root_box"])) for s in sorted(got["sections"], key=lambda s: s["ordinal"])] == [("sec_0", 1200.0, (0.0, 10.0, 100.0, 124.0)), ("sec_1", 1200.0, (0.0, 10.0, 100.0, 124.0))]
    assert got["llm_analyses"][0]["hypothesis_count"] == 2
    items = {(r["kind"], r["place"]): r for r in got["llm_items"]}
    assert set(items) == {("screen_pattern", 0), ("visual_style", 0), ("section_look", 0), ("recipe_insight", 0), ("recipe_insight", 1), ("page_flow", 0), ("page_flow", 1)}
    assert items["section_look", 0]["interpretation"] == "stack · look"
    assert (items["recipe_insight", 1]["interpretation"], items["recipe_insight", 1]["evidence_refs"]) == ("heading → body; gaps ~28px", ["dig:section.feature", "a", "b"])
    assert (items["page_flow", 0]["section_label"], items["page_flow", 0]["step_index"]) == ("hero · heading>body", 1)
    assert {(r["ontology_entity_id"], r["label"], r["text_preview"]) for r in got["design_nodes"]} == {("ont_1", "Later", "Hi"), ("ont_2", "Heading", "v")}
    assert {r["path"] for r in got["artifacts"]} == {"a.json", "b.json", "s.png"}
    kinds = sorted(r["kind"] for r in got["embeddings"])
    assert kinds == ["capture_summary"] + ["design_node"] * 2 + ["llm_item"] * 7 + ["section"] * 2
    summary = next(r for r in got["embeddings"] if r["kind"] == "capture_summary")
    assert summary["content_text"] == "A calm page" and abs(sum(v * v for v in summary["embedding"].values()) - 1) < 1e-9


def test_a_second_ingest_leaves_no_old_row(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    scope = spark.createDataFrame([("cap_one", "p1", "q1"), ("cap_two", "p1", None)], "capture_run_id string, project_id string, platform_project_id string")
    for name in ("one", "two", "three"):
        _package(root, name)
    assert library._one_glob(["file:/a/x", "file:/a/y/z"]) == "file:/a/{x,y/z}" and library._one_glob(["s://b/x"]) == "s://b/x"
    library.replace_captures(packages.manifests(spark, f"{root}/*"), out, scope, parts=2)
    before = _library(spark, out)
    library.replace_captures(packages.manifests(spark, f"{root}/*"), out, scope, parts=2)
    assert _library(spark, out) == before
    _package(root, "one", sections=(), design=False, requested_url="https://other.example/", status="failed", completed_at="2024-03-01T00:00:00Z")
    library.replace_captures(packages.manifests(spark, f"{root}/one"), out, None, parts=2)
    captures = {r["capture_run_id"]: r for r in library.stored(spark, out, "captures").collect()}
    one = captures["cap_one"]
    assert (one["status"], one["requested_url"], one["project_id"], len(captures)) == ("failed", "https://one.example/", "p1", 3)
    count = lambda t: {r["capture_run_id"]: r["count"] for r in library.stored(spark, out, t).groupBy("capture_run_id").count().collect()}
    assert count("sections") == {"cap_two": 2, "cap_three": 2} == count("sections") and set(count("llm_items")) == {"cap_two", "cap_three"}
    assert count("design_nodes") == {"cap_one": 2, "cap_two": 2, "cap_three": 2}
    (p,) = library.stored(spark, out, "projects").collect()
    assert (p["project_id"], p["captures"], str(p["last_activity"])) == ("p1", 2, "2024-03-01 00:00:00")


def test_a_part_that_is_left_empty_goes(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    _package(root, "one")
    library.replace_captures(packages.manifests(spark, f"{root}/*"), out, parts=1)
    _package(root, "one", sections=())
    library.replace_captures(packages.manifests(spark, f"{root}/*"), out, parts=1)
    left = library.stored(spark, out, "sections")
    assert left is None or left.count() == 0
    assert library.stored(spark, out, "captures").count() == 1


def test_ingest_from_a_stream(spark, tmp_path):
    root, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    _package(root, "one")
    _package(root, "two")
    jobs.ingest(library.manifest_stream(spark, f"{root}/*", 1), out, check)
    assert {r[0] for r in library.stored(spark, out, "captures").select("capture_run_id").collect()} == {"cap_one", "cap_two"}
    _package(root, "three")
    jobs.ingest(library.manifest_stream(spark, f"{root}/*", 100), out, check)
    assert library.stored(spark, out, "sections").count() == 6 and library.stored(spark, out, "captures").filter(F.col("quality_rating") == "good").count() == 3
