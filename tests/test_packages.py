import hashlib
import json

from pyspark.sql import functions as F

from lumenfold.operators import nodes
from lumenfold.sources import packages


def _package(root, name, **change):
    folder = root / name
    folder.mkdir(parents=True)
    data = b'{"node_id":"n1"}\n{"node_id":"n2","parent_node_id":"n1"}\n'
    (folder / "nodes.jsonl").write_bytes(data)
    artifact = {"path": "nodes.jsonl", "sha256": "sha256:" + hashlib.sha256(data).hexdigest(), "bytes": len(data), "media_type": "application/jsonl"}
    manifest = {"schema_version": "0.1.0", "capture_run_id": f"cap_{name}", "status": "complete", "run_artifacts": {}, "errors": [], "interventions": [], "site": {"site_id": "s", "domain": "a.example"}, "page": {"page_id": "p", "route": "/"}, "viewport_captures": [{"viewport_capture_id": "v1", "name": "desktop", "status": "complete", "node_count": 2, "viewport": {"width": 1200, "height": 800}, "artifacts": {"nodes": artifact}}]}
    manifest |= change.pop("manifest", {})
    artifact |= change
    (folder / "manifest.json").write_text(json.dumps(manifest))


def test_packages(spark, tmp_path):
    _package(tmp_path, "good")
    _package(tmp_path, "hash", sha256="sha256:0")
    _package(tmp_path, "size", bytes=1)
    _package(tmp_path, "escape", path="../good/nodes.jsonl")
    _package(tmp_path, "gone", path="lost.jsonl")
    _package(tmp_path, "partial", sha256=None)
    _package(tmp_path, "version", manifest={"schema_version": "9"})
    _package(tmp_path, "name", manifest={"capture_run_id": "x"})
    _package(tmp_path, "structure", manifest={"errors": None})
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "manifest.json").write_text("{not json")
    found = packages.manifests(spark, f"{tmp_path}/*").cache()
    listed = packages.artifacts(found)
    issues = packages.all_issues(packages.structure_issues(found), packages.artifact_issues(listed, packages.hashes(spark, str(tmp_path))))
    got = {r["package"].rsplit("/", 1)[-1]: r["code"] for r in issues.collect()}
    assert got == {"hash": "artifact_hash_mismatch", "size": "artifact_size_mismatch", "escape": "artifact_path_escape", "gone": "artifact_unreadable", "partial": "invalid_artifact_reference", "version": "unsupported_schema_version", "name": "invalid_capture_run_id", "structure": "manifest_invalid_structure", "broken": "manifest_unreadable"}
    valid = {r["package"].rsplit("/", 1)[-1] for r in packages.report(found, listed, issues).collect() if r["valid"]}
    assert valid == {"good"}
    lines = packages.records(spark, f"{tmp_path}/good/nodes.jsonl", packages.NODE)
    assert packages.dangling_issues(lines, lines, "file", "parent_node_id", "node_id", "node_parent_missing").count() == 0
    assert packages.duplicate_issues(lines.unionByName(lines), "file", "node_id", "duplicate_node_id").count() == 2


def test_catalog_and_taxonomy(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"id": "c", "entries": [{"rank": 1, "id": "a", "name": "A", "group": "g", "country": "DE", "url": "https://a.example"}]}))
    assert packages.catalog_entries(spark, f"{tmp_path}/*.json").first()["url"] == "https://a.example"
    schema = "taxonomy_id string, entity_type string, label string, category string"
    core, more = spark.createDataFrame([("t1", "page", "A", "x"), ("t2", "page", "B", "x")], schema), spark.createDataFrame([("t2", "page", "C", None), ("t3", "page", "D", "y")], schema)
    assert {r["taxonomy_id"]: (r["label"], r["category"]) for r in packages.taxonomy(core, more).collect()} == {"t1": ("A", "x"), "t2": ("C", "x"), "t3": ("D", "y")}


HTML = """<html><head><title>T</title></head><body><nav aria-label="Breadcrumb"><a href="/x">X</a></nav>
<section><h1>Hi</h1><p>one<p>two<button>Go</button></section>
<form role="search"><label for="q">Q</label><input id="q"><label>In <select></select></label></form><div hidden><p>no</p></div></body></html>"""


def test_nodes_and_ontology(spark):
    pages = spark.createDataFrame([(1, HTML), (2, None)], "page_id long, html string")
    n = nodes.page_nodes(pages).cache()
    tags = {r["tag"]: r["node_id"] for r in n.collect()}
    closure = nodes.ancestors(n)
    # brute force
    parent = {r["node_id"]: r["parent_id"] for r in n.collect()}
    want = set()
    for i in parent:
        at, depth = parent[i], 1
        while at is not None:
            want.add((i, at, depth))
            at, depth = parent[at], depth + 1
    assert {(r["node_id"], r["ancestor_id"], r["depth"]) for r in closure.collect()} == want
    found = nodes.entities(n)
    terms = {(r["node_id"], r["taxonomy_id"]) for r in found.collect()}
    assert (tags["nav"], "dig:pattern.breadcrumb") in terms and (tags["form"], "dig:component.search") in terms
    assert sum(t == "dig:content.body_text" for _, t in terms) == 2  # the hidden one isn't there
    boxes = n.select("capture", "node_id", F.lit(10.0).alias("y"))
    hero = nodes.heroes(n, closure, boxes, F.lit(800.0))
    assert [r["node_id"] for r in hero.collect()] == [tags["section"]]
    assert [r["node_id"] for r in nodes.primary_actions(n, closure, hero).collect()] == [tags["button"]]
    every = found.unionByName(hero)
    assert nodes.page_types(every).first()["taxonomy_id"] == "dig:page.landing"
    placed = nodes.with_parents(every, closure)
    rel = nodes.relationships(placed, n, closure)
    assert {r["type"]: r["count"] for r in rel.groupBy("type").count().collect()}["labels"] == 2
    by_id = {r["entity_id"]: r["taxonomy_id"] for r in placed.collect()}
    link = next(r for r in placed.collect() if r["taxonomy_id"] == "dig:component.link")
    assert by_id[link["parent_entity_id"]] == "dig:region.navigation"
