"""Packages as rows of the library, and the library's tables as Parquet that a capture's rows are replaced in.

Tables: captures, viewports, sections, llm_analyses, llm_items, design_nodes, artifacts, embeddings, projects. All have
capture_run_id, but for projects, which are counted from the captures.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import vectors
from lumenfold.functions.lineage import written
from lumenfold.functions.looks import union_box
from lumenfold.operators.library import subjects
from lumenfold.operators.sections import measured_recipes
from lumenfold.sources import packages

_BOX = "struct<x:double,y:double,width:double,height:double>"
_NAMED = "array<struct<name:string,confidence:double,evidence_refs:array<string>>>"
#: The documents of a package and their fields.
QUALITY = "overall double, rating string"
SECTIONS = f"viewports array<struct<viewport_capture_id:string,viewport_name:string,sections:array<struct<section_id:string,viewport_capture_id:string,viewport_name:string,root_node_id:string,taxonomy_id:string,category:string,signature:string,confidence:double,method:string,recipe:array<struct<kind:string,role:string,node_id:string,text_preview:string,box:{_BOX},gap_px:double>>,text_signals:array<string>>>>>"
DESIGN = f"""model string, base_url string, status string, analysis_mode string, design_summary string, hypotheses array<string>, raw_response_sha256 string, generated_at timestamp,
 mobbin struct<screen_patterns:{_NAMED},ui_elements:{_NAMED},visual_style_labels:{_NAMED},recipe_insights:array<struct<signature:string,category:string,interpretation:string,evidence_refs:array<string>>>,page_flow:array<struct<step:long,section_label:string,signature:string>>,
 section_descriptions:array<struct<section_id:string,signature:string,category:string,stack_summary:string,look_summary:string,interaction_summary:string,color_notes:string,confidence:double,evidence_refs:array<string>>>>"""
ONTOLOGY = f"viewports array<struct<viewport_capture_id:string,entities:array<struct<ontology_entity_id:string,source_node_id:string,taxonomy_id:string,label:string,entity_type:string,confidence:double,attributes:struct<text:string,name:string,box:{_BOX},bbox:{_BOX}>,evidence:array<struct<value:string>>>>>>"
DOCUMENTS = {"quality": ("quality.json", QUALITY), "sections": ("derived/section-compositions.json", SECTIONS), "design": ("derived/llm-design.json", DESIGN), "ontology": ("derived/ontology.json", ONTOLOGY)}
#: Parts that the rows of each table are dealt into by their capture; a replacement rewrites the parts that it touches.
PARTS = 256


def document(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """(package, the document's fields) of the packages below `root` that have a document of this kind; none is no error."""
    path, schema = DOCUMENTS[kind]
    try:
        rows = spark.read.schema(schema).option("multiLine", True).json(f"{root}/{path}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"package string, {schema}")
    folder = F.regexp_replace(F.col("_metadata.file_path"), f"/{path}$", "")
    return rows.select(folder.alias("package"), *rows.columns)


def _items(ids: DataFrame, kind: str, column: str, fields: dict, design: DataFrame) -> DataFrame:
    """Rows of one kind of what a model said, with their place; `fields` gives columns of an element e."""
    names = ("name", "signature", "category", "interpretation", "section_label")
    flat = design.select("package", F.posexplode(f"mobbin.{column}").alias("place", "e")).join(ids, "package")
    values = [fields.get(n, F.lit(None)).cast("string").alias(n) for n in names]
    return flat.select("capture_run_id", F.lit(kind).alias("kind"), F.col("place").cast("long").alias("place"), *values, fields.get("step", F.lit(None)).cast("long").alias("step_index"), fields.get("confidence", F.lit(None)).cast("double").alias("confidence"), F.coalesce(fields.get("refs", F.lit(None)), F.array()).cast("array<string>").alias("evidence_refs"))


def llm_items(ids: DataFrame, design: DataFrame, sections: DataFrame) -> DataFrame:
    """What a model said of captures, by kind and place; recipes and steps that it left out are those that were measured."""
    e = lambda n: F.col(f"e.{n}")
    named = {"name": e("name"), "confidence": e("confidence"), "refs": e("evidence_refs")}
    told = F.substring(F.concat_ws(" · ", *[F.when(e(n) != "", e(n)) for n in ("stack_summary", "look_summary", "interaction_summary", "color_notes")]), 1, 1600)
    parts = [
        _items(ids, "screen_pattern", "screen_patterns", named, design),
        _items(ids, "ui_element", "ui_elements", named, design),
        _items(ids, "recipe_insight", "recipe_insights", {"name": e("signature"), "signature": e("signature"), "category": e("category"), "interpretation": e("interpretation"), "confidence": F.lit(0.7), "refs": e("evidence_refs")}, design),
        _items(ids, "page_flow", "page_flow", {"section_label": e("section_label"), "signature": e("signature"), "step": e("step")}, design),
        _items(ids, "visual_style", "visual_style_labels", named, design),
        _items(ids, "section_look", "section_descriptions", {"name": e("section_id"), "signature": e("signature"), "category": e("category"), "interpretation": told, "confidence": e("confidence"), "refs": e("evidence_refs")}, design),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    analysed = design.select("package").join(ids, "package").select("capture_run_id")
    measured = sections.join(analysed, "capture_run_id", "left_semi").withColumns({"steps": F.filter("recipe", lambda s: s["kind"] == "role"), "gap_px": F.transform(F.filter("recipe", lambda s: s["kind"] == "gap"), lambda s: s["gap_px"])})
    insights, steps = measured_recipes(measured, ["capture_run_id"])
    none = F.lit(None).cast("string")
    by_measure = insights.select("capture_run_id", F.lit("recipe_insight").alias("kind"), (F.col("place") - 1).alias("place"), F.col("signature").alias("name"), "signature", "category", "interpretation", none.alias("section_label"), F.lit(None).cast("long").alias("step_index"), F.lit(0.7).alias("confidence"), "evidence_refs")
    by_place = steps.select("capture_run_id", F.lit("page_flow").alias("kind"), (F.col("step") - 1).alias("place"), none.alias("name"), "signature", none.alias("category"), none.alias("interpretation"), "section_label", F.col("step").alias("step_index"), F.lit(None).cast("double").alias("confidence"), F.array().cast("array<string>").alias("evidence_refs"))
    had = out.select("capture_run_id", "kind").distinct()
    return out.unionByName(by_measure.unionByName(by_place).join(had, ["capture_run_id", "kind"], "left_anti"))


def tables(found: DataFrame, root: str, scope: DataFrame | None = None) -> dict[str, DataFrame]:
    """The rows of manifests `found` (`packages.manifests`), with the documents of their packages below `root`, by table.

    `scope` has capture_run_id, project_id and platform_project_id of captures that belong to a project. A section or
    entity that a capture has twice is there once, the last one; a package without a document has no rows of it.
    """
    spark = found.sparkSession
    ids = found.select("package", "capture_run_id")
    quality = document(spark, root, "quality").select("package", F.col("overall").alias("_overall"), F.col("rating").alias("quality_rating"))
    captures = found.join(quality, "package", "left").select("capture_run_id", F.col("package").alias("package_path"), "requested_url", "canonical_url", "status", F.col("site.domain").alias("site_domain"), F.col("page.route").alias("page_route"), F.coalesce("_overall", "quality.overall").alias("quality_overall"), "quality_rating", "started_at", "completed_at")
    if scope is None:
        captures = captures.withColumns({c: F.lit(None).cast("string") for c in ("project_id", "platform_project_id")})
    else:
        captures = captures.join(scope.select("capture_run_id", "project_id", "platform_project_id"), "capture_run_id", "left")
    v = found.select("capture_run_id", F.explode("viewport_captures").alias("v"))
    shot = lambda *names: F.coalesce(*[F.col("v.artifacts")[n]["path"] for n in names])
    viewports = v.select("capture_run_id", "v.viewport_capture_id", "v.name", "v.status", F.col("v.viewport.width").alias("width"), F.col("v.viewport.height").alias("height"), "v.node_count", "v.title", shot("viewport_screenshot").alias("settled_screenshot_path"), shot("full_page_screenshot").alias("full_page_screenshot_path"), F.col("v.document.width").alias("document_width"), F.col("v.document.height").alias("document_height"))
    views = document(spark, root, "sections").join(ids, "package").select("capture_run_id", F.posexplode("viewports").alias("_v", "view"))
    flat = views.select("capture_run_id", "_v", F.posexplode("view.sections").alias("_s", "s")).select("capture_run_id", (F.col("_v") * 1_000_000 + F.col("_s")).cast("long").alias("ordinal"), "s.*")
    flat = flat.withColumn("root_box", union_box(F.transform(F.filter("recipe", lambda s: (s["kind"] == "role") & s["box"].isNotNull()), lambda s: s["box"])))
    named = viewports.groupBy("capture_run_id", F.col("name").alias("viewport_name")).agg(F.min(F.struct("width", "height")).alias("_by_name"))
    by_id = viewports.select("capture_run_id", "viewport_capture_id", F.struct("width", "height").alias("_by_id"))
    sized = flat.join(by_id, ["capture_run_id", "viewport_capture_id"], "left").join(named, ["capture_run_id", "viewport_name"], "left").withColumn("_size", F.coalesce("_by_id", "_by_name"))
    sections = _last(sized.select(*flat.columns, F.col("_size.width").alias("viewport_width"), F.col("_size.height").alias("viewport_height")), ["capture_run_id", "section_id"], "ordinal")
    design = document(spark, root, "design").join(ids.select("package"), "package", "left_semi")
    analyses = design.join(ids, "package").select("capture_run_id", "model", "base_url", "status", "analysis_mode", "design_summary", F.coalesce(F.size("hypotheses"), F.lit(0)).cast("long").alias("hypothesis_count"), "raw_response_sha256", "generated_at")
    analyses = analyses.withColumn("hypothesis_count", F.greatest(F.lit(0), F.col("hypothesis_count")).cast("long"))
    # each is read again below, and documents are parsed once
    sections, analyses = written(sections), written(analyses)
    items = written(llm_items(ids, design, sections))
    seen = document(spark, root, "ontology").join(ids, "package").select("capture_run_id", F.posexplode("viewports").alias("_v", "view"))
    e = seen.select("capture_run_id", "_v", "view.viewport_capture_id", F.posexplode("view.entities").alias("_e", "e"))
    said = F.coalesce("e.attributes.text", "e.attributes.name")
    shown = F.coalesce(F.when(F.trim(said) != "", F.substring(F.trim(said), 1, 240)), F.substring(F.filter("e.evidence", lambda x: x["value"].isNotNull())[0]["value"], 1, 240))
    entities = e.select("capture_run_id", "viewport_capture_id", "e.ontology_entity_id", F.col("e.source_node_id").alias("node_id"), "e.taxonomy_id", "e.label", "e.entity_type", shown.alias("text_preview"), "e.confidence", F.coalesce("e.attributes.box", "e.attributes.bbox").alias("box"), (F.col("_v") * 10_000_000 + F.col("_e")).cast("long").alias("_at"))
    entities = written(_last(entities, ["capture_run_id", "ontology_entity_id"], "_at").drop("_at"))
    files = _last(packages.artifacts(found).join(ids, "package").drop("package"), ["capture_run_id", "path"], "key").drop("key")
    words = lambda *names: F.concat_ws(" ", *[F.when(F.col(n) != "", F.col(n)) for n in names])
    section_text = F.concat_ws(" ", words("category", "signature", "taxonomy_id"), "text_signals")
    item_id = F.concat_ws(":", "kind", "place", F.coalesce("name", F.col("step_index").cast("string")))
    item_text = F.when(F.col("kind") == "recipe_insight", F.concat_ws(" ", F.lit("recipe"), F.coalesce("category", F.lit("")), "signature", "interpretation")).when(F.col("kind") == "page_flow", words("kind", "section_label", "signature")).otherwise(words("kind", "name", "category", "signature", "interpretation"))
    texts = subjects({"section": sections.select("capture_run_id", F.col("section_id").alias("id"), section_text.alias("text")), "capture_summary": analyses.select("capture_run_id", F.col("capture_run_id").alias("id"), F.col("design_summary").alias("text")), "llm_item": items.select("capture_run_id", item_id.alias("id"), item_text.alias("text")), "design_node": entities.select("capture_run_id", F.col("ontology_entity_id").alias("id"), words("label", "taxonomy_id", "entity_type", "text_preview").alias("text"))}, "capture_run_id", "id", "text")
    return {"captures": captures, "viewports": viewports, "sections": sections, "llm_analyses": analyses, "llm_items": items, "design_nodes": entities, "artifacts": files, "embeddings": _embedded(texts)}


def _last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the one of the greatest `order`, by one aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    held = F.max_by(F.struct(*rest), F.col(order)).alias("_r")
    return rows.groupBy(*keys).agg(held).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(rows.columns)


def _embedded(texts: DataFrame) -> DataFrame:
    """Subjects with their hashing embedding as a sparse map of cells."""
    named = texts.withColumn("_id", F.sha2(F.concat_ws("|", "capture_run_id", "kind", "subject_id"), 256))
    cells = vectors.hashing_embedding(named, "_id", "content_text").groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("cell", "value"))).alias("embedding"))
    return named.join(cells, "_id").drop("_id")


def stored(spark: SparkSession, out: str, table: str) -> DataFrame | None:
    """A table of the library; None before it has rows."""
    try:
        return spark.read.parquet(f"{out}/{table}")
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _upserted(new: DataFrame, old: DataFrame) -> DataFrame:
    """Captures: what a capture was asked for and when it began stays as it was, a project that isn't given anew too; all else is new."""
    kept = ("requested_url", "canonical_url", "site_domain", "page_route", "started_at")
    was = old.select(F.col("capture_run_id"), *[F.col(c).alias(f"_{c}") for c in (*kept, "project_id", "platform_project_id")], F.lit(True).alias("_was"))
    both = new.join(was, "capture_run_id", "left")
    values = {c: F.when(F.col("_was"), F.col(f"_{c}")).otherwise(F.col(c)) for c in kept} | {c: F.coalesce(c, f"_{c}") for c in ("project_id", "platform_project_id")}
    return both.select(*[values.get(c, F.col(c)).alias(c) for c in new.columns])


def _one_glob(folders: list[str]) -> str:
    """A glob of exactly these folders."""
    split = sorted(f.split("/") for f in folders)
    if len(split) == 1:
        return folders[0]
    same = 0
    while all(len(f) > same + 1 and f[same] == split[0][same] for f in split):
        same += 1
    return "/".join(split[0][:same]) + "/{" + ",".join("/".join(f[same:]) for f in split) + "}"


def replace_captures(found: DataFrame, out: str, scope: DataFrame | None = None, parts: int = PARTS) -> None:
    """Write manifests `found` and their packages' documents to the library below `out`, in place of what these captures had.

    Rows of other captures in the parts that are touched are read, written to the checkpoint folder and then written
    back by dynamic partition overwrite; parts that are left without rows are deleted. A second run gives the same
    library. The folders of the packages and the touched parts, at most `parts`, are all that the driver learns.
    """
    spark = found.sparkSession
    found = written(found.filter("capture_run_id IS NOT NULL"))
    folders = [r[0] for r in found.select("package").distinct().collect()]
    if not folders:
        return
    part = F.pmod(F.xxhash64("capture_run_id"), F.lit(parts)).cast("int").alias("part")
    touched = [r[0] for r in found.select(part).distinct().collect()]
    ids = found.select("capture_run_id").distinct()
    for name, rows in tables(found, _one_glob(folders), scope).items():
        old = stored(spark, out, name)
        if old is not None:
            old = old.filter(F.col("part").isin(touched)).select(rows.columns)
            if name == "captures":
                rows = _upserted(rows, old)
            rows = rows.unionByName(old.join(ids, "capture_run_id", "left_anti"))
        held = written(rows.select("*", part))
        held.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{out}/{name}")
        left = {r[0] for r in held.select("part").distinct().collect()}
        for p in set(touched) - left:
            _delete(spark, f"{out}/{name}/part={p}")
    captures = stored(spark, out, "captures")
    projects = captures.filter("project_id IS NOT NULL").groupBy("project_id").agg(F.count(F.lit(1)).alias("captures"), F.max("completed_at").alias("last_activity"))
    written(projects).write.mode("overwrite").parquet(f"{out}/projects")


def manifest_stream(spark: SparkSession, root: str, most: int = 1000) -> DataFrame:
    """Manifests as a stream, `most` a batch."""
    rows = spark.readStream.schema(packages.MANIFEST).option("multiLine", True).option("maxFilesPerTrigger", most).json(f"{root}/manifest.json")
    return rows.select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("package"), "*")
