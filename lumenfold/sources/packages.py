"""Capture packages: manifests, records, artifacts, and what an intact package must hold.

A package is a folder with manifest.json and the files that it names; `root` is a path or glob that Spark can read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARTIFACT = "struct<path:string,sha256:string,bytes:long,media_type:string>"
#: The fields of a manifest, of a record of nodes, boxes, styles and accessibility, and of a catalog.
MANIFEST = f"""schema_version string, capture_run_id string, status string, requested_url string, canonical_url string, started_at timestamp, completed_at timestamp, quality struct<overall:double>, run_artifacts map<string,{ARTIFACT}>, errors array<string>, interventions array<string>,
 site struct<site_id:string,domain:string>, page struct<page_id:string,route:string>,
 viewport_captures array<struct<viewport_capture_id:string,name:string,status:string,node_count:long,title:string,viewport:struct<width:double,height:double>,document:struct<width:double,height:double>,artifacts:map<string,{ARTIFACT}>>>"""
NODE = "node_id string, parent_node_id string, node_type string, tag string, sibling_index int, rendered boolean, attributes map<string,string>, source_anchor map<string,string>, dom_path string, text string"
BOX = "node_id string, bbox struct<x:double,y:double,width:double,height:double>"
STYLE = "node_id string, properties map<string,string>"
ACCESSIBILITY = "dom_node_id string, role string, name string"
CATALOG = "id string, entries array<struct<rank:int,id:string,name:string,group:string,country:string,url:string>>"
SCHEMA_VERSION = "0.1.0"
ISSUE = ("package", "code", "item")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """A1: a row per package: package (its folder), the fields of the manifest, and corrupt, the text that couldn't be read."""
    rows = spark.read.schema(MANIFEST + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(f"{root}/manifest.json")
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    return rows.select(folder.alias("package"), *[c for c in rows.columns if c != "_corrupt_record"], F.col("_corrupt_record").alias("corrupt"))


def records(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """A2: json lines with their file; the order of lines within a file is `ordinal`'s order, not its numbers."""
    return spark.read.schema(schema).json(paths).select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ordinal"))


def write_records(rows: DataFrame, path: str) -> None:
    """A3: json lines, one file a partition; `hashes` tells their content."""
    rows.write.mode("overwrite").json(path)


def hashes(spark: SparkSession, root: str) -> DataFrame:
    """A3, V1: file, bytes and SHA-256 of what lies below `root`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(F.regexp_replace("path", "^file:/+", "file:///").alias("file"), F.col("length").alias("bytes"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256"))


def artifacts(found: DataFrame) -> DataFrame:
    """A4: (package, key, path, sha256, bytes, media_type) of a run and of its viewports."""
    run = found.select("package", F.explode("run_artifacts").alias("_k", "_a")).select("package", F.concat(F.lit("run_artifacts."), "_k").alias("key"), "_a.*")
    views = found.select("package", F.explode("viewport_captures").alias("_v")).select("package", F.col("_v.name").alias("_n"), F.explode("_v.artifacts").alias("_k", "_a"))
    return run.unionByName(views.select("package", F.concat_ws(".", F.lit("viewport_captures"), "_n", "_k").alias("key"), "_a.*"))


def catalog_entries(spark: SparkSession, path: str) -> DataFrame:
    """A5: a row per entry of url catalogs; a file that isn't there is an empty catalog to Spark only within a glob."""
    rows = spark.read.schema(CATALOG).option("multiLine", True).json(path)
    return rows.select(F.col("id").alias("catalog_id"), F.explode("entries").alias("_e")).select("catalog_id", "_e.*")


def taxonomy(core: DataFrame, catalog: DataFrame) -> DataFrame:
    """Core terms, overlaid by the catalog's of the same id: taxonomy_id, entity_type, label, category."""
    names = [c for c in core.columns if c != "taxonomy_id"]
    new = catalog.select("taxonomy_id", *[F.col(c).alias(f"_{c}") for c in names])
    return core.join(new, "taxonomy_id", "full_outer").select("taxonomy_id", *[F.coalesce(f"_{c}", c).alias(c) for c in names])


def _issues(rows: DataFrame, code: str, item: Column, package: str = "package") -> DataFrame:
    return rows.select(F.col(package).alias("package"), F.lit(code).alias("code"), item.cast("string").alias("item"))


def all_issues(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def structure_issues(found: DataFrame) -> DataFrame:
    """V5 and the structure of a manifest: unreadable, without its collections, of another version, or without a valid id."""
    whole = F.col("capture_run_id").isNotNull() & F.col("schema_version").isNotNull() & F.col("run_artifacts").isNotNull() & F.col("viewport_captures").isNotNull() & F.col("errors").isNotNull() & F.col("interventions").isNotNull()
    read = found.filter("corrupt IS NULL")
    return all_issues(
        _issues(found.filter("corrupt IS NOT NULL"), "manifest_unreadable", F.lit("manifest.json")),
        _issues(read.filter(~whole), "manifest_invalid_structure", F.lit("manifest.json")),
        _issues(read.filter(whole & (F.col("schema_version") != SCHEMA_VERSION)), "unsupported_schema_version", F.col("schema_version")),
        _issues(read.filter(whole & ~F.col("capture_run_id").startswith("cap_")), "invalid_capture_run_id", F.col("capture_run_id")),
    )


def artifact_issues(listed: DataFrame, files: DataFrame) -> DataFrame:
    """V1: references that are incomplete or leave the package, and files that are missing or of another size or hash; a path once."""
    complete = (F.col("path") != "") & (F.col("sha256") != "") & F.col("bytes").isNotNull()
    inside = ~F.col("path").startswith("/") & ~F.col("path").rlike(r"(^|/)\.\.(/|$)")
    good = listed.filter(F.coalesce(complete, F.lit(False)) & inside).groupBy("package", "path").agg(F.min(F.struct("sha256", "bytes")).alias("_a"))
    good = good.withColumn("file", F.regexp_replace(F.concat_ws("/", "package", "path"), "^file:/+", "file:///"))
    seen = good.join(files.select("file", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha")), "file", "left")
    return all_issues(
        _issues(listed.filter(~F.coalesce(complete, F.lit(False))), "invalid_artifact_reference", F.col("key")),
        _issues(listed.filter(F.coalesce(complete, F.lit(False)) & ~inside), "artifact_path_escape", F.col("path")),
        _issues(seen.filter("_sha IS NULL"), "artifact_unreadable", F.col("path")),
        _issues(seen.filter("_bytes <> _a.bytes"), "artifact_size_mismatch", F.col("path")),
        _issues(seen.filter("_sha <> _a.sha256"), "artifact_hash_mismatch", F.col("path")),
    )


def duplicate_issues(rows: DataFrame, package: str, key: str, code: str) -> DataFrame:
    """V2: a row for each key that a package has more than once."""
    again = rows.filter(F.col(key).isNotNull()).groupBy(package, key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return _issues(again, code, F.col(key), package)


def dangling_issues(children: DataFrame, parents: DataFrame, package: str, fk: str, key: str, code: str) -> DataFrame:
    """V3: references that no row of the same package has as its key."""
    known = parents.select(F.col(package).alias("_p"), F.col(key).alias("_k")).distinct()
    lost = children.filter(F.col(fk).isNotNull()).join(known, (F.col(package) == F.col("_p")) & (F.col(fk) == F.col("_k")), "left_anti")
    return _issues(lost, code, F.col(fk), package)


def count_issues(declared: DataFrame, rows: DataFrame, package: str, count: str, code: str) -> DataFrame:
    """V4: packages that declare another number of rows than they have."""
    actual = rows.groupBy(F.col(package).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    off = declared.join(actual, F.col(package) == F.col("_p"), "left").filter(~F.col(count).eqNullSafe(F.coalesce("_n", F.lit(0))))
    return _issues(off, code, F.concat_ws(" is ", F.col(count).cast("string"), F.coalesce("_n", F.lit(0)).cast("string")), package)


def layer_issues(rows: DataFrame, package: str, key: str, known: DataFrame | None = None) -> DataFrame:
    """V6: hypotheses (L3) that claim certainty or have no method, measured rows (L2) that doubt, terms that nobody knows."""
    parts = [
        _issues(rows.filter("layer = 'L3' AND (confidence IS NULL OR confidence >= 1)"), "l3_confidence", F.col(key), package),
        _issues(rows.filter("layer = 'L3' AND coalesce(method, '') = ''"), "l3_method_missing", F.col(key), package),
    ]
    if known is not None:
        terms = known.toDF("_term").distinct()
        parts.append(_issues(rows.filter("taxonomy_id IS NOT NULL").join(terms, F.col("taxonomy_id") == F.col("_term"), "left_anti"), "unknown_taxonomy", F.col("taxonomy_id"), package))
    return all_issues(*parts)


def schema_issues(rows: DataFrame, package: str, key: str, required: list[str], closed: dict[str, list[str]], ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """V8: missing fields, values out of a closed list, numbers out of a range; one pass."""
    bad = lambda when, what: F.when(F.coalesce(when, F.lit(False)), F.lit(what))
    rules = [bad(F.col(c).isNull(), f"missing {c}") for c in required]
    rules += [bad(~F.col(c).isin(*values), f"value of {c}") for c, values in closed.items()]
    rules += [bad(~F.col(c).between(low, high), f"range of {c}") for c, (low, high) in ranges.items()]
    flat = rows.select(package, key, F.explode(F.array_compact(F.array(*rules))).alias("_what"))
    return _issues(flat, "schema", F.concat_ws(": ", F.col(key).cast("string"), "_what"), package)


def report(found: DataFrame, listed: DataFrame, issues: DataFrame) -> DataFrame:
    """V7: a row per package: valid, checked_artifacts, issues."""
    checked = listed.groupBy("package").agg(F.count_distinct("path").alias("checked_artifacts"))
    counts = issues.groupBy("package").agg(F.count(F.lit(1)).alias("issues"))
    joined = found.select("package").join(checked, "package", "left").join(counts, "package", "left")
    n = F.coalesce("issues", F.lit(0))
    return joined.select("package", (n == 0).alias("valid"), F.coalesce("checked_artifacts", F.lit(0)).alias("checked_artifacts"), n.alias("issues"))
