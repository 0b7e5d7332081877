"""Upserts, deduplication, top rows and set operations on library tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in `order`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `updates` replace those of the same key. Each side has a key once."""
    both = target.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    return latest(both, keys, F.col("_new").desc()).drop("_new")


def upsert_coalesce(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """A10: null columns of an update keep the old value."""
    rest = [c for c in target.columns if c not in keys]
    new = updates.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in rest])
    return target.join(new, keys, "full_outer").select(*keys, *[F.coalesce(f"_new_{c}", c).alias(c) for c in rest])


def insert_absent(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """A11."""
    return target.unionByName(rows.join(target.select(*keys), keys, "left_anti"))


def delete_cascade(parents: DataFrame, children: DataFrame, victims: DataFrame, parent_key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children that survive the deletion of `victims` (a column of parent keys)."""
    gone = victims.select(F.col(victims.columns[0]).alias("_gone")).distinct()
    return parents.join(gone, F.col(parent_key) == F.col("_gone"), "left_anti"), children.join(gone, F.col(child_key) == F.col("_gone"), "left_anti")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """`rows` dealt by `keys` over as many tasks as a shuffle has.

    Spark joins small shuffled partitions by their compressed size, which for keys in order is a fraction of what a task
    then sorts; it leaves these as they are.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def top_n(rows: DataFrame, groups: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each group; Spark limits each group before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col("rank") <= n)


def interleave(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """K6: `turn` and then the group's order give the round-robin."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def numbered_ids(rows: DataFrame, base: str, *order: Column) -> DataFrame:
    """K7: collision-free ids: the second holder of a name gets -2, and so on, without numbers that make a given name.

    The first holder of a name keeps it. Ids of two names never clash with each other, as the last number is the own one.
    """
    given = r"(?s)^(.*)-([2-9]|[1-9][0-9]{1,16})$"
    taken = rows.select(F.col(base).alias("_name")).distinct().filter(F.col("_name").rlike(given))
    taken = taken.groupBy(F.regexp_extract("_name", given, 1).alias("_base")).agg(F.sort_array(F.collect_list(F.regexp_extract("_name", given, 2).cast("long"))).alias("_taken"))
    rn = F.row_number().over(Window.partitionBy(base).orderBy(*order)).cast("long")
    numbered = rows.withColumn("_rn", rn).join(taken, F.col(base) == F.col("_base"), "left")
    number = F.aggregate(F.coalesce("_taken", F.array().cast("array<long>")), F.col("_rn"), lambda n, t: F.when(t <= n, n + 1).otherwise(n))
    return numbered.withColumn("unique_id", F.when(F.col("_rn") == 1, F.col(base)).otherwise(F.concat(base, F.lit("-"), number.cast("string")))).drop("_rn", "_base", "_taken")


def best_then_top(rows: DataFrame, capture: str, category: str, score: str, n: int, categories: list[str] | None = None, *ties: Column) -> DataFrame:
    """K4: the best row of each (capture, category), then the n best of each category, in the order of `categories`."""
    if categories:
        rows = rows.filter(F.col(category).isin(*categories))
    best = latest(rows, [capture, category], F.col(score).desc(), *ties)
    place = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col(category)) if categories else F.lit(0)
    return top_n(best, [category], n, F.col(score).desc(), F.col(capture), *ties).withColumn("category_order", place)


def first_per_key(docs: list[DataFrame], key: str) -> DataFrame:
    """Rows of several tables, of which the first table that has a key gives its row."""
    every = docs[0].withColumn("_source", F.lit(0))
    for i, d in enumerate(docs[1:], 1):
        every = every.unionByName(d.withColumn("_source", F.lit(i)))
    return latest(every, [key], F.col("_source")).drop("_source")


def first_distinct(rows: DataFrame, groups: list[str], key: str, n: int, *order: Column) -> DataFrame:
    """S3: the first row of each key in a group, at most n of them in order."""
    return top_n(latest(rows, [*groups, key], *order), groups, n, *order)


def avoid_keys(rows: DataFrame, key: str, *known: DataFrame) -> DataFrame:
    """Rows whose key none of `known` (one column each) has."""
    every = known[0].toDF("_known")
    for k in known[1:]:
        every = every.unionByName(k.toDF("_known"))
    return rows.join(every.distinct(), F.col(key) == F.col("_known"), "left_anti")


def drop_existing_urls(urls: DataFrame, key: str, position: str, existing: DataFrame) -> DataFrame:
    """A row per url that is kept, with what was skipped before: existing keys first, then repeated ones.

    `existing` has one column of keys. Urls without a key are left out of both counts.
    """
    known = existing.toDF("_known").distinct().withColumn("_there", F.lit(True))
    keyed = urls.filter(F.col(key) != "").join(known, F.col(key) == F.col("_known"), "left").groupBy(key).agg(F.min(position).alias(position), F.count(F.lit(1)).alias("_n"), F.max("_there").alias("_there"))
    return keyed.select(key, position, F.coalesce("_there", F.lit(False)).alias("existing"), F.when(F.col("_there"), F.col("_n")).otherwise(0).cast("long").alias("skipped_existing"), F.when(F.col("_there"), 0).otherwise(F.col("_n") - 1).cast("long").alias("skipped_duplicate"))


def pending_vectors(captures: DataFrame, analyses: DataFrame, vectors: DataFrame, key: str, *order: Column, limit: int | None = None) -> DataFrame:
    """Captures with a complete analysis and without a vector."""
    done = analyses.filter("status = 'complete'").select(key).distinct()
    out = captures.join(done, key, "left_semi").join(vectors.select(key), key, "left_anti")
    return out if limit is None else out.orderBy(*order).limit(limit)


def cache_split(requests: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Requests with `hit`, and the cached columns where there is one."""
    return requests.join(cache.withColumn("_hit", F.lit(True)), keys, "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def with_captures(rows: DataFrame, captures: DataFrame, key: str) -> DataFrame:
    """Viewports or analyses with the columns of their capture, those of a known capture only."""
    return rows.join(captures, key)


def member_counts(collections: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Every collection with the number of its members, 0 for none; members are counted before they are joined."""
    counts = members.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("members"))
    return collections.join(counts, key, "left").withColumn("members", F.coalesce("members", F.lit(0)))


def unmatched(rows: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
    """Rows that none of the others shares `on` with; a null matches nothing."""
    return rows.join(others.select(*on).distinct(), on, "left_anti")


def avoid_union(lists: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """(keys, avoid) the distinct entries of several lists or values of all rows of a key, sorted; nulls and empty texts are no entries."""
    kinds = dict(lists.dtypes)
    each = F.concat(*[F.coalesce(F.col(c) if kinds[c].startswith("array") else F.array(c), F.array().cast("array<string>")) for c in columns])
    flat = lists.select(*keys, F.explode_outer(each).alias("_e"))
    return flat.groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(F.col("_e") != "", F.col("_e")))).alias("avoid"))


def first_match(rows: DataFrame, others: DataFrame, on: list[str], pick: str) -> DataFrame:
    """Rows with the least `pick` of the others that share `on`, as `matched`; null without one."""
    first = others.groupBy(*on).agg(F.min(pick).alias("matched"))
    return rows.join(first, on, "left")


def two_step_match(rows: DataFrame, others: DataFrame, first: str, second: list[str], value: str) -> DataFrame:
    """`value` of the other with the same `first`, else the least one of those that share `second`."""
    by_id = others.filter(F.col(first).isNotNull()).groupBy(first).agg(F.min(value).alias("_one"))
    by_rest = others.groupBy(*second).agg(F.min(value).alias("_two"))
    return rows.join(by_id, first, "left").join(by_rest, second, "left").withColumn(value, F.coalesce("_one", "_two")).drop("_one", "_two")


def host_tags(catalogs: DataFrame, host: str, tag: str, *order: Column, most: int = 3) -> DataFrame:
    """The first `most` different tags of each host, in order."""
    named = latest(catalogs.filter(f"{host} <> '' AND {tag} IS NOT NULL"), [host, tag], *order)
    ranked = top_n(named, [host], most, *order)
    return ranked.groupBy(host).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(tag).alias("t")))), lambda r: r["t"]).alias("tags"))


def with_host_tags(captures: DataFrame, index: DataFrame, host: str) -> DataFrame:
    """Captures, or a stream of them, with the tags of their host; none is an empty list. `index` is a catalog, a row a host."""
    return captures.join(index, host, "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def resolve_scope(rows: DataFrame, projects: DataFrame) -> DataFrame:
    """The scope given, else the stored one, else that of the project: columns given_scope, stored_scope, project_id."""
    table = projects.select("project_id", F.col("scope").alias("_scope"))
    return rows.join(table, "project_id", "left").withColumn("scope", F.coalesce("given_scope", "stored_scope", "_scope")).drop("_scope")


def project_counters(projects: DataFrame, captures: DataFrame, references: DataFrame, key: str, at: str) -> DataFrame:
    """Captures, references and last activity of every project, also of those without any."""
    caps = captures.groupBy(key).agg(F.count(F.lit(1)).alias("captures"), F.max(at).alias("last_activity"))
    refs = references.groupBy(key).agg(F.count(F.lit(1)).alias("references"))
    return projects.select(key).join(caps, key, "left").join(refs, key, "left").select(key, F.coalesce("captures", F.lit(0)).alias("captures"), F.coalesce("references", F.lit(0)).alias("references"), "last_activity")


def grouped_items(items: DataFrame, keys: list[str], kind: str, kinds: list[str], value: str, *order: str) -> DataFrame:
    """A sorted list of values for each kind."""
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col(kind) == k, F.struct(*order, F.col(value).alias("_value"))))), lambda s: s["_value"]).alias(k) for k in kinds]
    return items.groupBy(*keys).agg(*lists)


def runs(rows: DataFrame, group: str, value: str, *order: Column) -> DataFrame:
    """Consecutive equal values of a group become one row: run number, length."""
    w = Window.partitionBy(group).orderBy(*order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = rows.withColumn("_c", changed).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(group, "run", value).agg(F.count(F.lit(1)).alias("length"))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """V2: keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def dangling(children: DataFrame, parents: DataFrame, fk: str, key: str) -> DataFrame:
    """V3: children whose reference has no parent."""
    return children.filter(F.col(fk).isNotNull()).join(parents.select(F.col(key).alias("_key")), F.col(fk) == F.col("_key"), "left_anti")
