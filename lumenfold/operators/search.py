"""Searches over library tables: filters first, then the limit."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: facets of a screen that hold one value of a closed vocabulary.
SINGLE = ("style", "layout", "imagery_density", "type_scale", "type_image_mode", "contrast_mode", "composition_energy", "chrome_weight")


def _all(conditions: list[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def _given(value: str | None) -> str | None:
    return (value or "").strip() or None


def holds_text(text: str | None, *columns: Column) -> Column:
    """Any of the columns holds the text in any case; no text is no filter."""
    needle = (_given(text) or "").lower()
    return reduce(or_, [F.coalesce(F.lower(c).contains(needle), F.lit(False)) for c in columns]) if needle else F.lit(True)


def search_rows(rows: DataFrame, equal: dict[str, str | None], text: str | None, text_columns: list[Column], order: list[Column], limit: int) -> DataFrame:
    """Rows that equal what is given, and hold the text, first in order."""
    conditions = [F.col(c) == v for c, v in equal.items() if _given(v) is not None]
    return rows.filter(_all([*conditions, holds_text(text, *text_columns)])).orderBy(*order).limit(limit)


def vocabulary_value(value: str | None, vocabulary: list[str]) -> str | None:
    """A value out of its vocabulary is no filter."""
    return v if (v := _given(value)) in vocabulary else None


def facets_match(facets: str, text: str | None = None, industry: str | None = None, modules: list[str] | None = None, craft_tags: list[str] | None = None, **single: str | None) -> Column:
    """All of the given facets, of a struct column; lists must hold all that is asked for. Without facets a row drops out once anything is asked."""
    get = lambda n: F.col(f"{facets}.{n}")
    unknown = set(single) - set(SINGLE)
    if unknown:
        raise ValueError(f"no facets: {sorted(unknown)}")
    conditions = [get(n) == _given(v) for n, v in single.items() if _given(v)]
    if industry := _given(industry):
        conditions.append(F.array_contains(get("industry_tags"), industry))
    for name, asked in (("modules", modules), ("craft_tags", craft_tags)):
        lowered = F.transform(get(name), F.lower)
        conditions += [F.array_contains(lowered, a.strip().lower()) for a in asked or [] if a.strip()]
    if text := (_given(text) or "").lower():
        hay = F.concat_ws(" ", *[get(n) for n in ("page_type", "style", "layout", "typography", "color_mood", "above_fold_job", "industry_tags", "modules", "craft_tags")])
        conditions.append(F.lower(hay).contains(text))
    return F.coalesce(_all([F.col(facets).isNotNull(), *conditions]), F.lit(False)) if conditions else F.lit(True)


def list_screens(screens: DataFrame, statuses: tuple[str, ...], match: Column, order: list[Column], limit: int) -> DataFrame:
    """Screens of the given statuses or without one that match, first in order."""
    return screens.filter(F.col("status").isNull() | F.col("status").isin(*statuses)).filter(match).orderBy(*order).limit(limit)


def ranked_screens(screens: DataFrame, scores: DataFrame, key: str, score: str, *order: Column) -> DataFrame:
    """Screens by their best score, those without one last, in their own order; no scores keep the list as it is."""
    best = scores.groupBy(key).agg(F.max(score).alias("best"))
    return screens.join(best, key, "left").orderBy(F.col("best").desc_nulls_last(), *order)


def reference_score(craft_tags: list[str], modules: list[str], category: str | None = None, text: str | None = None, **single: str | None) -> Column:
    """5 for each craft tag, 4 for each module (also within the signature), 3 for the category, 2 for each facet, 1 for the text in look and stack."""
    clean = lambda values: [v.strip().lower() for v in values if v.strip()]
    low = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    points = lambda when, n: F.when(F.coalesce(when, F.lit(False)), n).otherwise(0)
    out = F.lit(0)
    for tag in clean(craft_tags):
        out = out + points(F.array_contains(low("craft_tags"), tag), 5)
    for module in clean(modules):
        out = out + points(F.array_contains(low("screen_patterns"), module) | F.lower(F.col("signature")).contains(module), 4)
    if category := _given(category):
        out = out + points(F.col("category") == category, 3)
    for name, value in single.items():
        if value := _given(value):
            out = out + points(F.col(name) == value, 2)
    if text := (_given(text) or "").lower():
        out = out + points(F.lower(F.col("look_summary")).contains(text), 1) + points(F.lower(F.col("stack_summary")).contains(text), 1)
    return out


def search_references(references: DataFrame, equal: dict[str, str | None], style_label: str | None, text: str | None, match: Column, score: Column, newest: Column, limit: int, candidate_limit: int | None = None) -> DataFrame:
    """References that pass all filters, by score, then newest, then id. `candidate_limit` cuts to the newest ones before `match`, where that is wanted."""
    conditions = [F.col(c) == v for c, v in equal.items() if _given(v)]
    if style_label := _given(style_label):
        conditions.append(F.array_contains("style_labels", style_label))
    found = references.filter(_all([*conditions, holds_text(text, F.col("look_summary"), F.col("signature"), F.col("category"))]))
    if candidate_limit is not None:
        found = found.orderBy(newest.desc()).limit(candidate_limit)
    return found.filter(match).withColumn("score", score).orderBy(F.col("score").desc(), newest.desc(), "reference_id").limit(limit)


def by_similarity(neighbours: DataFrame, references: DataFrame, limit: int) -> DataFrame:
    """Neighbours (a, b, score) of each anchor with the references' columns: by score, then the anchor's signature first, category, id."""
    from pyspark.sql import Window

    own = references.select(F.col("reference_id").alias("a"), F.col("signature").alias("_own"))
    found = neighbours.select("a", F.col("b").alias("reference_id"), "score").join(references, "reference_id").join(own, "a", "left")
    other = F.when(F.col("signature") == F.col("_own"), 0).otherwise(1)
    w = Window.partitionBy("a").orderBy(F.col("score").desc(), other, "category", "reference_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).drop("_own")


def pack(references: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(references of the ids, ids that are unknown)."""
    asked = ids.toDF("reference_id").distinct()
    return references.join(asked, "reference_id", "left_semi"), asked.join(references, "reference_id", "left_anti")


def under_budget(references: DataFrame, pack_key: str, size: Column, most: int, *order: Column) -> DataFrame:
    """The first references of each pack, in order, whose sizes add up to `most` or less."""
    from pyspark.sql import Window

    w = Window.partitionBy(pack_key).orderBy(*order)
    return references.withColumn("used", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("used") <= most)


#: Fixed value: characters of a look that has to be short.
SHORT_LOOK = 120


def clipped(text: Column, most: int) -> Column:
    """At most so many characters, with an ellipsis where some are missing."""
    text = F.trim(text)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, max(0, most - 1))), F.lit("…")))


def fitted_packs(references: DataFrame, pack_key: str, place: str, fields: list[str], text: str, most: int) -> DataFrame:
    """(pack, place, fields, text, bytes, over): references of packs whose json arrays have `most` UTF-8 bytes or less.

    The last references go until the rest fits, but the first one stays; if it alone is too large, its text is clipped to
    120 characters, and if that is too large, to what is left. `over` tells of a pack whose first reference is too large
    without any text. A reference is the json object of the fields and the text; a null one is left out of it.
    """
    from pyspark.sql import Window

    size = lambda t: F.octet_length(F.to_json(F.struct(*fields, t.alias(text))))
    w = Window.partitionBy(pack_key).orderBy(place)
    sized = references.select(pack_key, place, *fields, text, size(F.col(text)).alias("_size"))
    used = F.sum(F.col("_size") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1
    kept = sized.withColumns({"_used": used, "_first": F.row_number().over(w) == 1}).filter((F.col("_used") <= most) | F.col("_first"))
    short = F.when(F.col("_used") > most, clipped(F.col(text), SHORT_LOOK)).otherwise(F.col(text))
    kept = kept.withColumn(text, short).withColumn("_more", size(F.col(text)) + 2 - most)
    # a character has a byte at least, the ellipsis three, so this many less are enough
    rest = F.length(text) - F.col("_more") - 3
    fits = F.when(F.col("_more") <= 0, F.col(text)).when(rest > 0, F.concat(F.rtrim(F.expr(f"substring(`{text}`, 1, cast(length(`{text}`) - _more - 3 AS INT))")), F.lit("…"))).otherwise("")
    out = kept.withColumn(text, fits).withColumn("bytes", size(F.col(text)).cast("long"))
    return out.select(pack_key, place, *fields, text, "bytes", (F.col("bytes") + 2 > most).alias("over"))


def recall_at(found: DataFrame, truth: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """Q6: (query, recall): part of the k true items of each query that `found` has among its own k; both have a rank."""
    true, got = truth.filter(F.col("rank") <= k).select(query, item), found.filter(F.col("rank") <= k).select(query, item).withColumn("_hit", F.lit(1))
    return true.join(got, [query, item], "left").groupBy(query).agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))
