"""Bands that a vision model sees on a page: cleaning, placing, merging, refinement, and the looks they give.

A band has band_id, label, category, confidence, and y and height as parts of its page (or tile); it is as wide as the page.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.keys import bound, is_consent_text

#: Categories of a band, bands of a page, least height of a band that a model gives.
CATEGORIES = ("hero", "nav", "feature", "content", "commerce", "conversion", "social_proof", "footer", "other")
MOST_BANDS, LEAST_SEEN = 12, 0.05
#: Gap that is closed, height of a sliver, least height, chrome above the first band.
SNAP, SLIVER, LEAST, CHROME = 0.045, 0.025, 0.04, 0.08
#: Two bands are one if they overlap by this part of the smaller one, or begin as close as this.
OVERLAP, CLOSE = 0.45, 0.03


def part(x: Column) -> Column:
    """Within 0 and 1; 0 for what isn't a number."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def _one_hero(bands: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Heroes after the first are features."""
    w = Window.partitionBy(*keys, F.col("category") == "hero").orderBy(*order)
    return bands.withColumn("category", F.when((F.col("category") == "hero") & (F.row_number().over(w) > 1), "feature").otherwise(F.col("category")))


def normalise_bands(raw: DataFrame, keys: list[str], most: int = MOST_BANDS, prefix: str = "band") -> DataFrame:
    """(keys, place, band_id, label, category, confidence, y, height) of a model's rows (ordinal, id, label, category, confidence, y, height).

    Consent overlays and rows lower than 0.05 are no bands. Unknown categories are other, a confidence that isn't a
    number is 0.6, and the first `most` in the model's order stay, then go from top to bottom.
    """
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("ordinal"))
    named = raw.withColumn("_n", number).withColumn("label", F.trim(F.coalesce("label", "id", F.concat(F.lit("Band "), F.col("_n")))))
    named = named.withColumn("label", F.when(F.col("label") == "", F.concat(F.lit("Band "), F.col("_n"))).otherwise(F.col("label")))
    kind = F.lower(F.coalesce("category", F.lit("other")))
    named = named.filter(~is_consent_text(F.col("label"))).withColumn("category", F.when(kind.isin(*CATEGORIES), kind).otherwise("other"))
    named = _one_hero(named, keys, F.col("_n"))
    sized = named.withColumn("y", part(F.col("y"))).withColumn("height", part(F.col("height"))).filter(F.col("height") >= LEAST_SEEN)
    tall = F.when(F.col("y") + F.col("height") > 1, F.greatest(F.lit(0.04), 1 - F.col("y"))).otherwise(F.col("height"))
    sure = F.col("confidence").cast("double")
    bands = sized.select(
        *keys, "_n", F.substring(F.regexp_replace(F.coalesce("id", F.concat(F.lit(prefix + "_"), F.col("_n"))), r"\s+", "_"), 1, 64).alias("band_id"),
        F.substring("label", 1, 80).alias("label"), "category", F.when(sure.isNull() | F.isnan(sure), 0.6).otherwise(part(sure)).alias("confidence"), "y", tall.alias("height"),
    )
    first = bands.withColumn("_kept", F.row_number().over(Window.partitionBy(*keys).orderBy("_n"))).filter(F.col("_kept") <= most)
    order = (F.col("y"), F.col("height").desc(), F.col("_n"))
    placed = _one_hero(first, keys, *order).withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return placed.select(*keys, "place", "band_id", "label", "category", "confidence", "y", "height")


def to_page(bands: DataFrame, top: Column, height: Column, page: Column, prefix: Column) -> DataFrame:
    """Bands of a tile as parts of the page that is `page` high; a tile or page without height has none."""
    y, tall = part((top + F.col("y") * height) / page), part(F.col("height") * height / page)
    return bands.filter((page > 0) & (height > 0)).withColumns({"band_id": F.concat_ws("_", prefix, "band_id"), "y": y, "height": tall})


def _merged(keys: list[str], most: int):
    """One pass over the sorted bands of each page; of each run of bands that are one, the better is held."""
    names = [*keys, "place", "band_id", "label", "category", "confidence", "y", "height"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, held, place, hero = None, None, 0, False

        def done() -> tuple:
            nonlocal place, hero
            place += 1
            label, kind = held.label, held.category
            if kind == "hero":
                kind, hero = ("feature" if hero else "hero"), True
            return (*page, place, held.band_id, label, kind, held.confidence, held.y, held.height)

        for pdf in batches:
            out: list[tuple] = []
            for b in pdf.itertuples(index=False):
                now = tuple(b[: len(keys)])
                if now != page:
                    if held is not None and place < most:
                        out.append(done())
                    page, held, place, hero = now, b, 0, False
                    continue
                shared = min(held.y + held.height, b.y + b.height) - max(held.y, b.y)
                if shared > min(held.height, b.height) * OVERLAP or abs(held.y - b.y) < CLOSE:
                    if (b.confidence, b.height) > (held.confidence, held.height):
                        held = b
                    continue
                if place < most:
                    out.append(done())
                held = b
            yield pd.DataFrame(out, columns=names)
        if held is not None and place < most:
            yield pd.DataFrame([done()], columns=names)

    return run


def merge_bands(bands: DataFrame, keys: list[str], most: int = MOST_BANDS) -> DataFrame:
    """Bands of overlapping tiles as those of a page; of two that are one, the surer stays, then the higher.

    Each band is held against the last that stays, from top to bottom (ties by place), so a chain of overlaps can end in
    one band. One pass over sorted partitions that holds one band; the first `most` of a page stay, the first hero is one.
    """
    columns = [*keys, "place", "band_id", "label", "category", "confidence", "y", "height"]
    kinds = dict(bands.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", place long, band_id string, label string, category string, confidence double, y double, height double"
    clean = bands.filter(~is_consent_text(F.col("label"))).select(*columns)
    return clean.repartition(*keys).sortWithinPartitions(*keys, "y", "place").mapInPandas(_merged(keys, most), schema)


def _within(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _put(b: Column, y: Column, height: Column) -> Column:
    return F.struct(*[b[n].alias(n) for n in ("band_id", "label", "category", "confidence")], y.alias("y"), height.alias("height"))


def _bottom(b: Column) -> Column:
    return b["y"] + b["height"]


def _in_pairs(bands: Column, step) -> Column:
    """Fold from the top: `step` of the last band so far and the next one gives what stands in their place."""

    def add(done: Column, b: Column) -> Column:
        joined = lambda last: F.concat(F.slice(done, 1, F.size(done) - 1), step(last, b))
        return F.when(F.size(done) == 0, F.concat(done, F.array(b))).otherwise(bound(F.element_at(done, -1), joined))

    return F.aggregate(bands, F.slice(bands, 1, 0), add)


def _chrome(bands: Column) -> Column:
    """What lies above the first band belongs to it, what lies below the last one too, if it is little."""
    first, last = bands[0], F.element_at(bands, -1)
    whole = F.when((first["y"] > 0) & (first["y"] <= CHROME), _put(first, F.lit(0.0), _within(first["height"] + first["y"]))).otherwise(first)
    return F.when(F.size(bands) > 0, F.concat(F.array(whole), F.slice(bands, 2, F.greatest(F.lit(0), F.size(bands) - 1)))).otherwise(bands)


def _tail(bands: Column) -> Column:
    last = F.element_at(bands, -1)
    rest = 1 - _bottom(last)
    longer = F.when((rest > 0) & (rest <= SNAP), _put(last, last["y"], _within(last["height"] + rest))).otherwise(last)
    return F.when(F.size(bands) > 0, F.concat(F.slice(bands, 1, F.greatest(F.lit(0), F.size(bands) - 1)), F.array(longer))).otherwise(bands)


def _close(a: Column, b: Column) -> Column:
    """A small gap goes to the lower of two bands."""
    gap = b["y"] - _bottom(a)
    down = F.array(_put(a, a["y"], _within(a["height"] + gap)), b)
    up = F.array(a, _put(b, _within(_bottom(a)), _within(b["height"] + gap)))
    return F.when((gap <= 0) | (gap > SNAP), F.array(a, b)).when(a["height"] <= b["height"], down).otherwise(up)


def _swallow(a: Column, b: Column) -> Column:
    """A sliver is part of the band above it."""
    both = _put(a, a["y"], _within(F.greatest(_bottom(a), _bottom(b)) - a["y"]))
    return F.when(b["height"] < SLIVER, F.array(both)).otherwise(F.array(a, b))


def _head(bands: Column) -> Column:
    """A sliver at the top is part of the band below it."""
    a, b = bands[0], bands[1]
    top = F.least(a["y"], b["y"])
    both = _put(b, top, _within(F.greatest(_bottom(a), _bottom(b)) - top))
    rest = F.slice(bands, 3, F.greatest(F.lit(0), F.size(bands) - 2))
    return F.when((F.size(bands) >= 2) & (a["height"] < SLIVER), F.concat(F.array(both), rest)).otherwise(bands)


def _grow(bands: Column) -> Column:
    """A low band takes what it lacks from the one below, else from the one above, if that is high enough."""

    def at(done: Column, i: Column) -> Column:
        b, below, above = F.get(done, i), F.get(done, i + 1), F.get(done, i - 1)
        lack = LEAST - b["height"]
        low = b["height"] < LEAST
        down = F.coalesce(low & (below["height"] > LEAST + lack), F.lit(False))
        up = F.coalesce(low & ~down & (above["height"] > LEAST + lack), F.lit(False))
        edge, start = b["y"] + LEAST, F.greatest(above["y"] + LEAST, b["y"] - lack)
        taller = _put(b, start, _within(F.greatest(F.lit(LEAST), _bottom(b) - start)))

        def place(x: Column, k: Column) -> Column:
            return (
                F.when(down & (k == i), _put(x, x["y"], F.lit(LEAST)))
                .when(down & (k == i + 1), _put(x, edge, _within(_bottom(x) - edge)))
                .when(up & (k == i), taller)
                .when(up & (k == i - 1), _put(x, x["y"], _within(start - x["y"])))
                .otherwise(x)
            )

        return F.transform(done, place)

    return F.aggregate(F.when(F.size(bands) > 0, F.sequence(F.lit(0), F.size(bands) - 1)).otherwise(F.array().cast("array<int>")), bands, at)


def _trim(a: Column, b: Column) -> Column:
    """Of two bands that overlap, the higher one ends earlier, or begins later."""
    over = _bottom(a) - b["y"]
    shorter = F.array(_put(a, a["y"], F.greatest(F.lit(SLIVER), a["height"] - over)), b)
    later = F.array(a, _put(b, _bottom(a), F.greatest(F.lit(SLIVER), _bottom(b) - _bottom(a))))
    return F.when(over <= 0, F.array(a, b)).when(a["height"] >= b["height"], shorter).otherwise(later)


#: The steps of the refinement, one after the other.
_STEPS = (_chrome, lambda b: _in_pairs(b, _close), _tail, lambda b: _in_pairs(b, _swallow), _head, _grow, lambda b: _in_pairs(b, _trim))


def refine_bands(bands: DataFrame, keys: list[str]) -> DataFrame:
    """The bands of each page with small gaps closed, slivers folded, least heights, and no overlaps; place and band_id anew.

    A page's bands are one array, MOST_BANDS at most as `merge_bands` leaves them, which goes from step to step.
    """
    b = F.struct(F.col("y").alias("_y"), (-F.col("height")).alias("_h"), F.col("place").alias("_p"), F.struct("band_id", "label", "category", "confidence", F.col("y"), F.col("height")).alias("b"))
    pages = bands.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(b)), lambda x: x["b"]).alias("_b"))
    refined = F.col("_b")
    for step in _STEPS:
        refined = bound(refined, step)
    out = pages.select(*keys, F.posexplode(refined).alias("_i", "_x"))
    return out.select(*keys, (F.col("_i") + 1).cast("long").alias("place"), F.concat(F.lit("band_"), F.col("_i") + 1).alias("band_id"), "_x.label", "_x.category", "_x.confidence", part(F.col("_x.y")).alias("y"), part(F.col("_x.height")).alias("height"))


def band_looks(bands: DataFrame, keys: list[str], crops: DataFrame | None = None) -> DataFrame:
    """A look row of each band; `crops` has keys, band_id and path."""
    rows = bands if crops is None else bands.join(crops.select(*keys, "band_id", F.col("path").alias("_crop")), [*keys, "band_id"], "left")
    crop = F.lit(None).cast("string") if crops is None else F.col("_crop")
    hero = F.col("category") == "hero"
    said = F.format_string('Vision-detected %s section labeled "%s". Full-width band y=%.2f h=%.2f.', "category", "label", "y", "height")
    return rows.select(
        *keys, F.col("band_id").alias("section_id"), F.when(hero, "media").otherwise("vision_band").alias("signature"), "category", F.concat("category", F.lit(" band · "), "label").alias("stack_summary"), said.alias("look_summary"),
        "confidence", F.array_compact(F.array(crop, F.concat(F.lit("vision_layout:"), F.col("band_id")))).alias("evidence_refs"), F.when(hero, "hero").otherwise("inline").alias("media_role"), F.coalesce(F.concat(F.lit("crop "), crop), F.lit("vision band")).alias("media_notes"),
    )


def prefers_vision(pages: DataFrame, looks: DataFrame, keys: list[str], least: float = 0.6) -> DataFrame:
    """(keys, prefer_vision) of each page: at least 60 % of the looks from its nodes are thin, or there are none."""
    thin = F.lower(F.coalesce("signature", F.lit(""))).isin("body", "unknown") | (F.lower(F.coalesce("category", F.lit(""))) == "commerce")
    found = looks.groupBy(*keys).agg(F.avg(thin.cast("double")).alias("_thin"))
    return pages.select(*keys).distinct().join(found, keys, "left").select(*keys, F.coalesce(F.col("_thin") >= least, F.lit(True)).alias("prefer_vision"))
