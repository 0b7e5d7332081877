"""Queries over bands, looks and classes of sections, which Spark derives from line items and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import looks
from lumenfold.operators import bands, sections
from lumenfold.plans.base import query
from lumenfold.plans.layout import _STEPS, _blocks

#: A part is a page, its line items are what a model sees on three tiles of it.
_RAW = """r AS (SELECT l_partkey AS page, l_orderkey % 3 AS tile, (l_orderkey * 10 + l_linenumber) * 1000000000 + floor(l_extendedprice * 100)::BIGINT AS ordinal, CASE WHEN l_linenumber < 6 THEN 'b ' || l_linenumber END AS id,
CASE l_linenumber WHEN 1 THEN 'Cookie settings' WHEN 2 THEN '  ' WHEN 3 THEN NULL ELSE l_returnflag || l_linestatus END AS label,
CASE l_returnflag WHEN 'A' THEN 'HERO' WHEN 'N' THEN 'feature' WHEN 'R' THEN 'carousel' END AS category, CASE WHEN l_linenumber < 7 THEN round(l_discount * 10, 1) END AS confidence, round(l_extendedprice % 97 / 90, 3) AS y, round(l_quantity / 180, 3) AS height FROM lineitem)"""
_PART = "CASE WHEN {0} IS NULL THEN 0 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, {0})) END"
_NORMAL = f"""{_RAW}, n AS (SELECT *, row_number() OVER (PARTITION BY page, tile ORDER BY ordinal) AS n FROM r),
l AS (SELECT *, coalesce(nullif(trim(coalesce(label, id, 'Band ' || n)), ''), 'Band ' || n) AS said FROM n),
k AS (SELECT *, CASE WHEN kind = 'hero' AND row_number() OVER (PARTITION BY page, tile, kind = 'hero' ORDER BY n) > 1 THEN 'feature' ELSE kind END AS kind2 FROM (SELECT *, CASE WHEN lower(category) IN ('hero', 'feature') THEN lower(category) ELSE 'other' END AS kind FROM l WHERE said NOT LIKE '%ookie%')),
z AS (SELECT page, tile, n, replace(coalesce(id, 'band_' || n), ' ', '_') AS band_id, said AS label, kind2 AS kind, CASE WHEN confidence IS NULL THEN 0.6 ELSE {_PART.format("confidence")} END AS confidence, {_PART.format("y")} AS y, height FROM k WHERE height >= 0.05 QUALIFY row_number() OVER (PARTITION BY page, tile ORDER BY n) <= 12),
b AS (SELECT page, tile, row_number() OVER (PARTITION BY page, tile ORDER BY y, h DESC, n) AS place, band_id, label, CASE WHEN kind = 'hero' AND row_number() OVER (PARTITION BY page, tile, kind = 'hero' ORDER BY y, h DESC, n) > 1 THEN 'feature' ELSE kind END AS category, confidence, y, h AS height
FROM (SELECT *, CASE WHEN y + height > 1 THEN greatest(0.04::DOUBLE, 1 - y) ELSE height END AS h FROM z))"""


def _raw(t):
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    label = F.when(n == 1, "Cookie settings").when(n == 2, "  ").when(n > 3, F.concat(flag, "l_linestatus"))
    kind = F.when(flag == "A", "HERO").when(flag == "N", "feature").when(flag == "R", "carousel")
    return t("lineitem").select(F.col("l_partkey").alias("page"), (F.col("l_orderkey") % 3).alias("tile"), ((F.col("l_orderkey") * 10 + n) * 1000000000 + F.floor(F.col("l_extendedprice") * 100)).alias("ordinal"), F.when(n < 6, F.concat(F.lit("b "), n)).alias("id"), label.alias("label"), kind.alias("category"), F.when(n < 7, F.round(F.col("l_discount") * 10, 1)).alias("confidence"), F.round(F.col("l_extendedprice") % 97 / 90, 3).alias("y"), F.round(F.col("l_quantity") / 180, 3).alias("height"))


@query("d23_normalised_bands", f"WITH {_NORMAL} SELECT page, tile, place, band_id, label, category, confidence, y, round(height, 9) AS height FROM b")
def _(t):
    return bands.normalise_bands(_raw(t), ["page", "tile"]).withColumn("height", F.round("height", 9))


#: The last band that stays is the end of a list; the next one takes its place, goes, or is added.
_MERGED = f"""{_NORMAL}, o AS (SELECT page, tile, place, 't' || tile || '_' || band_id AS band_id, label, category, confidence, {_PART.format("(tile * 800.0 + y * 1000) / 2600.0")} AS y, {_PART.format("height * 1000 / 2600.0")} AS height FROM b),
q AS (SELECT page, list({{'i': band_id, 'l': label, 'c': category, 's': confidence, 'y': y, 'h': height}} ORDER BY y, tile * 100 + place) AS bands FROM o GROUP BY page),
m AS (SELECT page, list_reduce(list_transform(bands, lambda b: [b]), lambda acc, e: CASE WHEN least(acc[-1].y + acc[-1].h, e[1].y + e[1].h) - greatest(acc[-1].y, e[1].y) > least(acc[-1].h, e[1].h) * 0.45::DOUBLE OR abs(acc[-1].y - e[1].y) < 0.03::DOUBLE
THEN CASE WHEN e[1].s > acc[-1].s OR e[1].s = acc[-1].s AND e[1].h > acc[-1].h THEN list_concat(acc[:-2], e) ELSE acc END ELSE list_concat(acc, e) END)[:12] AS bands FROM q),
f AS (SELECT page, generate_subscripts(bands, 1) AS place, unnest(bands) AS b FROM m),
g AS (SELECT page, place, b.i AS band_id, b.l AS label, CASE WHEN b.c = 'hero' AND row_number() OVER (PARTITION BY page, b.c = 'hero' ORDER BY place) > 1 THEN 'feature' ELSE b.c END AS category, b.s AS confidence, b.y AS y, b.h AS height FROM f)"""


def _merged(t):
    tiles = bands.normalise_bands(_raw(t), ["page", "tile"])
    placed = bands.to_page(tiles, F.col("tile") * 800.0, F.lit(1000.0), F.lit(2600.0), F.concat(F.lit("t"), F.col("tile")))
    return bands.merge_bands(placed.withColumn("place", F.col("tile") * 100 + F.col("place")), ["page"])


@query("d23_merged_bands", f"WITH {_MERGED} SELECT page, place, band_id, label, category, confidence, round(y, 9) AS y, round(height, 9) AS height FROM g")
def _(t):
    return _merged(t).withColumns({"y": F.round("y", 9), "height": F.round("height", 9)})


def _sql_part(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


def _sql_put(b: str, y: str, h: str) -> str:
    return f"{{'i': {b}.i, 'l': {b}.l, 'c': {b}.c, 's': {b}.s, 'y': ({y})::DOUBLE, 'h': ({h})::DOUBLE}}"


def _sql_pairs(step: str) -> str:
    """A step over neighbours: a is the last band so far, b the next one."""
    return f"list_reduce(list_transform(bands, lambda x: [x]), lambda acc, e: list_concat(acc[:-2], {step.replace('<a>', 'acc[-1]').replace('<b>', 'e[1]')}))"


def _refined_sql() -> str:
    put, part = _sql_put, _sql_part
    chrome = f"CASE WHEN bands[1].y > 0 AND bands[1].y <= 0.08 THEN list_concat([{put('bands[1]', '0', part('bands[1].h + bands[1].y'))}], bands[2:]) ELSE bands END"
    gap = "(<b>.y - (<a>.y + <a>.h))"
    close = f"CASE WHEN {gap} <= 0 OR {gap} > 0.045 THEN [<a>, <b>] WHEN <a>.h <= <b>.h THEN [{put('<a>', '<a>.y', part(f'<a>.h + {gap}'))}, <b>] ELSE [<a>, {put('<b>', part('<a>.y + <a>.h'), part(f'<b>.h + {gap}'))}] END"
    rest = "(1 - (bands[-1].y + bands[-1].h))"
    tail = f"CASE WHEN {rest} > 0 AND {rest} <= 0.045 THEN list_concat(bands[:-2], [{put('bands[-1]', 'bands[-1].y', part(f'bands[-1].h + {rest}'))}]) ELSE bands END"
    swallow = f"CASE WHEN <b>.h < 0.025 THEN [{put('<a>', '<a>.y', part('greatest(<a>.y + <a>.h, <b>.y + <b>.h) - <a>.y'))}] ELSE [<a>, <b>] END"
    head = f"CASE WHEN len(bands) >= 2 AND bands[1].h < 0.025 THEN list_concat([{put('bands[2]', 'least(bands[1].y, bands[2].y)', part('greatest(bands[1].y + bands[1].h, bands[2].y + bands[2].h) - least(bands[1].y, bands[2].y)'))}], bands[3:]) ELSE bands END"
    b, below, above = "acc[i]", "acc[i + 1]", "acc[i - 1]"
    lack = f"(0.04 - {b}.h)"
    down = f"({b}.h < 0.04 AND i < len(acc) AND {below}.h > 0.04 + {lack})"
    up = f"({b}.h < 0.04 AND i > 1 AND {above}.h > 0.04 + {lack})"
    start = f"greatest({above}.y + 0.04::DOUBLE, {b}.y - {lack})"
    lower = f"list_concat(list_concat(acc[:i - 1], [{put(b, f'{b}.y', '0.04')}, {put(below, f'{b}.y + 0.04::DOUBLE', part(f'{below}.y + {below}.h - ({b}.y + 0.04::DOUBLE)'))}]), acc[i + 2:])"
    higher = f"list_concat(list_concat(acc[:i - 2], [{put(above, f'{above}.y', part(f'{start} - {above}.y'))}, {put(b, start, part(f'greatest(0.04::DOUBLE, {b}.y + {b}.h - {start})'))}]), acc[i + 1:])"
    grow = f"list_reduce(range(1, len(bands) + 1), lambda acc, i: CASE WHEN {down} THEN {lower} WHEN {up} THEN {higher} ELSE acc END, bands)"
    over = "(<a>.y + <a>.h - <b>.y)"
    trim = f"CASE WHEN {over} <= 0 THEN [<a>, <b>] WHEN <a>.h >= <b>.h THEN [{put('<a>', '<a>.y', f'greatest(0.025::DOUBLE, <a>.h - {over})')}, <b>] ELSE [<a>, {put('<b>', '<a>.y + <a>.h', 'greatest(0.025::DOUBLE, <b>.y + <b>.h - (<a>.y + <a>.h))')}] END"
    steps = [chrome, _sql_pairs(close), tail, _sql_pairs(swallow), head, grow, _sql_pairs(trim)]
    names = "s1", "s2", "s3", "s4", "s5", "s6", "s7"
    chain = ", ".join(f"{n} AS (SELECT page, {step} AS bands FROM {before})" for n, step, before in zip(names, steps, ("s0", *names), strict=False))
    return f"WITH {_MERGED}, s0 AS (SELECT page, list({{'i': band_id, 'l': label, 'c': category, 's': confidence, 'y': y, 'h': height}} ORDER BY y, height DESC, place) AS bands FROM g GROUP BY page), {chain}, u AS (SELECT page, generate_subscripts(bands, 1) AS place, unnest(bands) AS b FROM s7) SELECT page, place, 'band_' || place AS band_id, b.l AS label, b.c AS category, b.s AS confidence, round({part('b.y')}, 9) AS y, round({part('b.h')}, 9) AS height FROM u"


@query("d24_refined_bands", _refined_sql())
def _(t):
    return bands.refine_bands(_merged(t), ["page"]).withColumns({"y": F.round("y", 9), "height": F.round("height", 9)})


@query("d25_band_looks", f"WITH {_MERGED} SELECT page, band_id AS section_id, CASE WHEN category = 'hero' THEN 'media' ELSE 'vision_band' END AS signature, category || ' band · ' || label AS stack_summary, 'Vision-detected ' || category || ' section labeled \"' || label || '\".' AS said, 'vision_layout:' || band_id AS evidence, CASE WHEN category = 'hero' THEN 'hero' ELSE 'inline' END AS media_role FROM g")
def _(t):
    out = bands.band_looks(_merged(t), ["page"])
    return out.select("page", "section_id", "signature", "stack_summary", F.regexp_extract("look_summary", r"^(.*\.) Full-width", 1).alias("said"), F.array_join("evidence_refs", ",").alias("evidence"), "media_role")


_ORDERS = f"""{_STEPS}, e AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, signature, floor(o_totalprice * 100)::BIGINT % 2600 AS y, floor(o_totalprice * 10)::BIGINT % 1200 AS h, floor(o_totalprice * 7)::BIGINT % 1500 AS w FROM orders JOIN g ON g.l_orderkey = o_orderkey)"""


def _orders(t):
    """An order is a section of its customer's page; its line items are the steps of its recipe."""
    found = sections.recipes(_blocks(t), ["l_orderkey"]).select(F.col("l_orderkey").alias("o_orderkey"), "signature")
    cents = lambda by, most: (F.floor(F.col("o_totalprice") * by) % most).cast("double")
    return t("orders").join(found, "o_orderkey").withColumns({"y": cents(100, 2600), "h": cents(10, 1200), "w": cents(7, 1500)})


@query("d25_prefers_vision", f"WITH {_ORDERS} SELECT c_custkey AS page, coalesce(avg((o_orderstatus = 'F' OR signature = 'body')::INT) >= 0.6, TRUE) AS prefer_vision FROM customer LEFT JOIN e ON o_custkey = c_custkey GROUP BY c_custkey")
def _(t):
    looks_ = _orders(t).select(F.col("o_custkey").alias("page"), "signature", F.when(F.col("o_orderstatus") == "F", "commerce").otherwise("hero").alias("category"))
    return bands.prefers_vision(t("customer").select(F.col("c_custkey").alias("page")), looks_, ["page"])


#: What the texts say, by priority and status; a rule of its own for most of them.
_SAYS = (("1-URGENT", "trusted by many"), ("2-HIGH", "price plan"), ("3-MEDIUM", "faq and questions"), ("4-NOT SPECIFIED", "subscribe to the newsletter"))
_CLASSES = f"""{_ORDERS}, told AS (SELECT *, CASE o_orderpriority {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _SAYS)} ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'accept all cookies' ELSE 'words' END END AS said, CASE o_orderkey % 9 WHEN 0 THEN 'header' WHEN 1 THEN 'footer' WHEN 2 THEN 'article' ELSE 'section' END AS tag,
CASE WHEN o_orderkey % 7 = 0 THEN signature || '>list' WHEN o_orderkey % 7 = 1 THEN signature || '>cta' WHEN o_orderkey % 7 = 2 THEN 'nav' WHEN o_orderkey % 7 = 3 THEN signature || '>form' ELSE signature END AS sig FROM e),
p AS (SELECT *, y <= 900 * 0.32::DOUBLE AS above, y <= 900 * 0.45::DOUBLE AS near_top, list_contains(string_split(sig, '>'), 'media') AS media, sig LIKE '%heading%' AS heading, sig LIKE '%cta%' AS cta, sig LIKE '%form%' AS form, sig LIKE '%list%' AS has_list, sig LIKE '%body%' AS body, sig LIKE '%nav%' OR tag IN ('nav', 'header') AS nav, sig LIKE 'media%' AS leads, sig = 'media' AS only_media FROM told),
v AS (SELECT *, media AND h >= 900 * 0.32::DOUBLE AS tall_media, media AND w >= 880 AND h >= 900 * 0.42::DOUBLE AS full_bleed FROM p),
w AS (SELECT *, CASE WHEN tag = 'header' OR nav AND near_top AND h < 160 THEN 'global_nav|nav|0.9' WHEN tag = 'footer' OR nav AND y > 900 THEN 'footer|nav|0.88' WHEN form AND said LIKE '%subscribe%' THEN 'cta_newsletter|form|0.82'
WHEN said LIKE '%faq%' AND has_list THEN 'faq|content|0.84' WHEN said LIKE '%price%' AND (has_list OR cta) THEN 'pricing|commerce|0.83' WHEN said LIKE '%trusted by%' THEN 'testimonials|social_proof|0.8' WHEN said LIKE '%cookie%' THEN 'cookie_consent|cookie_consent|0.9'
WHEN above AND full_bleed THEN CASE WHEN heading AND cta THEN CASE WHEN leads THEN 'hero_media_above' ELSE 'hero_split_cta' END WHEN only_media OR leads THEN 'hero_media_above' WHEN cta THEN 'hero' ELSE 'hero_centered' END || CASE WHEN heading OR cta THEN '|hero|0.86' ELSE '|hero|0.8' END
WHEN above AND heading AND media AND cta THEN CASE WHEN leads THEN 'hero_media_above' ELSE 'hero_split_cta' END || '|hero|0.86' WHEN near_top AND tall_media AND NOT full_bleed THEN CASE WHEN heading OR cta THEN 'feature_spotlight|feature|0.74' ELSE 'feature_grid|feature|0.74' END
WHEN media AND heading AND cta THEN 'feature_spotlight|feature|0.78' WHEN tall_media AND only_media THEN 'feature_spotlight|feature|0.72' WHEN heading AND has_list AND NOT form THEN 'feature_grid|feature|0.74' WHEN heading AND cta AND NOT media THEN 'cta_band|conversion|0.76'
WHEN heading AND body AND NOT media AND NOT cta AND NOT form THEN 'content_block|content|0.7' END AS rule FROM v)"""
#: A catalog of four entries; two of them have more than one hint.
_HINTS = (("dig:section.gallery", "section", "media", 1, ["media", "body"]), ("dig:section.gallery", "section", "media", 1, ["media_large", "body", "media"]), ("dig:section.quote", "section", "social_proof", 2, ["body"]), ("dig:pattern.story", "pattern", "content", 3, ["body", "media", "heading"]), ("dig:section.plain", "section", "content", 4, ["media"]))


def _classed(t):
    o = _orders(t)
    k = F.col("o_orderkey")
    said = F.when(k % 5 == 0, "accept all cookies").otherwise("words")
    for name, words in _SAYS:
        said = F.when(F.col("o_orderpriority") == name, words).otherwise(said)
    tag = F.when(k % 9 == 0, "header").when(k % 9 == 1, "FOOTER").when(k % 9 == 2, "article").otherwise("section")
    sig = F.when(k % 7 == 0, F.concat("signature", F.lit(">list"))).when(k % 7 == 1, F.concat("signature", F.lit(">cta"))).when(k % 7 == 2, "nav").when(k % 7 == 3, F.concat("signature", F.lit(">form"))).otherwise(F.col("signature"))
    rows = o.select(F.col("o_custkey").alias("page"), k.alias("section_id"), tag.alias("tag"), looks.box(F.lit(0.0), F.col("y"), F.col("w"), F.col("h")).alias("box"), F.lit(None).cast("struct<x:double,y:double,width:double,height:double>").alias("media_box"), sig.alias("signature"), F.array(said).alias("text_signals"))
    hints = t("region").sparkSession.createDataFrame(_HINTS, "entry_id string, entity_type string, category string, place int, hint array<string>")
    return sections.classify_sections(rows, F.lit(900.0), hints)


#: Scores of the hints by what is left of the signatures: roles body, media, heading, cta, list, form and nav, no two alike in a row.
_HINTED = """h(entry, category, place, hint) AS (VALUES ('dig:section.gallery', 'media', 1, ['media', 'body']), ('dig:section.gallery', 'media', 1, ['media', 'body', 'media']), ('dig:section.quote', 'social_proof', 2, ['body']), ('dig:pattern.story', 'content', 3, ['body', 'media', 'heading']), ('dig:section.plain', 'content', 4, ['media'])),
x AS (SELECT DISTINCT sig, above FROM w WHERE rule IS NULL),
y AS (SELECT sig, above, entry, category, place, hint, list_reduce(list_transform(hint, lambda r: {'r': r, 'n': 0, 'p': 0::BIGINT}), lambda acc, e: CASE WHEN list_position(string_split(sig, '>')[acc.p + 1:], e.r) > 0 THEN {'r': '', 'n': acc.n + 1, 'p': acc.p + list_position(string_split(sig, '>')[acc.p + 1:], e.r)} ELSE acc END, {'r': '', 'n': 0, 'p': 0::BIGINT}).n AS n FROM x, h),
i AS (SELECT sig, above, entry, category, place, max(n::DOUBLE / len(hint) + CASE WHEN n = len(hint) THEN 0.15 ELSE 0 END) AS score FROM y WHERE NOT (category = 'social_proof' AND sig IN ('body', 'unknown')) GROUP BY ALL HAVING max(n::DOUBLE / len(hint) + CASE WHEN n = len(hint) THEN 0.15 ELSE 0 END) >= 0.66),
j AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY sig, above ORDER BY score DESC, place) = 1)"""


@query("d16_section_classes", f"""WITH {_CLASSES}, {_HINTED} SELECT o_custkey AS page, o_orderkey AS section_id, CASE WHEN rule IS NOT NULL THEN 'dig:section.' || split_part(rule, '|', 1) WHEN entry IS NOT NULL THEN entry WHEN tag = 'article' THEN 'dig:section.article' ELSE 'dig:section.content_block' END AS taxonomy_id,
CASE WHEN rule IS NOT NULL THEN split_part(rule, '|', 2) WHEN entry IS NOT NULL THEN category ELSE 'content' END AS category, round(CASE WHEN rule IS NOT NULL THEN split_part(rule, '|', 3)::DOUBLE WHEN entry IS NOT NULL THEN least(0.9::DOUBLE, 0.55::DOUBLE + score * 0.35::DOUBLE) WHEN tag = 'article' THEN 0.8 ELSE 0.55 END, 6) AS confidence FROM w LEFT JOIN j ON j.sig = w.sig AND j.above = w.above""")
def _(t):
    return _classed(t).select("page", "section_id", "taxonomy_id", "category", F.round("confidence", 6).alias("confidence"))


@query("d15_hint_scores", f"WITH {_CLASSES}, {_HINTED.split('i AS')[0].rstrip().rstrip(',').replace(' WHERE rule IS NULL', '')} SELECT sig AS signature, entry, max(round(n::DOUBLE / len(hint) + CASE WHEN n = len(hint) THEN 0.15 ELSE 0 END, 6)) AS score FROM y GROUP BY ALL")
def _(t):
    hints = t("region").sparkSession.createDataFrame(_HINTS, "entry string, entity_type string, category string, place int, hint array<string>")
    met = _classed(t).select("signature").distinct().join(F.broadcast(hints), F.size("hint") > 0)
    return met.groupBy("signature", "entry").agg(F.max(F.round(sections.hint_score(F.split("signature", ">"), F.col("hint")), 6)).alias("score"))


#: The sections of a page, best first, are added to the picks one by one.
_PICKS = f"""{_CLASSES}, a AS (SELECT o_custkey AS page, o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'feature' WHEN 'O' THEN 'Hero' ELSE 'social_proof' END AS category, sig, y, h, CASE o_orderkey % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'tablet' ELSE 'mobile' END AS vp, (o_orderkey % 100) / 100.0::DOUBLE AS sure, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ordinal, said FROM w),
c AS (SELECT *, round(sure + CASE WHEN category = 'Hero' THEN 2 ELSE 0 END + CASE WHEN category = 'feature' THEN 1 ELSE 0 END + CASE WHEN sig LIKE '%media%' THEN 0.6 ELSE 0 END + CASE WHEN sig LIKE '%cta%' THEN 0.5 ELSE 0 END + CASE WHEN sig LIKE '%heading%' THEN 0.35 ELSE 0 END + CASE WHEN ordinal <= 3 THEN 0.4 ELSE 0 END
- CASE WHEN category = 'social_proof' THEN 0.35 ELSE 0 END + CASE WHEN len(string_split(sig, '>')) >= 3 THEN 0.45 ELSE 0 END - CASE WHEN sig = 'body' THEN 0.5 ELSE 0 END - CASE WHEN h > 0 AND h < 120 THEN 1.2 ELSE 0 END + CASE vp WHEN 'desktop' THEN 1.2 WHEN 'tablet' THEN 0.2 ELSE -0.3 END, 6)::DOUBLE AS score FROM a WHERE said NOT LIKE '%cookie%'),
d AS (SELECT page, list_reduce(list({{'id': id, 'c': lower(category), 's': sig, 'y': y, 'score': score}} ORDER BY score DESC, ordinal), lambda acc, e: CASE WHEN len(acc) >= 6 OR len(list_filter(acc, lambda x: x.c = e.c)) >= 2 OR len(list_filter(acc, lambda x: x.s = e.s)) >= 2 OR e.c = 'hero' AND len(list_filter(acc, lambda x: x.c = 'hero')) >= 1 OR (e.c = 'hero' OR e.s = 'media') AND len(list_filter(acc, lambda x: abs(x.y - e.y) < 120)) > 0 THEN acc ELSE list_append(acc, e) END,
[]::STRUCT(id BIGINT, c VARCHAR, s VARCHAR, y BIGINT, score DOUBLE)[]) AS picks FROM c GROUP BY page)"""


@query("d26_picked_sections", f"WITH {_PICKS} SELECT page, p.id AS section_id, pick, p.score AS score FROM (SELECT page, generate_subscripts(picks, 1) AS pick, unnest(picks) AS p FROM d)")
def _(t):
    k = F.col("section_id")
    rows = _classed(t).drop("category", "taxonomy_id", "confidence", "method").join(t("orders").select(F.col("o_orderkey").alias("section_id"), "o_orderstatus"), "section_id")
    category = F.when(F.col("o_orderstatus") == "F", "feature").when(F.col("o_orderstatus") == "O", "Hero").otherwise("social_proof")
    steps = F.array(F.struct(F.lit("body").alias("role"), F.lit("x").alias("text"), F.col("box")))
    name = F.when(k % 3 == 0, "desktop").when(k % 3 == 1, "tablet").otherwise("mobile")
    rows = rows.select("page", "section_id", k.alias("ordinal"), category.alias("category"), F.lit("dig:section.generic").alias("taxonomy_id"), "signature", "text_signals", ((k % 100) / 100).alias("confidence"), name.alias("viewport_name"), steps.alias("steps"))
    return sections.pick_sections(rows, ["page"], 6).withColumn("score", F.round("score", 6))
