"""Queries over urls and texts: keys, redaction, normalisers, embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import keys, looks, vectors
from lumenfold.operators import relational, rollups
from lumenfold.plans.base import ORACLES, query

_U = "'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#@]*@)?([^/?#@:\\s]+)(:[0-9]*)?([^?#]*)(\\?[^#]*)?(#.*)?$'"
_PARTS = f"""u AS (SELECT page_id, url, lower(regexp_extract(url, {_U}, 1)) AS s, regexp_extract(url, {_U}, 2) AS w, lower(regexp_extract(url, {_U}, 3)) AS h, regexp_extract(url, {_U}, 4) AS p,
regexp_extract(url, {_U}, 5) AS path, regexp_extract(url, {_U}, 6) AS q, regexp_extract(url, {_U}, 7) AS f, regexp_matches(url, {_U}) AS ok FROM pages),
v AS (SELECT *, CASE WHEN p = ':' OR s = 'http' AND p = ':80' OR s = 'https' AND p = ':443' THEN '' ELSE p END AS port, CASE WHEN path = '' THEN '/' ELSE path END AS full_path FROM u),
x AS (SELECT *, CASE WHEN length(full_path) > 1 AND full_path LIKE '%/' THEN left(full_path, length(full_path) - 1) ELSE full_path END AS short_path FROM v)"""
_KEY = "regexp_replace(h, '^www\\.', '') || CASE WHEN short_path = '/' THEN '' ELSE short_path END"
_REDACTED = "s || '://' || w || h || port || full_path || coalesce('?' || nullif(array_to_string(list_transform(list_filter(string_split(substr(q, 2), '&'), lambda y: y <> ''), lambda y: regexp_replace(y, '=.*$', '') || '=%5Bredacted%5D'), '&'), ''), '')"


@query("b1_capture_key", f"WITH {_PARTS} SELECT page_id, {_KEY} AS key FROM x")
def _(t):
    return t("pages").select("page_id", keys.capture_key(F.col("url")).alias("key"))


@query("b2_unique_urls", f"WITH k AS ({ORACLES['b1_capture_key']}) SELECT key, min(page_id) AS page_id, count(*) - 1 AS skipped_duplicate FROM k WHERE key <> '' GROUP BY key")
def _(t):
    return rollups.unique_urls(t("pages"), keys.capture_key(F.col("url")), "page_id")


@query("b3_drop_existing", f"""WITH k AS ({ORACLES['b1_capture_key']}), e AS (SELECT DISTINCT key FROM k WHERE page_id % 5 = 0)
SELECT k.key, min(page_id) AS page_id, max(e.key) IS NOT NULL AS existing, CASE WHEN max(e.key) IS NULL THEN 0 ELSE count(*) END AS skipped_existing, CASE WHEN max(e.key) IS NULL THEN count(*) - 1 ELSE 0 END AS skipped_duplicate FROM k LEFT JOIN e ON k.key = e.key WHERE k.key <> '' GROUP BY k.key""")
def _(t):
    keyed = t("pages").select("page_id", keys.capture_key(F.col("url")).alias("key"))
    return relational.drop_existing_urls(keyed, "key", "page_id", keyed.filter("page_id % 5 = 0").select("key"))


@query("b4_join_key", f"WITH {_PARTS} SELECT page_id, CASE WHEN s IN ('http', 'https') THEN s || '://' || h || port || short_path END AS key FROM x")
def _(t):
    return t("pages").select("page_id", keys.join_key(F.col("url")).alias("key"))


@query("b5_redact_url", f"WITH {_PARTS} SELECT page_id, CASE WHEN ok THEN {_REDACTED} ELSE '[invalid-url]' END AS redacted FROM x")
def _(t):
    return t("pages").select("page_id", keys.redact_url(F.col("url")).alias("redacted"))


@query("b10_redact_evidence", f"""WITH {_PARTS}, r AS (SELECT page_id, url, CASE WHEN ok THEN {_REDACTED} ELSE '[invalid-url]' END AS red FROM x)
SELECT page_id, red AS href, red AS listed, red || ' 2x' AS in_map, url AS plain, red AS wrapped, 'a{{background:url(' || red || ')}}' AS css, url AS source FROM r""")
def _(t):
    url = F.col("url")
    css = F.concat(F.lit("a{background:url("), url, F.lit(")}"))
    named = F.struct(F.lit("url").alias("name"), F.struct(url.alias("value"), F.lit(1).alias("line")).alias("value"))
    record = F.struct(F.struct(url.alias("href"), url.alias("label")).alias("link"), F.array(F.struct(F.array(F.struct(url.alias("src"))).alias("images"))).alias("items"), F.create_map(F.lit("srcset"), F.concat(url, F.lit(" 2x")), F.lit("alt"), url).alias("attributes"), F.struct(css.alias("css_text"), url.alias("source")).alias("sheet"), named.alias("entry"))
    rows = t("pages").select("page_id", "url", record.alias("e"))
    clean = rows.select("page_id", keys.redact_evidence(F.col("e"), rows.schema["e"].dataType, url).alias("e"))
    return clean.select("page_id", F.col("e.link.href").alias("href"), F.col("e.items")[0]["images"][0]["src"].alias("listed"), F.col("e.attributes")["srcset"].alias("in_map"), F.col("e.link.label").alias("plain"), F.col("e.entry.value.value").alias("wrapped"), F.col("e.sheet.css_text").alias("css"), F.col("e.sheet.source").alias("source"))


@query("b8_redact_diagnostic", f"""WITH {_PARTS}, r AS (SELECT page_id, CASE WHEN ok THEN {_REDACTED} ELSE '[invalid-url]' END AS red FROM x)
SELECT page_id, sha256('at ' || red || ' with Bearer [redacted] and TOKEN=[redacted]') AS redacted_sha256 FROM r""")
def _(t):
    text = F.concat(F.lit("at "), F.col("url"), F.lit(" with bearer ab.c"), F.col("page_id").cast("string"), F.lit(" and TOKEN="), F.col("page_id").cast("string"))
    return t("pages").select("page_id", F.sha2(keys.redact_diagnostic(text), 256).alias("redacted_sha256"))


@query("b8_redact_documents")
def _(t):
    return t("documents").select("doc_id", F.sha2(keys.redact_diagnostic(F.col("text")), 256).alias("redacted_sha256"))


@query("b11_redact_html")
def _(t):
    return t("pages").select("page_id", F.sha2(keys.redact_html(F.col("html"), F.col("url")), 256).alias("redacted_sha256"))


@query("b12_site_identity", f"""WITH {_PARTS} SELECT page_id, 'site_' || substr(sha256(s || '://' || h || port), 1, 20) AS site_id, h AS domain, s AS scheme, s || '://' || h || port AS origin, 'pg_' || substr(sha256(url), 1, 20) AS page_key, full_path AS route FROM x WHERE ok""")
def _(t):
    named = t("pages").select("page_id", keys.site_identity(F.col("url")).alias("i")).filter("i IS NOT NULL")
    return named.select("page_id", "i.site_id", "i.domain", "i.scheme", "i.origin", F.col("i.page_id").alias("page_key"), "i.route")


@query("b13_host_key", f"WITH {_PARTS} SELECT page_id, regexp_replace(h, '^www\\.', '') AS host FROM x")
def _(t):
    return t("pages").select("page_id", keys.host_key(F.col("url")).alias("host"))


@query("b14_destination_class", f"""WITH {_PARTS} SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'internal_same_origin' WHEN 1 THEN 'internal_path' WHEN 2 THEN 'action_unsafe' ELSE 'external' END AS destination_class,
CASE WHEN page_id % 4 = 2 THEN 'path' END AS unsafe_reason FROM x WHERE s IN ('http', 'https') AND NOT regexp_matches(path, '(?i)/(logout|log-out|signout|sign-out|delete|destroy|purchase|checkout|pay|billing|password|reset-password|download)\\b|\\.(zip|exe|dmg|pkg|msi)(\\?|$)')""")
def _(t):
    href = F.when(F.col("page_id") % 4 == 0, F.lit("?again=1")).when(F.col("page_id") % 4 == 1, F.lit("/an/other/path")).when(F.col("page_id") % 4 == 2, F.lit("/account/logout")).otherwise(F.lit("https://elsewhere.example/x?y=1"))
    rows = t("pages").filter(~F.regexp_extract("url", keys.URL, 5).rlike(keys.UNSAFE_PATH) & F.lower(F.regexp_extract("url", keys.URL, 1)).isin("http", "https"))
    rows = rows.withColumn("to", keys.resolve(href, F.col("url")))
    return rows.select("page_id", keys.destination_class(href, F.col("url"), F.col("to")).alias("d")).select("page_id", "d.destination_class", "d.unsafe_reason")


@query("b15_path", f"WITH {_PARTS} SELECT page_id, CASE WHEN lower(path) LIKE '/%' THEN lower(path) ELSE '/' || lower(path) END AS path FROM x")
def _(t):
    return t("pages").select("page_id", keys.path_of(F.col("url")).alias("path"))


@query("b16_locale", f"""WITH {_PARTS} SELECT page_id, CASE WHEN h LIKE '%.de' THEN 'de-DE' WHEN h LIKE '%.at' THEN 'de-AT' WHEN h LIKE '%.ch' THEN 'de-CH' WHEN h LIKE '%.fr' THEN 'fr-FR' WHEN h LIKE '%.it' THEN 'it-IT' WHEN h LIKE '%.nl' THEN 'nl-NL' WHEN h LIKE '%.uk' THEN 'en-GB' WHEN page_id % 2 = 0 THEN 'de-DE' ELSE 'en-US' END AS locale FROM x""")
def _(t):
    zone = F.when(F.col("page_id") % 2 == 0, "Europe/Berlin").otherwise("America/Chicago")
    return t("pages").select("page_id", keys.locale_of(F.col("url"), zone).alias("locale"))


@query("b18_home_and_blocked", f"WITH {_PARTS} SELECT page_id, regexp_matches(path, '^/*$') AND q IN ('', '?') AS home, h = '' OR regexp_matches(h, '\\.(gov|edu|mil)$') OR h LIKE '%.wikipedia.org' OR h = 'example.com' OR h LIKE '%.example.com' AS blocked FROM x")
def _(t):
    return t("pages").select("page_id", keys.is_home(F.col("url")).alias("home"), keys.is_blocked(keys.host_of(F.col("url")), ["example.com"]).alias("blocked"))


@query("b19_bound_bytes", "SELECT doc_id, strlen(text) > 200 AS truncated FROM documents WHERE text IS NOT NULL")
def _(t):
    cut = t("documents").filter("text IS NOT NULL").select("doc_id", keys.bound_bytes(F.col("text"), 200, "text").alias("b"))
    return cut.filter(F.octet_length("b.value") <= 300).select("doc_id", "b.truncated")


@query("b20_clip", "SELECT doc_id, sha256(CASE WHEN length(c) <= 120 THEN c ELSE rtrim(left(c, 119)) || '…' END) AS clip_sha256 FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS c FROM documents) WHERE c <> ''")
def _(t):
    return t("documents").select("doc_id", keys.clip(F.col("text")).alias("c")).filter("c IS NOT NULL").select("doc_id", F.sha2("c", 256).alias("clip_sha256"))


@query("b20_unique_first", "SELECT conv_id, len(list_distinct(list(lower(trim(role)))))::BIGINT AS n FROM conversations GROUP BY conv_id")
def _(t):
    lists = t("conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: F.upper(s["role"])).alias("r"))
    return lists.select("conv_id", F.size(keys.unique_first(F.col("r"), 10)).cast("long").alias("n"))


@query("b22_consent", "SELECT doc_id, regexp_matches(text, '(?i)cookie|einwilligung|consent|zustimmung|datenschutz.*einstell|alle akzeptieren|accept all|tracking.*(akzept|accept)|zwecke|privatsphäre|gdpr|cmp') AS consent FROM documents WHERE text IS NOT NULL")
def _(t):
    return t("documents").filter("text IS NOT NULL").select("doc_id", keys.is_consent_text(F.col("text")).alias("consent"))


@query("b24_colors", """WITH c AS (SELECT p_partkey, (p_partkey * 7) % 256 AS r, (p_partkey * 13) % 256 AS g, p_size % 256 AS b, p_size % 101 AS a FROM part)
SELECT p_partkey, printf('#%02x%02x%02x%02x', r, g, b, floor(round(a / 100.0::DOUBLE, 4) * 255 + 0.5)::BIGINT) AS hex, round((0.2126 * r + 0.7152 * g + 0.0722 * b) / 255.0::DOUBLE, 6) AS luminance FROM c""")
def _(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    css = F.concat(F.lit("rgba("), (k * 7 % 256).cast("string"), F.lit(", "), (k * 13 % 256).cast("string"), F.lit(", "), (s % 256).cast("string"), F.lit(" / "), (s % 101).cast("string"), F.lit("%)"))
    return t("part").select("p_partkey", looks.hex8(looks.parse_rgb(css)).alias("hex")).select("p_partkey", "hex", F.round(looks.luminance(F.col("hex")), 6).alias("luminance"))


@query("b26_track_count", "SELECT p_partkey, (p_size % 5)::INT AS tracks FROM part")
def _(t):
    css = F.array_join(F.array_repeat(F.lit("minmax(0, calc(1fr - (2px + 3px)))"), F.col("p_size") % 5), "  ")
    return t("part").select("p_partkey", looks.track_count(css).alias("tracks"))


@query("b27_stable_id", "SELECT o_orderkey, 'o_' || substr(sha256(o_orderkey || '|' || o_orderstatus), 1, 20) AS id FROM orders")
def _(t):
    return t("orders").select("o_orderkey", keys.stable_id("o", F.col("o_orderkey"), F.col("o_orderstatus")).alias("id"))


@query("b28_hashing_embedding", """WITH w AS (SELECT doc_id, unnest(CASE WHEN len(t) > 0 THEN t ELSE [NULL] END) AS t FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9:#.>_-]+'), lambda x: length(x) > 1) AS t FROM documents)),
h AS (SELECT doc_id, t, sha256(t) AS h FROM w),
c AS (SELECT doc_id, CASE WHEN t IS NULL THEN 0 ELSE ('0x' || substr(h, 1, 8))::BIGINT % 384 END AS cell, CASE WHEN t IS NULL THEN 1.0::DOUBLE ELSE CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * (1 + (('0x' || substr(h, 11, 2))::BIGINT % 5) / 5.0::DOUBLE) END AS v FROM h),
s AS (SELECT doc_id, cell, sum(v) AS v FROM c GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM s GROUP BY ALL)
SELECT doc_id, cell, round(CASE WHEN n > 0 THEN v / n ELSE 0 END, 6) + 0.0 AS value FROM s JOIN n USING (doc_id)""")
def _(t):
    out = vectors.hashing_embedding(t("documents"), "doc_id", "text")
    return out.select("doc_id", "cell", (F.round("value", 6) + 0.0).alias("value"))


@query("b29_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(t):
    e = t("embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


@query("b30_vector_literal", "SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 4) AS total, len(embedding)::INT AS dims FROM embeddings")
def _(t):
    back = t("embeddings").select("vec_id", vectors.parse_literal(vectors.literal(F.col("embedding"))).alias("v"))
    return back.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.size("v").alias("dims"))


@query("b33_changed_entries", "SELECT l_orderkey, count(*) FILTER (l_returnflag <> l_linestatus) AS n FROM lineitem GROUP BY l_orderkey")
def _(t):
    both = t("lineitem").select("l_orderkey", F.size(keys.changed_entries(F.create_map(F.lit("flag"), "l_returnflag"), F.create_map(F.lit("flag"), "l_linestatus"))).alias("n"))
    return both.groupBy("l_orderkey").agg(F.sum("n").cast("long").alias("n"))


@query("b34_boxes", """WITH b AS (SELECT l_orderkey, l_quantity AS x, l_linenumber * 10.0::DOUBLE AS y, l_discount * 100 AS w, l_tax * 100 AS h FROM lineitem)
SELECT l_orderkey, min(x) AS x, min(y) AS y, greatest(0, max(x + w) - min(x)) AS width, greatest(0, max(y + h) - min(y)) AS height FROM b GROUP BY l_orderkey""")
def _(t):
    b = looks.box(F.col("l_quantity"), F.col("l_linenumber") * 10.0, F.col("l_discount") * 100, F.col("l_tax") * 100)
    return t("lineitem").groupBy("l_orderkey").agg(F.collect_list(b).alias("b")).select("l_orderkey", looks.union_box(F.col("b")).alias("u")).select("l_orderkey", "u.*")


@query("b36_json_object", "SELECT event_id, (props->>'k')::INT AS k FROM events")
def _(t):
    answer = F.concat(F.lit("Here it is:\n```json\n"), F.regexp_replace("props", r"\}$", ",}"), F.lit("\n```"))
    return t("events").select("event_id", keys.json_object(answer, "k int").alias("o")).select("event_id", "o.k")


@query("b31_canonical", """SELECT p_partkey, 'kind:module' || chr(10) || 'category:' || p_type || chr(10) || 'signature:' || p_brand || chr(10) || 'look:' || p_name AS text FROM part""")
def _(t):
    return t("part").select("p_partkey", keys.canonical_card("module", {"category": F.col("p_type"), "signature": F.col("p_brand")}, F.col("p_name"), {}).alias("text"))


@query("b32_omits_identity", "SELECT doc_id, NOT regexp_matches(text, '(?i)\\bhttps?://|cap_[a-f0-9]{8}|www\\.') AS omits FROM documents WHERE text IS NOT NULL")
def _(t):
    return t("documents").filter("text IS NOT NULL").select("doc_id", keys.omits_identity(F.col("text")).alias("omits"))
