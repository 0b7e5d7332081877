"""Keys and redaction of urls and text, as columns.

Urls are taken apart by one pattern: scheme, user, host, port, path, query, fragment. Percent signs and dot segments
stay as they are given. A null stays null unless a function says otherwise.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What stands for a redacted value, in text and in a query string, and for a url that can't be read.
REDACTED, REDACTED_VALUE, INVALID = "[redacted]", "%5Bredacted%5D", "[invalid-url]"
#: scheme, user, host, port, path, query, fragment
URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#@]*@)?([^/?#@:\s]+)(:[0-9]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URL, group)


def _with_scheme(url: Column) -> Column:
    return F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))


def host_of(url: Column) -> Column:
    """Lower host without user and port; empty where there is none."""
    return F.lower(_part(url, 3))


def path_of(url: Column) -> Column:
    """Lower path without query, / where there is none."""
    path = F.lower(F.when(url.rlike(URL), _part(url, 5)).otherwise(F.regexp_replace(url, r"\?.*$", "")))
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def _port(url: Column) -> Column:
    """:port where it isn't the scheme's own."""
    scheme, port = F.lower(_part(url, 1)), _part(url, 4)
    own = (port == ":") | ((scheme == "http") & (port == ":80")) | ((scheme == "https") & (port == ":443"))
    return F.when(own, "").otherwise(port)


def _one_slash_less(path: Column) -> Column:
    return F.when((F.length(path) > 1) & path.endswith("/"), F.substring(path, F.lit(1), F.length(path) - 1)).otherwise(path)


def origin_of(url: Column) -> Column:
    return F.concat(F.lower(_part(url, 1)), F.lit("://"), host_of(url), _port(url))


def capture_key(url: Column) -> Column:
    """B1: identity of a capture: host without www. and port, and path without its last slash; https is assumed."""
    raw = F.trim(url)
    full = _with_scheme(raw)
    host, path = F.regexp_replace(host_of(full), r"^www\.", ""), _one_slash_less(_part(full, 5))
    plain = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"(?i)^https?://", ""), r"(?i)^www\.", ""), r"/+$", ""))
    return F.when(raw == "", "").when(full.rlike(URL), F.concat(host, F.when(path == "/", "").otherwise(path))).otherwise(plain)


def host_key(url: Column) -> Column:
    """The host of a url or bare host, without www.; empty for none."""
    raw = F.trim(F.coalesce(url, F.lit("")))
    full = _with_scheme(raw)
    plain = F.lower(F.substring_index(F.regexp_replace(raw, r"(?i)^www\.", ""), "/", 1))
    return F.when(raw == "", "").when(full.rlike(URL), F.regexp_replace(host_of(full), r"^www\.", "")).otherwise(plain)


def join_key(url: Column) -> Column:
    """http(s) url without user, default port, query, hash and the last slash of its path; else null."""
    path = _one_slash_less(F.when(_part(url, 5) == "", F.lit("/")).otherwise(_part(url, 5)))
    return F.when(url.rlike(URL) & F.lower(_part(url, 1)).isin("http", "https"), F.concat(origin_of(url), path))


def redact_url(url: Column) -> Column:
    """No hash; the names of parameters stay, each with a redacted value."""
    names = F.transform(F.filter(F.split(F.substring(_part(url, 6), 2, 1 << 30), "&"), lambda p: p != ""), lambda p: F.concat(F.regexp_replace(p, "=.*$", ""), F.lit("=" + REDACTED_VALUE)))
    query = F.when(F.size(names) > 0, F.concat(F.lit("?"), F.array_join(names, "&"))).otherwise("")
    path = F.when(_part(url, 5) == "", "/").otherwise(_part(url, 5))
    known = F.concat(F.lower(_part(url, 1)), F.lit("://"), _part(url, 2), host_of(url), _port(url), path, query)
    bare = F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:[^/]"), F.regexp_replace(url, "#.*$", ""))
    return F.when(url.isNull(), None).when(url.rlike(URL), known).otherwise(F.coalesce(bare, F.lit(INVALID)))


def _base_parts(base: Column) -> Column:
    """Struct of what resolve() asks of a base, for callers that resolve many addresses against one."""
    path = F.when(_part(base, 5) == "", "/").otherwise(_part(base, 5))
    user = F.concat(F.lower(_part(base, 1)), F.lit("://"), _part(base, 2), host_of(base), _port(base))
    scheme = F.concat(F.lower(_part(base, 1)), F.lit(":"))
    return F.struct(base.rlike(URL).alias("ok"), scheme.alias("scheme"), user.alias("user"), path.alias("path"), F.regexp_replace(path, "[^/]*$", "").alias("folder"), _part(base, 6).alias("query"))


def _resolve(href: Column, base: Column) -> Column:
    """resolve() against the struct that _base_parts() gives."""
    here = F.concat(base["user"], base["path"])
    out = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(base["scheme"], href))
        .when(href.startswith("/"), F.concat(base["user"], href))
        .when(href == "", F.concat(here, base["query"]))
        .when(href.startswith("#"), F.concat(here, base["query"], href))
        .when(href.startswith("?"), F.concat(here, href))
        .otherwise(F.concat(base["user"], base["folder"], F.regexp_replace(href, r"^(\./)+", "")))
    )
    return F.when(base["ok"] & href.isNotNull(), out)


def resolve(href: Column, base: Column) -> Column:
    """`href` against an http(s) `base`: absolute, //host, /path, ?query, #hash or relative; null where the base isn't one."""
    return _resolve(href, _base_parts(base))


def _redact_resolved(href: Column, base: Column) -> Column:
    """redact_stored() against the struct that _base_parts() gives; the resolved address, which redact_url() names often, is worked out once."""
    return F.coalesce(bound(_resolve(href, base), redact_url), F.when(href.isNotNull(), F.lit(INVALID)))


def redact_stored(href: Column, base: Column) -> Column:
    """B5 of `href` resolved against `base`."""
    return bound(_base_parts(base), lambda b: _redact_resolved(href, b))


def redact_srcset(srcset: Column, base: Column) -> Column:
    """Each candidate's url redacted, its descriptor kept."""

    def one(candidate: Column) -> Column:
        parts = F.split(F.trim(candidate), r"\s+")
        rest = F.when(F.size(parts) > 1, F.concat(F.lit(" "), parts[1])).otherwise("")
        return F.when(parts[0] == "", candidate).otherwise(F.concat(redact_stored(parts[0], base), rest))

    return F.array_join(F.transform(F.split(srcset, ","), one), ", ")


#: Attributes that hold a url.
URL_ATTRIBUTES = ("href", "src", "action", "formaction", "poster", "data-src")


def redact_attributes(tag: Column, attributes: Column, base: Column) -> Column:
    """A node's attribute map with urls, srcset and the value of password and one-time-code inputs redacted."""
    secret = (tag == "input") & ((F.lower(attributes["type"]) == "password") | F.coalesce(attributes["autocomplete"].rlike("(?i)password|one-time-code"), F.lit(False)))

    def value(name: Column, old: Column) -> Column:
        return F.when(name.isin(*URL_ATTRIBUTES), redact_stored(old, base)).when(name == "srcset", redact_srcset(old, base)).when((name == "value") & F.coalesce(secret, F.lit(False)), REDACTED).otherwise(old)

    return F.transform_values(attributes, value)


def _replaced(text: Column, pattern: str, by) -> Column:
    """`text` with each match of `pattern` replaced by the column by(match)."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), by)
    gaps = F.split(text, pattern, -1)
    return F.array_join(F.flatten(F.zip_with(gaps, found, lambda g, m: F.array(F.coalesce(g, F.lit("")), F.coalesce(m, F.lit(""))))), "")


def redact_diagnostic(text: Column) -> Column:
    """Bearer tokens, key=value secrets and urls of a diagnostic text, in any case."""
    out = F.regexp_replace(text, r"(?i)\bBearer\s+[A-Za-z0-9._~+/-]+=*", "Bearer " + REDACTED)
    out = F.regexp_replace(out, r"(?i)\b(api[_-]?key|token|secret|password)=([^\s&]+)", "$1=" + REDACTED)
    return _replaced(out, r"(?i)https?://[^\s\"'<>]+", redact_url)


def redact_css(text: Column, base: Column) -> Column:
    """The urls of url(...), quotes kept."""
    inner = r"(?is)^url\(\s*([\"']?)(.*?)\1\s*\)$"

    def one(m: Column) -> Column:
        quote = F.regexp_extract(m, inner, 1)
        return F.concat(F.lit("url("), quote, redact_stored(F.regexp_extract(m, inner, 2), base), quote, F.lit(")"))

    return _replaced(text, r"(?i)url\(\s*(?:\"[^\"]*\"|'[^']*'|[^)\"']*)\s*\)", one)


def redact_html(html: Column, base: Column) -> Column:
    """Url attributes, and the value of password and one-time-code inputs.

    What is named more than once is bound: within functions of array items Spark works out each mention anew.
    """
    attribute = r"(?is)^(\S+?)\s*=\s*([\"'])(.*)\2$"

    def one(m: Column, b: Column) -> Column:
        quote = F.regexp_extract(m, attribute, 2)
        return bound(F.regexp_extract(m, attribute, 3), lambda href: bound(quote, lambda q: F.concat(F.regexp_extract(m, attribute, 1), F.lit("="), q, _redact_resolved(href, b), q)))

    urls = r"(?i)\b(?:href|src|action|formaction|poster|data-src)\s*=\s*(?:\"[^\"]*\"|'[^']*')"
    secret = r"(?i)\btype\s*=\s*[\"']?password\b|\bautocomplete\s*=\s*[\"']?(?:current-password|new-password|one-time-code)\b"
    hidden = lambda tag: F.when(tag.rlike(secret), F.regexp_replace(tag, r"(?i)\bvalue\s*=\s*(?:\"[^\"]*\"|'[^']*')", f'value="{REDACTED}"')).otherwise(tag)
    out = bound(_base_parts(base), lambda b: _replaced(html, urls, lambda m: one(m, b)))
    return bound(out, lambda text: _replaced(text, r"(?i)<input\b[^>]*>", hidden))


def site_identity(url: Column) -> Column:
    """Struct of site_id, domain, scheme, origin, page_id, route."""
    path = F.when(_part(url, 5) == "", "/").otherwise(_part(url, 5))
    fields = {"site_id": F.concat(F.lit("site_"), short_hash(origin_of(url))), "domain": host_of(url), "scheme": F.lower(_part(url, 1)), "origin": origin_of(url), "page_id": F.concat(F.lit("pg_"), short_hash(url)), "route": path}
    return F.when(url.rlike(URL), F.struct(*[v.alias(k) for k, v in fields.items()]))


#: What makes a destination unsafe.
UNSAFE_SCHEME = r"(?i)^(mailto:|tel:|sms:|javascript:|data:)"
UNSAFE_PATH = r"(?i)/(logout|log-out|signout|sign-out|delete|destroy|purchase|checkout|pay|billing|password|reset-password|download)\b|\.(zip|exe|dmg|pkg|msi)(\?|$)"


def destination_class(href: Column, page: Column, to: Column) -> Column:
    """Struct of destination (queries redacted), class and the reason why it is unsafe.

    `to` is resolve(href, page), as a column of its own, so that it is worked out once.
    """
    dest = F.concat(redact_url(to), _part(to, 7))
    same = origin_of(to) == origin_of(page)
    path = lambda u: F.when(_part(u, 5) == "", "/").otherwise(_part(u, 5))
    here = same & (path(to) == path(page))
    row = lambda d, c, r=None: F.struct(d.cast("string").alias("destination"), F.lit(c).alias("destination_class"), F.lit(r).cast("string").alias("unsafe_reason"))
    none = F.lit(None)
    return (
        F.when(href.isNull() | (href == ""), row(none, "unknown"))
        .when(href.rlike(UNSAFE_SCHEME), row(none, "action_unsafe", "scheme"))
        .when(href.startswith("#"), row(F.substring(href, 1, 120), "fragment"))
        .when(to.isNull(), row(none, "unknown"))
        .when(_part(to, 5).rlike(UNSAFE_PATH), row(dest, "action_unsafe", "path"))
        .when(~F.lower(_part(to, 1)).isin("http", "https"), row(none, "action_unsafe", "protocol"))
        .when(here & (_part(to, 7) != "") & (_part(to, 6) == ""), row(F.substring(F.concat(path(to), _part(to, 7)), 1, 200), "fragment"))
        .when(here, row(dest, "internal_same_origin"))
        .when(same, row(dest, "internal_path"))
        .otherwise(row(dest, "external"))
    )


#: Ends of hosts and their locales, in this order.
LOCALES = ((".de", "de-DE"), (".at", "de-AT"), (".ch", "de-CH"), (".fr", "fr-FR"), (".it", "it-IT"), (".nl", "nl-NL"), (".uk", "en-GB"))


def locale_of(url: Column, zone: Column) -> Column:
    """B16."""
    host, out = host_of(_with_scheme(url)), F.when(zone.startswith("Europe/"), "de-DE").otherwise("en-US")
    for end, locale in reversed(LOCALES):
        out = F.when(host.endswith(end), locale).otherwise(out)
    return out


def is_home(url: Column) -> Column:
    """A path of slashes only, and no query."""
    return url.rlike(URL) & _part(url, 5).rlike("^/*$") & _part(url, 6).isin("", "?")


def is_blocked(host: Column, hosts: list[str]) -> Column:
    """No host, a .gov, .edu, .mil or encyclopedia one, or one of `hosts` or below it."""
    out = (host == "") | host.rlike(r"\.(gov|edu|mil)$") | host.endswith(".wikipedia.org")
    for h in hosts:
        out = out | (host == h) | host.endswith("." + h)
    return out


def brand_slug(name: Column) -> Column:
    """Letters and digits; spaces and &._/' become one hyphen, anything else goes."""
    out = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N} &._/']", ""), r"[ &._/']+", "-")
    out = F.regexp_replace(out, "^-+|-+$", "")
    return F.when(out == "", "brand").otherwise(out)


def country_code(label: Column) -> Column:
    """A short single word as it is, else the first two letters; XX for none."""
    label = F.trim(F.coalesce(label, F.lit("")))
    return F.when(label == "", "XX").otherwise(F.upper(F.when(label.rlike(r"^[^\s,]{1,3}$"), label).otherwise(F.substring(label, 1, 2))))


def bound_bytes(text: Column, most: int, marker: str) -> Column:
    """Struct of value (at most `most` UTF-8 bytes, whole characters, then a note) and whether it was cut."""

    @F.pandas_udf("string")
    def head(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else t.encode("utf-8", "surrogatepass")[:most].decode("utf-8", "ignore"))

    size = F.octet_length(text)
    note = F.concat(head(text), F.lit(f"\n<!-- dig:truncated {marker} original_bytes="), size.cast("string"), F.lit(" -->\n"))
    return F.struct(F.when(size <= most, text).otherwise(note).alias("value"), (size > most).alias("truncated"))


def short_hash(text: Column, length: int = 20) -> Column:
    """First hex digits of a SHA-256."""
    return F.substring(F.sha2(text, 256), 1, length)


def stable_id(prefix: str, *parts: Column, length: int = 20) -> Column:
    """Prefix and the hash of the parts, joined by bars; a null part is empty."""
    return F.concat(F.lit(prefix + "_"), short_hash(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), length))


def collapse(text: Column) -> Column:
    """White space runs become one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clip(text: Column, most: int = 120) -> Column:
    """Collapsed and, beyond `most` characters, cut with an ellipsis; null for none."""
    out = collapse(text)
    return F.when(out == "", None).when(F.length(out) <= most, out).otherwise(F.concat(F.rtrim(F.substring(out, 1, most - 1)), F.lit("…")))


def words_key(text: Column) -> Column:
    """Lower case, with _, |, / and - as spaces."""
    return collapse(F.regexp_replace(F.lower(text), "[_|/-]+", " "))


def unique_first(values: Column, most: int) -> Column:
    """Trimmed values, the first of those equal in lower case, at most `most`."""
    trimmed = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")
    lowered = F.transform(trimmed, F.lower)
    first = F.filter(F.transform(trimmed, lambda v, i: F.when(F.array_position(lowered, F.lower(v)) == i + 1, v)), lambda v: v.isNotNull())
    return F.slice(first, 1, most)


def bound(value: Column, f) -> Column:
    """f(value), where value is worked out once however often f names it."""
    return F.transform(F.array(value), lambda v: f(v))[0]


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def tokens(text: Column) -> Column:
    """Alphanumeric ASCII tokens of three characters or more."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda t: F.length(t) > 2)


#: Fixed value: what a consent overlay says.
CONSENT = r"(?i)cookie|cookies|einwilligung|consent|zustimmung|datenschutz.*einstell|ihre cookie|cookie einstellungen|alle akzeptieren|accept all|accept cookies|manage cookies|preferenc(e|es).*cookie|tracking.*(akzept|accept)|zwecke|privatsphäre|gdpr|cmp"


def is_consent_text(text: Column) -> Column:
    """B22."""
    return F.coalesce(text.rlike(CONSENT), F.lit(False))


def is_consent_section(taxonomy: Column, category: Column, texts: Column) -> Column:
    """By its term, its category, or any of its texts."""
    named = F.lower(taxonomy).rlike("cookie|consent") | F.lower(category).contains("cookie") | (F.lower(category) == "consent")
    return F.coalesce(named, F.lit(False)) | F.coalesce(F.exists(texts, is_consent_text), F.lit(False))


def barrier(title: Column, body: Column, phrases: list[tuple[str, list[str]]], challenged: Column) -> Column:
    """Kind of the barrier: a challenge element, then the first of (kind, phrases) that title or body hold, then a named service with its ray id."""
    title, body = F.lower(title), F.substring(F.lower(body), 1, 4000)
    out = F.when(body.contains("cloudflare") & (body.contains("ray id") | body.contains("cf-ray")), "cloudflare").otherwise("none")
    for kind, some in reversed(phrases):
        hit = F.lit(False)
        for phrase in some:
            hit = hit | title.contains(phrase) | body.contains(phrase)
        out = F.when(hit, kind).otherwise(out)
    return F.when(challenged, "cloudflare").otherwise(out)


def half_up(x: Column) -> Column:
    """To the nearest whole number, ties up."""
    return F.floor(x + 0.5)


def changed_entries(before: Column, after: Column) -> Column:
    """Map of key to struct (before, after) of the keys of `before` whose values differ."""
    both = F.transform_values(before, lambda k, v: F.struct(v.alias("before"), after[k].alias("after")))
    return F.map_filter(both, lambda k, v: ~v["before"].eqNullSafe(v["after"]))


def json_object(text: Column, schema: str) -> Column:
    """The object within a model's answer: fences and what is around the outer braces cut, commas before an end dropped; null if it can't be read."""
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)```", 1)
    inner = F.regexp_extract(F.when(fenced != "", fenced).otherwise(text), r"(?s)\{.*\}", 0)
    return F.when(inner != "", F.from_json(F.regexp_replace(inner, r",\s*([\]}])", "$1"), schema))


#: Fixed value: what would tell whose page a canonical text is of.
IDENTITY = r"(?i)\bhttps?://|cap_[a-f0-9]{8}|www\."


def omits_identity(text: Column) -> Column:
    """B32."""
    return ~text.rlike(IDENTITY)


def canonical_card(kind: str, before: dict[str, Column], look: Column, after: dict[str, Column], most: int = 1500) -> Column:
    """Lines name:value, the look's cut first where the whole is longer than `most` characters."""
    value = lambda c: F.coalesce(collapse(c), F.lit(""))
    line = lambda n, c: F.rtrim(F.concat(F.lit(n + ":"), value(c))) if n == "type" else F.concat(F.lit(n + ":"), value(c))
    head = [F.lit(f"kind:{kind}"), *[line(n, c) for n, c in before.items()]]
    tail = [line(n, c) for n, c in after.items()]
    card = lambda text: F.concat_ws("\n", *head, F.concat(F.lit("look:"), text), *tail)
    whole = card(value(look))
    short = F.substring(value(look), F.lit(1), F.greatest(F.lit(0), F.length(value(look)) - (F.length(whole) - most)))
    return F.when(F.length(whole) <= most, whole).otherwise(F.substring(card(short), 1, most))


#: Names of fields that hold an address, candidates of a picture, and text with css addresses.
EVIDENCE_URLS, EVIDENCE_SRCSET, EVIDENCE_CSS = ("url", "href", "src", "current_src"), "srcset", ("css_text", "value", "source")


def redact_evidence(value: Column, kind: T.DataType, base: Column, name: str = "") -> Column:
    """A value of any nested type with its addresses redacted, by the names of fields or map keys, as one expression.

    The type is walked when the query is built: structs, arrays and maps of any depth become field by field what they
    are, and strings are redacted where the field they lie in says so. An array's items have no name. A record named
    `url` whose value holds a value has that one redacted, whatever it is.
    """
    if isinstance(kind, T.StructType):
        fields = {f.name: f.dataType for f in kind.fields}
        plain = F.struct(*[redact_evidence(value[f], d, base, f).alias(f) for f, d in fields.items()])
        inner = fields.get("value")
        if isinstance(fields.get("name"), T.StringType) and isinstance(inner, T.StructType) and isinstance({f.name: f.dataType for f in inner.fields}.get("value"), T.StringType):
            wrapped = F.struct(*[(redact_stored(value["value"][f.name], base) if f.name == "value" else value["value"][f.name]).alias(f.name) for f in inner.fields])
            whole = F.struct(*[(wrapped if f == "value" else value[f]).alias(f) for f in fields])
            plain = F.when((value["name"] == "url") & value["value"]["value"].isNotNull(), whole).otherwise(plain)
        return F.when(value.isNotNull(), plain)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: redact_evidence(x, kind.elementType, base))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda k, v: _redact_by_key(k, v, kind.valueType, base))
    if not isinstance(kind, T.StringType):
        return value
    if name in EVIDENCE_URLS:
        return redact_stored(value, base)
    if name == EVIDENCE_SRCSET:
        return redact_srcset(value, base)
    return F.when(value.rlike(r"(?i)url\("), redact_css(value, base)).otherwise(value) if name in EVIDENCE_CSS else value


def _redact_by_key(key: Column, value: Column, kind: T.DataType, base: Column) -> Column:
    """A map's value by its key, which is known row by row."""
    if not isinstance(kind, T.StringType):
        return redact_evidence(value, kind, base)
    named = lambda n: redact_evidence(value, kind, base, n)
    return F.when(key.isin(*EVIDENCE_URLS), named("url")).when(key == EVIDENCE_SRCSET, named(EVIDENCE_SRCSET)).when(key.isin(*EVIDENCE_CSS), named("value")).otherwise(value)
