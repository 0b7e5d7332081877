"""Secret scans with an incremental blob ledger (DataFrame functions only).

A blob is a text named by its SHA-256. Each distinct blob is scanned once for every rule version that the ledger does
not yet hold for it; the spans found join back to all paths (documents, or versions of a file) that hold the blob.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import cut_lineage, join_hot, whole_text
from lumenfold.llm.words import is_small


@dataclass(frozen=True)
class Rule:
    """Spans of `pattern`, leftmost and not overlapping, of which group `group` has `least` characters or more."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    base: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def _any_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([_any_case(w) for w in ("password", "passwd", "secret", "token")] + [_any_case("api") + "_?" + _any_case("key")])

#: In the order of kinds. A run of hex digits or capitals that is long enough is found whole by a pattern with the
#: least length in it, as every run starts where a shorter one would. The last two rules are beyond the base ones.
RULES = (
    Rule("assign", 1, rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12, True),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", 0, 18, True),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16, True),
    Rule("forge", 1, r"gh[opsu]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
)


#: Matches that are placed one after the other; an array grows by a copy, so it is kept short.
BLOCK = 256
_SPAN = "struct<start:int,end:int,m:string>"


def _bound(value: Column, f) -> Column:
    """f(value), where value is worked out once however often f names it."""
    return F.transform(F.array(value), lambda v: f(v))[0]


def _placed(block: Column, offset: Column) -> Column:
    """Spans of a block's matches (m, gap before it, long), the first gap of which begins at `offset`."""
    step = lambda acc, x: F.struct(
        (acc["at"] + x["gap"] + x["long"]).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["long"]).alias("end"), x["m"].alias("m")))).alias("out"),
    )
    return F.aggregate(block, F.struct(offset.alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out")), step, lambda acc: acc["out"])


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> in code points, end exclusive.

    Matches are placed block by block, from the sums of the blocks before, so the work grows with their number.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    steps = _bound(found, lambda f: F.zip_with(f, F.slice(gaps, 1, F.size(f)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("gap"), F.length(m).alias("long"))))

    def walk(matches: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / BLOCK).cast("int")), lambda i: F.slice(matches, i * BLOCK + 1, BLOCK))

    def joined(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + x["long"]))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        offsets = F.aggregate(sums, start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, offsets, _placed))

    # (start, end) of the matches whose group is long enough
    none = F.array().cast(f"array<{_SPAN}>")
    every = _bound(steps, lambda m: F.when(F.size(m) > 0, _bound(walk(m), joined)).otherwise(none))
    long_enough = F.filter(every, lambda x: F.length(F.regexp_extract(x["m"], rule.pattern, rule.group)) >= rule.least)
    return F.transform(long_enough, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """Ledger rows (blob_sha, rule, spans) of the pairs of blob and rule version that `ledger` does not hold.

    `blobs` has blob_sha and blob_text, one row for each blob. Pairs without a span get a row too, so that they are
    not scanned again.
    """
    if ledger is None:
        pending = blobs.withColumn("_seen", F.array().cast("array<string>"))
    else:
        seen = ledger.groupBy(F.col("blob_sha").alias("_sha")).agg(F.collect_set("rule").alias("_seen"))
        pending = blobs.join(seen, F.col("blob_sha") == F.col("_sha"), "left").withColumn("_seen", F.coalesce("_seen", F.array().cast("array<string>")))
    entries = F.array(*[F.struct(F.lit(r.key).alias("rule"), F.when(~F.array_contains("_seen", r.key), spans_of(F.col("blob_text"), r)).alias("spans")) for r in rules])
    return pending.select("blob_sha", F.explode(entries).alias("e")).select("blob_sha", "e.rule", "e.spans").filter("spans IS NOT NULL")


def blobs_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.select(F.sha2(whole_text(text_col), 256).alias("blob_sha"), whole_text(text_col).alias("blob_text")).distinct()


def scan_secrets(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(paths, news): a row per document with blob_sha and findings, and the rows to append to the ledger.

    findings is array<struct<start, end, order, kind, base>> sorted by start, then by the order of the rules, from
    the ledger and the new rows. Null texts are empty and have no finding, null ids stay as they are, repeated rows
    give a row each, an empty table an empty result; further columns of `docs` are left out.
    """
    news = scan_blobs(blobs_of(docs, text_col), rules, ledger)
    held = news if ledger is None else news.unionByName(ledger.select("blob_sha", "rule", "spans"))
    order = F.lit(None).cast("int")
    for i, r in enumerate(rules):
        order = F.when(F.col("rule") == r.key, F.lit(i)).otherwise(order)
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    flat = held.filter(F.size("spans") > 0).withColumn("o", order).filter("o IS NOT NULL").withColumn("k", F.element_at(kinds, F.col("o") + 1))
    per_blob = flat.groupBy("blob_sha").agg(
        F.array_sort(F.flatten(F.collect_list(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("o").alias("order"), s["end"].alias("end"), F.col("k").alias("kind")))))).alias("findings")
    )
    paths = docs.select(F.col(id_col), F.sha2(whole_text(text_col), 256).alias("blob_sha"))
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    # blobs with findings are few; how many paths each has is counted before any path moves
    per_blob = cut_lineage(per_blob)
    counts = paths.join(F.broadcast(per_blob.select("blob_sha")), "blob_sha", "left_semi") if is_small(per_blob, F.lit(96)) else paths
    held = cut_lineage(per_blob.join(counts.groupBy("blob_sha").agg(F.count(F.lit(1)).alias("_paths")), "blob_sha"))
    return join_hot(paths, held, "blob_sha", "_paths", F.concat(F.lit("~"), F.xxhash64(id_col).cast("string"))).select(id_col, "blob_sha", F.coalesce("findings", none).alias("findings")), news


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    paths, _ = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n_base = sum(r.base for r in RULES)
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda i: F.size(F.filter("findings", lambda s: s["order"] == i)).cast("long")
    return paths.select(
        "doc_id",
        *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(RULES) if r.base],
        F.sha2(joined(F.filter("findings", lambda s: s["order"] < n_base)), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
    )


def _oracle() -> str:
    """Spans from the gaps between matches, per kind, as the DataFrame form finds them."""
    parts = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, rid, {i} AS o, '{r.kind}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS m,
  unnest(regexp_extract_all(text, '{p}', {r.group})) AS g, unnest(range(len(regexp_extract_all(text, '{p}')))) AS k,
  regexp_split_to_array(text, '{p}') AS gaps FROM d WHERE regexp_matches(text, '{p}')""")
    least = " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(RULES))
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(parts)}),
s AS (SELECT *, length(gaps[k + 1]) AS gap, length(m) AS long FROM m),
t AS (SELECT *, sum(gap + long) OVER (PARTITION BY rid, o ORDER BY k) - long AS start FROM s),
f AS (SELECT doc_id, rid, o, kind, start::BIGINT AS start, (start + long)::BIGINT AS stop FROM t WHERE length(g) >= CASE o {least} END),
a AS (SELECT rid, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) FILTER (o < 3) AS base,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) AS spans FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)"""


SQL = {"op2_secret_scan": _oracle()}
