"""Registered queries of the library's own operators, bound to the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import keys
from lumenfold.operators import flows, graphs, relational, rollups
from lumenfold.plans import urls, layout, library, pages, catalog, bands, facets, briefs, visions  # noqa: F401  they register their queries
from lumenfold.plans.base import ORACLES, QUERIES, query
from lumenfold.streaming import jobs

_SIM = """SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM (SELECT * FROM embeddings ORDER BY vec_id DESC LIMIT 5000) a JOIN (SELECT * FROM embeddings ORDER BY vec_id DESC LIMIT 5000) b ON a.vec_id <> b.vec_id"""
_KNN = f"k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM ({_SIM}) WHERE score >= 0.2 QUALIFY rank <= 8)"
_EDGES = f"WITH {_KNN}, e AS (SELECT least(a, b) AS from_id, greatest(a, b) AS to_id, max(score) AS score FROM k GROUP BY ALL)"
_GRAPH = f"{_EDGES}, g AS (SELECT * FROM e ORDER BY score DESC, from_id, to_id LIMIT 40000), n AS (SELECT from_id AS id, to_id AS neighbour FROM g UNION SELECT to_id, from_id FROM g)"
_JOBS = "j AS (SELECT event_id, user_id AS job_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'capturing' WHEN 'click' THEN 'indexing' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'failed' END AS stage, ts FROM events)"
_TARGET = "t AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 < 2), u AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'X' END AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 3 > 0)"


def _upsert_sides(t):
    o = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    return o.filter(k % 3 < 2), o.filter(k % 3 > 0).select(k, F.when(k % 2 == 0, "X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))


@query("j5_nearest", """WITH s AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM s WHERE score >= 0.2 QUALIFY rank <= 8""")
def _(t):
    return graphs.neighbours(t("embeddings"), "vec_id", "embedding", 8, 0.2).withColumn("rank", F.col("rank").cast("long"))


@query("r22_ranked_neighbours", f"{_EDGES}, g AS (SELECT * FROM e ORDER BY score DESC, from_id, to_id LIMIT 40000), n AS (SELECT from_id AS id, to_id AS neighbour, score FROM g UNION ALL SELECT to_id, from_id, score FROM g) SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, neighbour) AS rank FROM n QUALIFY rank <= 5")
def _(t):
    return graphs.ranked_neighbours(graphs.similarity_graph(t("embeddings"), "vec_id", "embedding", 8, 0.2)).withColumn("rank", F.col("rank").cast("long"))


@query("b20_slug", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def _(t):
    return t("part").select("p_partkey", keys.slug(F.col("p_name")).alias("slug"))


@query("k7_numbered_ids", "SELECT p_partkey, CASE WHEN rn = 1 THEN p_name ELSE p_name || '-' || rn END AS unique_id FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part)")
def _(t):
    return relational.numbered_ids(t("part"), "p_name", F.col("p_partkey")).select("p_partkey", "unique_id")


@query("d19_runs", """WITH c AS (SELECT *, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM c) SELECT conv_id, run::BIGINT AS run, role, count(*) AS length FROM r GROUP BY ALL""")
def _(t):
    return relational.runs(t("conversations"), "conv_id", "role", F.col("turn"))


@query("f2_seed_edges", """WITH s AS (SELECT conv_id, role AS from_id, lead(role) OVER w AS to_id, row_number() OVER w - 1 AS step FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT *, 0.8::DOUBLE AS confidence FROM s WHERE to_id IS NOT NULL AND from_id <> to_id""")
def _(t):
    return flows.seed_edges(t("conversations"), "conv_id", "role", F.col("turn"))


@query("t4_retries", f"""WITH {_JOBS}, a AS (SELECT job_id, count(*) FILTER (stage = 'failed') AS attempts, max({{'ts': ts, 'id': event_id, 's': stage}}) FILTER (stage IN ('failed', 'complete')) AS l FROM j GROUP BY job_id)
SELECT job_id, attempts, CASE WHEN l IS NULL THEN 'ok' WHEN l.s = 'complete' THEN 'complete' WHEN attempts < 3 THEN 'queued' ELSE 'failed' END AS status FROM a""")
def _(t):
    return jobs.retries(jobs.job_events(t("events")), 3)


@query("t2_health_windows", f"""WITH {_JOBS}, w AS (SELECT date_trunc('day', ts) AS window_start, count(*) FILTER (stage IN ('queued', 'capturing', 'indexing')) AS open, count(*) FILTER (stage = 'failed') AS failed FROM j GROUP BY 1)
SELECT *, CASE WHEN failed > 20 THEN 'critical' WHEN failed > 0 OR open > 0 THEN 'warn' ELSE 'ok' END AS health FROM w""")
def _(t):
    return jobs.health_windows(jobs.job_events(t("events")))


@query("t10_recovered", f"""WITH {_JOBS}, s AS (SELECT job_id, stage, ts AS updated_at FROM j QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1), m AS (SELECT max(updated_at) AS now FROM s)
SELECT job_id, CASE WHEN stage IN ('capturing', 'indexing') THEN 'queued' ELSE stage END AS stage, updated_at, stage IN ('capturing', 'indexing') AS recovered FROM s, m WHERE stage NOT IN ('complete', 'failed') OR updated_at >= now - INTERVAL 6 HOUR""")
def _(t):
    states = jobs.current_state(jobs.job_events(t("events")))
    now = states.agg(F.max("updated_at")).first()[0]
    return jobs.recovered(states, F.lit(now), "6 hours")


@query("k11_queue_order", f"""WITH {_JOBS}, s AS (SELECT job_id, stage, ts AS updated_at FROM j QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1),
q AS (SELECT job_id, job_id % 8 AS shard, stage IN ('capturing', 'indexing') AS recovered, CASE WHEN job_id % 3 = 0 THEN job_id % 11 END AS position, updated_at AS created_at FROM s WHERE stage IN ('capturing', 'indexing', 'queued'))
SELECT shard, job_id, recovered, row_number() OVER (PARTITION BY shard ORDER BY recovered DESC, position NULLS LAST, created_at, job_id) AS place FROM q""")
def _(t):
    states = jobs.recovered(jobs.current_state(jobs.job_events(t("events"))), F.lit("2000-01-01").cast("timestamp"))
    queue = states.withColumn("shard", F.col("job_id") % 8).withColumn("position", F.when(F.col("job_id") % 3 == 0, F.col("job_id") % 11)).withColumnRenamed("updated_at", "created_at")
    return jobs.queue_order(queue).select("shard", "job_id", "recovered", F.col("place").cast("long").alias("place"))


@query("k12_live", f"WITH {_JOBS} SELECT job_id, stage, ts AS updated_at FROM (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1) WHERE stage IN ('capturing', 'indexing')")
def _(t):
    return jobs.live(jobs.current_state(jobs.job_events(t("events"))))


@query("t3_claims", f"""WITH {_JOBS}, s AS (SELECT job_id, CASE WHEN stage = 'queued' THEN 'queued' ELSE 'running' END AS status, ts AS updated_at FROM j WHERE stage IN ('queued', 'capturing', 'indexing') QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1), m AS (SELECT max(updated_at) AS now FROM s)
SELECT job_id, status, updated_at AS created_at, updated_at, status = 'running' AS reclaimed FROM s, m WHERE status = 'queued' OR updated_at < now - INTERVAL 4 MINUTE ORDER BY reclaimed, created_at, job_id LIMIT 16""")
def _(t):
    open_jobs = jobs.job_events(t("events")).filter(F.col("stage").isin("queued", "capturing", "indexing"))
    states = jobs.current_state(open_jobs).select("job_id", F.when(F.col("stage") == "queued", "queued").otherwise("running").alias("status"), F.col("updated_at").alias("created_at"), "updated_at")
    now = states.agg(F.max("updated_at")).first()[0]
    return jobs.claims(states, F.lit(now), 16)


@query("b21_tokens", "SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 2))::INT AS n_tokens FROM documents")
def _(t):
    return t("documents").select("doc_id", F.size(keys.tokens(F.col("text"))).alias("n_tokens"))


@query("r20_similarity_graph", f"{_EDGES} SELECT * FROM e ORDER BY score DESC, from_id, to_id LIMIT 40000")
def _(t):
    return graphs.similarity_graph(t("embeddings"), "vec_id", "embedding", 8, 0.2)


@query("r22_degrees", f"{_EDGES}, g AS (SELECT * FROM e ORDER BY score DESC, from_id, to_id LIMIT 40000) SELECT id, count(*) AS degree FROM (SELECT from_id AS id FROM g UNION ALL SELECT to_id FROM g) GROUP BY id")
def _(t):
    return graphs.degrees(graphs.similarity_graph(t("embeddings"), "vec_id", "embedding", 8, 0.2))


@query("j3_collection_counts", "SELECT c_custkey, c_name, count(o_orderkey) AS members FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def _(t):
    return relational.member_counts(t("customer").select("c_custkey", "c_name"), t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("k4_top_per_group", "SELECT p_type, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 12")
def _(t):
    return relational.top_n(t("part").select("p_type", "p_partkey", "p_retailprice"), ["p_type"], 12, F.col("p_retailprice").desc(), F.col("p_partkey")).withColumn("rank", F.col("rank").cast("long"))


@query("k6_interleave", "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS turn FROM part")
def _(t):
    return relational.interleave(t("part"), "p_brand", F.col("p_name"), F.col("p_partkey")).select("p_brand", "p_partkey", F.col("turn").cast("long").alias("turn"))


@query("a9_upsert", f"WITH {_TARGET} SELECT * FROM u UNION ALL SELECT * FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM u)")
def _(t):
    return relational.upsert(*_upsert_sides(t), ["o_orderkey"])


@query("a10_upsert_coalesce", f"WITH {_TARGET} SELECT o_orderkey, coalesce(u.o_orderstatus, t.o_orderstatus) AS o_orderstatus, coalesce(u.o_totalprice, t.o_totalprice) AS o_totalprice FROM t FULL JOIN u USING (o_orderkey)")
def _(t):
    return relational.upsert_coalesce(*_upsert_sides(t), ["o_orderkey"])


@query("a11_insert_absent", f"WITH {_TARGET} SELECT * FROM t UNION ALL SELECT * FROM u WHERE o_orderkey NOT IN (SELECT o_orderkey FROM t)")
def _(t):
    return relational.insert_absent(*_upsert_sides(t), ["o_orderkey"])


@query("a12_delete_cascade", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey")
def _(t):
    victims = t("orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    return relational.delete_cascade(t("orders"), t("lineitem"), victims, "o_orderkey", "l_orderkey")[1].groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("v2_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(t):
    return relational.duplicate_keys(t("lineitem"), ["l_orderkey", "l_linenumber"])


@query("v3_dangling", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY ALL")
def _(t):
    return relational.dangling(t("lineitem"), t("orders").filter("o_orderstatus <> 'F'"), "l_orderkey", "o_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("t1_current_state", f"WITH {_JOBS} SELECT job_id, stage, ts AS updated_at FROM j QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1")
def _(t):
    return jobs.current_state(jobs.job_events(t("events")))


@query("t2_stage_windows", f"WITH {_JOBS} SELECT date_trunc('day', ts) AS window_start, stage, count(*) AS n FROM j GROUP BY ALL")
def _(t):
    return jobs.stage_windows(jobs.job_events(t("events")))


@query("t3_sessions", f"""WITH {_JOBS}, g AS (SELECT *, CASE WHEN lag(ts) OVER w + INTERVAL 4 MINUTE > ts THEN 0 ELSE 1 END AS c FROM j WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(c) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT job_id, min(ts) AS started, max(ts) + INTERVAL 4 MINUTE AS stale_at, count(*) AS beats FROM s GROUP BY job_id, s""")
def _(t):
    return jobs.sessions(jobs.job_events(t("events")))


@query("t6_last_events", f"WITH {_JOBS} SELECT job_id, event_id, stage, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS rank FROM j QUALIFY rank <= 5")
def _(t):
    return jobs.last_events(jobs.job_events(t("events")), 5).select("job_id", "event_id", "stage", F.col("rank").cast("long").alias("rank"))


@query("r28_fused_ranks", """WITH a AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part), b AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS rank FROM part)
SELECT p_partkey, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL""")
def _(t):
    by = lambda *o: relational.top_n(t("part"), ["p_brand"], 1 << 30, *o).select("p_partkey", "rank")
    return graphs.fuse_ranks([by(F.col("p_retailprice").desc(), F.col("p_partkey")), by(F.col("p_size"), F.col("p_partkey"))], "p_partkey", "rank")


@query("e20_layout_shift", "SELECT user_id, round(coalesce(sum(value) FILTER (event_type <> 'click'), 0.0), 6) AS cumulative_layout_shift FROM events GROUP BY user_id")
def _(t):
    return rollups.layout_shift(t("events"), ["user_id"], F.col("value"), F.col("event_type") == "click")


@query("r3_neighbours", f"{_GRAPH} SELECT id, neighbour FROM n")
def _(t):
    return flows.neighbours(graphs.similarity_graph(t("embeddings"), "vec_id", "embedding", 8, 0.2))


@query("s2_shared_neighbours", f"{_GRAPH} SELECT from_id, to_id, count(b.id) AS shared FROM g LEFT JOIN n a ON a.id = from_id LEFT JOIN n b ON b.id = to_id AND b.neighbour = a.neighbour GROUP BY ALL")
def _(t):
    edges = graphs.similarity_graph(t("embeddings"), "vec_id", "embedding", 8, 0.2)
    return flows.shared_neighbours(edges, edges)


@query("r4_compare_nodes", """WITH e AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_linenumber = 1), q AS (SELECT DISTINCT least(a.p, b.p) AS l, greatest(a.p, b.p) AS r FROM e a JOIN e b ON b.s = a.s AND b.p = a.p + 1)
SELECT q.l AS left_id, q.r AS right_id, x.p_type = y.p_type AS same_type, concat_ws(',', CASE WHEN x.p_brand <> y.p_brand THEN 'brand' END, CASE WHEN x.p_size % 3 = 0 OR y.p_size % 3 = 0 THEN CASE WHEN x.p_size % 3 <> 0 OR y.p_size % 3 <> 0 OR x.p_size <> y.p_size THEN 'size' END END) AS differing,
(SELECT string_agg(a.s, ',' ORDER BY a.s) FROM e a JOIN e b ON b.s = a.s WHERE a.p = q.l AND b.p = q.r) AS shared FROM q JOIN part x ON x.p_partkey = q.l JOIN part y ON y.p_partkey = q.r""")
def _(t):
    """Parts and suppliers are nodes, first lines link them; parts of one supplier that are next to each other are compared."""
    far = 1_000_000_000
    e = t("lineitem").filter("l_linenumber = 1").select(F.col("l_partkey").alias("from_id"), (F.col("l_suppkey") + far).alias("to_id")).distinct()
    sized = F.when(F.col("p_size") % 3 == 0, F.create_map(F.lit("brand"), "p_brand", F.lit("size"), F.col("p_size").cast("string"))).otherwise(F.create_map(F.lit("brand"), "p_brand"))
    n = t("part").select(F.col("p_partkey").alias("node_id"), F.col("p_type").alias("type"), sized.alias("properties"))
    after = e.select((F.col("from_id") - 1).alias("from_id"), "to_id", F.col("from_id").alias("right_id"))
    pairs = e.join(after, ["from_id", "to_id"]).select(F.col("from_id").alias("left_id"), "right_id")
    out = flows.compare_nodes(pairs, n, e)
    return out.select("left_id", "right_id", "same_type", F.array_join("differing_properties", ",").alias("differing"), F.array_join(F.transform("shared_neighbours", lambda x: x - far), ",").alias("shared"))


@query("g4_run_status", """WITH s AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'complete' WHEN 'N' THEN 'partial' WHEN 'R' THEN 'blocked' END AS s FROM lineitem)
SELECT l_orderkey, CASE WHEN count(*) FILTER (s = 'blocked') = count(*) THEN 'blocked' WHEN count(*) FILTER (s = 'complete') = count(*) THEN 'complete' WHEN count(*) FILTER (s IN ('complete', 'partial')) > 0 THEN 'partial' ELSE 'failed' END AS status FROM s GROUP BY l_orderkey""")
def _(t):
    flag = F.col("l_returnflag")
    return rollups.run_status(t("lineitem"), ["l_orderkey"], F.when(flag == "A", "complete").when(flag == "N", "partial").when(flag == "R", "blocked"))


@query("g7_name_frequency", "SELECT p_name, count(*) AS n, round(avg(p_retailprice), 4) AS avg_confidence FROM part WHERE p_name IS NOT NULL GROUP BY p_name ORDER BY n DESC, p_name LIMIT 100")
def _(t):
    return rollups.name_frequency(t("part"), "p_name", "p_retailprice", 100)


@query("g8_component_counts", "SELECT p_type, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY p_type ORDER BY n DESC, p_type LIMIT 24")
def _(t):
    return rollups.name_frequency(t("part"), "p_type", None, 24)


@query("j6_preferred_row", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(o_orderstatus = 'F', false) DESC, o_orderkey) = 1")
def _(t):
    return rollups.preferred(t("orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], F.col("o_orderstatus") == "F", F.col("o_orderkey"))


@query("j13_unmatched", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def _(t):
    matched = t("orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return relational.unmatched(t("customer").select("c_custkey", "c_name"), matched, ["c_custkey"])


@query("j22_coverage", """WITH s AS (SELECT l_suppkey, l_partkey, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag = 'R') AS r FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL)
SELECT l_suppkey, count(*) FILTER (a AND r) AS covered, count(*) AS total FROM s GROUP BY l_suppkey""")
def _(t):
    lines = t("lineitem")
    return rollups.coverage(lines.filter("l_returnflag = 'A'"), lines.filter("l_returnflag = 'R'"), ["l_suppkey"], "l_partkey")


@query("k3_score_order", """WITH b AS (SELECT o_custkey, max(o_totalprice) AS best FROM orders GROUP BY o_custkey)
SELECT c_nationkey, c_custkey, best, row_number() OVER (PARTITION BY c_nationkey ORDER BY best DESC NULLS LAST, c_custkey) AS rank FROM customer LEFT JOIN b ON o_custkey = c_custkey""")
def _(t):
    ranked = rollups.by_best_score(t("customer").select("c_nationkey", "c_custkey"), t("orders"), ["c_nationkey"], "c_custkey", "o_custkey", "o_totalprice")
    return ranked.withColumn("rank", F.col("rank").cast("long"))


@query("r18_stale_subjects", "SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NULL OR sha256(text) <> sha256(regexp_replace(text, '[0-9]', '0', 'g'))")
def _(t):
    docs = t("documents")
    masked = docs.select("doc_id", F.sha2(F.regexp_replace("text", "[0-9]", "0"), 256).alias("digest"))
    return rollups.stale_subjects(docs.select("doc_id", F.sha2("text", 256).alias("digest")), masked, "doc_id", "digest")


@query("t9_running_cost", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS calls, round(sum(value), 4) AS usd FROM events GROUP BY ALL")
def _(t):
    return jobs.running_cost(t("events"), "ts", "event_type", "value")


@query("v4_count_mismatch", "WITH d AS (SELECT conv_id, max(turn) AS declared, count(*) AS actual FROM conversations GROUP BY conv_id) SELECT * FROM d WHERE declared IS DISTINCT FROM actual")
def _(t):
    turns = t("conversations")
    return rollups.count_mismatch(turns.groupBy("conv_id").agg(F.max("turn").alias("turns")), turns, "conv_id", "turns")
