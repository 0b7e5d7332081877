"""Edges between captured screens, flow actions and flow graphs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.keys import destination_class, join_key, path_of, resolve, stable_id
from lumenfold.operators.relational import first_per_key, latest, spread

#: Flow actions (id without its prefix, label, aliases, path hints).
PREFIX = "dig:flow."
ACTIONS = (
    ("onboarding", "Onboarding", ("welcome", "getting started", "first run"), ("/onboarding", "/welcome", "/getting-started", "/intro")),
    ("logging_in", "Logging in", ("login", "sign in", "signin"), ("/login", "/signin", "/sign-in", "/auth/login")),
    ("creating_account", "Creating account", ("sign up", "signup", "register"), ("/signup", "/sign-up", "/register", "/auth/register")),
    ("editing_profile", "Editing profile", ("profile settings", "account settings"), ("/profile", "/account", "/settings/profile")),
    ("filtering_sorting", "Filtering & sorting", ("filters", "sort", "refine"), ()),
    ("chatting_messaging", "Chatting & sending messages", ("chat", "messages", "inbox"), ("/messages", "/chat", "/inbox")),
    ("subscribing_upgrading", "Subscribing & upgrading", ("pricing", "upgrade", "paywall", "subscribe"), ("/pricing", "/upgrade", "/subscribe", "/billing")),
    ("browsing_tutorial", "Browsing tutorial", ("tutorial", "walkthrough", "product tour"), ("/tutorial", "/tour", "/guide")),
    ("checkout", "Checkout", ("cart", "bag", "purchase", "payment"), ("/checkout", "/cart", "/bag", "/payment")),
    ("searching", "Searching", ("search", "find"), ("/search", "/find")),
    ("settings", "Settings", ("preferences", "configuration"), ("/settings", "/preferences")),
    ("empty_recovery", "Empty state & recovery", ("empty state", "no results", "error recovery"), ()),
    ("navigation_ia", "Primary navigation", ("nav", "menu", "tab bar"), ()),
    ("content_browse", "Content browsing", ("browse", "explore", "feed"), ("/explore", "/browse", "/feed")),
    ("unknown", "Unknown flow", (), ()),
)


def flow_actions(spark) -> DataFrame:
    """action_id, label, aliases, path_hints; a fixed, small table."""
    rows = [(PREFIX + i, label, list(a), list(h)) for i, label, a, h in ACTIONS]
    return spark.createDataFrame(rows, "action_id string, label string, aliases array<string>, path_hints array<string>")


def clamp(confidence: Column, most: float = 0.999) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(most), F.round(confidence, 4)))


#: Classes of destinations that no edge is drawn to.
SKIPPED = ("action_unsafe", "fragment", "unknown")


def href_edges(screens: DataFrame, candidates: DataFrame) -> DataFrame:
    """An edge for each candidate link that leads to another captured screen, the first by id of those with its url.

    `screens` has capture_id, url; `candidates` has capture_id, candidate_id, destination, destination_class, safety,
    score. What is forbidden, unsafe, a fragment or unknown gives no edge. Two least ids a url are enough to leave out
    the own screen, so a url that many screens share doesn't fan out.
    """
    keyed = screens.select("capture_id", join_key(F.col("url")).alias("_key")).filter("_key IS NOT NULL")
    targets = keyed.groupBy("_key").agg(F.min("capture_id").alias("_first"), F.max("capture_id").alias("_last"))
    second = keyed.join(targets.select("_key", "_first"), "_key").filter("capture_id <> _first").groupBy("_key").agg(F.min("capture_id").alias("_second"))
    targets = targets.join(second, "_key", "left")
    links = candidates.filter(~F.coalesce(F.col("safety") == "forbid", F.lit(False)) & ~F.coalesce(F.col("destination_class").isin(*SKIPPED), F.lit(False)) & (F.col("destination") != ""))
    links = links.join(screens.select("capture_id", F.col("url").alias("_base")), "capture_id")
    # generated rather than projected, so that it is worked out once however often it is named
    links = links.select("*", F.explode(F.array(resolve(F.col("destination"), F.col("_base")))).alias("_to"))
    links = links.withColumn("_key", join_key(F.col("_to")))
    found = links.join(targets, "_key").withColumn("to_id", F.when(F.col("_first") != F.col("capture_id"), F.col("_first")).otherwise(F.col("_second"))).filter("to_id IS NOT NULL")
    sure = clamp(F.least(F.lit(0.95), 0.55 + F.col("score") * 0.4))
    return found.select(stable_id("fe", F.col("capture_id"), F.col("to_id"), F.col("candidate_id"), length=16).alias("edge_id"), F.col("capture_id").alias("from_id"), "to_id", "candidate_id", F.lit("href_join").alias("method"), sure.alias("confidence"))


def seed_edges(steps: DataFrame, session: str, capture: str, *order: Column, url: str | None = None, screens: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """F2: consecutive steps of a session that show different captures, with their zero-based step, at 0.8.

    With the urls of steps, `screens` and `candidates` (with ordinal), a link of the step before to the url of the step
    after proves the edge, up to 0.92; the first such link counts.
    """
    w = Window.partitionBy(session).orderBy(*order)
    to_url = F.lead(url).over(w) if url else F.lit(None).cast("string")
    pairs = steps.select(session, F.col(capture).alias("from_id"), F.lead(capture).over(w).alias("to_id"), (F.row_number().over(w) - 1).cast("long").alias("step"), to_url.alias("_url"))
    pairs = pairs.filter("to_id IS NOT NULL AND from_id <> to_id")
    if candidates is None:
        return pairs.drop("_url").withColumn("confidence", F.lit(0.8))
    links = candidates.filter(~F.coalesce(F.col("safety") == "forbid", F.lit(False))).join(screens.select("capture_id", F.col("url").alias("_base")), "capture_id")
    links = links.select(F.col("capture_id").alias("from_id"), join_key(resolve(F.col("destination"), F.col("_base"))).alias("_key"), "ordinal", "candidate_id", "score").filter("_key IS NOT NULL")
    proof = links.groupBy("from_id", "_key").agg(F.min(F.struct("ordinal", "candidate_id", "score")).alias("_p"))
    found = pairs.withColumn("_key", join_key(F.col("_url"))).join(proof, ["from_id", "_key"], "left")
    sure = F.when(F.col("_p").isNull(), 0.8).otherwise(clamp(F.least(F.lit(0.92), 0.8 + F.col("_p.score") * 0.12)))
    name = stable_id("fe", F.lit("seed"), F.col("from_id"), F.col("to_id"), F.col("step"), length=16)
    return found.select(session, "from_id", "to_id", "step", name.alias("edge_id"), F.col("_p.candidate_id").alias("candidate_id"), sure.alias("confidence"))


def activated_edges(candidates: DataFrame) -> DataFrame:
    """observed edges (confidence 1) of candidates that may be activated: allowed, not forbidden and not unsafe."""
    allowed = candidates.filter("safety = 'allow_activate' AND coalesce(destination_class, '') <> 'action_unsafe'")
    name = stable_id("fe", F.lit("activate"), F.col("from_id"), F.col("to_id"), F.col("candidate_id"), length=16)
    return allowed.select(name.alias("edge_id"), "from_id", "to_id", "candidate_id", F.lit("safe_activate").alias("method"), F.lit(1.0).alias("confidence"))


def imported_edges(edges: DataFrame) -> DataFrame:
    """edges from outside, at 0.99 at most; `position` names those without an id."""
    name = stable_id("fe", F.lit("import"), F.col("position"), F.col("from_id"), F.col("to_id"), length=16)
    return edges.select(F.coalesce(F.when(F.col("edge_id") != "", F.col("edge_id")), name).alias("edge_id"), "from_id", "to_id", F.lit("external_import").alias("method"), clamp(F.least(F.col("confidence"), F.lit(0.99))).alias("confidence"))


def touching(edges: DataFrame, captures: DataFrame) -> DataFrame:
    """edges with an end among `captures` (one column), each once."""
    ids = captures.toDF("_id").distinct()
    one = edges.join(ids, F.col("from_id") == F.col("_id"), "left_semi")
    return one.unionByName(edges.join(ids, F.col("from_id") == F.col("_id"), "left_anti").join(ids, F.col("to_id") == F.col("_id"), "left_semi"))


def merge_edges(docs: list[DataFrame]) -> DataFrame:
    """The first document that has an edge id gives its edge."""
    return first_per_key(docs, "edge_id")


def detect_actions(screens: DataFrame, flow: str) -> DataFrame:
    """(flow, action_id, confidence, method) of `screens` (url, ordinal, has_form, has_nav): the surest rule for each action, the first of ties.

    The path hints of the fixed actions become one array of conditions a row, so nothing is joined.
    """
    path, form = path_of(F.regexp_replace(F.col("url"), r"#.*$", "")), F.coalesce(F.col("has_form"), F.lit(False))
    hit = lambda when, action, sure, method: F.when(when, F.struct(F.lit(PREFIX + action).alias("action_id"), (sure if isinstance(sure, Column) else F.lit(sure)).alias("confidence"), (method if isinstance(method, Column) else F.lit(method)).alias("method")))
    rules = []
    for action, _, _, hints in ACTIONS:
        if hints:
            at = F.lit(False)
            for h in hints:
                at = at | (path == h) | path.startswith(h + "/")
            rules.append(hit(at, action, 0.75, "path_hint"))
    cart = path.contains("/checkout") | (path == "/cart") | path.startswith("/cart/")
    rules += [
        hit(((path == "/login") | path.startswith("/login/") | path.contains("/signin") | path.contains("/sign-in")) & form, "logging_in", 0.9, "path_ontology_rule"),
        hit((path.contains("/signup") | path.contains("/sign-up") | path.contains("/register")) & form, "creating_account", 0.9, "path_ontology_rule"),
        hit(cart, "checkout", F.when(form, 0.88).otherwise(0.8), F.when(form, "path_ontology_rule").otherwise("path_hint")),
        hit(path.contains("/settings") | path.contains("/preferences"), "settings", 0.82, "path_hint"),
        hit(F.coalesce(F.col("has_nav"), F.lit(False)), "navigation_ia", 0.55, "ontology_nav_signal"),
    ]
    flat = screens.select(flow, "ordinal", F.posexplode(F.array_compact(F.array(*rules))).alias("_pos", "_h")).select(flow, "ordinal", "_pos", "_h.*")
    best = latest(flat, [flow, "action_id"], F.col("confidence").desc(), F.col("ordinal"), F.col("_pos")).select(flow, "action_id", "confidence", "method")
    none = screens.select(flow).distinct().join(best.select(flow), flow, "left_anti")
    return best.unionByName(none.select(flow, F.lit(PREFIX + "unknown").alias("action_id"), F.lit(0.4).alias("confidence"), F.lit("no_match").alias("method")))


def merge_actions(sure: DataFrame, guessed: DataFrame, flow: str) -> DataFrame:
    """the surer of the two for each action, `sure` of ties; guesses of unknown actions go, and unknown stays only alone."""
    known = [PREFIX + a[0] for a in ACTIONS]
    every = sure.withColumn("_o", F.lit(0)).unionByName(guessed.filter(F.col("action_id").isin(known)).withColumn("_o", F.lit(1)))
    best = latest(every.filter(F.col("action_id") != PREFIX + "unknown"), [flow, "action_id"], F.col("confidence").desc(), F.col("_o")).drop("_o")
    none = every.select(flow).distinct().join(best.select(flow), flow, "left_anti")
    return best.unionByName(none.select(flow, F.lit(PREFIX + "unknown").alias("action_id"), F.lit(0.4).alias("confidence"), F.lit("no_match").alias("method")))


def evidence_fingerprint(screens: DataFrame, edges: DataFrame, flow: str) -> DataFrame:
    """F8: SHA-256 of a flow's screens in order and its sorted edge ids."""
    place = F.struct("ordinal", F.coalesce("capture_id", path_of(F.col("url"))).alias("id"), path_of(F.col("url")).alias("path"))
    lists = screens.groupBy(flow).agg(F.array_sort(F.collect_list(place)).alias("screens"))
    ids = edges.groupBy(flow).agg(F.array_sort(F.collect_list("edge_id")).alias("edges"))
    both = lists.join(ids, flow, "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<string>")))
    return both.select(flow, F.sha2(F.to_json(F.struct("screens", "edges")), 256).alias("fingerprint"))


def _walk(flow: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                ids, after, has_before = sorted(row.ids), {}, set()
                for e in row.edges:
                    after.setdefault(e["from_id"], []).append(e)
                    has_before.add(e["to_id"])
                roots = [i for i in ids if i not in has_before] or ids[:1]
                own, seen = set(ids), {}
                stack = roots[::-1]
                while stack:
                    at = stack.pop()
                    if at in seen or at not in own:
                        continue
                    seen[at] = len(seen)
                    stack += [e["to_id"] for e in sorted(after.get(at, []), key=lambda e: (-e["confidence"], e["to_id"]))][::-1]
                for i in ids:
                    seen.setdefault(i, len(seen))
                out += [(row[0], i, n) for i, n in seen.items()]
            yield pd.DataFrame(out, columns=[flow, "capture_id", "place"])

    return run


def order_screens(screens: DataFrame, edges: DataFrame, flow: str) -> DataFrame:
    """(flow, capture_id, place): the given order where every screen of a flow has one, else depth first.

    Roots are screens without an edge to them (else the least id), edges go by confidence, then id; what isn't reached
    comes last, by id. A flow's screens and edges, a session's worth, are one row.
    """
    numbered = F.sum(F.when(F.col("ordinal").isNull(), 1).otherwise(0)).over(Window.partitionBy(flow))
    marked = screens.withColumn("_open", numbered)
    given = marked.filter("_open = 0").select(flow, "capture_id", F.col("ordinal").cast("long").alias("place"))
    ids = marked.filter("_open > 0").groupBy(flow).agg(F.collect_set("capture_id").alias("ids"))
    links = edges.groupBy(flow).agg(F.collect_list(F.struct("from_id", "to_id", "confidence")).alias("edges"))
    kinds = {f.name: f.dataType.simpleString() for f in screens.schema}
    rows = ids.join(links, flow, "left").select(flow, "ids", F.coalesce("edges", F.array().cast(links.schema["edges"].dataType)).alias("edges"))
    walked = rows.mapInPandas(_walk(flow), f"{flow} {kinds[flow]}, capture_id {kinds['capture_id']}, place long")
    return given.unionByName(walked)


def flow_ids(places: DataFrame, flow: str, scope: Column) -> DataFrame:
    """a stable id for each flow from its scope and its captures in order."""
    lists = places.groupBy(flow).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "capture_id"))), lambda p: p["capture_id"].cast("string")).alias("_ids"), F.max(scope).alias("_scope"))
    return lists.select(flow, stable_id("flow", F.col("_scope"), F.col(flow), F.array_join("_ids", "|"), length=16).alias("flow_id"))


def flow_edges(edges: DataFrame, places: DataFrame, flow: str) -> DataFrame:
    """edges with both ends among the screens of their flow."""
    ends = places.select(flow, F.col("capture_id").alias("_end"))
    from_end, to_end = ends.withColumnRenamed("_end", "from_id"), ends.withColumnRenamed("_end", "to_id")
    return edges.join(from_end, [flow, "from_id"], "left_semi").join(to_end, [flow, "to_id"], "left_semi")


def flow_issues(actions: DataFrame, places: DataFrame, edges: DataFrame, flow: str) -> DataFrame:
    """(flow, code, item) of unknown actions, repeated or broken orders, edges without an end, and inferred edges that claim certainty."""
    row = lambda df, code, item: df.select(flow, F.lit(code).alias("code"), item.cast("string").alias("item"))
    known = [PREFIX + a[0] for a in ACTIONS]
    orders = places.groupBy(flow).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("place").alias("_d"), F.min("place").alias("_low"), F.max("place").alias("_high"))
    ends = places.select(flow, F.col("capture_id").alias("_end"))
    out = row(actions.filter(~F.col("action_id").isin(known)), "catalog", F.col("action_id"))
    out = out.unionByName(row(orders.filter("_n <> _d"), "duplicate_order", F.col("_n")))
    out = out.unionByName(row(orders.filter("_low <> 0 OR _high <> _n - 1 OR _n <> _d"), "order_not_contiguous", F.col("_high")))
    for end in ("from_id", "to_id"):
        asked, there = spread(edges.select(flow, end, "edge_id"), flow, end), spread(ends.withColumnRenamed("_end", end), flow, end)
        out = out.unionByName(row(asked.join(there, [flow, end], "left_anti"), f"missing_{end}", F.col("edge_id")))
    return out.unionByName(row(edges.filter("activation = 'inferred_href_only' AND confidence >= 1"), "inferred_confidence", F.col("edge_id")))


def neighbours(edges: DataFrame, a: str = "from_id", b: str = "to_id", type_col: str | None = None) -> DataFrame:
    """(id, neighbour), and the type where there is one, of undirected edges, each once."""
    more = [F.col(type_col).alias(type_col)] if type_col else []
    ends = F.explode(F.array(F.struct(F.col(a).alias("id"), F.col(b).alias("neighbour")), F.struct(F.col(b).alias("id"), F.col(a).alias("neighbour"))))
    return edges.select(ends.alias("_e"), *more).select("_e.*", *([type_col] if type_col else [])).distinct()


def shared_neighbours(pairs: DataFrame, edges: DataFrame, a: str = "from_id", b: str = "to_id") -> DataFrame:
    """Number of neighbours that both nodes of each pair have; pairs without any have 0."""
    near = neighbours(edges)
    left, right = near.toDF(a, "_n"), near.toDF(b, "_n")
    met = pairs.select(a, b).join(left, a).join(right, [b, "_n"]).groupBy(a, b).agg(F.count(F.lit(1)).alias("shared"))
    return pairs.select(a, b).distinct().join(met, [a, b], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))


#: Labels of controls that change or end something, and of links to small print.
UNSAFE_LABEL = r"(?i)\b(log\s*out|sign\s*out|delete account|purchase|buy now|pay now|download)\b"
SMALL_PRINT = r"(?i)\b(cookie|consent|privacy|impressum|legal|datenschutz|agb)\b"
#: Landmarks by tags and roles, and the levels above a node in which they count.
LANDMARKS = {"nav": (("nav",), ("navigation", "menubar"), 7), "main": (("main",), ("main",), 11), "footer": (("footer",), ("contentinfo",), 9)}
#: What destination, control, place and label add to a candidate's score, which begins at 0.35.
CLASS_POINTS = {"internal_path": 0.28, "internal_same_origin": 0.12, "fragment": 0.08, "external": -0.12, "unknown": -0.05}
KIND_POINTS = {"link": 0.08, "nav_item": 0.08, "button": 0.05, "submit": 0.05, "tab": 0.04}
#: Score of what is unsafe before its control and place count; candidates of a capture.
FIRST_SCORE, UNSAFE_SCORE, MOST_CANDIDATES = 0.35, 0.05, 80


def landmark_flags(nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """(capture, node_id, nav, main, footer) of nodes that are, or lie closely below, a landmark; `closure` as C10 gives it."""
    role, tag = F.lower(F.coalesce(F.col("attributes")["role"], F.lit(""))), F.lower(F.coalesce("tag", F.lit("")))
    marks = {name: tag.isin(*tags) | role.isin(*roles) for name, (tags, roles, _) in LANDMARKS.items()}
    held = nodes.select("capture", F.col("node_id").alias("ancestor_id"), *[m.alias(f"_{n}") for n, m in marks.items()]).filter(" OR ".join(f"_{n}" for n in marks))
    near = closure.filter(F.col("depth") <= max(levels for _, _, levels in LANDMARKS.values())).join(held, ["capture", "ancestor_id"])
    own = held.select("capture", "ancestor_id", F.col("ancestor_id").alias("node_id"), F.lit(0).alias("depth"), *[f"_{n}" for n in marks])
    flags = [F.max(F.col(f"_{n}") & (F.col("depth") <= levels)).alias(n) for n, (_, _, levels) in LANDMARKS.items()]
    return near.select(own.columns).unionByName(own).groupBy("capture", "node_id").agg(*flags)


def flow_candidates(nodes: DataFrame, closure: DataFrame, pages: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """The controls of each capture that may lead somewhere, best first, 80 of a capture at most.

    (capture, node_id, candidate_id, control_kind, destination, destination_class, unsafe_reason, safety, score, method,
    name, box, rank). `nodes` has capture, node_id, parent_id, tag, attributes, text, rendered and box (null without
    one); `pages` has capture and url. Whether a node lies in a navigation, the main part or the footer comes from the
    closure, once for all nodes.
    """
    attribute = lambda n: F.coalesce(F.col("attributes")[n], F.lit(""))
    tag, role, kind = F.lower(F.coalesce("tag", F.lit(""))), F.lower(attribute("role")), F.lower(attribute("type"))
    href = F.trim(attribute("href"))
    pressed = (tag == "input") & kind.isin("submit", "button", "image")
    acts = ((tag == "a") & (href != "")) | (tag == "button") | pressed | ((tag != "input") & role.isin("link", "button", "tab", "menuitem"))
    name = F.substring(F.trim(F.regexp_replace(F.coalesce(*[F.when(x != "", x) for x in (attribute("aria-label"), attribute("aria-labelledby"), attribute("title"), F.coalesce("text", F.lit("")))], F.lit("")), r"\s+", " ")), 1, 120)
    height = nodes.groupBy("capture").agg(F.coalesce(F.expr("nullif(greatest(0.0D, max(box.y + box.height)), 0.0D)"), F.lit(900.0)).alias("_height"))
    flags = landmark_flags(nodes, closure)
    rows = nodes.filter(acts & F.coalesce("rendered", F.lit(True))).join(flags, ["capture", "node_id"], "left").join(height, "capture").join(pages.select("capture", F.col("url").alias("_page")), "capture", "left")
    rows = rows.withColumns({n: F.coalesce(n, F.lit(False)) for n in LANDMARKS})
    control = (
        F.when(role == "tab", "tab").when((tag == "a") | (role == "link"), F.when(F.col("nav"), "nav_item").otherwise("link"))
        .when((tag == "button") | (role == "button"), F.when(kind == "submit", "submit").otherwise("button")).when(pressed, F.when(kind == "submit", "submit").otherwise("button")).otherwise("other")
    )
    rows = rows.withColumns({"control_kind": control, "name": name, "_href": F.when(href != "", href)}).filter("_href IS NOT NULL OR control_kind IN ('button', 'submit', 'tab')")
    # generated rather than projected, so that each is worked out once however often it is named
    rows = rows.select("*", F.explode(F.array(resolve(F.col("_href"), F.col("_page")))).alias("_to"))
    rows = rows.select("*", F.explode(F.array(destination_class(F.col("_href"), F.col("_page"), F.col("_to")))).alias("_d"))
    label = F.col("name").rlike(UNSAFE_LABEL)
    unsafe = label & (F.col("_d.destination_class") != "action_unsafe")
    rows = rows.withColumns({"destination": F.col("_d.destination"), "destination_class": F.when(unsafe, "action_unsafe").otherwise(F.col("_d.destination_class")), "unsafe_reason": F.when(unsafe, "label").otherwise(F.col("_d.unsafe_reason"))})
    add = lambda when, p: F.when(F.coalesce(when, F.lit(False)), p).otherwise(0.0)
    score = F.when(F.col("destination_class") == "action_unsafe", UNSAFE_SCORE).otherwise(FIRST_SCORE)
    for column, points in (("destination_class", CLASS_POINTS), ("control_kind", KIND_POINTS)):
        for value, p in points.items():
            score = score + add(F.col(column) == value, p)
    score = score + add(F.col("main"), 0.12) + add(F.col("nav"), 0.06) + add(F.col("footer"), -0.2) + add(F.col("name").rlike(SMALL_PRINT), -0.25) + add(F.length("name") >= 2, 0.06) + 0.04
    score = score + add(F.col("box.y") < F.col("_height") * 1.1, 0.08) + add(F.col("box.width") * F.col("box.height") > 4000, 0.03)
    safety = (
        F.when(F.col("destination_class") == "action_unsafe", "forbid").when(F.col("destination_class").isin("external", "fragment") | F.col("control_kind").isin("link", "nav_item"), "href_join_only")
        .when(F.col("destination_class").isin("internal_path", "internal_same_origin"), "allow_activate").otherwise("href_join_only")
    )
    out = rows.withColumns({"score": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4), "safety": safety, "method": F.when(F.col("_href").isNotNull(), "link_href_scan").otherwise("control_role_scan")})
    rank = F.row_number().over(Window.partitionBy("capture").orderBy(F.col("score").desc(), F.col("node_id").cast("string"))).cast("long")
    out = out.withColumn("rank", rank).filter(F.col("rank") <= most).withColumn("candidate_id", stable_id("cand", F.col("capture"), F.col("node_id"), F.col("control_kind"), length=16))
    return out.select("capture", "node_id", "candidate_id", "control_kind", "destination", "destination_class", "unsafe_reason", "safety", "score", "method", "name", "box", "rank")


def compare_nodes(pairs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(left_id, right_id, same_type, differing_properties, shared_neighbours) of pairs (left_id, right_id) of known nodes.

    Properties differ where a key has another value or none; shared neighbours are nodes that both are linked with, in
    either direction. Both lists are sorted. Only neighbours of nodes that are asked for are looked up.
    """
    asked = pairs.select("left_id", "right_id").distinct()
    of = lambda s: nodes.select(F.col("node_id").alias(f"{s}_id"), F.col("type").alias(f"_{s}_type"), F.col("properties").alias(f"_{s}_map"))
    known = asked.join(of("left"), "left_id").join(of("right"), "right_id")
    left, right = F.coalesce("_left_map", F.create_map().cast("map<string,string>")), F.coalesce("_right_map", F.create_map().cast("map<string,string>"))
    differing = F.array_sort(F.filter(F.array_union(F.map_keys(left), F.map_keys(right)), lambda k: ~left[k].eqNullSafe(right[k])))
    known = known.select("left_id", "right_id", F.col("_left_type").eqNullSafe(F.col("_right_type")).alias("same_type"), differing.alias("differing_properties"))
    both = neighbours(edges)
    near = asked.join(both.select(F.col("id").alias("left_id"), F.col("neighbour").alias("_n")), "left_id").join(both.select(F.col("id").alias("right_id"), F.col("neighbour").alias("_n")), ["right_id", "_n"])
    shared = near.groupBy("left_id", "right_id").agg(F.array_sort(F.collect_set("_n")).alias("shared_neighbours"))
    kind = dict(shared.dtypes)["shared_neighbours"]
    return known.join(shared, ["left_id", "right_id"], "left").withColumn("shared_neighbours", F.coalesce("shared_neighbours", F.array().cast(kind)))
