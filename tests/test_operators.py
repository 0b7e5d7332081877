import pytest
from pyspark.sql import functions as F

from lumenfold.functions import keys, looks, vectors
from lumenfold.operators import evaluation, flows, geometry, graphs, quality, relational, rollups, search, sections, tokens
from lumenfold.streaming import jobs


def one(spark, column, *values):
    names = [f"v{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column(*map(F.col, names))).first()[0]


def test_keys(spark):
    assert one(spark, keys.join_key, "https://Shop.Example:443/pricing/#x") == "https://shop.example/pricing"
    assert one(spark, keys.join_key, "https://user:pw@shop.example:8080/") == "https://shop.example:8080/"
    assert one(spark, keys.join_key, "https://shop.example//a//") == "https://shop.example//a/"
    assert one(spark, keys.join_key, "mailto:x") is None
    assert one(spark, keys.capture_key, "https://www.A.example/b/") == "a.example/b"
    assert one(spark, keys.capture_key, "www.Example.com/a/") == "example.com/a"
    assert one(spark, keys.capture_key, "https://u:p@example.com:8443/a?x=1") == "example.com/a"
    assert one(spark, keys.capture_key, "https://www.example.com/") == "example.com"
    assert one(spark, keys.capture_key, "  ") == ""
    assert one(spark, keys.host_key, "www.Shop.example/x") == "shop.example"
    assert one(spark, keys.redact_url, "https://a.example/p?token=1&x=2#y") == "https://a.example/p?token=%5Bredacted%5D&x=%5Bredacted%5D"
    assert one(spark, keys.redact_url, "https://a.example/p?secretvalue") == "https://a.example/p?secretvalue=%5Bredacted%5D"
    assert one(spark, keys.redact_url, "nonsense") == "[invalid-url]"


def test_resolved_and_classed(spark):
    page = "https://a.example/docs/page?x=1"
    for href, want in {"/x": "https://a.example/x", "other": "https://a.example/docs/other", "?y=2": "https://a.example/docs/page?y=2", "#z": page + "#z", "//b.example/q": "https://b.example/q", "mailto:x@y": "mailto:x@y"}.items():
        assert one(spark, keys.resolve, href, page) == want
    kind = lambda h, p: tuple(one(spark, lambda a, b: keys.destination_class(a, b, keys.resolve(a, b)), h, p)[1:])
    assert kind("#top", page) == ("fragment", None)
    assert kind("mailto:a@b", page) == ("action_unsafe", "scheme")
    assert kind("/account/logout", page) == ("action_unsafe", "path")
    assert kind("/file.zip", page) == ("action_unsafe", "path")
    assert kind("https://b.example/", page) == ("external", None)
    assert kind("/docs/other", page) == ("internal_path", None)
    assert kind("?y=1", page) == ("internal_same_origin", None)


def test_diagnostics_in_any_case(spark):
    clean = lambda t: one(spark, keys.redact_diagnostic, t)
    assert clean("TOKEN=ab API_KEY=cd api-key=ef apikey=gh") == "TOKEN=[redacted] API_KEY=[redacted] api-key=[redacted] apikey=[redacted]"
    assert clean("API-KEY=abc BEARER zzz") == "API-KEY=[redacted] Bearer [redacted]"
    assert clean("at HTTPS://a.example/p?x=1&y#h, k=1") == "at https://a.example/p?x=%5Bredacted%5D&y=%5Bredacted%5D k=1"
    assert clean("nothing here") == "nothing here" and clean("") == ""


def test_html_and_css_redaction(spark):
    base = "https://a.example/d/"
    html = '<a href="x?t=1">y</a><input type="password" value="p1"><input type="text" value="v">'
    assert one(spark, keys.redact_html, html, base) == '<a href="https://a.example/d/x?t=%5Bredacted%5D">y</a><input type="password" value="[redacted]"><input type="text" value="v">'
    assert one(spark, keys.redact_css, "a{background:url('i.png?k=1')}", base) == "a{background:url('https://a.example/d/i.png?k=%5Bredacted%5D')}"
    assert one(spark, keys.redact_srcset, "a.png?x=1 1x, b.png 2x", base) == "https://a.example/d/a.png?x=%5Bredacted%5D 1x, https://a.example/d/b.png 2x"


def test_attributes(spark):
    rows = spark.createDataFrame([("input", {"type": "Password", "value": "s", "href": "x?y=1"})], "tag string, attributes map<string,string>")
    got = rows.select(keys.redact_attributes(F.col("tag"), F.col("attributes"), F.lit("https://a.example/"))).first()[0]
    assert got == {"type": "Password", "value": "[redacted]", "href": "https://a.example/x?y=%5Bredacted%5D"}


def test_text_functions(spark):
    assert one(spark, lambda t: keys.bound_bytes(t, 5, "html")["value"], "aéé€") == "aéé\n<!-- dig:truncated html original_bytes=8 -->\n"
    assert one(spark, lambda t: keys.bound_bytes(t, 8, "html")["truncated"], "aéé€") is False
    assert one(spark, lambda t: keys.clip(t, 6), "  ab  cd efgh ") == "ab cd…"
    assert one(spark, keys.words_key, "Above_Fold|Hero-x") == "above fold hero x"
    assert one(spark, keys.brand_slug, "A&B 's Co.") == "a-b-s-co"
    assert one(spark, keys.country_code, "Germany") == "GE" and one(spark, keys.country_code, "") == "XX"
    assert one(spark, keys.locale_of, "shop.example.de", "America/Chicago") == "de-DE"
    assert one(spark, lambda t: keys.json_object(t, "a int")["a"], 'so:\n```json\n{"a": 3,}\n``` ok') == 3
    assert one(spark, lambda t: keys.json_object(t, "a int"), "no object") is None
    card = keys.canonical_card("screen", {"industry": F.lit("x")}, F.lit("l" * 40), {"rhythm": F.lit("r")}, 50)
    text = spark.range(1).select(card).first()[0]
    assert text.startswith("kind:screen\nindustry:x\nlook:l") and text.endswith("\nrhythm:r") and len(text) == 50
    assert one(spark, lambda a, b: keys.barrier(a, b, [("access_denied", ["denied"]), ("waf", ["checking"])], F.lit(False)), "Access DENIED", "checking") == "access_denied"
    assert one(spark, lambda t: keys.is_consent_text(t), "Alle akzeptieren") and not one(spark, lambda t: keys.is_consent_text(t), "Hello")


def test_embedding_by_brute_force(spark):
    import hashlib

    def embed(text):
        v = [0.0] * 384
        words = [w for w in __import__("re").split(r"[^a-z0-9:#.>_-]+", text.lower()) if len(w) > 1]
        for w in words:
            d = hashlib.sha256(w.encode()).digest()
            v[int.from_bytes(d[:4], "big") % 384] += (1 if d[4] & 1 else -1) * (1 + d[5] % 5 / 5)
        if not words:
            v[0] = 1.0
        n = sum(x * x for x in v) ** 0.5 or 1
        return {i: round(x / n, 9) for i, x in enumerate(v) if x}

    texts = ["hero>media a bb bb", "", "x", "One two THREE #tag a.b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got: dict = {}
    for r in vectors.hashing_embedding(rows, "id", "text").filter("value <> 0").collect():
        got.setdefault(r["id"], {})[r["cell"]] = round(r["value"], 9)
    assert got == {i: embed(t) for i, t in enumerate(texts)}


def test_colors_and_tracks(spark):
    assert one(spark, lambda v: looks.hex8(looks.parse_rgb(v)), "rgba(255, 0, 16, 0.5)") == "#ff001080"
    assert one(spark, lambda v: looks.hex8(looks.parse_rgb(v)), "rgb(1 2 3 / 50%)") == "#01020380"
    assert one(spark, looks.parse_rgb, "red") is None
    assert one(spark, looks.track_count, "1fr minmax(10px, calc(1fr + 2px))  200px") == 3
    assert one(spark, looks.track_count, "none") == 0
    assert one(spark, looks.pixels, " -1.5px ") == -1.5 and one(spark, looks.pixels, "2em") is None
    assert one(spark, looks.families, "\"A B\", serif") == ["A B", "serif"]


def _boxes(spark, items):
    rows = [("v", "root", i, *map(float, b)) for i, b in enumerate(items)]
    return spark.createDataFrame(rows, "viewport string, parent string, ordinal long, x double, y double, width double, height double")


def test_layout_example(spark):
    boxes = _boxes(spark, [(16, 0, 100, 40), (16, 64, 100, 40), (160, 0, 100, 40), (160, 64, 100, 40)])
    found = {r["value"]: (r["n"], r["directions"]) for r in geometry.spacing_scale(boxes, ["viewport", "parent"], ["viewport"]).collect()}
    assert found[24.0] == (2, "vertical") and found[44.0] == (2, "horizontal")
    groups = geometry.alignment_groups(boxes, ["viewport"])
    assert sorted(r["center"] for r in groups.filter("axis = 'x' AND edge = 'start'").collect()) == [16.0, 160.0]
    grid = geometry.probable_grid(groups, boxes, ["viewport"]).first()
    assert (grid["column_count"], grid["column_starts"], grid["confidence"]) == (2, [16.0, 160.0], 0.95)
    assert geometry.aligned_edges(groups, ["viewport"]).filter("axis = 'x' AND edge = 'start'").count() == 2


def test_relations_by_brute_force(spark):
    import random

    random.seed(3)
    items = [(random.randint(-50, 1500), random.randint(-50, 1500), random.randint(0, 700), random.randint(0, 700)) for _ in range(60)]
    want = set()
    for i, a in enumerate(items):
        for j in range(i + 1, len(items)):
            b = items[j]
            ox, oy = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
            if ox > 0 and oy > 0:
                want.add((i, j, "overlaps"))
            elif oy > 0:
                want.add((i, j, "left_of") if a[0] <= b[0] else (j, i, "left_of"))
            elif ox > 0:
                want.add((i, j, "above") if a[1] <= b[1] else (j, i, "above"))
    got = [(r["from_ordinal"], r["to_ordinal"], r["relation"]) for r in geometry.relations(_boxes(spark, items), ["viewport", "parent"]).collect()]
    assert len(got) == len(want) and set(got) == want


def test_clusters_by_brute_force(spark):
    import random

    random.seed(5)
    values = [round(random.uniform(-40, 40) * 2) / 2 for _ in range(120)]
    found: list[list[float]] = []
    for v in sorted(values):
        near = next((c for c in found if abs(sum(c) / len(c) - v) <= 2), None)
        near.append(v) if near else found.append([v])
    want = sorted((((sum(c) / len(c) * 2 + 0.5) // 1) / 2, len(c)) for c in found if len(c) > 1)
    rows = spark.createDataFrame([("v", i, v) for i, v in enumerate(values)], "vp string, id long, x double")
    got = geometry.clusters_1d(rows, ["vp"], "x", "id").collect()
    assert sorted((r["center"], r["n"]) for r in got) == want
    assert sum(r["n"] for r in got) == len({i for r in got for i in r["ids"]})


def test_transformations(spark):
    style = lambda **s: {k.replace("_", "-"): v for k, v in s.items()}
    box = lambda *b: dict(zip(("x", "y", "width", "height"), map(float, b), strict=True))
    vps = spark.createDataFrame([("c", "m", 400.0, 800.0, 3000.0), ("c", "d", 1200.0, 900.0, 2000.0)], "capture string, viewport_id string, width double, height double, document_height double")
    schema = "capture string, element_id string, viewport_id string, rendered boolean, sibling_index int, style map<string,string>, box struct<x:double,y:double,width:double,height:double>"
    members = spark.createDataFrame([("c", "e", "m", True, 1, style(display="block", grid_template_columns="none"), box(0, 0, 400, 100)), ("c", "e", "d", True, 2, style(display="grid", grid_template_columns="1fr 1fr", order="3"), box(300, 10, 600, 100)), ("c", "f", "m", True, 1, {}, None), ("c", "f", "d", False, 1, {}, None)], schema)
    got = {(r["element_id"], r["type"]): r["evidence"] for r in geometry.transformations(geometry.adjacent_pairs(vps, members, ["capture"]), ["capture"]).collect()}
    assert set(got) == {("e", "reorder"), ("e", "resize"), ("e", "move"), ("e", "layout_mode_change"), ("f", "hide")}
    assert got["e", "resize"]["width"] == "-0.5" and got["e", "move"]["x"] == "0.25"
    assert got["e", "layout_mode_change"] == {"display": "block to grid", "grid-column-count": "0 to 2"}


def test_logical_elements(spark):
    schema = "capture string, viewport_id string, ordinal long, node_id string, node_type string, tag string, anchor map<string,string>, dom_path string, text string"
    rows = [("c", v, i, f"{v}{i}", "element", "a", a, p, t) for v in ("m", "d") for i, (a, p, t) in enumerate([({"id": "x"}, "/a", "T"), ({"id": "x"}, "/b", "T"), ({}, "/c", " Some  Text"), ({}, "/d", ""), ({}, f"/{v}", "")])]
    got = {r["method"]: [tuple(m) for m in r["members"]] for r in geometry.logical_elements(spark.createDataFrame(rows, schema), ["capture"]).collect()}
    assert got == {"stable_anchor": [("d", "d0"), ("m", "m0")], "structure_and_text": [("d", "d2"), ("m", "m2")], "structure": [("d", "d3"), ("m", "m3")]}


STEP = "array<struct<role:string,text:string,box:struct<x:double,y:double,width:double,height:double>>>"


def _steps(spark, *steps):
    rows = [([(r, t, (0.0, float(y), 100.0, 20.0)) for r, t, y in steps],)]
    return spark.createDataFrame(rows, f"s {STEP}")


def test_recipes(spark):
    df = _steps(spark, ("media_large", "", 0), ("heading", "H", 30), ("subheading", "S", 60), ("cta", "A", 90), ("cta", "B", 92), ("cta", "C", 400), ("decorative", "", 430), ("body", "x", 460))
    merged = df.select(sections.merge_cta_pairs(F.col("s")).alias("s"))
    got = merged.select(sections.signature(F.col("s")).alias("sig"), sections.gaps(F.col("s")).alias("gaps"), F.transform("s", lambda x: x["role"]).alias("roles"), F.transform("s", lambda x: x["text"]).alias("texts")).first()
    assert got["roles"] == ["media_large", "heading", "subheading", "cta_pair", "cta", "decorative", "body"]
    assert got["texts"][3] == "A | B" and got["sig"] == "media>heading>cta>body" and got["gaps"] == [10, 10, 10, 290, 10, 10]
    assert _steps(spark).select(sections.signature(F.col("s"))).first()[0] == "unknown"


def test_demotion_and_hints(spark):
    row = lambda c, s, text, h, m="x", p=0.5: spark.range(1).select(sections.demotion(F.lit(c), F.lit(s), F.array(F.lit(text)), F.lit(h), F.lit(m), F.lit(p))).first()[0]
    assert row("cookie_consent", "hero", "", 500) == "cookie_consent"
    assert row("hero", "body", "x", 50) == "thin_short_body"
    assert row("commerce", "body", "nothing of note", 500) == "thin_commerce_without_cues"
    assert row("commerce", "body", "jetzt kaufen", 500) is None
    assert row("content", "body", "short", 500) == "thin_empty_content"
    assert row("nav", "unknown", "tiny", 500, "catalog_composition_hint", 0.9) == "catalog_body_overmatch"
    score = lambda a, b: spark.range(1).select(sections.hint_score(F.split(F.lit(a), ">"), F.split(F.lit(b), ">"))).first()[0]
    assert score("media>heading>cta", "media>cta") == 1.15 and score("heading", "media>heading") == 0.5 and score("media>x", "media>cta") == 0.5


def test_section_roots(spark):
    rows = [("v", i, tag, True, *map(float, b)) for i, (tag, b) in enumerate([("main", (0, 0, 1200, 4000)), ("section", (0, 0, 1200, 600)), ("div", (10, 10, 600, 300)), ("section", (0, 600, 1200, 500)), ("div", (0, 1200, 1200, 300)), ("span", (0, 2000, 1200, 600))])]
    nodes = spark.createDataFrame(rows, "vp string, node_id long, tag string, rendered boolean, x double, y double, width double, height double")
    got = sections.section_roots(nodes, ["vp"], F.lit(900.0)).orderBy("place").collect()
    assert [r["node_id"] for r in got] == [1, 3, 4]


def test_direct_children(spark):
    rows = [("v", 0, None, "section", 1.0), ("v", 1, 0, "div", 1.0), ("v", 2, 1, "p", 1.0), ("v", 3, 1, "p", 1.0), ("v", 10, None, "section", 1.0), ("v", 11, 10, "p", 1.0), ("v", 12, 10, "p", 1.0), ("v", 20, None, "section", 1.0), ("v", 21, 20, "div", 1.0), ("v", 22, 21, "img", 1.0), ("v", 30, None, "section", 1.0), ("v", 31, 30, "div", 1.0), ("v", 32, 31, "p", 1.0)]
    nodes = spark.createDataFrame(rows, "vp string, node_id long, parent_id long, tag string, x double").withColumn("rendered", F.lit(True))
    got = sections.direct_children(nodes.filter("tag = 'section'").select("vp", "node_id"), nodes, ["vp"]).collect()
    assert sorted((r["root_id"], r["node_id"]) for r in got) == [(0, 2), (0, 3), (10, 11), (10, 12), (20, 22), (30, 31)]


def test_tokens(spark):
    styles = spark.createDataFrame([("v", i, {"border-top-left-radius": r}) for i, r in enumerate(["4px", "5px", "8px", "8px", "50%", "0px", "100px"])], "vp string, node_id long, properties map<string,string>")
    got = [(r["role"], r["value_px"], r["occurrences"]) for r in tokens.radius_scale(tokens.shape_values(styles, ["vp"]), ["vp"]).collect()]
    assert sorted(got) == [("md", 8.0, 2), ("pill", 999.0, 1), ("sm", 4.0, 2)]


def test_quality_examples(spark):
    q = lambda **m: tuple(spark.range(1).select(quality.weighted_quality({k: F.lit(v).cast("double") for k, v in m.items()}).alias("q")).select("q.*").first())
    assert q(**dict.fromkeys(quality.WEIGHTS, 1)) == (1.0, "excellent")
    assert q(**dict.fromkeys(quality.WEIGHTS, 0.6)) == (0.6, "partial")
    assert q(**dict.fromkeys(quality.WEIGHTS, 2)) == (1.0, "excellent")
    assert q(geometry_coverage=float("nan"), style_coverage=float("inf")) == (0.0, "poor")


@pytest.mark.parametrize(("failed", "queued", "level"), [(0, 0, "ok"), (1, 0, "warn"), (0, 1, "warn"), (21, 0, "critical")])
def test_health(spark, failed, queued, level):
    rows = [("a", "failed")] * failed + [("a", "queued")] * queued + [("a", "complete")]
    got = quality.tallies(spark.createDataFrame(rows, "k string, stage string"), ["k"]).first()
    assert (got["health"], got["total"], got["open"]) == (level, failed + queued + 1, queued)


def test_costs(spark):
    cost = lambda model, cached=False, reported=None: spark.range(1).select(quality.stage_cost(F.lit(model), F.lit(1000), F.lit(500), F.lit(cached), reported=F.lit(reported).cast("double"))).first()[0]
    assert cost("x/Qwen3.7-flash") == 9.5e-05 and cost("z:free") == 0.0 and cost("other") is None
    assert cost("other", True) == 0.0 and cost("other", False, 0.5) == 0.5


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert sorted(map(tuple, relational.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, None), (3, "c")]
    assert sorted(map(tuple, relational.upsert_coalesce(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(map(tuple, relational.insert_absent(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_drop_existing_urls(spark):
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(["a", "b", "a", "c", "b", "", "b"])], "i int, key string")
    got = {r["key"]: tuple(r)[1:] for r in relational.drop_existing_urls(rows, "key", "i", spark.createDataFrame([("b",)], "k string")).collect()}
    assert got == {"a": (0, False, 0, 1), "b": (1, True, 3, 0), "c": (3, False, 0, 0)}


def _stream(spark, tmp_path, events):
    events.write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    # a last event far ahead moves the watermark past every window
    late = events.limit(1).withColumn("ts", F.expr("timestamp'2030-01-01 00:00:00'"))
    late.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    jobs.replay(jobs.stage_windows(jobs.job_events(stream)), str(tmp_path / "out"), str(tmp_path / "c"))
    got = spark.read.parquet(str(tmp_path / "out")).filter("window_start < '2029-01-01'")
    want = jobs.stage_windows(jobs.job_events(events))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["state", "retries", "recent"])
def test_stateful_stream_ends_as_batch(spark, tmp_path, name):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").filter("user_id % 5 = 0").repartition(2)
    stream, batch = jobs.job_events(_stream(spark, tmp_path, events)), jobs.job_events(events)
    if name == "retries":
        # attempts are order-free; the status is of the last end in the order of arrival
        forms = jobs.retry_stream(stream, 3), {r["job_id"]: r["attempts"] for r in jobs.retries(batch, 3).collect()}, "attempts"
    elif name == "state":
        forms = jobs.state_stream(stream), {r["job_id"]: r["stage"] for r in jobs.current_state(batch).collect()}, "stage"
    else:
        lists: dict = {}
        for r in jobs.last_events(batch, 3).orderBy("job_id", "rank").collect():
            lists.setdefault(r["job_id"], []).append(r["event_id"])
        forms = jobs.recent_stream(stream, 3), lists, "event_ids"
    out, want, column = forms
    jobs.replay(out, str(tmp_path / "out"), str(tmp_path / "c"), "update")
    last: dict = {}
    for r in spark.read.parquet(str(tmp_path / "out" / "batch=*")).orderBy("batch_id").collect():
        last[r["job_id"]] = r[column]
    assert last == want


def test_duplicate_submissions(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:05:00"), ("b", "2024-01-01 00:01:00")], "key string, at string").withColumn("ts", F.col("at").cast("timestamp"))
    stream = _stream(spark, tmp_path, rows.coalesce(1))
    jobs.replay(jobs.accepted(stream, "key"), str(tmp_path / "out"), str(tmp_path / "c"))
    assert sorted(r["key"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_run_status_and_nulls(spark):
    rows = [("a", "blocked"), ("a", "blocked"), ("b", "complete"), ("c", "complete"), ("c", None), ("d", "blocked"), ("d", None)]
    runs = spark.createDataFrame(rows, "run string, s string")
    got = {r["run"]: r["status"] for r in rollups.run_status(runs, ["run"], F.col("s")).collect()}
    assert got == {"a": "blocked", "b": "complete", "c": "partial", "d": "failed"}


def test_layout_shift_ignores_recent_input(spark):
    shifts = spark.createDataFrame([("v", 0.1, True), ("v", 0.2, False), ("v", None, False), ("v", 0.3, None)], "vp string, value double, recent boolean")
    assert rollups.layout_shift(shifts, ["vp"], F.col("value"), F.col("recent")).first()["cumulative_layout_shift"] == 0.5


def test_seed_edges_skip_same_capture(spark):
    steps = spark.createDataFrame([("s", 1, "a"), ("s", 2, "a"), ("s", 3, "b"), ("s", 4, None)], "session string, at int, capture string")
    got = flows.seed_edges(steps, "session", "capture", F.col("at")).collect()
    assert [(r["from_id"], r["to_id"], r["step"]) for r in got] == [("a", "b", 1)]


CANDIDATE = "capture_id string, ordinal int, candidate_id string, destination string, destination_class string, safety string, score double"


def test_href_and_proven_edges(spark):
    screens = spark.createDataFrame([("c1", "https://a.example/"), ("c2", "https://a.example/pricing"), ("c3", "https://a.example/pricing/"), ("c4", "https://b.example/")], "capture_id string, url string")
    rows = [("c1", 0, "k1", "/pricing", "internal_path", "allow", 0.5), ("c2", 0, "k2", "/pricing", "internal_same_origin", "allow", 1.0), ("c1", 1, "k3", "/pricing", "internal_path", "forbid", 1.0), ("c1", 2, "k4", "#x", "fragment", "allow", 1.0), ("c1", 3, "k5", "https://b.example", "external", "allow", 1.0)]
    candidates = spark.createDataFrame(rows, CANDIDATE)
    got = {(r["candidate_id"], r["from_id"], r["to_id"], r["confidence"]) for r in flows.href_edges(screens, candidates).collect()}
    assert got == {("k1", "c1", "c2", 0.75), ("k2", "c2", "c3", 0.95), ("k5", "c1", "c4", 0.95)}
    steps = spark.createDataFrame([("s", 1, "c1", "https://a.example/"), ("s", 2, "c2", "https://a.example/pricing"), ("s", 3, "c4", "https://b.example/")], "session string, at int, capture string, url string")
    proven = {(r["from_id"], r["to_id"]): (r["candidate_id"], r["confidence"]) for r in flows.seed_edges(steps, "session", "capture", F.col("at"), url="url", screens=screens, candidates=candidates).collect()}
    assert proven == {("c1", "c2"): ("k1", 0.86), ("c2", "c4"): (None, 0.8)}


def test_actions(spark):
    rows = [("f", 0, "https://a.example/login?x=1", True, False), ("f", 1, "https://a.example/cart", False, True), ("f", 2, "https://a.example/settings/x", False, False), ("g", 0, "https://a.example/zzz", False, False)]
    got = {(r["flow"], r["action_id"]): (r["confidence"], r["method"]) for r in flows.detect_actions(spark.createDataFrame(rows, "flow string, ordinal int, url string, has_form boolean, has_nav boolean"), "flow").collect()}
    assert got == {("f", "dig:flow.logging_in"): (0.9, "path_ontology_rule"), ("f", "dig:flow.checkout"): (0.8, "path_hint"), ("f", "dig:flow.settings"): (0.82, "path_hint"), ("f", "dig:flow.navigation_ia"): (0.55, "ontology_nav_signal"), ("g", "dig:flow.unknown"): (0.4, "no_match")}


def test_screen_order(spark):
    screens = spark.createDataFrame([("f", c, None) for c in "abcde"] + [("g", "y", 0), ("g", "x", 1)], "flow string, capture_id string, ordinal long")
    edges = spark.createDataFrame([("f", "b", "a", 0.5), ("f", "b", "d", 0.9), ("f", "d", "c", 0.8), ("f", "c", "b", 0.7)], "flow string, from_id string, to_id string, confidence double")
    got = {}
    for r in flows.order_screens(screens, edges, "flow").orderBy("flow", "place").collect():
        got.setdefault(r["flow"], []).append(r["capture_id"])
    assert got == {"f": ["e", "a", "b", "c", "d"], "g": ["y", "x"]}


def test_shared_neighbours(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 4)], "from_id int, to_id int")
    got = {(r["from_id"], r["to_id"]): r["shared"] for r in flows.shared_neighbours(edges, edges).collect()}
    assert got == {(1, 2): 1, (1, 3): 1, (2, 3): 1, (3, 4): 0}


def test_numbered_ids_skip_given_names(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a-2"), (4, "a-2"), (5, "a"), (6, "a-4"), (7, None), (8, None)], "i int, name string")
    got = {r["i"]: r["unique_id"] for r in relational.numbered_ids(rows, "name", F.col("i")).collect()}
    assert got == {1: "a", 2: "a-3", 3: "a-2", 4: "a-2-2", 5: "a-5", 6: "a-4", 7: None, 8: None}


def test_nearest_in_small_blocks(spark):
    import random

    random.seed(1)
    rows = [(i, [random.gauss(0, 1) for _ in range(6)]) for i in range(150)] + [(150, None), (151, [0.0] * 6)]
    vecs = spark.createDataFrame(rows, "id long, v array<double>")
    whole = graphs.nearest(vecs, "id", "v", 4, 0.1, vecs).collect()
    blocks = graphs.nearest(vecs, "id", "v", 4, 0.1, vecs, block=20).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, blocks))
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    for i in (0, 77):
        want = sorted(((-round(cos(rows[i][1], v), 6), j) for j, v in rows[:150] if j != i and cos(rows[i][1], v) >= 0.1))[:4]
        assert [(-r["score"], r["b"]) for r in sorted(whole, key=lambda r: r["rank"]) if r["a"] == i] == want


def test_paths_and_recommendations(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5), (5, 4)], "from_id long, to_id long")
    got = {r["node"]: (r["hops"], r["before"]) for r in graphs.distances(edges, spark.createDataFrame([(1,)], "i long")).collect()}
    assert got == {1: (0, None), 2: (1, 1), 5: (1, 1), 3: (2, 2), 4: (2, 5)}
    nodes = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, "a", None), (5, "a", None)], "node_id long, type string, taxonomy_id string")
    rec = {(r["seed_id"], r["node_id"]) for r in graphs.recommend(nodes, nodes.filter("node_id IN (1, 4)"), 2).collect()}
    assert rec == {(1, 2), (1, 3), (4, 1), (4, 2)}


def test_facet_filter(spark):
    facets = "style string, layout string, industry_tags array<string>, modules array<string>, craft_tags array<string>, page_type string, typography string, color_mood string, above_fold_job string"
    rows = spark.createDataFrame([(1, ("dark", "grid", ["cars"], ["Hero"], ["Calm"], "home", "", "", "")), (2, None)], f"id int, f struct<{facets.replace(' string', ':string').replace(' array', ':array')}>")
    ids = lambda **q: [r["id"] for r in rows.filter(search.facets_match("f", **q)).orderBy("id").collect()]
    assert ids() == [1, 2] and ids(style="dark") == [1] and ids(style=" ") == [1, 2]
    assert ids(modules=["hero"], craft_tags=["CALM"]) == [1] and ids(modules=["hero", "nav"]) == [] and ids(text="HOME") == [1]
    assert search.vocabulary_value("x", ["y"]) is None


def test_scores(spark):
    result = ("r struct<stages_complete:int,stages_total:int,parsed:boolean,screen_patterns:array<string>,ui_elements:array<string>,recipes:array<string>,flow_labels:array<string>,style:array<string>>", (6, 6, True, ["Hero area"], ["button", "nav"], ["media>cta"], ["start"], ["dark look"]))
    golden = ("g struct<screen_patterns:array<string>,ui_elements:array<string>,recipes:array<string>,flow_labels:array<string>,style:array<string>>", (["hero", "faq"], ["Button", "nav", "x", "y"], ["Media>CTA"], ["start", "end"], ["dark"]))
    got = spark.createDataFrame([(result[1], golden[1])], f"{result[0]}, {golden[0]}").select(evaluation.text_score("r", "g").alias("s")).select("s.*").first()
    assert got.asDict() == {"stages": 15.0, "screen_patterns": 7.5, "ui_elements": 10.0, "recipes": 20.0, "flow_labels": 5.0, "style": 15.0, "json": 10.0, "total": 82.5, "percent": 82.5}
    vision = spark.createDataFrame([(("ok", "Big Sale", "Buy", ["hero", "nav"]), (["sale"], ["buy", "now"], ["hero", "grid"]))], "r struct<status:string,heading:string,cta:string,layout:array<string>>, g struct<heading:array<string>,cta:array<string>,layout:array<string>>")
    got = vision.select(evaluation.vision_score("r", "g").alias("s")).select("s.*").first()
    assert (got["heading"], got["cta"], got["layout"]) == (30.0, 15.0, 25.0)
