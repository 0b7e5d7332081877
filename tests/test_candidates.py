"""Flow candidates by a plain walk, and evidence of any depth."""

from pyspark.sql import functions as F

from lumenfold.functions import keys
from lumenfold.operators import flows, nodes

BOX = "struct<x:double,y:double,width:double,height:double>"


def test_candidates_by_hand(spark):
    rows, up = [(0, None, "body", {}, "", None)], {}
    # navigations 1 to 12 levels above a link: up to seven count
    at = 1
    for levels in range(1, 13):
        rows.append((at, 0, "nav", {}, "", None))
        for k in range(levels - 1):
            rows.append((at + 1 + k, at + k, "div", {}, "", None))
        rows.append((at + levels, at + levels - 1, "a", {"href": f"/p{levels}"}, f"Go {levels}", None))
        up[at + levels] = levels
        at += levels + 1
    more = [
        ("a", {"href": "mailto:x@y"}, "Mail"), ("a", {"href": "/logout"}, "Bye"), ("a", {"href": "/x", "aria-label": "Pay now"}, "X"), ("a", {"href": "/ok", "role": "tab"}, "T"), ("a", {}, "no address"), ("button", {"type": "submit"}, ""), ("input", {"type": "image"}, ""), ("input", {"type": "text", "role": "button"}, ""), ("div", {"role": "menuitem"}, "M"), ("button", {"title": " Cookie \n settings "}, "z"),
    ]
    start = at
    rows += [(start + i, 0, tag, attrs, text, (0.0, 2000.0, 100.0, 50.0) if i == 0 else None) for i, (tag, attrs, text) in enumerate(more)]
    df = spark.createDataFrame([(7, *r) for r in rows], f"capture long, node_id long, parent_id long, tag string, attributes map<string,string>, text string, box {BOX}").withColumn("rendered", F.lit(True))
    pages = spark.createDataFrame([(7, "https://a.example/home")], "capture long, url string")
    found = flows.flow_candidates(df, nodes.ancestors(df), pages)
    got = {r["node_id"]: r for r in found.collect()}
    for node, levels in up.items():
        assert (got[node]["control_kind"], got[node]["score"]) == (("nav_item", 0.87) if levels <= 7 else ("link", 0.81)), levels
    kinds = {i - start: (r["control_kind"], r["destination_class"], r["unsafe_reason"], r["safety"]) for i, r in got.items() if i >= start}
    assert kinds == {
        0: ("link", "action_unsafe", "scheme", "forbid"), 1: ("link", "action_unsafe", "path", "forbid"), 2: ("link", "action_unsafe", "label", "forbid"), 3: ("tab", "internal_path", None, "allow_activate"), 5: ("submit", "unknown", None, "href_join_only"), 6: ("button", "unknown", None, "href_join_only"), 9: ("button", "unknown", None, "href_join_only"),
    }
    assert got[start + 9]["name"] == "Cookie settings" and got[start + 9]["score"] == round(0.35 - 0.05 + 0.05 - 0.25 + 0.06 + 0.04, 4)
    assert got[start]["score"] == round(0.05 + 0.08 + 0.06 + 0.04 + 0.08 + 0.03, 4)  # 2000 is within 1.1 of the page's 2050
    few = flows.flow_candidates(df, nodes.ancestors(df), pages, most=5).orderBy("rank").collect()
    assert [r["rank"] for r in few] == [1, 2, 3, 4, 5] and few[0]["score"] == max(r["score"] for r in got.values())


def test_evidence_of_any_depth(spark):
    url, safe = "https://a.example/p?token=1", "https://a.example/p?token=%5Bredacted%5D"
    schema = "a struct<href:string,n:int,b:array<struct<src:string,m:map<string,struct<url:string,x:string>>>>>, s array<string>, m map<string,string>, e struct<name:string,value:struct<value:string,k:int>>, srcset string, css_text string"
    rows = spark.createDataFrame([((url, 1, [(url, {"k": (url, url)})]), [url], {"current_src": url, "srcset": f"{url} 1x", "value": f"url('{url}')", "other": url}, ("url", (url, 3)), f"{url} 2x", "no address"), (None,) * 6], schema)
    base = F.lit("https://a.example/")
    got = rows.select(*[keys.redact_evidence(F.col(f.name), f.dataType, base, f.name).alias(f.name) for f in rows.schema.fields]).collect()
    r = got[0]
    assert r["a"]["href"] == safe and r["a"]["n"] == 1 and r["a"]["b"][0]["src"] == safe and r["a"]["b"][0]["m"]["k"]["url"] == safe and r["a"]["b"][0]["m"]["k"]["x"] == url
    assert r["s"] == [url] and r["m"] == {"current_src": safe, "srcset": f"{safe} 1x", "value": f"url('{safe}')", "other": url}
    assert r["e"]["value"] == (safe, 3) and r["srcset"] == f"{safe} 2x" and r["css_text"] == "no address"
    assert all(v is None for v in got[1])
    other = rows.select(F.struct(F.lit("href").alias("name"), F.struct(F.lit(url).alias("value")).alias("value")).alias("e"))
    assert other.select(keys.redact_evidence(F.col("e"), other.schema["e"].dataType, base)).first()[0]["value"]["value"] == url
