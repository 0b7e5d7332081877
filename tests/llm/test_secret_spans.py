"""Spans of many secrets in one text."""

import re
import time

from pyspark.sql import functions as F

from lumenfold.llm import secret_scan


def test_a_text_of_100_000_spans(spark):
    text = "".join(f"é{i} token={'k' * (8 + i % 9)}{i} " if i % 3 else f"deadbeef{i:08x}zz" for i in range(100_100))
    docs = spark.createDataFrame([(1, text), (2, "none"), (3, None), (4, "token=abcdefghijkl")], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["findings"] or []] for r in secret_scan.scan_secrets(docs)[0].collect()}
    assert time.time() - began < 120
    want = []
    for rule in secret_scan.RULES:
        want += [(m.start(), m.end(), rule.kind) for m in re.finditer(rule.pattern, text) if len(m[rule.group]) >= rule.least]
    order = [r.kind for r in secret_scan.RULES]
    assert got[1] == sorted(want, key=lambda s: (s[0], order.index(s[2]))) and len(want) >= 100_000
    assert got[2] == got[3] == [] and got[4] == [(0, 18, "assign")]


def test_blocks_of_spans(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "BLOCK", 3)
    rule = secret_scan.Rule("x", 1, "a+(b*)", 1, 0)
    texts = ["", "a", "aab" * 3, "ab" * 10, "c" + "ab c" * 7, "zzz", "ab" * 3]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: [tuple(s) for s in r["s"]] for r in df.select("i", secret_scan.spans_of(F.col("t"), rule).alias("s")).collect()}
    assert got == {i: [(m.start(), m.end()) for m in re.finditer("a+(b*)", t)] for i, t in enumerate(texts)}
