"""Spelling variants, against every pair of words."""

import random
import zlib

import pytest
from oracle import rows, views

from lumenfold.llm import queries, spelling


def is_near(a, b):
    """Whether one inserted, deleted or replaced code point turns a into b."""
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_brute_force(counts, ratio=10):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if is_near(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[w] = [form, None, n, len(near), counts[form] if form is not None else None]
    for w in out:
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        out[w][1] = root
    return out


def result(df):
    return {r["word"]: [r["form"], r["root"], r["n"], r["n_near"], r["form_n"]] for r in df.collect()}


@pytest.mark.parametrize("most", [2, 5, 2048])
def test_variants_by_brute_force(spark, most):
    random.seed(most)
    words = {"".join(random.choices("abé", k=random.randint(1, 9))) for _ in range(500)} | {"x" * n for n in range(1, 60)} | {"y" * 30 + c + "z" * 30 for c in "abcdefgh"} | {"y" * 30 + "z" * 30}
    words |= {"\U0001f600" + w for w in ("ab", "abc", "bc")}
    counts = {w: random.choice([1, 2, 15, 150, 2000, 30_000]) for w in sorted(words)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    assert result(spelling.spelling_variants(df, most=most)) == by_brute_force(counts)


def test_a_key_of_many_words_is_halved(spark):
    """Words that share their first half have the same key at first; no key has more than `most` in the end, but for one place."""
    random.seed(1)
    words = {"samefirsthalf" + "".join(random.choices("abcd", k=8)) for _ in range(3000)}
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long").checkpoint() if spark.sparkContext.getCheckpointDir() else spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    sizes = spelling.in_ranges(df, most=100).groupBy("_key", (spelling.F.col("hi") - spelling.F.col("lo")).alias("w")).count().collect()
    assert max(r["count"] for r in sizes if r["w"] > 1) <= 100 and max(r["count"] for r in sizes) <= 100


def test_tiles_of_blocks_and_batches(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SIDE", 4)
    import pyarrow as pa

    words = sorted({"".join(random.Random(i).choices("abc", k=6)) for i in range(300)})
    table = pa.table({"_key": ["k"] * len(words), "m": pa.array([6] * len(words), pa.int32()), "lo": pa.array([0] * len(words), pa.int32()), "hi": pa.array([6] * len(words), pa.int32()), "word": words, "n": list(range(len(words)))})
    got = {(a, b) for a, b in zip(*[x.tolist() for x in spelling._Rows(table).pairs()], strict=True)}
    assert got == {(a, b) for b in range(len(words)) for a in range(b) if is_near(words[a], words[b])}
    monkeypatch.setattr(spelling, "ROWS", 10)
    keyed = table.set_column(0, "_key", pa.array([w[:2] for w in words]))
    parts = [pa.Table.from_batches([b]) for b in spelling._tiled(iter(keyed.to_batches(max_chunksize=7)))]
    found = {r["word"]: r["n_near"] for t in parts for r in t.to_pylist()}
    assert found == {w: n for w in words if (n := sum(is_near(w, v) and w[:2] == v[:2] for v in words))}


def test_noisy_words_by_brute_force(spark):
    text = "Naïveté überGroß × couleurs÷ ABCDEFGH short Abcdefgh " * 40 + "x" * 50_000 + " ÀÉÎÕÜÝÞ"
    docs = [(i, text) for i in range(30)] + [(None, text), (None, text), (3, None), (4, ""), (5, "no")]
    counts: dict = {}
    import re

    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] = counts.get(run, 0) + 1
    want = {w: n for w, n in counts.items() if n >= 2}
    got = spelling.noisy_words(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["word"]: r["n"] for r in got.collect()} == want and len(want) >= 9
    assert result(spelling.spelling_variants(got)) == by_brute_force(want)


def test_odd_rows(spark):
    schema = "word string, n long, form string, root int, _key string, m int"
    assert spelling.spelling_variants(spark.createDataFrame([], schema)).collect() == []
    data = [("abcdefg", 5, "x", 1, "k", 2), ("abcdefg", 5, "x", 1, "k", 2), (None, 4, "x", 1, "k", 2), ("abcdefgh", 1, None, None, None, None), ("", 3, "", 0, "", 0), ("a", 40, "", 0, "", 0)]
    out = spelling.spelling_variants(spark.createDataFrame(data, schema))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert result(out) == by_brute_force({"abcdefg": 10, "abcdefgh": 1, "": 3, "a": 40})
    docs = spark.createDataFrame([], "doc_id long, text string, word string, n int")
    assert spelling.noisy_words(docs).collect() == []


def test_whole_table_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op12_spelling"](spark, sf).toPandas()
    want = views(sf).execute(queries.ORACLES["op12_spelling"]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert got["form"].notna().sum() > 10
