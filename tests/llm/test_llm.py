import hashlib
import random
import zlib

import numpy as np
import pytest
from oracle import rows, views

from lumenfold.llm import bpe, exact_dedup, fingerprint, jaccard_join, license_scan, mixing, quality, queries, secret_scan, sharding, substring_dedup

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, _text string"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = views(SF).execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


OPERATORS = {
    "mix": lambda s, d: mixing.mix_sources(d),
    "mixed": lambda s, d: mixing.mixed_documents(d),
    "secrets": lambda s, d: secret_scan.scan_secrets(d)[0],
    "bpe": lambda s, d: bpe.encode_and_decode(d, bpe.Vocabulary(bpe.vocabulary_path())),
    "fingerprints": lambda s, d: fingerprint.compare_neighbours(d),
    "shards": lambda s, d: sharding.shard_documents(d),
    "quality": lambda s, d: quality.keep_good(d, s.createDataFrame([], "doc_id long, grade int")),
    "exact": lambda s, d: exact_dedup.exact_groups(d),
    "licences": lambda s, d: license_scan.scan_licenses(d, license_scan.known_digests(s)),
    "repeats": lambda s, d: substring_dedup.remove_repeats(d),
    "near": lambda s, d: jaccard_join.near_groups(d),
}
ODD = [(1, "", "en", None, 0, 7, "x"), (1, "", "en", None, 0, 7, "x"), (2, None, None, "a", None, None, None), (None, "some words here", "en", "a", 3, 1, ""), (3, "word " * 30_000, "en", "b", 1, 1, ""), (4, "x" * 100_000, "en", "b", 1, 1, "")]


@pytest.mark.parametrize("name", sorted(OPERATORS))
@pytest.mark.parametrize("data", [[], ODD], ids=["empty", "odd"])
def test_odd_rows(spark, name, data):
    out = OPERATORS[name](spark, spark.createDataFrame(data, SCHEMA)).collect()
    if not data:
        assert out == []
    elif name not in ("licences", "mixed"):
        assert len(out) == len(data)


def test_chunk_names_that_clash_are_told_apart(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    weak = exact_dedup.exact_groups(docs, name_of=lambda c: exact_dedup.F.length(c).cast("long")).toPandas()
    assert rows(weak) == rows(exact_dedup.exact_groups(docs).toPandas())


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    random.seed(5)
    pool = [chr(i) for i in [*range(0x250), *range(0x300, 0x330), *range(0x2000, 0x2070), *range(0x3000, 0x3020), *range(0x1F600, 0x1F620), 0x85, 0x1680, 0x180E]]
    texts = ["".join(random.choices(pool, k=random.randint(0, 50))) for _ in range(3000)] + ["a<|endoftext|> b", "x" * 3000, " " * 300, "é" * 500, "two  spaces and\n\nlines "]
    own, lib = bpe.Coder(bpe.Vocabulary(bpe.vocabulary_path())), Tokenizer.from_file(bpe.vocabulary_path())
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ids
        assert own.decode(own.encode(t)) == lib.decode(ids, skip_special_tokens=False)


def test_winnowing_by_brute_force():
    random.seed(2)
    text = "".join(random.choices("ab ", k=700))
    k, w = 5, 7
    grams = fingerprint.kgram_hashes(np.frombuffer(text.encode("utf-32-le"), np.uint32), k)
    top = [int(g) >> (64 - fingerprint.HASH_BITS) for g in grams]
    want = {max(i for i in range(s, s + w) if top[i] == min(top[s : s + w])) for s in range(len(top) - w + 1)}
    positions, values = fingerprint.winnow(text, k, w)
    assert positions.tolist() == sorted(want)
    assert values.tolist() == [top[i] for i in sorted(want)]


def test_edited_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy(fingerprint.F.desc("doc_id")).collect()
    got = {r["doc_id"]: r for r in queries.QUERIES["op4_fingerprints"](spark, SF).collect()}
    assert len(got) == len(docs)
    for i, d in enumerate(docs):
        nxt, part = docs[(i + 1) % len(docs)], len(d["text"]) // 3
        edited = d["text"][: len(d["text"]) - part] + nxt["text"][:part]
        assert got[d["doc_id"]]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[d["doc_id"]]["near_next"] <= 1


def test_shards(spark):
    out = queries.QUERIES["op5_sharding"](spark, "/root/testdata/sf0.01").toPandas()
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").toPandas().set_index("doc_id")["text"]
    assert all(zlib.crc32(texts[i].encode()) == c and len(texts[i].encode()) + 16 == n for i, c, n in zip(out["doc_id"], out["text_crc32"], out["size"], strict=True))
    for _, s in out.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    loads = out.groupby("shard")["size"].sum()
    assert len(loads) == 40 and loads.max() < 1.05 * loads.mean()


def test_near_groups_of_many_edits(spark):
    """A large group of near copies of varied distance, chains and a shared passage, against all pairs."""
    random.seed(4)
    words = [f"w{i}" for i in range(4000)]
    base, passage = random.choices(words, k=120), random.choices(words, k=60)
    texts = []
    for i in range(220):
        t = list(base)
        for _ in range(i % 9):
            t[random.randrange(len(t))] = random.choice(words)
        texts.append(t)
    texts += [random.choices(words, k=random.randint(10, 120)) + passage for _ in range(80)]
    t = random.choices(words, k=100)
    for _ in range(25):
        t = list(t)
        t[random.randrange(len(t))] = random.choice(words)
        texts.append(t)
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(len(docs))}


def test_ledger_scans_only_what_is_new(spark):
    docs = spark.createDataFrame([(1, "token = abcdefghijkl"), (2, "AKIA" + "A" * 20)], "doc_id long, text string")
    first, news = secret_scan.scan_secrets(docs.limit(1))
    again, more = secret_scan.scan_secrets(docs, news)
    assert more.select("blob_sha").distinct().count() == 1
    assert rows(again.toPandas()) == rows(secret_scan.scan_secrets(docs)[0].toPandas())


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, grades = spark.read.parquet(f"{sf}/documents.parquet"), quality.label_grades(spark, sf)
    even, odd = grades.filter("doc_id % 2 = 0"), grades.filter("doc_id % 2 = 1")
    model = quality.train(docs, even)
    got = docs.join(odd, "doc_id").select("grade", (quality.rate(quality.F.col("text"), model)["tail"] >= quality.TAIL).alias("kept")).toPandas()
    share = got.groupby("grade")["kept"].mean()
    assert share[0] < 0.02 and share[1] < 0.3 and share[2] > 0.95


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    texts = {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in before.collect()}
    assert all(texts[r["doc_id"]] == r["decoded_sha256"] for r in docs.collect())


_A, _B, _C = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")


@pytest.mark.parametrize(
    ("data", "groups", "kept"),
    [
        # copies of 3 and 9 without an id don't join 3 and 9
        ([(3, _A), (9, _B), (None, _A), (None, _B)], [(3, 3), (9, 9), (None, 3), (None, 9)], [(3, _A), (9, _B)]),
        ([(3, _A), (None, _A), (None, _B)], [(3, 3), (None, 3), (None, None)], [(3, _A), (None, _B)]),
        ([(None, _A), (None, _A + " z"), (None, _B)], [(None, None)] * 3, None),
        ([(0, _B), (1, _A), (1, _B)], [(0, 0), (1, 0), (1, 1)], [(0, _B), (1, _A)]),
        ([(1, _A), (1, _A), (2, _C)], [(1, 1), (1, 1), (2, 2)], [(1, _A), (2, _C)]),
        ([(5, _A), (None, _A)], [(5, 5), (None, 5)], [(5, _A)]),
        ([(1, ""), (1, ""), (None, None)], [(1, 1), (1, 1), (None, None)], [(1, ""), (1, ""), (None, None)]),
    ],
)
def test_near_groups_of_shared_and_null_ids(spark, data, groups, kept):
    docs = spark.createDataFrame(data, "doc_id long, text string")
    order = lambda rows: sorted(rows, key=str)
    got = jaccard_join.near_groups(docs).select("doc_id", "component_id").collect()
    assert order(map(tuple, got)) == order(groups)
    left = order(map(tuple, jaccard_join.one_of_each(docs).collect()))
    assert left == order(kept) if kept is not None else len(left) == 2


@pytest.mark.parametrize(
    ("data", "kept"),
    [
        ([(0, _B), (1, _A), (1, _B)], [(0, _B), (1, _A)]),
        ([(1, _A), (1, _A)], [(1, _A)]),
        ([(5, _A), (None, _A), (None, _B)], [(5, _A), (None, _B)]),
        ([(None, _A), (None, _A), (1, "x y"), (1, "xy")], [(None, _A), (1, "x y")]),
        ([(1, None), (1, ""), (2, None)], None),
    ],
)
def test_drop_copies_of_shared_and_null_ids(spark, data, kept):
    docs = spark.createDataFrame(data, "doc_id long, text string")
    left = sorted(map(tuple, exact_dedup.drop_copies(docs).collect()), key=str)
    assert left == sorted(kept, key=str) if kept is not None else [r[0] for r in left] == [1]


def _licences(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = license_scan.scan_licenses(docs, license_scan.known_digests(spark)).select("doc_id", "license_id").distinct().collect()
    return [sorted(r["license_id"] for r in found if r["doc_id"] == i) for i in range(len(texts))]


def test_licences_under_any_wrap(spark):
    import textwrap

    wrap = lambda text, width: "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))
    cases = [(i, "Copyright (c) 2020 A B\n\n" + wrap(t, w)) for i, t in (("MIT", license_scan._MIT), ("ISC", license_scan._ISC), ("BSD-3-Clause", license_scan._BSD)) for w in range(40, 81, 2)]
    assert _licences(spark, [t for _, t in cases]) == [[i] for i, _ in cases]


def test_licences_in_longer_texts(spark):
    head, tail = "A readme of a tool.\n\nThe MIT License (MIT)\n\nCopyright 2020 A B\n\n", "\n\nAnd more.\n\nSo much."
    assert _licences(spark, [head + license_scan._MIT + tail, head + license_scan._ISC, license_scan._APACHE + tail, head + tail]) == [["MIT"], ["ISC"], ["Apache-2.0"], []]


CLASH = "doc_id long, text string, lang string, source string, n_chars long, row string, _id string, _name string, _key string, _copies int, _copy int, _gone string, _rated string, _row_name string, _n int, component string"


def _clashing(spark, data):
    return spark.createDataFrame([(i, t, "en", s, 0, "r", "i", "n", "k", 7, 8, "g", "q", "w", 9, "c") for i, t, s in data], CLASH)


@pytest.mark.parametrize("name", ["quality", "exact", "near", "mix"])
@pytest.mark.parametrize("empty", [True, False])
def test_filters_keep_columns_of_any_name(spark, name, empty):
    docs = _clashing(spark, [] if empty else [(1, _A, "a"), (2, _B, None), (None, None, "b"), (3, "word " * 20_000, "b")])
    forms = {"quality": lambda d: quality.keep_good(d, spark.createDataFrame([], "doc_id long, grade int")), "exact": exact_dedup.drop_copies, "near": jaccard_join.one_of_each, "mix": mixing.mixed_documents}
    out = forms[name](docs)
    assert out.columns == docs.columns
    got = {tuple(r) for r in out.collect()}
    assert got == {tuple(r) for r in docs.collect()}


def test_mixed_documents_by_brute_force(spark):
    data = [(i, " ".join(["w"] * (i % 7)), "abc"[i % 3] if i % 5 else None) for i in range(60)] + [(7, "other text", "a"), (None, "x y", "a"), (None, "z", "b"), (4, "w w w w", "b"), (4, "w w w w", "b")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    mixed = mixing.mix_sources(docs).collect()
    want: dict = {}
    for r in mixed:
        whole = int(r["target"] // r["source_size"]) if r["source_size"] else 0
        n = -(-r["taken"] // r["size"]) if r["size"] else max(1, whole)
        want[r["doc_id"], r["source"], r["size"]] = want.get((r["doc_id"], r["source"], r["size"]), 0) + n
    got: dict = {}
    for r in mixing.mixed_documents(docs).collect():
        key = (r["doc_id"], r["source"], len((r["text"] or "").split()))
        got[key] = got.get(key, 0) + 1
    assert got == {k: n for k, n in want.items() if n}


def test_shards_keep_groups_whole(spark):
    out = queries.QUERIES["op5_sharding"](spark, "/root/testdata/sf0.01").select("doc_id", "shard", "size").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").toPandas()
    both = out.merge(docs, on="doc_id")
    loads = both.groupby("shard")["size"].sum()
    groups = both.groupby("text").agg(shards=("shard", "nunique"), size=("size", "sum"))
    assert (groups["shards"][groups["size"] <= loads.mean()] == 1).all()
    # a plain packing of the same groups, one lane: the same shard for each
    vectors = both.assign(words=[len([w for w in t.encode().split()]) for t in both["text"]], rows=1).groupby("text").agg(size=("size", "sum"), words=("words", "sum"), rows=("rows", "sum")).reset_index()
    vectors["name"] = [hashlib.sha256(t.encode()).hexdigest() + ":0" for t in vectors["text"]]
    if (groups["shards"] > 1).any():
        return
    vectors = vectors.sort_values(["size", "words", "rows", "name"], ascending=[False, False, False, True])
    totals = vectors[["size", "words", "rows"]].sum() / 40
    residual, want = [[1.0, 1.0, 1.0] for _ in range(40)], {}
    for t, *v in vectors[["text", "size", "words", "rows"]].itertuples(index=False):
        v = [x / n for x, n in zip(v, totals, strict=True)]
        best = max(range(40), key=lambda s: (round(sum(a * b for a, b in zip(residual[s], v, strict=True)), 12), -s))
        residual[best] = [a - b for a, b in zip(residual[best], v, strict=True)]
        want[t] = best
    same = sum(want[t] == s for t, s in zip(both["text"], both["shard"], strict=True))
    assert same >= 0.9 * len(both)


def test_likeness_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter("length(text) < 3000").orderBy(fingerprint.F.desc("doc_id")).limit(40)
    rows_ = docs.collect()
    got = {r["doc_id"]: r for r in fingerprint.compare_neighbours(docs).collect()}

    def chosen(text, k=fingerprint.K, w=fingerprint.WINDOW):
        k = min(k, len(text))
        grams = fingerprint.kgram_hashes(np.frombuffer(text.encode("utf-32-le"), np.uint32), k) if text else []
        top = [int(g) >> (64 - fingerprint.HASH_BITS) for g in grams]
        w = min(w, len(top))
        return {top[max(i for i in range(s, s + w) if top[i] == min(top[s : s + w]))] for s in range(len(top) - w + 1)} if top else set()

    for i, d in enumerate(rows_):
        nxt, part = rows_[(i + 1) % len(rows_)]["text"], len(d["text"]) // 3
        a, b, e = chosen(d["text"]), chosen(nxt), chosen(d["text"][: len(d["text"]) - part] + nxt[:part])
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert abs(got[d["doc_id"]]["near_edited"] - like(a, e)) < 1e-9
        assert abs(got[d["doc_id"]]["near_next"] - like(a, b)) < 1e-9


def test_one_outlying_id_leaves_the_ranges_even(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(1000)] + [(10**15, "far")], "doc_id long, text string")
    ranges = fingerprint.in_ranges(docs, "doc_id", "text", 16).filter("_ghost = 0").groupBy("_range").count().collect()
    assert len(ranges) == 16 and max(r["count"] for r in ranges) < 200


def test_fit_against_a_grid(spark):
    """One feature and two thresholds: the likelihood of the fit is that of the best of a fine grid."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, 400)
    u = rng.logistic(size=400) + 2.5 * x
    grades = (u > 0.5).astype(int) + (u > 2.0).astype(int)
    rows_ = [(np.array([5] if v else [], dtype=np.int64), np.array([1.0] if v else [])) for v in x]
    model = quality.fit(rows_, grades)

    def loss(weight, cuts):
        sig = lambda z: 1 / (1 + np.exp(-z))
        upper, lower = np.r_[cuts, np.inf][grades] - weight * x, np.r_[-np.inf, cuts][grades] - weight * x
        return -np.mean(np.log(np.maximum(sig(upper) - sig(lower), 1e-12)))

    grid = min(loss(w, np.array([a, a + g])) for w in np.arange(1, 4, 0.1) for a in np.arange(-0.5, 1.5, 0.1) for g in np.arange(0.5, 3, 0.1))
    assert loss(float(model.weights[5]), model.thresholds) < grid + 0.005
    assert model.thresholds[0] < model.thresholds[1]


def test_stages_by_brute_force(spark, tmp_path):
    """What each stage of the pipeline keeps, from what the one before it kept."""
    import corpus_pipeline

    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    after = [*kept[1:], {r["doc_id"]: r["text"] for r in docs.collect()}]
    model, features = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), quality.label_grades(spark, SF)), quality.Features()
    assert set(after[0]) == {i for i, t in kept[0].items() if model.tails(t, features)[-1] >= quality.TAIL}
    groups: dict = {}
    for i, t in kept[1].items():
        groups.setdefault("".join((t or "").translate({c: None for c in (32, *range(9, 14))})), []).append((-len(t or ""), i))
    assert set(after[1]) == {min(g)[1] for g in groups.values()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := (t or "").encode().lower().split()) else set() for i, t in kept[2].items()}
    links = {(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    least = {i: i for i in sets}
    while any(least[a] != least[b] for a, b in links):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert set(after[2]) == {i for i in sets if least[i] == i}
    assert set(after[3]) <= set(kept[3])


def test_repeats_of_shared_and_null_ids(spark):
    """Documents of one id, or without one, are told apart; equal rows are decided alike."""
    a, b = " ".join(f"p{i}" for i in range(40)), " ".join(f"q{i}" for i in range(40))
    docs = spark.createDataFrame([(1, a), (1, b), (1, b), (2, a + " " + b), (None, b), (None, "x y")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs).collect()), key=str)
    assert got == [(1, 40, 0), (1, 40, 0), (1, 40, 0), (2, 80, 80), (None, 2, 0), (None, 40, 40)]
    spans = substring_dedup.remove_repeats(docs).filter("doc_id = 2").first()["repeats"]
    assert [tuple(s) for s in spans] == [(0, 80)]


def test_repeats_by_brute_force(spark):
    random.seed(11)
    words = [f"w{i}" for i in range(30)]
    passages = [random.choices(words, k=random.randint(20, 60)) for _ in range(6)]
    texts = []
    for i in range(60):
        t = random.choices(words, k=random.randint(0, 60))
        for _ in range(random.randint(0, 3)):
            p = random.choice(passages)
            start = random.randint(0, len(p) // 2)
            t[random.randint(0, len(t)) : 0] = p[start : start + random.randint(15, 60)]
        texts.append(t)
    seen, want = set(), {}
    for i, t in enumerate(texts):
        gone = [False] * len(t)
        for s in range(len(t) - 19):
            win = tuple(t[s : s + 20])
            if win in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(win)
        want[i] = (sum(gone), " ".join(w for w, g in zip(t, gone, strict=True) if not g))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == want and sum(n for n, _ in want.values()) > 500
