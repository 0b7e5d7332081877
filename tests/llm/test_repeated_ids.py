"""Copies that share an id, or have none."""

import pytest

from lumenfold.llm import exact_dedup, sharding

_A, _B = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")


@pytest.mark.parametrize(
    ("data", "kept"),
    [
        ([(None, _A), (None, _A)], [(None, None, 2, True)]),
        ([(1, _A), (1, _A)], [(1, 1, 2, True)]),
        ([(1, "a b"), (1, "a\tb"), (1, "ab")], [(1, 1, 3, True)]),
        ([(2, "a  b"), (1, "ab"), (2, "ab")], [(2, 2, 3, True)]),
        ([(None, _A), (3, _A), (3, _B), (None, None), (4, "")], [(3, 3, 2, True), (3, 3, 1, True), (4, 4, 2, True)]),
        ([(None, _A)] * 400 + [(7, _A)] * 300, [(7, 7, 700, True)]),
    ],
)
def test_one_row_of_a_group_is_kept(spark, data, kept, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BLOCK", 64)
    out = exact_dedup.exact_groups(spark.createDataFrame(data, "doc_id long, text string"))
    rows = [tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept")) for r in out.collect()]
    assert sorted((r for r in rows if r[-1]), key=str) == sorted(kept, key=str) and len(rows) == len(data)
    assert sorted((r[0] for r in rows), key=str) == sorted((d[0] for d in data), key=str)


@pytest.mark.parametrize("key", [None, 1])
def test_copies_of_one_id_are_spread(spark, key):
    data = [(key, _A)] * 400 + [(i, f"text {i} " * 12) for i in range(2, 402)]
    out = sharding.shard_documents(spark.createDataFrame(data, "doc_id long, text string"), shards=10).toPandas()
    loads = out.groupby("shard")["size"].sum()
    assert len(out) == 800 and len(loads) == 10 and loads.max() < 1.25 * loads.mean()
    for _, s in out.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
