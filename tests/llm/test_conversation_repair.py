"""Conversation repair, against a plain search over edit sequences and against SQL."""

import functools
import hashlib
import random
import zlib

import pytest
from oracle import rows, views

from lumenfold.llm import conversation_repair as cr
from lumenfold.llm import queries

SPACE = " \t\n\v\f\r"
STATE = {"": "su", "s": "u", "u": "a", "a": "u"}


def damage(data):
    """(conv_id, turn, role, text) after damage; the conversations that there were."""
    out = []
    for conv, turn, role, text in data:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d == 1:
            text = ""
        if d == 2:
            text = "".join(c for c in text if c not in ".!?")
        if d == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(d, 1)
    return out, {d[0] for d in data}


def by_search(data, convs):
    out = {}
    for conv in convs:
        mine = sorted((r for r in data if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, marked = set(), []
        for _, _, role, text in mine:
            words = text.strip(SPACE)
            fault = "b" if not words else "d" if (role, text) in seen else "t" if words[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))

        @functools.cache
        def best(i, state, inserts, marked=tuple(marked)):
            ways = []
            if i == len(marked) and state in ("", "a"):
                ways.append((0, "", ()))
            if inserts < 3:
                for name in ("user", "assistant"):
                    if name[0] in STATE[state]:
                        c, a, t = best(i, name[0], inserts + 1)
                        ways.append((c + 3, "I" + a, (f"{name}:", *t)))
            if i < len(marked):
                role, text, fault = marked[i]
                c, a, t = best(i + 1, state, 0)
                ways.append((c + 4, "D" + a, t))
                if fault not in ("b", "d"):
                    for letter, cost, name in (("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant")):
                        if name[:1] and name[:1] in STATE[state]:
                            c, a, t = best(i + 1, name[:1], 0)
                            ways.append((c + cost + 3 * (fault == "t"), letter + a, (f"{name}:{text}", *t)))
            return min(ways, default=(10**6, "", ()))

        cost, audit, lines = best(0, "", 0)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        count = lambda f: sum(m[2] == f for m in marked)  # noqa: E731, B023
        out[conv] = (gaps, count("b"), count("d"), count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(n, seed):
    rng, out = random.Random(seed), []
    for conv in [*range(n), None]:
        for turn in range(rng.randint(1, 14)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "s"])
            text = rng.choice(["Yes.", "No", "Why?", "", None, " \n", "Ça va\n.", "ok!\t", "a:b\nuser:c."])
            out.append((conv, rng.choice([turn, turn, turn, turn + 5, None]), role, text))
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def result(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in found}) == len(found)
    return {r[0]: r[1:] for r in found}


@pytest.mark.parametrize("chunk", [1024, 3, 1])
def test_repairs_by_search(spark, chunk):
    data = conversations(120, 7)
    want = by_search(*damage(data))
    df = cr.damaged(spark.createDataFrame(data, SCHEMA).repartition(3))
    assert result(cr.digests(cr.repair(df, present=cr.F.col("present"), chunk=chunk))) == want
    assert any("I" in v[-2] and "D" in v[-2] for v in want.values()) and any("R" in v[-2] for v in want.values())


def test_ways_through_chunks_are_those_through_the_whole():
    rng = random.Random(3)
    for _ in range(200):
        rows_ = [cr.Row(None, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", ""]), rng.random() < 0.1) for _ in range(rng.randint(1, 12))]
        cuts = sorted({0, len(rows_), *[rng.randint(0, len(rows_)) for _ in range(3)]})
        parts = [rows_[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        cost, audit, each = cr.combine([cr.summarise(p) for p in parts])
        assert (cost, audit) == cr.plan(rows_) and "".join(a for _, a in each) == audit
        assert [x for (s, a), p in zip(each, parts, strict=True) for x in cr.apply(a, p, s)] == cr.apply(audit, rows_)


def test_weights_of_long_audits():
    w = cr.Weights(3000)
    audit = "".join(random.Random(1).choices("DIKR", k=2500))
    assert w.read(w.joined(77, audit, 0)) == (77, audit)
    assert w.joined(1, "K", 0) < w.joined(1, "KD", 0) < w.joined(1, "R", 0) < w.joined(2, "", 0)


def test_a_long_conversation(spark):
    """One conversation with most rows, a part of them equal, beside short ones."""
    data = [(7, i // 2, ("user", "assistant")[i % 2], "same." if i % 3 else f"text {i}.") for i in range(5000)] + [(i, 0, "user", "Hi.") for i in range(20)]
    df = spark.createDataFrame(data, SCHEMA)
    whole, cut = (result(cr.digests(cr.repair(df, chunk=n))) for n in (10_000, 256))
    assert whole == cut and len(cut[7][-2]) >= 5000


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, lines string, piece int, present string, _row int"
    assert cr.repair(spark.createDataFrame([], schema)).plans.collect() == []
    data = [(1, 0, "user", "x" * 100_000 + ".", "", 1, "", 1)] * 2 + [(1, 1, "assistant", "word " * 20_000, "", 1, "", 1), (None, None, None, None, None, None, None, None), (2, 5, "user", ".", "", 1, "n", 2)]
    want = by_search([d[:4] if d[2] else (None, None, " ", " ") for d in data], {1, None, 2})
    assert result(cr.digests(cr.repair(spark.createDataFrame(data, schema)))) == want
    gone = cr.digests(cr.repair(spark.createDataFrame(data, schema), present=cr.F.lit(False)))
    assert result(gone) == {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in (1, 2, None)}


def test_whole_table_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op13_conversation_repair"](spark, sf).toPandas()
    assert rows(got) == rows(views(sf).execute(queries.ORACLES["op13_conversation_repair"]).df())
    assert (got["cost"] > 0).sum() > 20
