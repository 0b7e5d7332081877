"""Repair of conversation structure: the cheapest edits after which roles alternate, by shortest paths with integer weights.

A conversation's rows are read from the last to the first. For each of four states (nothing yet, after a system row, after
a user row, after an assistant row) a Python integer holds the best way to the end: its high digits are the cost, its
low digits, of fixed width, the letters of the edits from the front on, with zeros behind the last one. The least
integer is then the least cost, and of equal ones the least audit string, as an end is less than any letter.

A conversation of more than CHUNK rows is cut: each chunk gives the best way from every state to every state, chunks
are put together by the same minimum, and the text is repaired chunk by chunk. Within a chunk, two ways of equal cost
between the same states are never the beginning one of the other, since they have as many rows, so the best of the parts is the
best of the whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import cut_lineage, running_start
from lumenfold.llm.sql import CRC_TABLE, crc32
from lumenfold.llm.words import join_side

#: Rows of a conversation that are repaired at once.
CHUNK = 1024
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Edits by the order of their initials; 0 is the end.
LETTERS, BITS = "\0DIKR", 3
_D, _I, _K, _R = range(1, 5)
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a row of an initial, and before which states it may stand; the role that may follow a state.
AFTER = {"s": (SYSTEM, (START,)), "u": (USER, (START, SYSTEM, ASSISTANT)), "a": (ASSISTANT, (USER,))}
FOLLOWS = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
_NEVER = 1 << 50
_SPACE = " \t\n\v\f\r"


class Weights:
    """Integers of a cost and up to `letters` letters."""

    def __init__(self, letters: int):
        self.low, self.top = BITS * letters, BITS * (letters - 1)
        self.mask, self.never = (1 << self.low) - 1, _NEVER << self.low

    def before(self, letter: int, cost: int, rest: int) -> int:
        """The weight of an edit and what follows it."""
        return ((rest >> self.low) + cost << self.low) + (letter << self.top) + ((rest & self.mask) >> BITS)

    def joined(self, cost: int, audit: str, rest: int) -> int:
        """The weight of edits and what follows them."""
        digits = 0
        for c in audit:
            digits = digits << BITS | LETTERS.index(c)
        n = BITS * len(audit)
        return ((rest >> self.low) + cost << self.low) + (digits << self.low - n) + ((rest & self.mask) >> n)

    def read(self, weight: int) -> tuple[int, str]:
        digits = weight & self.mask
        text = "".join(LETTERS[(digits >> at) & 7] for at in range(self.top, -1, -BITS)) if self.low < 4096 else _letters(digits, self.low // BITS)
        return weight >> self.low, text.rstrip("\0")

    def inserted(self, base: list[int]) -> list[int]:
        """Up to two inserted rows before what the states lead to; more would be a detour."""
        out = base
        for _ in range(2):
            out = [min(b, self.before(_I, INSERT, out[FOLLOWS[q]])) for q, b in enumerate(base)]
        return out

    def end(self) -> list[int]:
        return self.inserted([0, self.never, self.never, 0])

    def row(self, initial: str, delete: bool, truncated: bool, after: list[int]) -> list[int]:
        """Weights before a row from those after it."""
        base = [self.before(_D, DELETE, w) for w in after]
        if not delete:
            more = TRUNCATED * truncated
            ways = [(_R, REROLE + more, *AFTER[r]) for r in "ua"]
            if initial in AFTER:
                ways.append((_K, KEEP + more, *AFTER[initial]))
            for letter, cost, state, before in ways:
                for q in before:
                    base[q] = min(base[q], self.before(letter, cost, after[state]))
        return self.inserted(base)


def _letters(digits: int, n: int) -> str:
    """Letters of a long number, by halves."""
    if n <= 512:
        return "".join(LETTERS[(digits >> at) & 7] for at in range(BITS * (n - 1), -1, -BITS))
    half = n // 2
    return _letters(digits >> BITS * half, n - half) + _letters(digits & ((1 << BITS * half) - 1), half)


@dataclass
class Row:
    turn: int | None
    role: str
    text: str
    repeated: bool

    @property
    def fault(self) -> str:
        words = self.text.strip(_SPACE)
        return "blank" if not words else "duplicate" if self.repeated else "truncated" if words[-1] not in ".!?" else ""


@dataclass
class Summary:
    """What a chunk tells of a conversation; the matrix has (cost, audit) from each state to each."""

    blank: int
    duplicate: int
    truncated: int
    illegal: int
    first: str
    last: str
    matrix: list[tuple[int, str]]


def _illegal(a: str, b: str) -> bool:
    return a[:1] + b[:1] not in ("su", "ua", "au")


def _faults(rows: list[Row]) -> list[tuple[str, bool, bool]]:
    return [(r.role[:1], f in ("blank", "duplicate"), f == "truncated") for r in rows if (f := r.fault) is not None]


def summarise(rows: list[Row], matrix: bool = True) -> Summary:
    """Of one or more rows in order."""
    faults = [r.fault for r in rows]
    ways: list[tuple[int, str]] = []
    if matrix:
        w = Weights(3 * len(rows))
        exits = []
        for t in range(4):
            now = [0 if q == t else w.never for q in range(4)]
            for row in reversed(_faults(rows)):
                now = w.row(*row, now)
            exits.append([w.read(x) if x < w.never else (_NEVER, "") for x in now])
        ways = [exits[t][q] for q in range(4) for t in range(4)]
    return Summary(
        *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(_illegal(a.role, b.role) for a, b in zip(rows, rows[1:], strict=False)),
        rows[0].role,
        rows[-1].role,
        ways,
    )


def plan(rows: list[Row]) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    w = Weights(3 * len(rows) + 2)
    now = w.end()
    for row in reversed(_faults(rows)):
        now = w.row(*row, now)
    return w.read(now[START])


def combine(parts: list[Summary]) -> tuple[int, str, list[tuple[int, str]]]:
    """(cost, audit, (state before, audit) of each chunk) of a conversation cut into chunks; what is inserted at its end goes to the last one."""
    w = Weights(sum(max(len(a) for _, a in p.matrix) for p in parts) + 2)
    values = [w.end()]
    for p in reversed(parts):
        values.append([min((w.joined(*p.matrix[4 * q + t], values[-1][t]) for t in range(4) if p.matrix[4 * q + t][0] < _NEVER), default=w.never) for q in range(4)])
    values.reverse()
    state, out = START, []
    for p, here, after in zip(parts, values, values[1:], strict=False):
        leave = next(t for t in range(4) if p.matrix[4 * state + t][0] < _NEVER and w.joined(*p.matrix[4 * state + t], after[t]) == here[state])
        out.append((state, p.matrix[4 * state + leave][1]))
        state = leave
    out[-1] = (out[-1][0], out[-1][1] + w.read(values[-1][state])[1])
    return *w.read(values[0][START]), out


def apply(audit: str, rows: list[Row], state: int = START) -> list[tuple[str, str]]:
    """(role, text) of the repaired rows, from a state on."""
    out, left = [], iter(rows)
    for letter in audit:
        row = None if letter == "I" else next(left)
        if letter == "K":
            state = AFTER[row.role[:1]][0]
            out.append((row.role, row.text))
        elif letter != "D":
            state = FOLLOWS[state]
            out.append((ROLE[state], row.text if row else ""))
    return out


def _lines(rows: list[tuple[str, str]]) -> str:
    return "\n".join(f"{r}:{t}" for r, t in rows)


_NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_SCHEMA = ", ".join(f"{n} long" for n in _NUMBERS) + ", audit string"


def _numbers(parts: list[Summary]) -> list[int]:
    """Of a conversation: blank, duplicate, truncated and illegal ones."""
    between = sum(_illegal(a.last, b.first) for a, b in zip(parts, parts[1:], strict=False))
    return [*[sum(getattr(p, name) for p in parts) for name in _NUMBERS[1:4]], sum(p.illegal for p in parts) + between]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and place; a row each for conversations held whole."""
    schema = None
    out: list[list] = []

    def done(conv, rows: list[Row]) -> None:
        if not rows:
            out.append([conv, 0, 0, 0, 0, 0, 0, "", ""])
            return
        turns = {r.turn for r in rows if r.turn is not None}
        cost, audit = plan(rows)
        out.append([conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *_numbers([summarise(rows, matrix=False)]), cost, audit, _lines(apply(audit, rows))])

    now, rows, seen, begun = None, [], set(), False
    for batch in batches:
        schema = schema or pa.schema([pa.field("conv_id", batch.schema.field(0).type), *[pa.field(n, pa.int64()) for n in _NUMBERS], pa.field("audit", pa.string()), pa.field("lines", pa.string())])
        for at in range(0, batch.num_rows, 256):
            for conv, turn, role, text, present in zip(*[c.to_pylist() for c in batch.slice(at, 256).columns], strict=True):
                if not begun or conv != now:
                    if begun:
                        done(now, rows)
                    now, rows, seen, begun = conv, [], set(), True
                if present:
                    rows.append(Row(turn, role, text, (role, text) in seen))
                    seen.add((role, text))
            if sum(len(r[-1]) for r in out) > 1 << 20 or len(out) > 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
                out.clear()
    if begun:
        done(now, rows)
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)


@dataclass
class Repaired:
    """plans: conv_id, the numbers, audit, lines (`role:text`, newline-joined; null for a conversation in pieces). pieces: conv_id, piece, lines, if any is."""

    plans: DataFrame
    pieces: DataFrame | None


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None, chunk: int = CHUNK) -> Repaired:
    """Repair every conversation of a table of rows.

    Rows are ordered by turn, nulls first, then by role and text, so repeated rows stand side by side. A null role or
    text counts as one space; rows without a conversation id are one conversation. A conversation none of whose rows is
    `present` has zeros and an empty audit; an empty table gives an empty result; further columns are left out, whatever
    their names. A role's initial is its first character as it is.

    Conversations up to `chunk` rows are streamed in the order of a sorted partition, one at a time. Rows of longer ones
    are dealt over range partitions and repaired by chunks; only their summaries meet, whose size is that of the audit,
    one cell of the result by contract.
    """
    base = rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"), (F.lit(True) if present is None else present).alias("present"))
    long = cut_lineage(base.groupBy("conv_id").agg(F.count(F.when(F.col("present"), 1)).alias("_n")).filter(F.col("_n") > chunk).select(F.struct("conv_id").alias("_long")))
    kind = rows.schema[id_col].dataType.simpleString()
    if long.isEmpty():
        return Repaired(_streamed(base, kind), None)
    named = base.withColumn("_long", F.struct("conv_id"))
    size = F.lit(64)
    short = _streamed(join_side(named, long, "_long", "left_anti", size).drop("_long"), kind)
    plans, pieces = _by_chunks(join_side(named, long, "_long", "left_semi", size).filter("present").drop("_long", "present"), kind, chunk)
    return Repaired(short.unionByName(plans), pieces)


def _streamed(rows: DataFrame, kind: str) -> DataFrame:
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order).mapInArrow(_whole, f"conv_id {kind}, {_SCHEMA}, lines string")


def _rows_of(pdf: pd.DataFrame) -> list[Row]:
    pdf = pdf.sort_values("_place")
    return [Row(None, r, x, not f) for r, x, f in zip(pdf["role"], pdf["text"], pdf["_first"], strict=True)]


def _by_chunks(rows: DataFrame, kind: str, chunk: int) -> tuple[DataFrame, DataFrame]:
    """plans and pieces of long conversations."""
    full = _placed(rows, chunk)
    turns = full.filter("turn IS NOT NULL").groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    every = ["blank", "duplicate", "truncated", "illegal"]

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        s = summarise(_rows_of(pdf))
        head = {"conv_id": pdf["conv_id"].iloc[:1].tolist(), "piece": pdf["piece"].iloc[:1].tolist()}
        return pd.DataFrame(head | {n: [getattr(s, n)] for n in (*every, "first", "last")} | {"costs": [[c for c, _ in s.matrix]], "audits": [[a for _, a in s.matrix]]})

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("piece")
        found = [Summary(r.blank, r.duplicate, r.truncated, r.illegal, r.first, r.last, list(zip(map(int, r.costs), r.audits, strict=True))) for r in pdf.itertuples(index=False)]
        cost, audit, each = combine(found)
        first = [True] + [False] * (len(found) - 1)
        numbers = dict(zip(every, _numbers(found), strict=True)) | {"cost": cost}
        return pd.DataFrame({"conv_id": pdf["conv_id"].tolist(), "piece": pdf["piece"].tolist(), "state": [s for s, _ in each], "part": [a for _, a in each], "audit": [audit if f else None for f in first]} | {k: [v] * len(found) for k, v in numbers.items()})

    def applied(rows_: pd.DataFrame, decided_: pd.DataFrame) -> pd.DataFrame:
        d = decided_.iloc[0]
        return pd.DataFrame({"conv_id": rows_["conv_id"].iloc[:1].tolist(), "piece": rows_["piece"].iloc[:1].tolist(), "lines": [_lines(apply(d["part"], _rows_of(rows_), int(d["state"])))]})

    numbers = ", ".join(f"{n} long" for n in every)
    summaries = full.groupBy("conv_id", "piece").applyInPandas(told, f"conv_id {kind}, piece long, {numbers}, first string, last string, costs array<long>, audits array<string>")
    decided = cut_lineage(summaries.groupBy("conv_id").applyInPandas(joined, f"conv_id {kind}, piece long, state int, part string, audit string, {numbers}, cost long"))
    pieces = full.groupBy("conv_id", "piece").cogroup(decided.groupBy("conv_id", "piece")).applyInPandas(applied, f"conv_id {kind}, piece long, lines string")
    plans = decided.filter("audit IS NOT NULL").withColumn("_c", F.struct("conv_id")).join(turns.select(F.struct("conv_id").alias("_c"), "gaps"), "_c", "left")
    return plans.select("conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), *every, "cost", "audit", F.lit(None).cast("string").alias("lines")), pieces


def _placed(rows: DataFrame, chunk: int) -> DataFrame:
    """conv_id, turn, role, text, _place (from 0, by turn, role and text), piece, _first (whether its role and text are new)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    sorted_ = rows.repartitionByRange(parts, F.col("conv_id"), *order).sortWithinPartitions("conv_id", *order)
    # ids rise along the sorted partitions, so they are the order from here on
    stored = cut_lineage(sorted_.withColumns({"_bucket": F.spark_partition_id(), "_row": F.monotonically_increasing_id(), "_digest": F.sha2("text", 256)}))
    one = stored.select("conv_id", "_bucket", "_row", "role", "_digest", F.lit(1).alias("_one"))
    placed = cut_lineage(running_start(one, ["conv_id"], "_bucket", ["_row"], F.col("_one"), "_place").drop("_one", "_bucket"))
    firsts = placed.groupBy("conv_id", "role", "_digest").agg(F.min("_row").alias("_row")).select("_row", F.lit(True).alias("_first"))
    marked = placed.select("_row", "_place").join(firsts, "_row", "left")
    return cut_lineage(stored.join(marked, "_row").select("conv_id", "turn", "role", "text", "_place", F.coalesce("_first", F.lit(False)).alias("_first"), F.floor(F.col("_place") / chunk).alias("piece")))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by conversation and place: a row per conversation, whose text goes through the hash piece by piece."""
    now, state, begun, schema = None, hashlib.sha256(), False, None
    done: list[tuple] = []
    for batch in batches:
        schema = schema or pa.schema([pa.field("conv_id", batch.schema.field(0).type), pa.field("sha", pa.string())])
        for conv, lines in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if not begun or conv != now:
                if begun:
                    done.append((now, state.hexdigest()))
                now, state, begun, empty = conv, hashlib.sha256(), True, True
            if lines:
                state.update((lines if empty else "\n" + lines).encode("utf-8", "surrogatepass"))
                empty = False
    if begun:
        done.append((now, state.hexdigest()))
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in done], schema)


def digests(repaired: Repaired) -> DataFrame:
    """conv_id, the numbers, audit, repaired_sha256 of `role:text` lines. A long text is hashed in order, as a hash has to be, and held piece by piece."""
    own = repaired.plans.select("conv_id", *_NUMBERS, "audit", F.sha2("lines", 256).alias("repaired_sha256"))
    if repaired.pieces is None:
        return own
    kind = repaired.pieces.schema["conv_id"].dataType.simpleString()
    found = repaired.pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_hashed, f"conv_id {kind}, sha string").select(F.struct("conv_id").alias("_c"), "sha")
    both = own.withColumn("_c", F.struct("conv_id")).join(found, "_c", "left")
    return both.select("conv_id", *_NUMBERS, "audit", F.coalesce("repaired_sha256", "sha").alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present: rows as crc32 of `conv_id:turn` damages them; a dropped row stays, but isn't present. Nulls count as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", text("conv_id"), text("turn")).cast("binary")) % 20
    said = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text"))
    copies = F.sequence(F.lit(1), F.when(F.col("_d") == 3, 2).otherwise(1))
    return rows.withColumn("_d", kind).select("conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(text("role")).alias("role"), said.alias("text"), (F.col("_d") != 0).alias("present"), F.explode(copies).alias("_copy")).drop("_copy")


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every damaged conversation; nulls, ties and repeats as `damaged` and `repair` have them."""
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    return digests(repair(rows, present=F.col("present")))


def _sql() -> str:
    """Each step from a row to the one before it puts a letter and a line before the best of what follows each state."""
    way = lambda cost, letter, line, rest: f"{{'c': {rest}.c + {cost}, 'a': '{letter}' || {rest}.a, 't': {line} || {rest}.t}}"
    after = [f"v[{q}]" for q in range(1, 5)]
    said = lambda role: f"chr(10) || '{role}:' || text"
    allowed = {"s": (1,), "u": (1, 2, 4), "a": (3,)}
    base = []
    for q in range(1, 5):
        ways = [way(4, "D", "''", after[q - 1])]
        for initial, role, state in (("s", None, 2), ("u", "user", 3), ("a", "assistant", 4)):
            if q in allowed[initial]:
                ways.append(f"CASE WHEN fault IN (0, 3) AND initial = '{initial}' THEN {way('more', 'K', 'chr(10) || role || chr(58) || text', after[state - 1])} END")
                if role:
                    ways.append(f"CASE WHEN fault IN (0, 3) THEN {way('3 + more', 'R', said(role), after[state - 1])} END")
        base.append(f"list_min(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))")

    def inserted(rows: str) -> str:
        follows = [(3, "user"), (3, "user"), (4, "assistant"), (3, "user")]
        line = "chr(10) || '{}:'"
        once = lambda source: f"SELECT conv_id, i, b, [{', '.join(f'list_min([b[{q + 1}], {way(3, 'I', line.format(r), f'v[{s}]')}])' for q, (s, r) in enumerate(follows))}] AS v FROM ({source})"
        return f"SELECT conv_id, i, v FROM ({once(once(rows))})"

    never = "{'c': 1000000::BIGINT, 'a': '', 't': ''}"
    none = "{'c': 0::BIGINT, 'a': '', 't': ''}"
    start = inserted(f"SELECT conv_id, count(*) + 1 AS i, [{none}, {never}, {never}, {none}] AS b, [{none}, {never}, {never}, {none}] AS v FROM f GROUP BY conv_id")
    step = inserted(f"SELECT conv_id, i, b, b AS v FROM (SELECT w.conv_id, f.i, [{', '.join(base)}] AS b FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i - 1)")
    return f"""WITH RECURSIVE {CRC_TABLE},
x AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS d FROM conversations, crc),
y AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE d WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS k, left(role, 1) AS initial FROM y),
f AS (SELECT *, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS more FROM (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN k > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault FROM z)),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (wrong) AS illegal
FROM (SELECT *, i > 1 AND lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS wrong FROM f) GROUP BY conv_id),
w AS ({start} UNION ALL {step})
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(w.v[1].c, 0) AS cost, coalesce(w.v[1].a, '') AS audit, sha256(coalesce(substr(w.v[1].t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM o.conv_id AND w.i = 1"""


SQL = {"op13_conversation_repair": _sql()}
