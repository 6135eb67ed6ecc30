"""Conversation structure repair by a run-length dynamic programme.

A conversation is a string of symbols, one a turn: the class of its role and its fault. The
cheapest edits lead through four states (nothing yet, after a system turn, after a user turn,
after an assistant turn); a symbol is a 4 x 4 min-plus matrix of the costs between them. Equal
consecutive symbols form a run, and a run of length n is applied by the cached binary powers
of its matrix. The choices are unrolled afterwards, runs by halving, so that every turn gets
its edit.

Turns are sorted by range and cut into blocks of at most ``BLOCK`` rows, so a conversation of
any length is spread over tasks: blocks become matrices, one row a block is scanned for the
costs behind each block, every block is unrolled from each state it may begin in, and a second
scan picks the state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.textops import arrow_limits
from cohortspark.sources.stored import settle

BLOCK_BITS = 16  # rows of a block: 2^16 at most
SPACES = " \t\n\x0b\x0c\r"
FAR = 1 << 60
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
DELETED = 8  # the symbol of turns that must go, whatever their role


class Costs(NamedTuple):
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


Matrix = tuple[tuple[int, ...], ...]


def _times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(FAR, *(a[i][k] + b[k][j] for k in STATES)) for j in STATES) for i in STATES)


def _apply(a: Matrix, v: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(FAR, *(a[i][k] + v[k] for k in STATES)) for i in STATES)


def _next(state: int) -> int:
    """The state after the one turn that may be inserted or renamed to here."""
    return ASSISTANT if state == USER else USER


@lru_cache(maxsize=None)
def _inserts(costs: Costs) -> Matrix:
    """Cheapest insertions between states, none included."""
    m = tuple(tuple(0 if i == j else costs.insert if j == _next(i) else FAR for j in STATES) for i in STATES)
    return _times(m, _times(m, m))


@lru_cache(maxsize=None)
def _moves(symbol: int, costs: Costs) -> tuple[tuple[str, tuple[tuple[int, int], ...]], ...]:
    """For each edit in ASCII order, (target, cost) of every state; no insertions."""
    drop = tuple((i, costs.delete) for i in STATES)
    if symbol == DELETED:
        return (("D", drop),)
    role, worse = symbol >> 1, (symbol & 1) * costs.truncated
    keeps = {0: {START: SYSTEM}, 1: {START: USER, SYSTEM: USER, ASSISTANT: USER}, 2: {USER: ASSISTANT}, 3: {}}[role]
    keep = tuple((keeps.get(i, i), worse if i in keeps else FAR) for i in STATES)
    rename = tuple((_next(i), costs.rerole + worse) for i in STATES)
    return (("D", drop), ("K", keep), ("R", rename))


@lru_cache(maxsize=None)
def _power(symbol: int, exponent: int, costs: Costs) -> Matrix:
    """The matrix of 2^exponent turns of a symbol, insertions before each included."""
    if exponent:
        half = _power(symbol, exponent - 1, costs)
        return _times(half, half)
    best = [[FAR] * 4 for _ in STATES]
    for _, moves in _moves(symbol, costs):
        for i, (j, cost) in enumerate(moves):
            best[i][j] = min(best[i][j], cost)
    return _times(_inserts(costs), tuple(map(tuple, best)))


def _advance(symbol: int, n: int, after: tuple[int, ...], costs: Costs) -> tuple[int, ...]:
    """Costs before a run of ``n`` turns from the costs behind it."""
    exponent = 0
    while n:
        if n & 1:
            after = _apply(_power(symbol, exponent, costs), after)
        n, exponent = n >> 1, exponent + 1
    return after


def _run_matrix(runs: list[tuple[int, int]], costs: Costs) -> Matrix:
    columns = [tuple(0 if i == j else FAR for i in STATES) for j in STATES]
    for symbol, n in reversed(runs):
        columns = [_advance(symbol, n, c, costs) for c in columns]
    return tuple(zip(*columns))


def _end_costs(costs: Costs) -> tuple[int, ...]:
    return _apply(_inserts(costs), (0, FAR, FAR, 0))


def _unroll(symbol: int, n: int, state: int, after: tuple[int, ...], costs: Costs, out: list[str], to: list[str]) -> int:
    """Append the edits of a run, ASCII-least among the cheapest; returns the state behind it."""
    if n > 1:
        half = 1 << ((n - 1).bit_length() - 1)
        state = _unroll(symbol, half, state, _advance(symbol, n - half, after, costs), costs, out, to)
        return _unroll(symbol, n - half, state, after, costs, out, to)
    before = _advance(symbol, 1, after, costs)
    while True:
        for edit, moves in _moves(symbol, costs):
            target, cost = moves[state]
            if edit > "I" and costs.insert + before[_next(state)] == before[state]:
                break
            if cost < FAR and cost + after[target] == before[state]:
                out.append(edit)
                to.append("-" if edit == "D" else "=" if edit == "K" else "ua"[target == ASSISTANT])
                return target
        state = _insert(state, out, to)


def _insert(state: int, out: list[str], to: list[str]) -> int:
    state = _next(state)
    out.append("I")
    to.append("ua"[state == ASSISTANT])
    return state


def _runs(codes: list[int]) -> list[tuple[int, int]]:
    """Runs of equal symbols from codes 4 * role class + fault."""
    symbols = (DELETED if c & 3 in (BLANK, DUPLICATE) else (c >> 2) * 2 + (c & 3 == TRUNCATED) for c in codes)
    return [(s, sum(1 for _ in g)) for s, g in groupby(symbols)]


def _legal(a: int, b: int) -> bool:
    return (a, b) in ((0, 1), (1, 2), (2, 1))


def plan(codes: list[int], costs: Costs = Costs()) -> tuple[int, str, str]:
    """Cost, edits and resulting roles of one conversation that is held in memory."""
    runs, after = _runs(codes), [_end_costs(costs)]
    for symbol, n in reversed(runs):
        after.append(_advance(symbol, n, after[-1], costs))
    out, to, state = [], [], START
    for (symbol, n), v in zip(runs, reversed(after[:-1])):
        state = _unroll(symbol, n, state, v, costs, out, to)
    while state not in (START, ASSISTANT):
        state = _insert(state, out, to)
    return after[-1][START], "".join(out), "".join(to)


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations with faults to practise on; nulls are read as one space.

    ``crc32(conv:turn) % 20``: 0 drops a turn, 1 empties its text, 2 takes its end marks, 3
    repeats it, 4 makes it the user's.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(conv_col), F.lit(":"), blank(turn_col)).cast("binary")) % 20
    rows = turns.select(F.col(conv_col), F.col(turn_col), blank(role_col).alias(role_col), blank(text_col).alias(text_col), kind.alias("_kind")).filter("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace(text_col, "[.!?]", "")).otherwise(F.col(text_col))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col(role_col))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    return rows.select(conv_col, turn_col, role.alias(role_col), text.alias(text_col), copies.alias("_copy")).drop("_copy")


def _ordered(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Turns with their place ``at`` in the order of the whole table, written."""
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"))
    trimmed = F.rtrim("text", F.lit(SPACES))
    fault = F.when(trimmed == "", BLANK).when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(NONE)
    role = sum((F.when(F.left("role", F.lit(1)) == c, i - 3).otherwise(0) for i, c in enumerate("sua")), F.lit(3))
    rows = rows.withColumns({"fault": fault, "class": role, "role_hash": F.sha2("role", 256), "text_hash": F.sha2("text", 256)})
    order = ["conv", "turn", "role_hash", "text_hash"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return settle(rows.withColumn("at", F.monotonically_increasing_id()), "turns")


def _coded(ordered: DataFrame) -> DataFrame:
    """(conv, at, code): blank turns first, then those seen before, then truncated ones."""
    keys = ["conv", "role_hash", "text_hash"]
    rows = ordered.select(*keys, "at", "fault", "class")
    first = rows.groupBy(*keys).agg(F.min("at").alias("first")).toDF("c", "r", "t", "first")
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role_hash") == F.col("r")) & (F.col("text_hash") == F.col("t"))
    fault = F.when(F.col("fault") == BLANK, BLANK).when(F.col("at") > F.col("first"), DUPLICATE).otherwise(F.col("fault"))
    return rows.join(first, same).select("conv", "at", (F.col("class") * 4 + fault).cast("int").alias("code"))


def _map(df: DataFrame, columns: list[str], added: str, fn) -> DataFrame:
    """``fn(values of a row) -> rows``; the first column is kept with its own type."""
    fields = [f.strip().split(" ") for f in added.split(", ")]
    to_arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()),
                "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = [row for values in zip(*(c.to_pylist() for c in batch.columns)) for row in fn(*values)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], batch.schema.field(0).type), *[pa.array([r[i + 1] for r in out], to_arrow[t]) for i, (_, t) in enumerate(fields)]],
                [columns[0], *[n for n, _ in fields]])

    return df.select(*columns).mapInArrow(run, f"{columns[0]} {df.schema[columns[0]].dataType.simpleString()}, {added}")


def repaired(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", costs: Costs = Costs(),
) -> tuple[DataFrame, DataFrame]:
    """The edited turns and a row a conversation with its faults, cost and edits.

    Turns: ``(conv_col, turn_col, at, part, role_col, text_col, fault, edit, new_role)``, in the
    order of ``at`` and ``part``; ``edit`` is K(eep), R(erole), D(elete) or I(nsert); a deleted
    turn has no ``new_role``, an inserted one no ``role_col``. Conversations: ``(conv_col, gaps,
    blank, duplicate, truncated, illegal, cost, audit)``. A legal conversation is empty or an
    optional system turn and then pairs of user and assistant, told by the first letter of
    their role. Blank turns and repeats of an earlier role and text must go; a turn that does
    not end in a full stop, question or exclamation mark costs more to keep. Of equally cheap
    edits the ASCII-least string counts.

    Turns go by number, null first; of equal numbers by hash of role, then of text; repeats
    stand together. Null roles and texts are one space, an empty role is none of the three, a
    null conversation id is a conversation. Other columns are ignored. An empty table gives
    empty results. Rows of one conversation, number, role and text are never split over tasks.
    """
    arrow_limits(turns.sparkSession)
    ordered = _ordered(turns, conv_col, turn_col, role_col, text_col)
    block = F.shiftright("at", BLOCK_BITS)
    coded = settle(_coded(ordered), "codes")
    cells = F.array_sort(F.collect_list(F.struct("at", "code")))
    blocks = coded.groupBy("conv", block.alias("block")).agg(cells.alias("cells"))
    blocks = settle(blocks.select("conv", "block", F.col("cells.at")[0].alias("at"), F.col("cells.code").alias("codes")), "blocks")

    def summed(conv, block, codes):
        faults = [sum(c & 3 == f for c in codes) for f in (BLANK, DUPLICATE, TRUNCATED)]
        illegal = sum(not _legal(a >> 2, b >> 2) for a, b in zip(codes, codes[1:]))
        yield conv, block, [*faults, illegal, codes[0] >> 2, codes[-1] >> 2], [x for row in _run_matrix(_runs(codes), costs) for x in row]

    parts = _map(blocks, ["conv", "block", "codes"], "block long, counts array<long>, matrix array<long>", summed)

    def backwards(conv, rows):
        after, total, behind = _end_costs(costs), [0] * 4, []
        for row in reversed(rows):
            behind.append((row["block"], after))
            m = row["matrix"]
            after = _apply(tuple(tuple(m[4 * j : 4 * j + 4]) for j in STATES), after)
            total = [a + b for a, b in zip(total, row["counts"])]
        total[3] += sum(not _legal(a["counts"][5], b["counts"][4]) for a, b in zip(rows, rows[1:]))
        for i, (block, costs_behind) in enumerate(reversed(behind)):
            yield conv, block, list(costs_behind), i == 0, i == len(rows) - 1, [*total, after[START]]

    scanned = parts.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "counts", "matrix"))).alias("rows"))
    behind = settle(_map(scanned, ["conv", "rows"], "block long, behind array<long>, first boolean, last boolean, total array<long>", backwards), "behind")

    def unrolled(conv, block, at, codes, costs_behind, first, last):
        runs, after = _runs(codes), [tuple(costs_behind)]
        for symbol, n in reversed(runs):
            after.append(_advance(symbol, n, after[-1], costs))
        audits, roles, ends = [], [], []
        for start in STATES:
            out, to, state = [], [], start
            if start == START or not first:
                for (symbol, n), v in zip(runs, reversed(after[:-1])):
                    if after[-1][start] >= FAR:
                        break
                    state = _unroll(symbol, n, state, v, costs, out, to)
                while last and state not in (START, ASSISTANT):
                    state = _insert(state, out, to)
            audits.append("".join(out))
            roles.append("".join(to))
            ends.append(state)
        yield conv, block, at, audits, roles, ends

    b = behind.select(F.col("conv").alias("c"), F.col("block").alias("k"), "behind", "first", "last")
    joined = blocks.join(b, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("k")))
    pieces = settle(_map(joined, ["conv", "block", "at", "codes", "behind", "first", "last"],
                         "block long, at long, audits array<string>, roles array<string>, ends array<int>", unrolled), "pieces")

    def forwards(conv, rows):
        state = START
        for row in rows:
            yield conv, row["block"], state
            state = row["ends"][state]

    chain = pieces.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "ends"))).alias("rows"))
    begins = _map(chain, ["conv", "rows"], "block long, state int", forwards).toDF("c", "k", "state")
    chosen = pieces.join(begins, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("k")))
    chosen = settle(chosen.select("conv", "block", "at", F.col("audits")[F.col("state")].alias("audit"), F.col("roles")[F.col("state")].alias("roles")), "audits")

    def each(conv, at, audit, roles):
        row, last = at, at + len(audit) - audit.count("I") - 1
        for part, (edit, to) in enumerate(zip(audit, roles)):
            yield conv, min(row, last), part, edit, to
            row += edit != "I"

    edits = _map(chosen, ["conv", "at", "audit", "roles"], "at long, part int, edit string, to string", each)
    return _edited(ordered, coded, edits).toDF(conv_col, turn_col, "at", "part", role_col, text_col, "fault", "edit", "new_role"), _summary(
        ordered, behind, chosen).withColumnRenamed("conv", conv_col)


def _edited(ordered: DataFrame, coded: DataFrame, edits: DataFrame) -> DataFrame:
    fault = F.element_at(F.array(*[F.lit(x) for x in ("", "blank", "duplicate", "truncated")]), F.col("code") % 4 + 1)
    rows = ordered.select("at", "turn", "role", "text").join(coded.select("at", fault.alias("fault")), "at").join(edits.select("conv", "at", "part", "edit", "to"), "at")
    own = F.col("edit") != "I"
    new = F.when(F.col("to") == "=", F.col("role")).when(F.col("to") == "u", "user").when(F.col("to") == "a", "assistant")
    return rows.select("conv", F.when(own, F.col("turn")), "at", "part", F.when(own, F.col("role")), F.when(own, F.col("text")).otherwise(""),
                       F.when(own, F.col("fault")).otherwise(""), "edit", new)


def _summary(ordered: DataFrame, behind: DataFrame, chosen: DataFrame) -> DataFrame:
    turn = F.col("turn")
    gaps = F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).cast("long")
    spans = ordered.groupBy("conv").agg(gaps.alias("gaps"))
    names = ["blank", "duplicate", "truncated", "illegal", "cost"]
    totals = behind.filter("first").select(F.col("conv").alias("c"), *[F.col("total")[i].alias(n) for i, n in enumerate(names)])
    audit = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]))
    audits = chosen.groupBy(F.col("conv").alias("a")).agg(audit.alias("audit"))
    return (spans.join(totals, F.col("conv").eqNullSafe(F.col("c"))).join(audits, F.col("conv").eqNullSafe(F.col("a")))
            .select("conv", "gaps", *names, "audit"))


def digests(edited: DataFrame, conv_col: str = "conv_id", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_col, repaired_sha256) of ``role:text`` lines of the turns that are left, hashed as they stream by."""
    line: Column = F.concat("new_role", F.lit(":"), F.col(text_col))
    rows = edited.filter("edit <> 'D'").select(F.col(conv_col).alias("conv"), "at", "part", line.alias("line"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "at", "part").select("conv", "line")

    def run(batches: Iterator[pa.RecordBatch]):
        current, sha = None, None
        for batch in batches:
            done = []
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if sha is None or conv != current:
                    if sha is not None:
                        done.append((current, sha.hexdigest()))
                    current, sha = conv, hashlib.sha256(text.encode())
                else:
                    sha.update(b"\n" + text.encode())
            kind = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], kind), pa.array([x[1] for x in done], pa.string())], ["conv", "sha"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], kind), pa.array([sha.hexdigest()], pa.string())], ["conv", "sha"])

    return rows.mapInArrow(run, f"conv {edited.schema[conv_col].dataType.simpleString()}, sha string").toDF(conv_col, "repaired_sha256")


def report(original: DataFrame, summary: DataFrame, hashes: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The summary with digests, one row for each conversation of ``original``, also those of which nothing is left."""
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = original.select(F.col(conv_col).alias("conv")).distinct()
    s, h = summary.withColumnRenamed(conv_col, "c"), hashes.withColumnRenamed(conv_col, "h")
    joined = every.join(s, F.col("conv").eqNullSafe(F.col("c")), "left").join(h, F.col("conv").eqNullSafe(F.col("h")), "left")
    return joined.select(F.col("conv").alias(conv_col), *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names],
                         F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
