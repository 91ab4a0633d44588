"""Chat formatting with minimum-cost role repair.

A conversation is legal if it has at most one system turn, at its start, and then user and assistant turns by turns that
begin with user and end with assistant. Every turn can be kept, merged into the turn before it, relabelled, or preceded by
inserted empty turns; dynamic programming over the automaton of legal conversations finds the cheapest repair, and the
repaired sequence is rendered turn by turn.

Turns are dealt by ranges of (conv_id, turn), so a conversation of any length is split over tasks: each task gives the cost
of its run of a conversation from every entry state to every exit state, the driver chains the runs that a range border
cuts (two a task at most), and the tasks then trace back between known states. Python sees roles only; texts meet their
repaired turns in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import groups_of, map_rows, write_table

#: States: before any turn, and after a system, user or assistant turn.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = ("", "system", "user", "assistant")
LEGAL = {BEGIN: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, INSERT = 1, 2, 3
FAR = 1 << 40
END_MARK = "<|im_end|>\n"


def _paths() -> dict[tuple[int, int], tuple[int, ...]]:
    """Shortest runs of inserted roles from a state to another one in which a turn of the given role is legal."""
    out = {}
    for s in LEGAL:
        seen, todo = {s: ()}, [s]
        for at in todo:
            for role in LEGAL[at]:
                if role not in seen:
                    seen[role] = (*seen[at], role)
                    todo.append(role)
        for role in (SYSTEM, USER, ASSISTANT):
            found = sorted((len(p), p) for at, p in seen.items() if role in LEGAL[at])
            if found:
                out[s, role] = found[0][1]
    return out


PATHS = _paths()
#: Empty turns that end a conversation legally from each state.
ENDINGS = {BEGIN: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def moves(state: int, role: int) -> Iterator[tuple[int, int, str, tuple[int, ...]]]:
    """(cost, next state, action, inserted roles before) of a turn of ``role`` (0 if unknown), in order of preference."""
    if (state, role) in PATHS and not PATHS[state, role]:
        yield 0, role, "keep", ()
    if state != BEGIN:
        yield MERGE + (role != state) * RELABEL, state, "merge", ()
    for new in (SYSTEM, USER, ASSISTANT):
        path = PATHS.get((state, new))
        if path is None or (new == role and not path):
            continue
        yield (new != role) * RELABEL + INSERT * len(path), new, "keep" if new == role else "relabel", path


MOVES = {(s, r): list(moves(s, r)) for s in range(4) for r in range(4)}


def forward(roles: list[int], entry: int) -> list[list[int]]:
    """Least cost of each state after each turn, from one entry state."""
    costs = [[0 if s == entry else FAR for s in range(4)]]
    for r in roles:
        now = [FAR] * 4
        for s, c in enumerate(costs[-1]):
            if c < FAR:
                for cost, to, _, _ in MOVES[s, r]:
                    if c + cost < now[to]:
                        now[to] = c + cost
        costs.append(now)
    return costs


def trace(roles: list[int], entry: int, leave: int) -> list[tuple[int, str, tuple[int, ...]]]:
    """(role, action, inserted roles before) of each turn of a cheapest way from one state to another."""
    costs, out, state = forward(roles, entry), [], leave
    for i in range(len(roles) - 1, -1, -1):
        for s in range(4):
            got = next(((a, p) for c, to, a, p in MOVES[s, roles[i]] if to == state and costs[i][s] + c == costs[i + 1][state]), None)
            if costs[i][s] < FAR and got:
                out.append((state, *got))
                state = s
                break
    return out[::-1]


def best_end(costs: list[int]) -> int:
    return min(range(4), key=lambda s: (costs[s] + INSERT * len(ENDINGS[s]), s))


def chain(runs: list[list[list[int]]]) -> list[tuple[int, int]]:
    """(entry, exit) state of each run of one conversation, from the runs' costs by entry and exit state."""
    costs = [[0, FAR, FAR, FAR]]
    for m in runs:
        costs.append([min(min(costs[-1][s] + m[s][e], FAR) for s in range(4)) for e in range(4)])
    state = best_end(costs[-1])
    out = []
    for k in range(len(runs) - 1, -1, -1):
        entry = next(s for s in range(4) if costs[k][s] < FAR and costs[k][s] + runs[k][s][state] == costs[k + 1][state])
        out.append((entry, state))
        state = entry
    return out[::-1]


def _role(name: str | None) -> int:
    return ROLES.get((name or "").strip().lower(), 0)


def escaped(text: Column) -> Column:
    """Text in which no turn mark can be read: a space parts the bar of ``<|im_start|>`` and ``<|im_end|>``."""
    return F.regexp_replace(text, r"<\|(im_start|im_end)\|>", "<| $1 |>")


def rendered(role: Column, text: Column, action: Column) -> Column:
    """One turn's markup; a merged turn goes on after a blank line. The end mark of a turn stands before the next one."""
    opened = F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), escaped(text))
    return F.when(action == "merge", F.concat(F.lit("\n\n"), escaped(text))).when(action == "insert", F.concat(opened, F.lit(END_MARK))).otherwise(opened)


def repaired(turns: DataFrame) -> DataFrame:
    """(conv_id, position, turn, role, action, text, rendered) of the repaired turns of ``turns`` (conv_id, turn, role, text).

    A conversation's rendering is its rows' ``rendered`` in order of position (from 0). Turns go by turn (null first), then
    role and text; every row is a turn, repeated ones too; a null text is empty and texts of any length stay whole, but turn
    marks inside them are parted in ``rendered``; unknown or null roles are relabelled; a null conv_id is a conversation of
    its own. Inserted turns have a null ``turn`` and no text. Other columns are ignored; empty tables give no rows.
    """
    order = ("conv_id", "turn", "role", "text")
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    copy = F.monotonically_increasing_id()  # repeats of one row may fill several ranges
    rows = rows.withColumn("copy", copy).repartitionByRange(*order, "copy").sortWithinPartitions(*order)
    rows = write_table(rows.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"), *order), "turns")
    dealt = rows.select("part", "conv_id", "place", "role").repartition("part").sortWithinPartitions("part", "place")

    def edges(it):
        for (part,), group in groups_of(((r[0], r[1], _role(r[3])) for r in it), 1):
            first, last = group[0][1], group[-1][1]
            for conv in dict.fromkeys((first, last)):
                roles = [r[2] for r in group if r[1] == conv]
                yield part, conv, [c for s in range(4) for c in forward(roles, s)[-1]]

    schema = pa.schema([("part", pa.int32()), ("conv_id", pa.int64()), ("costs", pa.list_(pa.int64()))])
    borders: dict = {}
    for r in sorted(map_rows(dealt, lambda: edges, schema, "part int, conv_id long, costs array<long>").collect(), key=lambda r: r["part"]):
        borders.setdefault(r["conv_id"], []).append((r["part"], [r["costs"][4 * s : 4 * s + 4] for s in range(4)]))
    known = {}
    for conv, runs in borders.items():
        if len(runs) > 1:
            for k, ((part, _), states) in enumerate(zip(runs, chain([m for _, m in runs]), strict=True)):
                known[part, conv] = (*states, k == len(runs) - 1)
    spark = turns.sparkSession

    def rows_of_run(group, states):
        roles = [_role(r[3]) for r in group]
        entry, leave, last = states or (BEGIN, best_end(forward(roles, BEGIN)[-1]), True)
        for r, (role, action, before) in zip(group, trace(roles, entry, leave), strict=True):
            yield from ((None, NAMES[extra], "insert") for extra in before)
            yield r[2], NAMES[role], action
        yield from ((None, NAMES[extra], "insert") for extra in (ENDINGS[leave] if last else ()))

    offsets: dict = {}
    if known:
        cut = spark.sparkContext.broadcast(known)

        def sizes(it):
            for (part, conv), group in groups_of(it, 2):
                if (part, conv) in cut.value:
                    yield part, conv, sum(1 for _ in rows_of_run(group, cut.value[part, conv]))

        so_far: dict = {}
        counted = map_rows(dealt, lambda: sizes, pa.schema([("part", pa.int32()), ("conv_id", pa.int64()), ("n", pa.int64())]), "part int, conv_id long, n long")
        for r in sorted(counted.collect(), key=lambda r: r["part"]):
            offsets[r["part"], r["conv_id"]] = so_far.get(r["conv_id"], 0)
            so_far[r["conv_id"]] = so_far.get(r["conv_id"], 0) + r["n"]
    shared = spark.sparkContext.broadcast((known, offsets))

    def out(it):
        states, starts = shared.value
        for (part, conv), group in groups_of(it, 2):
            start = starts.get((part, conv), 0)
            for k, (place, role, action) in enumerate(rows_of_run(group, states.get((part, conv)))):
                yield conv, start + k, place, role, action

    fields = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("action", pa.string())])
    fixed = write_table(map_rows(dealt, lambda: out, fields, "conv_id long, position long, place long, role string, action string"), "repairs")
    kept = fixed.where("place is not null").join(rows.select("place", "turn", "text"), "place")
    every = kept.unionByName(fixed.where("place is null").withColumns({"turn": F.lit(None).cast("long"), "text": F.lit("")}))
    return every.select("conv_id", "position", "turn", "role", "action", "text", rendered(F.col("role"), F.col("text"), F.col("action")).alias("rendered"))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, text): each conversation's whole rendering, for conversations that fit into a string."""
    rows = repaired(turns)
    parts = F.array_sort(F.collect_list(F.struct("position", "action", "rendered")))
    joined = F.aggregate(
        "parts",
        F.lit(""),
        lambda t, p: F.concat(t, F.when((t != "") & (p["action"] != "merge") & ~t.endswith(END_MARK), F.lit(END_MARK)).otherwise(F.lit("")), p["rendered"]),
        lambda t: F.when(t.endswith(END_MARK), t).otherwise(F.concat(t, F.lit(END_MARK))),
    )
    return rows.groupBy("conv_id").agg(parts.alias("parts")).select("conv_id", joined.alias("text"))
