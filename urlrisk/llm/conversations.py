"""Conversation structure repair: cheapest edits by bidirectional Dijkstra over the edit lattice.

A node of the lattice is a place between turns and the last role kept; edges keep, rerole or delete a turn, or insert an empty one. A heap from the
start and one from the end grow until their tops together exceed the best meeting, so all crossings of equal cost are finished; of
all crossings the least concatenated audit is taken. (Two audits of equal cost to one node are never a prefix of one another, since they have
equally many turns and an insertion costs something; so least parts make least wholes.)

Turns are sorted by range partitions over (conversation, turn, role, text), so a conversation of any size is spread over many tasks. Each
task cuts its sorted turns into blocks of at most ``BLOCK`` turns. A conversation that lies within a partition and fits one block is solved at
once. Of the others each block is solved between all pairs of roles at its ends (by the same search), which gives a small table of costs and
ranks of audits; the tables are folded per partition, then per conversation (at most one entry for each partition), and the roles at the
blocks' ends found so fix the audit of each block. Turns seen earlier are found by a grouped minimum. No task collects a conversation; only ``digest_columns`` reads the blocks of a long one in one
stream, because its hash runs over the whole text, and holds one block at a time.

Cases: an empty table gives an empty result. Rows without a conversation are one conversation; turns without a number come first. Rows of one turn are ordered by role, then text;
equal rows are each other's duplicates. A role outside system, user and assistant fits nowhere but by its first letter. Other columns are not read. Null roles and texts
count as one space. Conversation and turn are whole numbers.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.llm.common import bound_batches, shared_folder
from urlrisk.operators.ordering import cut_lineage

# ship the functions of this module with the job, so executors do not need the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 256
#: A block also ends when its texts have so many characters.
BLOCK_CHARS = 1 << 22
#: Roles of the last turn kept: none yet, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: Where a turn of a role may come, and what it leads to.
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The role that an inserted or reroled turn takes after each state.
FORCED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: What is left to insert at the end of a conversation.
ENDING = {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}
LEGAL = {"su", "ua", "au"}
INFINITE = 1 << 60
MARK = re.compile(r"[^\x20\x09-\x0D]")
TURN = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
LINE = pa.struct([("role", pa.string()), ("text", pa.string())])
SOLVED = [
    ("cost", pa.int64(), "long"),
    ("audit", pa.string(), "string"),
    ("blank", pa.int64(), "long"),
    ("duplicate", pa.int64(), "long"),
    ("truncated", pa.int64(), "long"),
    ("illegal", pa.int64(), "long"),
    ("first_role", pa.string(), "string"),
    ("last_role", pa.string(), "string"),
    ("first_turn", pa.int64(), "long"),
    ("last_turn", pa.int64(), "long"),
    ("n_turns", pa.int64(), "long"),
    ("repaired", pa.list_(LINE), "array<struct<role string, text string>>"),
]
KEYS = [("conv_id", pa.int64(), "long"), ("part", pa.int64(), "long"), ("seq", pa.int64(), "long")]
TURNS = [("turns", pa.list_(TURN), "array<struct<turn long, role string, text string>>")]
WHOLE = [("whole", pa.bool_(), "boolean")]
TABLE = "conv_id long, part long, seq long, cost array<long>, rank array<long>"


def ddl(fields: list) -> str:
    return ", ".join(f"{name} {kind}" for name, _, kind in fields)


def batch_of(fields: list, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t, _ in fields], names=[n for n, _, _ in fields])


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of the contract's damaged rows: by hash one is dropped, emptied, robbed of its final marks, repeated or made the user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_c")).drop("_c")


# faults and the lattice


def faults_of(turns: list[dict], first: set[int] | None = None) -> list[str]:
    """The first fault of each turn, empty if it has none. ``first``: positions of those not seen earlier, if known from outside."""
    seen: set[tuple[str, str]] = set()
    out = []
    for i, t in enumerate(turns):
        text = t["text"]
        key = (t["role"], text)
        again = key in seen if first is None else i not in first
        seen.add(key)
        end = len(text)
        while end and not MARK.match(text, end - 1):
            end -= 1
        out.append("blank" if not end else "duplicate" if again else "truncated" if text[end - 1] not in ".!?" else "")
    return out


def ahead(turns: list[tuple[str, str]], i: int, state: int, trailing: bool) -> Iterator[tuple[int, str, int, int]]:
    """(cost, edit, place, state) of the edges that leave a node. ``turns``: first letter of the role, and fault."""
    if i < len(turns):
        initial, fault = turns[i]
        yield DELETE, "D", i + 1, state
        if fault not in ("blank", "duplicate"):
            extra = TRUNCATED if fault else 0
            if state in STEPS.get(initial, ()):
                yield extra, "K", i + 1, STEPS[initial][state]
            yield REROLE + extra, "R", i + 1, FORCED[state]
    if i < len(turns) or trailing:
        yield INSERT, "I", i, FORCED[state]


def behind(turns: list[tuple[str, str]], i: int, state: int, trailing: bool) -> Iterator[tuple[int, str, int, int]]:
    """The edges that end in a node, with the nodes they come from."""
    if i:
        initial, fault = turns[i - 1]
        yield DELETE, "D", i - 1, state
        if fault not in ("blank", "duplicate"):
            extra = TRUNCATED if fault else 0
            for old, new in STEPS.get(initial, {}).items():
                if new == state:
                    yield extra, "K", i - 1, old
            for old, new in FORCED.items():
                if new == state:
                    yield REROLE + extra, "R", i - 1, old
    if i < len(turns) or trailing:
        for old, new in FORCED.items():
            if new == state:
                yield INSERT, "I", i, old


def cheapest(turns: list[tuple[str, str]], entry: int, exits: Iterable[int], trailing: bool) -> tuple[int, str] | None:
    """Cost and least audit from ``entry`` before the first turn to one of ``exits`` after the last; None if there is no way.

    With ``trailing``, turns may be inserted after the last one.
    """
    n = len(turns)
    goals = [(n, x) for x in exits]
    cost = ({(0, entry): 0}, dict.fromkeys(goals, 0))
    done: tuple[dict, dict] = ({}, {})
    heaps = ([(0, 0, entry)], [(0, *g) for g in goals])
    best = 0 if (0, entry) in goals else INFINITE
    while True:
        for side in (0, 1):  # drop what was reached more cheaply
            while heaps[side] and (heaps[side][0][1:] in done[side]):
                heappop(heaps[side])
        tops = [h[0][0] if h else INFINITE for h in heaps]
        if sum(tops) > best or sum(tops) >= INFINITE:
            break
        side = 0 if (tops[0], len(done[0])) <= (tops[1], len(done[1])) else 1
        d, i, state = heappop(heaps[side])
        done[side][i, state] = d
        for c, _, j, to in (behind if side else ahead)(turns, i, state, trailing):
            if d + c < cost[side].get((j, to), INFINITE):
                cost[side][j, to] = d + c
                heappush(heaps[side], (d + c, j, to))
                best = min(best, d + c + cost[1 - side].get((j, to), INFINITE))
    if best >= INFINITE:
        return None
    forth, back = done
    # an edge of cost 0 leads to a later place, so this order has every node after those before it
    prefix = {(0, entry): ""}
    for (i, state), d in sorted(forth.items(), key=lambda x: (x[1], x[0])):
        for c, edit, j, to in ahead(turns, i, state, trailing):
            if forth.get((j, to)) == d + c:
                audit = prefix[i, state] + edit
                prefix[j, to] = min(prefix.get((j, to), audit), audit)
    suffix = {}
    for (i, state), d in sorted(back.items(), key=lambda x: (x[1], -x[0][0])):
        options = [e + suffix[j, to] for c, e, j, to in ahead(turns, i, state, trailing) if back.get((j, to), INFINITE) + c == d]
        suffix[i, state] = min(options) if d else min([*options, ""]) if (i, state) in goals else min(options)
    audits = [prefix[g] for g in goals if forth.get(g) == best]
    for (i, state), d in forth.items():
        for c, edit, j, to in ahead(turns, i, state, trailing):
            if (j, to) not in forth and back.get((j, to), INFINITE) + c + d == best:
                audits.append(prefix[i, state] + edit + suffix[j, to])
    return best, min(audits)


def repaired(turns: list[dict], audit: str, state: int = START) -> tuple[list[dict], int]:
    """The turns that an audit leaves, and the state it ends in."""
    out, i = [], 0
    for edit in audit:
        if edit == "I":
            state = FORCED[state]
            out.append({"role": NAMES[state], "text": ""})
            continue
        t, i = turns[i], i + 1
        if edit == "K":
            state = STEPS[t["role"][:1]][state]
            out.append({"role": t["role"], "text": t["text"]})
        elif edit == "R":
            state = FORCED[state]
            out.append({"role": NAMES[state], "text": t["text"]})
    return out, state


def solved(turns: list[dict], faults: list[str], cost: int, audit: str, state: int = START) -> dict:
    """The columns ``SOLVED`` of a block."""
    initials = [t["role"][:1] for t in turns]
    numbers = [t["turn"] for t in turns if t["turn"] is not None]
    return {
        "cost": cost,
        "audit": audit,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
        "first_role": initials[0],
        "last_role": initials[-1],
        "first_turn": numbers[0] if numbers else None,
        "last_turn": numbers[-1] if numbers else None,
        "n_turns": len(set(numbers)),
        "repaired": repaired(turns, audit, state)[0],
    }


def lattice_turns(turns: list[dict], faults: list[str]) -> list[tuple[str, str]]:
    return [(t["role"][:1], f) for t, f in zip(turns, faults, strict=True)]


# sorted turns to blocks


def _cut(batches: Iterator[pa.RecordBatch], block: int, block_chars: int) -> Iterator[pa.RecordBatch]:
    """Blocks of a sorted partition; the conversations that surely lie within it, and fit one block, are solved."""
    fields = KEYS + WHOLE + TURNS + SOLVED

    def finish(key: tuple[int | None, int], seq: int, turns: list[dict], whole: bool) -> dict:
        row = {"conv_id": key[0], "part": key[1], "seq": seq, "whole": whole}
        if not whole:
            return row | {"turns": turns}
        faults = faults_of(turns)
        return row | solved(turns, faults, *cheapest(lattice_turns(turns, faults), START, (START, ASSISTANT), True))

    key, seq, turns, chars, nth, out = None, 0, [], 0, -1, []
    for batch in batches:
        for r in batch.to_pylist():
            now = (r["conv_id"], r["part"])
            if now != key:
                if key is not None:
                    out.append(finish(key, seq, turns, whole=nth > 0 and seq == 0))
                key, seq, turns, chars, nth = now, 0, [], 0, nth + 1
            elif len(turns) == block or chars >= block_chars:
                out.append(finish(key, seq, turns, whole=False))
                seq, turns, chars = seq + 1, [], 0
            turns.append({"turn": r["turn"], "role": r["role"], "text": r["text"]})
            chars += len(r["text"])
        if out:
            yield batch_of(fields, out)
            out = []
    if key is not None:
        yield batch_of(fields, [finish(key, seq, turns, whole=False)])


# tables of blocks: cost and rank of the least audit for each pair of states at the ends


def block_table(turns: list[tuple[str, str]]) -> tuple[list[int], list[int]]:
    cost, rank = [], []
    for entry in STATES:
        ways = {x: cheapest(turns, entry, (x,), False) for x in STATES}
        order = sorted((w[1], x) for x, w in ways.items() if w)
        place = {x: k for k, (_, x) in enumerate(order)}
        cost += [ways[x][0] if ways[x] else INFINITE for x in STATES]
        rank += [place.get(x, 0) for x in STATES]
    return cost, rank


def folded(tables: Iterable[tuple[list[int], list[int]]]) -> tuple[list[int], list[int]]:
    """The table of successive blocks."""
    cost = [0 if e == x else INFINITE for e in STATES for x in STATES]
    rank = [0] * 16
    for c, r in tables:
        new_cost, new_rank = [INFINITE] * 16, [0] * 16
        for e in STATES:
            keys = {}
            for x in STATES:
                total, way = min((cost[4 * e + y] + c[4 * y + x], (rank[4 * e + y], r[4 * y + x])) for y in STATES)
                if total < INFINITE:
                    new_cost[4 * e + x], keys[x] = total, way
            for k, x in enumerate(sorted(keys, key=keys.get)):
                new_rank[4 * e + x] = k
        cost, rank = new_cost, new_rank
    return cost, rank


def route(tables: list[tuple[list[int], list[int]]], entry: int, goal: int | None = None) -> list[int]:
    """The states between blocks, ends included, of the cheapest way with the least audit; to the end of a conversation if there is no ``goal``."""
    cost, rank, back = {entry: 0}, {entry: 0}, []
    for c, r in tables:
        options = {}
        for x in STATES:
            found = [(cost[y] + c[4 * y + x], (rank[y], r[4 * y + x]), y) for y in cost if c[4 * y + x] < INFINITE]
            if found:
                options[x] = min(found)
        order = sorted(options, key=lambda x: options[x][1])
        cost = {x: options[x][0] for x in options}
        rank = {x: order.index(x) for x in options}
        back.append({x: options[x][2] for x in options})
    if goal is None:
        goal = min(cost, key=lambda x: (cost[x] + INSERT * len(ENDING[x]), rank[x]))
    states = [goal]
    for step in reversed(back):
        states.append(step[states[-1]])
    return states[::-1]


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [*KEYS, ("cost", pa.list_(pa.int64()), ""), ("rank", pa.list_(pa.int64()), "")]
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            cost, rank = block_table(lattice_turns(r["turns"], faults_of(r["turns"], set(r["firsts"] or ()))))
            rows.append({k: r[k] for k, _, _ in KEYS} | {"cost": cost, "rank": rank})
        yield batch_of(fields, rows)


def _fold_part(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("seq")
    cost, rank = folded(zip(rows["cost"], rows["rank"], strict=True))
    return pd.DataFrame({"_c": rows["_c"].iloc[:1], "part": rows["part"].iloc[:1], "cost": [cost], "rank": [rank]})


def _route_parts(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("part")
    states = route(list(zip(rows["cost"], rows["rank"], strict=True)), START)
    return pd.DataFrame({"_c": rows["_c"], "part": rows["part"], "entry": states[:-1], "goal": states[1:], "last": [False] * (len(rows) - 1) + [True]})


def _route_blocks(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("seq")
    states = route(list(zip(rows["cost"], rows["rank"], strict=True)), int(rows["entry"].iloc[0]), int(rows["goal"].iloc[0]))
    last = [False] * (len(rows) - 1) + [bool(rows["last"].iloc[0])]
    return pd.DataFrame({"_c": rows["_c"], "part": rows["part"], "seq": rows["seq"], "entry": states[:-1], "goal": states[1:], "last": last})


def _solve_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            faults = faults_of(r["turns"], set(r["firsts"] or ()))
            cost, audit = cheapest(lattice_turns(r["turns"], faults), r["entry"], (r["goal"],), False)
            ending = ENDING[r["goal"]] if r["last"] else ""
            rows.append({k: r[k] for k, _, _ in KEYS} | solved(r["turns"], faults, cost + INSERT * len(ending), audit + ending, r["entry"]))
        yield batch_of(KEYS + SOLVED, rows)


def _solve_open(blocks: DataFrame) -> DataFrame:
    """The blocks of conversations that may reach over several blocks."""
    named = F.coalesce(F.concat(F.lit("#"), F.col("conv_id").cast("string")), F.lit("none"))
    blocks = blocks.withColumn("_c", named)
    turns = blocks.select("_c", "part", "seq", F.posexplode("turns").alias("pos", "t"))
    place = F.shiftleft(F.shiftleft("part", 22) + F.col("seq"), 10) + F.col("pos")
    first = turns.groupBy("_c", "t.role", F.sha2("t.text", 256).alias("_h")).agg(F.min(place).alias("_p"))
    at = first.select(
        "_c", F.shiftright("_p", 32).alias("part"), (F.shiftright("_p", 10) % (1 << 22)).alias("seq"), (F.col("_p") % 1024).cast("int").alias("pos")
    )
    firsts = at.groupBy("_c", "part", "seq").agg(F.collect_set("pos").alias("firsts"))  # at most a block's turns
    known = blocks.join(firsts, ["_c", "part", "seq"], "left")
    tables = known.select("conv_id", "part", "seq", "turns", "firsts").mapInArrow(_tables, TABLE).withColumn("_c", named)
    tables = cut_lineage(tables.drop("conv_id"))
    parts = tables.groupBy("_c", "part").applyInPandas(_fold_part, "_c string, part long, cost array<long>, rank array<long>")
    ends = "entry long, goal long, last boolean"
    ways = parts.groupBy("_c").applyInPandas(_route_parts, f"_c string, part long, {ends}")
    inner = tables.join(ways, ["_c", "part"]).groupBy("_c", "part").applyInPandas(_route_blocks, f"_c string, part long, seq long, {ends}")
    inner = cut_lineage(inner)
    rows = known.join(inner, ["_c", "part", "seq"]).select("conv_id", "part", "seq", "turns", "firsts", "entry", "goal", "last")
    return rows.mapInArrow(_solve_blocks, ddl(KEYS + SOLVED))


def repair_conversations(turns: DataFrame, block: int = BLOCK, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per block: conv_id, part and seq (the order of its blocks), whole (the conversation has no other block), cost, audit, counts of faults, roles and turns at its
    ends, and the repaired turns. ``turns``: conv_id, turn, role, text; ``block`` is at most 1024."""
    spark = turns.sparkSession
    bound_batches(spark)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), space("role"), space("text"), F.monotonically_increasing_id().alias("_nr"))
    order = ["conv_id", "turn", "role", "text", "_nr"]  # the last so that equal rows can be told apart and spread
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_nr").withColumn("part", F.spark_partition_id().cast("long"))
    folder = shared_folder(spark, "conversations")
    spread.mapInArrow(lambda b: _cut(b, block, block_chars), ddl(KEYS + WHOLE + TURNS + SOLVED)).write.parquet(folder)
    blocks = spark.read.parquet(folder)
    names = [n for n, _, _ in KEYS + SOLVED]
    inside = blocks.where("whole").select(*names, F.lit(True).alias("whole"))
    others = _solve_open(blocks.where("not whole").select("conv_id", "part", "seq", "turns"))
    return inside.unionByName(others.select(*names, F.lit(False).alias("whole")))


# one row per conversation

DIGEST = [
    ("conv_id", pa.int64(), "long"),
    *[(n, pa.int64(), "long") for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
    ("audit", pa.string(), "string"),
    ("repaired_sha256", pa.string(), "string"),
]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations from their blocks in order, one block at a time."""
    now: dict = {}

    def finish() -> dict:
        turns = 0 if now["first"] is None else now["last"] - now["first"] + 1 - now["n"]
        return now["sums"] | {"conv_id": now["key"][0], "gaps": turns, "audit": "".join(now["audits"]), "repaired_sha256": now["hash"].hexdigest()}

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if not now or (r["conv_id"],) != now["key"]:
                if now:
                    out.append(finish())
                sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
                now = {"key": (r["conv_id"],), "first": None, "last": None, "n": 0, "sums": sums, "audits": [], "hash": hashlib.sha256(), "role": None, "lines": 0}
            for c in now["sums"]:
                now["sums"][c] += r[c]
            if now["role"] is not None and now["role"] + r["first_role"] not in LEGAL:
                now["sums"]["illegal"] += 1
            now["role"] = r["last_role"]
            if r["first_turn"] is not None:
                now["n"] += r["n_turns"] - (r["first_turn"] == now["last"])
                now["first"] = r["first_turn"] if now["first"] is None else now["first"]
                now["last"] = r["last_turn"]
            now["audits"].append(r["audit"])
            for line in r["repaired"]:
                now["hash"].update((("\n" if now["lines"] else "") + f"{line['role']}:{line['text']}").encode())
                now["lines"] += 1
        if out:
            yield batch_of(DIGEST, out)
    if now:
        yield batch_of(DIGEST, [finish()])


def digest_columns(repaired_blocks: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each ``conv_id`` of ``conversations``: gaps, faults, cost, audit and the hash of the repaired text."""
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0).cast("long"))
    names = [n for n, _, _ in DIGEST]
    short = repaired_blocks.where("whole").select("conv_id", gaps.alias("gaps"), *names[2:8], F.sha2(lines, 256).alias("repaired_sha256"))
    long = repaired_blocks.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    columns = ["conv_id", *names[2:8], "first_role", "last_role", "first_turn", "last_turn", "n_turns", "repaired"]
    found = short.unionByName(long.select(*columns).mapInArrow(_digest, ddl(DIGEST)))
    every = conversations.select(F.col("conv_id").cast("long").alias("_id")).distinct()
    joined = every.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return joined.select(
        F.col("_id").alias("conv_id"),
        *[zero(c) for c in names[1:7]],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
