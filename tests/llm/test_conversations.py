"""Conversation repair against an enumeration over all edits and a plain label-correcting search."""

import hashlib
import random
import re
import zlib

import pytest

from urlrisk.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string, cost string, part string"


def plain_damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """Whole conversations, place by place: for each state the least (cost, audit, lines)."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        marks = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"": (0, "", ())}

    def offer(to, state, label):
        if state not in to or label < to[state]:
            to[state] = label

    def insertions(at):
        for _ in range(3):
            for state, (cost, audit, lines) in list(at.items()):
                role = "assistant" if state == "u" else "user"
                offer(at, role[0], (cost + 5, audit + "I", (*lines, f"{role}:")))

    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        insertions(best)
        after = {}
        for state, (cost, audit, lines) in best.items():
            offer(after, state, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault else 0
            follows = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
            if role and role[0] in follows:
                offer(after, role[0], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
            new = "assistant" if state == "u" else "user"
            offer(after, new[0], (cost + more + 1, audit + "R", (*lines, f"{new}:{text}")))
        best = after
    insertions(best)
    cost, audit, lines = min(best[s] for s in ("", "a") if s in best)
    turns = [r[1] for r in rows if r[1] is not None]
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    count = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain_digest(rows, damaged):
    out = set()
    for conv in {r[0] for r in rows}:
        out.add((conv, *plain_repair([r for r in damaged if r[0] == conv])))
    return out


def random_turns(rng, n, conv):
    rows = []
    for t in range(n):
        role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]) if rng.random() < 0.4 else ("user", "assistant")[t % 2]
        text = rng.choice(["Yes.", "No!", "Well", "so it goes on", "What? ", f"Turn {rng.randrange(6)}.", f"Number {t} ends here.", "", " \n", "ends. 。"])
        rows.append((conv, None if rng.random() < 0.05 else t + rng.choice((0, 0, 0, 1, 3)), role, text, "x", "y"))
    return rows


@pytest.mark.parametrize("block", [3, 256])
def test_against_plain_version(spark, block):
    """Small blocks send conversations through the tables of blocks; the result is the same."""
    rng = random.Random(11)
    rows = []
    for conv in range(40):
        rows += random_turns(rng, rng.choice((1, 2, 5, 9, 14)), conv)
    rows += [(None, 1, "user", "No id.", None, None), (None, 2, None, None, None, None), (50, None, "user", "Hi.", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    damaged = plain_damage(rows)
    assert sorted(map(repr, map(tuple, c.damage(df).collect()))) == sorted(map(repr, damaged))
    got = {tuple(r) for r in c.digest_columns(c.repair_conversations(c.damage(df), block), df).collect()}
    assert got == plain_digest(rows, damaged)


def test_long_conversation_over_partitions(spark):
    """One conversation holds most rows and spans all partitions; repeated texts lie far apart."""
    rng = random.Random(3)
    rows = random_turns(rng, 700, 1) + random_turns(rng, 20, 0) + random_turns(rng, 20, 2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    damaged = plain_damage(rows)
    blocks = c.repair_conversations(c.damage(df), 16)
    assert blocks.where("conv_id = 1").count() > 30
    got = {tuple(r) for r in c.digest_columns(blocks, df).collect()}
    assert got == plain_digest(rows, damaged)


def test_search_finds_every_tie():
    """All pairs of ends of random lattices against a search over all audits."""
    rng = random.Random(5)
    for _ in range(150):
        turns = [(rng.choice("suax"), rng.choice(["", "", "blank", "truncated"])) for _ in range(rng.randrange(5))]
        trailing = rng.random() < 0.5
        for entry in c.STATES:
            best: dict = {}
            stack = [(0, "", 0, entry)]
            while stack:
                cost, audit, i, state = stack.pop()
                if cost > 25 or audit.endswith("III"):
                    continue
                if i == len(turns):
                    best[state] = min(best.get(state, (cost, audit)), (cost, audit))
                stack += [(cost + w, audit + e, j, to) for w, e, j, to in c.ahead(turns, i, state, trailing)]
            for x in c.STATES:
                assert c.cheapest(turns, entry, (x,), trailing) == best.get(x)
            ends = [best[x] for x in (c.START, c.ASSISTANT) if x in best]
            assert c.cheapest(turns, entry, (c.START, c.ASSISTANT), trailing) == (min(ends) if ends else None)


def test_empty_and_dropped(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert c.digest_columns(c.repair_conversations(c.damage(df)), df).count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "All of it.", "", "")], SCHEMA)
    got = [tuple(r) for r in c.digest_columns(c.repair_conversations(c.damage(df)), df).collect()]
    assert got == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_turns_are_legal(spark):
    rng = random.Random(8)
    rows = [r for conv in range(20) for r in random_turns(rng, 10, conv)]
    df = spark.createDataFrame(rows, SCHEMA)
    for r in c.repair_conversations(df).collect():
        assert re.fullmatch("(s?(ua)+)?", "".join(t["role"][0] for t in r["repaired"]))
