"""Conversation repair against brute force: plain Python over whole conversations and a shortest-path search without checkpoints."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from portage.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, digest string, absent int"


def shortest(rows):
    """Dijkstra over (row, state) by (cost, audit): rows are (initial, must go, cut). Returns the least cost and audit."""
    moves = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    queue, done = [(0, "", 0, "")], set()
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit
        wanted = "a" if state == "u" else "u"
        heapq.heappush(queue, (cost + 2, audit + "I", i, wanted))
        if i < len(rows):
            initial, must_go, cut = rows[i]
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, state))
            if not must_go:
                heapq.heappush(queue, (cost + 2 + cut, audit + "R", i + 1, wanted))
                if initial in moves[state]:
                    heapq.heappush(queue, (cost + cut, audit + "K", i + 1, moves[state][initial]))


def plain(rows, conv):
    """The contract's columns for the damaged rows of one conversation, in order."""
    blank = duplicate = cut = 0
    seen, judged = set(), []
    for turn, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        is_blank = body == ""
        again = not is_blank and (role, text) in seen
        short = not is_blank and not again and body[-1] not in ".!?"
        seen.add((role, text))
        blank, duplicate, cut = blank + is_blank, duplicate + again, cut + short
        judged.append((role[:1], is_blank or again, int(short)))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [j[0] for j in judged]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = shortest(judged)
    lines, state, left = [], "", iter(rows)
    for edit in audit:
        row = None if edit == "I" else next(left)
        if edit == "D":
            continue
        wanted = "assistant" if state == "u" else "user"
        role = row[1] if edit == "K" else wanted
        lines.append(f"{role}:{'' if row is None else row[2]}")
        state = role[0]
    return (conv, gaps, blank, duplicate, cut, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        kept = out.setdefault(conv, [])
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        kept += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r))) for c, v in out.items()}


def digest(row):
    return hashlib.sha256(f"{len(row[1])}:{row[1]}{row[2]}".encode()).digest()


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def queried(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    found = repair.op13_conversation_structure_repair(spark, str(tmp_path))
    assert found.columns == COLUMNS
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize("length", [0, 1, 2, 3, 5, 9, 16, 17, 40])
def test_least_cost_and_audit_equal_the_shortest_path(length):
    draw = random.Random(length)
    for _ in range(300):
        rows = [(draw.choice("suuaaax"), draw.random() < 0.2, int(draw.random() < 0.3)) for _ in range(length)]
        rows = [(r, g, 0 if g else c) for r, g, c in rows]
        symbols = bytes(
            (repair.INITIALS.index(r) if r in "sua" else repair.OTHER) + repair.MUST_GO * g + repair.CUT * c for r, g, c in rows
        )
        assert repair.cheapest_edits(symbols) == shortest(rows)


def test_a_long_conversation_stores_vectors_at_checkpoints_only():
    draw = random.Random(4)
    symbols = bytes(draw.choice([0, 1, 2, 1, 2, 3, 5, 9, 10]) for _ in range(100_000))
    cost, audit = repair.cheapest_edits(symbols)
    again = {"D": 3, "I": 2, "R": 2, "K": 0}
    kept = [s for s, e in zip(symbols, audit.replace("I", "")) if e != "D"]
    assert len(audit.replace("I", "")) == len(symbols)
    assert cost == sum(again[e] for e in audit) + sum(1 for s in kept if s & repair.CUT)


def test_query_equals_plain_python(spark, tmp_path):
    draw = random.Random(8)
    said = ["Yes.", "no", "What?", " ", "", "Done! ", "end.\n", "a\tb", "été.", "x" * 3000 + "."]
    rows = [
        (conv, turn if draw.random() < 0.9 else turn + 2, draw.choice(["system", "user", "assistant", "assistant", "tool"]), draw.choice(said))
        for conv in range(300) for turn in range(draw.randrange(9))
    ]
    rows += [(None, 1, "user", "hi."), (None, None, "assistant", None), (900, None, None, "x"), (900, 3, "", "y."), (900, 3, "user", None)]
    rows += [(901, 1, "user", "same.")] * 5 + [(902, i, "user" if i % 2 else "assistant", f"t{i}.") for i in range(3000)]
    assert queried(spark, tmp_path, rows) == sorted((plain(v, c) for c, v in damage(rows).items()), key=repr)


def test_rows_that_are_repaired(spark):
    rows = [(1, 1, "assistant", "A."), (1, 2, "user", "B."), (1, 3, "user", "B."), (2, 1, "user", " "), (3, 5, "tool", "cut")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plans = repair.repair_plans(turns)
    assert {r.conv_id: (r.cost, r.audit) for r in plans.collect()} == {1: (7, "IKKDI"), 2: (3, "D"), 3: (3, "D")}
    found = repair.repaired(turns, plans).collect()
    by_conv = {c: [(r.edit, r.turn, r.role, r.text) for r in found if r.conv_id == c] for c in (1, 2, 3)}
    for conv, made in by_conv.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(r[2][0] for r in made))
    assert by_conv[2] == []


def test_empty_table(spark, tmp_path):
    assert queried(spark, tmp_path, []) == []
