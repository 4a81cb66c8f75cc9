"""Conversation structure repair: the cheapest edits to strictly alternating turns, by dynamic programming with checkpoints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portage.llm.common import in_tasks, staged, table

#: White space of the contract: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"

#: What a row is to the repair: the initial of its role, and whether it must go or ends early.
INITIALS = "sua"
OTHER, MUST_GO, CUT, ABSENT = 3, 4, 8, 16

#: States: nothing yet, after the system turn, after a user's, after an assistant's. A conversation may end in the first and last.
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
TURN_TO = (USER, USER, ASSISTANT, USER)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}

DELETE_COST, INSERT_COST, REROLE_COST, CUT_COST = 3, 2, 2, 1

Vector = tuple[int, int, int, int]


def _with_inserts(cost: list[int]) -> Vector:
    """Costs to go once turns may be inserted; two inserts in a row lead back to the same state, so one round is enough."""
    user = min(cost[USER], INSERT_COST + cost[ASSISTANT])
    assistant = min(cost[ASSISTANT], INSERT_COST + cost[USER])
    return min(cost[START], INSERT_COST + user), min(cost[SYSTEM], INSERT_COST + user), user, assistant


AT_END = _with_inserts([0, 1 << 60, 1 << 60, 0])


def _before(symbol: int, after: Vector) -> Vector:
    """Costs to go from each state in front of a row, given those behind it."""
    cost = [DELETE_COST + a for a in after]
    if not symbol & MUST_GO:
        extra, initial = CUT_COST if symbol & CUT else 0, symbol & 3
        for state in range(4):
            cost[state] = min(cost[state], REROLE_COST + extra + after[TURN_TO[state]])
            kept = KEEP.get((state, initial))
            if kept is not None:
                cost[state] = min(cost[state], extra + after[kept])
    return _with_inserts(cost)


def cheapest_edits(symbols: bytes) -> tuple[int, str]:
    """The least cost and the ASCII-least cheapest edits (D, I, K, R) of a conversation given as one symbol a row.

    Going backward, only the cost vectors in front of every block of about ``sqrt(n)`` rows are stored; going forward,
    the vectors of one block at a time are computed again, so ``n`` rows need about ``2 * sqrt(n)`` vectors at once.
    In every state each letter leads to one state only, so the least letter that still reaches the least cost is right.
    """
    n = len(symbols)
    size = isqrt(n) + 1
    marks = [AT_END] * (n // size + 2)  # marks[b] is in front of row b * size; AT_END behind the last row
    vector = AT_END
    for i in range(n - 1, -1, -1):
        vector = _before(symbols[i], vector)
        if i % size == 0:
            marks[i // size] = vector
    total, state, edits = vector[START], START, bytearray()
    for low in range(0, n, size):
        high = min(low + size, n)
        vectors = [marks[high // size] if high < n else AT_END]
        for i in range(high - 1, low - 1, -1):
            vectors.append(_before(symbols[i], vectors[-1]))
        vectors.reverse()
        for i in range(low, high):
            here, after = vectors[i - low], vectors[i - low + 1]
            symbol = symbols[i]
            while True:
                left = here[state]
                if DELETE_COST + after[state] == left:
                    edits += b"D"
                    break
                if INSERT_COST + here[TURN_TO[state]] == left:
                    edits += b"I"
                    state = TURN_TO[state]
                    continue
                kept = KEEP.get((state, symbol & 3))
                if kept is not None and (CUT_COST if symbol & CUT else 0) + after[kept] == left:
                    edits += b"K"
                    state = kept
                else:
                    edits += b"R"
                    state = TURN_TO[state]
                break
    while AT_END[state]:
        edits += b"I"
        state = TURN_TO[state]
    return total, edits.decode()


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of ``turns`` (``conv_id``, ``turn``, ``role``, ``text``) with faults that a hash of id and turn decides.

    Nulls of role, text and of the hashed id and turn count as one blank. A dropped row stays as one that is ``absent``,
    so that its conversation is known; other columns are left aside.
    """
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    name = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit(" ")) for c in (conv, turn)])
    rows = turns.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), F.crc32(name.cast("binary")).alias("h"))
    kind = F.col("h") % 20
    rows = rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (kind == 0).alias("absent"), F.when(kind == 3, 2).otherwise(1).alias("copies"),
    )
    return rows.select("conv_id", "turn", "role", "text", "absent", F.explode(F.sequence(F.lit(1), "copies"))).drop("col")


def _ordered(turns: DataFrame, absent: str | None) -> DataFrame:
    """``turns`` with ``digest``, which orders rows of one turn that agree in their role, and tells equal rows."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    absent = F.lit(False) if absent is None else F.col(absent)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        absent.alias("absent"),
    )
    said = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.withColumn("digest", F.unhex(F.sha2(said.cast("binary"), 256)))


def _symbol() -> Column:
    """A row's initial and marks, from ``role``, ``tail`` (the last character that is no white space), ``again`` and ``absent``."""
    initial = F.instr(F.lit(INITIALS), F.left("role", F.lit(1))) - 1
    initial = F.when((F.col("role") == "") | (initial < 0), OTHER).otherwise(initial)
    must_go = (F.col("tail") == "") | F.col("again")
    return (
        initial
        + F.when(must_go, MUST_GO).otherwise(0)
        + F.when(~must_go & ~F.col("tail").isin(".", "!", "?"), CUT).otherwise(0)
        + F.when(F.col("absent"), ABSENT).otherwise(0)
    )


PLAN = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def repair_plans(turns: DataFrame, absent: str | None = None) -> DataFrame:
    """One row per conversation of ``turns``: its faults, the least cost of a repair, and the edits as ``audit``.

    Rows go by turn, null first; rows of one turn by role and a SHA-256 digest of their text, which also tells rows seen
    before. Null roles and texts are one blank; rows without conv_id are one conversation without id; rows for which
    the column ``absent`` holds only name their conversation. The repair gives ``(s?(ua)+)?`` by role initials: it keeps rows (free), gives them
    the role user or assistant (2), deletes them (3; blank and repeated ones must go) and inserts empty turns (2); a
    truncated row that stays costs 1.

    Texts stay behind: a conversation comes to its task as one byte a row, in order, and its audit, one cell of the
    result, has at least as many. The vectors of the dynamic programme are only kept at checkpoints. An empty table
    gives no rows.
    """
    tail = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1)).alias("tail")
    light = _ordered(turns, absent).select("conv_id", "turn", "role", "digest", "absent", tail)
    seen = Window.partitionBy("conv_id", "digest", "absent").orderBy(F.col("turn").asc_nulls_first())
    # One exchange: rows dealt by conversation are also together by conversation and digest.
    dealt = light.repartition("conv_id").withColumn("again", F.row_number().over(seen) > 1)
    dealt = dealt.withColumns({"blank": F.col("tail") == "", "symbol": _symbol().cast("int")})
    dealt = dealt.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "digest", "again")
    schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in PLAN.split(", ")])

    def closed(conv: int | None, symbols: bytearray, turns_seen: list) -> dict:
        blank, duplicate, distinct, low, high = turns_seen
        rows = bytes(symbols)
        cost, audit = cheapest_edits(rows)
        initials = [s & 3 for s in rows]
        legal = {(0, 1), (1, 2), (2, 1)}
        illegal = sum(pair not in legal for pair in zip(initials, initials[1:]))
        gaps = high - low + 1 - distinct if distinct else 0
        cut = sum(1 for s in rows if s & CUT)
        return dict(zip(schema.names, (conv, gaps, blank, duplicate, cut, illegal, cost, audit)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, conv, symbols, state, last = False, None, bytearray(), [0, 0, 0, 0, 0], None
        for batch in batches:
            out = []
            for name, turn, blank, symbol in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if not open_ or name != conv:
                    if open_:
                        out.append(closed(conv, symbols, state))
                    open_, conv, symbols, state, last = True, name, bytearray(), [0, 0, 0, 0, 0], None
                if symbol & ABSENT:
                    continue
                symbols.append(symbol)
                if symbol & MUST_GO:
                    state[0 if blank else 1] += 1
                if turn is not None and turn != last:
                    if state[2] == 0:
                        state[3] = turn
                    state[2], state[4], last = state[2] + 1, turn, turn
            yield pa.RecordBatch.from_pylist(out, schema)
        if open_:
            yield pa.RecordBatch.from_pylist([closed(conv, symbols, state)], schema)

    return in_tasks(dealt.select("conv_id", "turn", "blank", "symbol"), run, PLAN)


def repaired(turns: DataFrame, plans: DataFrame, absent: str | None = None) -> DataFrame:
    """The repaired conversations: ``conv_id``, ``step`` (from 0, in order), ``edit`` (K, R or I), ``turn``, ``role``, ``text``.

    The edits of a conversation come before its rows, sorted as ``repair_plans`` sorts them, and both are read as one
    stream: beside the audit only one batch of rows is in memory. Inserted turns have no number and an empty text.
    Rows of a conversation come out together and in order.
    """
    rows = _ordered(turns, absent).where("not absent").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text")
    edits = plans.where("audit <> ''").select(
        "conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
        F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"),
    )
    dealt = rows.unionByName(edits).repartition("conv_id")
    dealt = dealt.sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "digest")
    schema = pa.schema([
        ("conv_id", pa.int64()), ("step", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, left, state, step = None, "", 0, 0, START, 0
        for batch in batches:
            out = []

            def put(edit: str, turn: int | None, role: str, text: str) -> None:
                nonlocal step
                out.append((conv, step, edit, turn, role, text))
                step += 1

            for name, kind, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if kind == 0:
                    conv, audit, at, left, state, step = name, text, 0, len(text) - text.count("I"), START, 0
                else:
                    while audit[at] == "I":
                        state, at = TURN_TO[state], at + 1
                        put("I", None, ROLE_OF[state], "")
                    edit, at, left = audit[at], at + 1, left - 1
                    if edit == "K":
                        state = KEEP[state, INITIALS.index(role[0])]
                        put("K", turn, role, text)
                    elif edit == "R":
                        state = TURN_TO[state]
                        put("R", turn, ROLE_OF[state], text)
                while not left and at < len(audit):  # what is inserted at the end follows the last row
                    state, at = TURN_TO[state], at + 1
                    put("I", None, ROLE_OF[state], "")
            columns = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    wanted = dealt.select("conv_id", "kind", "turn", "role", "text")
    return in_tasks(wanted, run, "conv_id long, step long, edit string, turn long, role string, text string")


def conversation_digests(rows: DataFrame) -> DataFrame:
    """``conv_id`` and ``sha256`` of the ``role:text`` lines of each conversation of ``repaired``, read as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None
        for batch in batches:
            names, found = [], []
            for name, step, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if step == 0:
                    if digest is not None:
                        names.append(conv)
                        found.append(digest.hexdigest())
                    conv, digest = name, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(found, pa.string())], ["conv_id", "sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()])], ["conv_id", "sha256"])

    return in_tasks(rows.select("conv_id", "step", "role", "text"), run, "conv_id long, sha256 string")


def op13_conversation_structure_repair(spark, sf_dir):
    turns = damaged(table(spark, sf_dir, "conversations"))
    plans = staged(repair_plans(turns, "absent"), "repair-plans")
    found = conversation_digests(repaired(turns, plans, "absent"))
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return plans.join(found.withColumnRenamed("conv_id", "conv"), F.col("conv").eqNullSafe(F.col("conv_id")), "left").select(
        *plans.columns, F.coalesce("sha256", empty).alias("repaired_sha256")
    )
