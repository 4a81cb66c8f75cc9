"""Chat formatting: schema fingerprints pick the mapping to canonical turns, which one template formats and unformats."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portage.llm.common import in_tasks, table

#: The strings that mark turns, here and in other templates. None of them survives inside a text.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTROLS = (OPEN, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>")

#: An escaped backslash, and what stands for the first character of a control string.
ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b", "\n": "\\n"}

LEARNED_ROLE = "assistant"

#: Where layouts keep their turns. Each mapping has the field paths a record must have, those it may have, and its turns:
#: a list of turns with the fields of role and text, or single fields with the role they stand for.
MAPPINGS = {
    "turn rows": {"paths": {"conv_id", "turn", "role", "text"}, "rows": ("conv_id", "turn", "role", "text")},
    "messages": {"paths": {"messages", "messages.role", "messages.content"}, "turns": ("messages", "role", "content")},
    "shared": {"paths": {"conversations", "conversations.from", "conversations.value"}, "turns": ("conversations", "from", "value")},
    "prompt": {"paths": {"prompt", "completion"}, "fields": [("system", "system"), ("user", "prompt"), ("assistant", "completion")]},
    "response": {"paths": {"prompt", "response"}, "fields": [("system", "system"), ("user", "prompt"), ("assistant", "response")]},
    "instruction": {
        "paths": {"instruction", "output"},
        "fields": [("system", "system"), ("user", ("instruction", "input")), ("assistant", "output")],
    },
    "question": {"paths": {"question", "answer"}, "fields": [("system", "system"), ("user", "question"), ("assistant", "answer")]},
}

#: Field paths that do not tell layouts apart, and the names that other tools give roles.
OPTIONAL = {"system", "input"}
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths: set[str]) -> str:
    """The hash of a layout's nested field paths, in any order and without the optional ones."""
    return hashlib.sha256("\n".join(sorted(paths - OPTIONAL)).encode()).hexdigest()[:16]


KNOWN = {fingerprint(m["paths"]): name for name, m in MAPPINGS.items()}


def schema_paths(kind: T.DataType, above: str = "") -> set[str]:
    """The nested field paths of a type; elements of a list have the list's path."""
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, above)
    if not isinstance(kind, T.StructType):
        return set()
    out: set[str] = set()
    for field in kind.fields:
        path = f"{above}.{field.name}" if above else field.name
        out |= {path} | schema_paths(field.dataType, path)
    return out


def value_paths(value, above: str = "") -> set[str]:
    """The same for a parsed JSON value; null fields do not count."""
    if isinstance(value, list):
        return set().union(*(value_paths(v, above) for v in value)) if value else set()
    if not isinstance(value, dict):
        return set()
    out: set[str] = set()
    for name, inner in value.items():
        if inner is not None:
            path = f"{above}.{name}" if above else name
            out |= {path} | value_paths(inner, path)
    return out


def mapping_for(paths: set[str]) -> dict | None:
    """The mapping of these field paths: that of their fingerprint, or of the known layout within them that says most."""
    if name := KNOWN.get(fingerprint(paths)):
        return MAPPINGS[name]
    within = [m for m in MAPPINGS.values() if m["paths"] <= paths]
    return max(within, key=lambda m: len(m["paths"]), default=None)


def turns_of(record: dict) -> list[tuple[str, str]] | None:
    """Canonical turns of a parsed record, or None if its layout is unknown."""
    mapping = mapping_for(value_paths(record))
    if mapping is None or "rows" in mapping:
        return None
    if "turns" in mapping:
        field, role, text = mapping["turns"]
        turns = [(t.get(role), t.get(text)) for t in record[field] if isinstance(t, dict)]
    else:
        turns = []
        for role, names in mapping["fields"]:
            parts = [record.get(n) for n in ([names] if isinstance(names, str) else names)]
            if any(p is not None for p in parts):
                turns.append((role, "\n\n".join(str(p) for p in parts if p not in (None, ""))))
    return [(ROLES.get(str(r or ""), str(r or "")), "" if t is None else str(t)) for r, t in turns]


def canonical_records(records: DataFrame, record_id: str, raw: str) -> DataFrame:
    """Turn rows (``conv_id``, ``turn``, ``role``, ``text``) of JSON records of any known layout, chosen record by record.

    A record of an unknown layout, or one that is null or no JSON object, has one row with all but ``conv_id`` null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    record = json.loads(body) if body is not None else None
                except ValueError:
                    record = None
                turns = turns_of(record) if isinstance(record, dict) else None
                if turns is None:
                    out.append({"conv_id": name, "turn": None, "role": None, "text": None})
                else:
                    out += [{"conv_id": name, "turn": i, "role": r, "text": t} for i, (r, t) in enumerate(turns)]
            yield pa.RecordBatch.from_pylist(out, pa.schema(
                [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]
            ))

    rows = records.select(F.col(record_id).cast("long").alias("conv_id"), F.col(raw).cast("string").alias("raw"))
    return in_tasks(rows, run, "conv_id long, turn long, role string, text string")


def canonical(data: DataFrame) -> DataFrame:
    """Turn rows of a table whose own schema is a known layout; ``ValueError`` if it is not.

    The schema's fingerprint selects the mapping. Further columns and nested fields are left aside. Layouts with a
    conversation per row need a ``conv_id`` column.
    """
    mapping = mapping_for(schema_paths(data.schema))
    if mapping is None:
        raise ValueError(f"no layout is known for the fields {sorted(schema_paths(data.schema))}")
    if "rows" in mapping:
        conv, turn, role, text = (F.col(c) for c in mapping["rows"])
        return data.select(conv.cast("long").alias("conv_id"), turn.cast("long").alias("turn"), role.cast("string").alias("role"), text.cast("string").alias("text"))
    if "turns" in mapping:
        field, role, text = mapping["turns"]
        turns = F.transform(field, lambda t: F.struct(t[role].cast("string").alias("role"), t[text].cast("string").alias("text")))
    else:
        found = []
        for role, names in mapping["fields"]:
            there = [F.col(n).cast("string") for n in ([names] if isinstance(names, str) else names) if n in data.columns]
            if there:
                said = F.concat_ws("\n\n", *[F.nullif(c, F.lit("")) for c in there])
                found.append(F.when(reduce(lambda a, b: a | b, [c.isNotNull() for c in there]), F.struct(F.lit(role).alias("role"), said.alias("text"))))
        turns = F.array_compact(F.array(*found))
    renamed = reduce(lambda rest, old: F.when(F.col("turn_.role") == old, F.lit(ROLES[old])).otherwise(rest), ROLES, F.col("turn_.role"))
    return data.select(F.col("conv_id").cast("long").alias("conv_id"), F.posexplode(turns).alias("turn", "turn_")).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), renamed.alias("role"), F.col("turn_.text").alias("text")
    )


def escape(text: Column, line: bool = False) -> Column:
    """``text`` without control strings, reversibly; with ``line`` also without line breaks."""
    text = F.replace(text, F.lit("\\"), F.lit(ESCAPES["\\"]))
    for control in CONTROLS:
        text = F.replace(text, F.lit(control), F.lit(ESCAPES[control[0]] + control[1:]))
    return F.replace(text, F.lit("\n"), F.lit(ESCAPES["\n"])) if line else text


def formatted(turns: DataFrame) -> DataFrame:
    """``turns`` with ``piece``: the turn as it stands in the formatted conversation, which is its pieces in order.

    A piece opens the turn, names its role on the first line, has the text, and closes the turn. Null roles and texts
    are empty. Only what lies between the first line and the end of an assistant's piece is under the loss mask.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return turns.select("conv_id", "turn", F.concat(
        F.lit(OPEN), escape(role, line=True), F.lit("\n"), escape(text), F.lit(CLOSE + "\n")
    ).alias("piece"))


_PIECE = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE) + "\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_MEANT = {code[1]: char for char, code in ESCAPES.items()}


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _MEANT[m[1]], text)


def read_turns(piece: str) -> Iterator[tuple[str, str]]:
    """The roles and texts of formatted turns; ``ValueError`` if anything lies outside of turns."""
    at = 0
    for found in _PIECE.finditer(piece):
        if found.start() != at:
            break
        yield unescape(found[1]), unescape(found[2])
        at = found.end()
    if at != len(piece):
        raise ValueError(f"no turn begins at {piece[at : at + 40]!r}")


def digests(pieces: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted pieces.

    ``n_turns``, ``turns_sha256`` (role, line break, text, line break of each turn), ``loss_chars`` and ``loss_sha256``
    (the texts under the loss mask), ``formatted_chars``. The pieces of a conversation come sorted and are read as a
    stream, so a conversation of any length needs no more memory than its longest turn. Turns go by number, null first;
    turns with equal numbers, and repeated rows, are all kept, in the order of their pieces. Rows without conv_id form
    one conversation without id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            out = []
            for conv, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if state is None or conv != current:
                    if state is not None:
                        out.append(closed(current, state))
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[4] += len(piece)
                for role, text in read_turns(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    if role == LEARNED_ROLE:
                        state[2] += len(text)
                        state[3].update(text.encode())
            yield pa.RecordBatch.from_pylist(out, schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([closed(current, state)], schema)

    def closed(conv: int | None, state: list) -> dict:
        return dict(zip(schema.names, (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])))

    schema = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ])
    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "piece").select("conv_id", "piece")
    return in_tasks(
        dealt, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


#: The conversation that says control strings only.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op10_chat_formatting(spark, sf_dir):
    turns = canonical(table(spark, sf_dir, "conversations"))
    probe = canonical(spark.createDataFrame(PROBE, turns.schema))
    return digests(formatted(turns.unionByName(probe)))
