"""Stored procedures, functions, triggers and views: assemble, tokenise, rewrite, triage, quarantine.

``lines(owner, name, type, line, text)`` is the source catalog. A body is one row, rewritten by the column
expressions of ``portage.functions.rewrite_rules``; bodies never meet each other except in the joins below.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portage.functions import rewrite_rules as R
from portage.operators.graph import blocked_by_failure
from portage.session import new_work_dir, stage

_KEY = ["owner", "name", "type"]


def assemble(lines: DataFrame) -> DataFrame:
    """One row per object: its lines in order, joined by line feeds.

    An object is translated as a whole, whatever its length, so its text is one value. A group is one stored object:
    the databases bound its lines, and Spark its text to 2 GB; a longer one fails the job rather than being cut.
    """
    return (
        lines.groupBy(*_KEY)
        .agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("parts"))
        .select(*_KEY, F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("body"))
    )


def view_bodies(views: DataFrame) -> DataFrame:
    """View texts as bodies: ``name AS text``."""
    return views.select(
        "owner", F.col("view_name").alias("name"), F.lit("VIEW").alias("type"),
        F.concat(F.lower("view_name"), F.lit(" AS "), F.col("text")).alias("body"),
    )


def tokens(bodies: DataFrame, key: list[str], body: str) -> DataFrame:
    """Whitespace tokens with their position; a parenthesis glued to the second word is detached from it."""
    detached = F.regexp_replace(F.regexp_replace(body, r"^\s+|\s+$", ""), r"^(\S+\s+[^\s(]+)\(", "$1 (")
    return bodies.select(*key, F.posexplode(F.split(detached, r"\s+")).alias("pos", "token"))


def apply_rules(bodies: DataFrame, rules: list[R.Rule], late: list | None = None) -> DataFrame:
    """The bodies with the rules applied outside literals and comments.

    ``late`` rules are made from the literals and run after the others.
    """
    out = bodies.withColumn("_atoms", R.literals(F.col("body"))).withColumn("_code", R.mask(F.col("body")))
    for rule in rules:
        out = out.withColumn("_code", rule(F.col("_code")))
    for make in late or []:
        out = out.withColumn("_code", make(F.col("_atoms"))(F.col("_code")))
    return out.withColumn("body", R.restore(F.col("_code"), F.col("_atoms"))).drop("_atoms", "_code")


def masked(bodies: DataFrame) -> DataFrame:
    return bodies.withColumn("_atoms", R.literals(F.col("body"))).withColumn("_code", R.mask(F.col("body")))


def reads_system_views(bodies: DataFrame, views: DataFrame) -> DataFrame:
    """Objects that read a view of the system owner and therefore cannot be translated."""
    reading = bodies.where(R.mentions(F.lower("body"), "from", "join"))
    names = masked(reading).select(*_KEY, F.explode(R.referenced_names(F.col("_code"))).alias("view_name"))
    system = views.where(F.col("owner") == "SYS").select(F.upper("view_name").alias("view_name")).distinct()
    return names.join(system, "view_name", "left_semi").select(*_KEY).distinct()


def _verdict(code: Column, lower: Column) -> Column:
    """Reason why the rewritten code cannot be used, or null. ``lower`` is the code, or more of it, in lower case."""
    known = r"(?i)\b(?:dbms_output\.put_line|raise_\w+)\s*\("
    return (
        F.when(code.rlike(r"(?is)\bBEGIN\b.*?\bBEGIN\b"), "factory")
        .when(R.mentions(lower, "dbms_") & F.regexp_replace(code, known, "").rlike(r"(?i)\bDBMS_"), "unsupported")
        .when(R.mentions(lower, "dbms_output", "raise_") & code.rlike(known), "review")
    )


def triage(bodies: DataFrame, views: DataFrame, schema: str) -> DataFrame:
    """``ok`` or ``failed`` with the reason, for every object.

    untranslatable: reads a system view; factory: a second BEGIN; unsupported: a package call no rule knows; review:
    nested parentheses where a rule stops at the first. ``bodies`` is read several times, so it should be a stored
    table.
    """
    return _triaged(bodies, views, schema).select(
        *_KEY, F.when(F.col("reason").isNull(), "ok").otherwise("failed").alias("status"), "reason"
    )


def _ruled(bodies: DataFrame, schema: str) -> DataFrame:
    """The bodies masked, with the general rules applied, and ``_verdict``: what is wrong with a body by itself."""
    out = masked(bodies).withColumn("_lower", F.lower("_code"))

    def only(rule: R.Rule, words: list[str]) -> Column:
        # A rule is run where the words are that it needs. No rule writes a word of a later one, and none
        # removes text within a word.
        return F.when(R.mentions(F.col("_lower"), *words), rule(F.col("_code"))).otherwise(F.col("_code"))

    for rule, words in R.general_steps(schema):
        out = out.withColumn("_code", only(rule, words))
    # The late rules are not run here: what matters is whether a call is left that none of them matches.
    left = only(lambda code: F.regexp_replace(code, r"(?i)\b(?:dbms_output\.put_line|raise_\w+)\s*\([^()]*\)\s*;", ""), ["dbms_output", "raise_"])
    return out.withColumn("_left", left).withColumn("_verdict", _verdict(F.col("_left"), F.col("_lower"))).drop("_left", "_lower")


def _triaged(bodies: DataFrame, views: DataFrame, schema: str, columns: dict[str, Column] | None = None) -> DataFrame:
    """Key, ``columns`` and ``reason`` of every object. All that is asked of the code is found before the join, so that
    only this moves and not the code."""
    system = reads_system_views(bodies, views).withColumn("_system", F.lit(True))
    return (
        _ruled(bodies, schema)
        .select(*_KEY, *[c.alias(n) for n, c in (columns or {}).items()], "_verdict")
        .join(system, _KEY, "left")
        .withColumn("reason", F.when(F.col("_system"), "untranslatable").otherwise(F.col("_verdict")))
        .drop("_verdict", "_system")
    )


def ready(bodies: DataFrame, views: DataFrame, schema: str) -> DataFrame:
    """Accepted bodies with the general rules applied, masked: ``_code`` and ``_atoms``.

    A written table, as the rewriters below read it several times. The code of bodies that are rejected by themselves does not
    move. It is blanked and not filtered out: a filter would be moved below the rules and run them twice.
    """
    fine = F.col("_verdict").isNull()
    accepted = _triaged(bodies, views, schema, {c: F.when(fine, F.col(c)) for c in ("_atoms", "_code")}).where(F.col("reason").isNull())
    return stage(accepted.drop("reason"), new_work_dir(bodies.sparkSession, "accepted-code"))


def _target(schema: str, name: Column) -> Column:
    return F.concat(F.lit(f"{schema}."), name)


def routine_text(schema: str, kind: Column, name: Column, code: Column) -> Column:
    """A translated procedure or function around rewritten, still masked code."""
    head = R.header_of(code)
    rest = R.after(code, head)
    signature = F.regexp_replace(
        F.regexp_replace(head, r"(?i)^\s*(?:PROCEDURE|FUNCTION)\s+[\w$#.\"]+|\b(?:IS|AS)$", ""),
        r"(?i)\bRETURN\b", "RETURNS",
    )
    declared = F.regexp_extract(rest, r"(?is)^(.*?)\bBEGIN\b", 1)
    block = F.regexp_extract(rest, r"(?is)\bBEGIN\b(.*)$", 1)
    record = R.loop_record(code)
    return F.concat(
        F.lit("CREATE OR REPLACE "), kind, F.lit(" "), _target(schema, name), F.trim(signature), F.lit(R.LANGUAGE_LINE),
        F.when(record != "", F.concat(record, F.lit("\n"))).otherwise(""),
        F.regexp_replace(declared, r"^\s+|\s+$", ""), F.lit("\nBEGIN\n"),
        F.regexp_replace(R.statements(block), r"^\s+", ""), F.lit(R.HANDLER),
    )


def trigger_function_text(schema: str, name: Column, block: Column) -> Column:
    """The function a trigger runs: the block without its end, then RETURN NEW."""
    return F.concat(
        F.lit("CREATE OR REPLACE FUNCTION "), _target(schema, F.concat(F.lit("fn_"), name)),
        F.lit(R.TRIGGER_FUNCTION_LINE), R.statements(R.drop_dual(block)), F.lit(R.TRIGGER_FUNCTION_END),
    )


def trigger_text(schema: str, name: Column, code: Column, function: Column, arguments: Column) -> Column:
    """The trigger itself: its head with the table qualified, running ``function``."""
    head = F.regexp_extract(code, r"(?is)^(.*?)\b(?:DECLARE|BEGIN|CALL)\b", 1)
    head = F.regexp_replace(head, r"(?i)^\s*TRIGGER\s+[\w$#.\"]+", "")
    head = R.qualify(schema, "ON")(head)
    return F.concat(
        F.lit("CREATE OR REPLACE TRIGGER "), name, F.lit(" "), F.regexp_replace(head, r"^\s+|\s+$", ""),
        F.lit("\nEXECUTE FUNCTION "), _target(schema, F.concat(F.lit("fn_"), function)), arguments, F.lit(";"),
    )


def called_routine(code: Column) -> Column:
    """Lower-case name behind CALL, empty for a trigger with a block."""
    return F.lower(F.regexp_extract(code, r"(?i)\bCALL\s+([\w$#]+)", 1))


def _emitted(rows: DataFrame, name: Column, kind: Column, text: Column) -> DataFrame:
    return rows.select(
        "owner", "name", "type", name.alias("target_name"), kind.alias("target_type"),
        R.restore(text, F.col("_atoms")).alias("script"),
    )


def _finish(rows: DataFrame) -> DataFrame:
    """The rules that write literal text, after everything else looked at the code."""
    for make in (R.raise_call, R.notices):
        rows = rows.withColumn("_code", make(F.col("_atoms"))(F.col("_code")))
    return rows


def rewrite_routines(accepted: DataFrame, schema: str) -> DataFrame:
    rows = accepted.where(F.col("type").isin("PROCEDURE", "FUNCTION")).withColumn("target", F.lower("name"))
    rows = rows.withColumn("_code", routine_text(schema, F.col("type"), F.col("target"), F.col("_code")))
    return _emitted(_finish(rows), F.col("target"), F.col("type"), F.col("_code"))


def rewrite_block_triggers(accepted: DataFrame, schema: str) -> DataFrame:
    """A trigger with a block becomes two objects: its function and the trigger that runs it."""
    rows = accepted.where((F.col("type") == "TRIGGER") & (called_routine(F.col("_code")) == "")).withColumn(
        "target", F.lower("name")
    )
    block = F.regexp_extract(F.col("_code"), r"(?is)\b(?:DECLARE|BEGIN)\b.*$", 0)
    both = F.array(
        F.struct(
            F.concat(F.lit("fn_"), F.col("target")).alias("target_name"), F.lit("FUNCTION").alias("target_type"),
            trigger_function_text(schema, F.col("target"), block).alias("_code"),
        ),
        F.struct(
            F.col("target").alias("target_name"), F.lit("TRIGGER").alias("target_type"),
            trigger_text(schema, F.col("target"), F.col("_code"), F.col("target"), F.lit("()")).alias("_code"),
        ),
    )
    rows = rows.select(*_KEY, "_atoms", F.explode(both).alias("out")).select(*_KEY, "_atoms", "out.*")
    return _emitted(_finish(rows), F.col("target_name"), F.col("target_type"), F.col("_code"))


def _calling(accepted: DataFrame) -> DataFrame:
    called = accepted.where(F.col("type") == "TRIGGER").withColumn("callee", called_routine(F.col("_code")))
    return called.where(F.col("callee") != "")


def _callable(accepted: DataFrame) -> DataFrame:
    return accepted.where(F.col("type").isin("PROCEDURE", "FUNCTION")).withColumn("callee", F.lower("name"))


def without_routine(accepted: DataFrame) -> DataFrame:
    """Triggers that call a routine which is missing or rejected, with that reason and their code as it was."""
    routines = _callable(accepted).select("owner", "callee").distinct()
    return _calling(accepted).join(routines, ["owner", "callee"], "left_anti").select(
        *_KEY, F.lit("missing routine").alias("reason"), R.restore(F.col("_code"), F.col("_atoms")).alias("body")
    )


def trigger_balance(accepted: DataFrame, schema: str) -> DataFrame:
    """Per owner how many triggers were accepted, emitted and set aside: the first is always the sum of the others."""
    count = F.count(F.lit(1))
    emitted = rewrite_block_triggers(accepted, schema).unionByName(rewrite_call_triggers(accepted, schema))
    parts = [
        accepted.where("type = 'TRIGGER'").groupBy("owner").agg(count.alias("accepted")),
        emitted.where("target_type = 'TRIGGER'").groupBy("owner").agg(count.alias("emitted")),
        without_routine(accepted).groupBy("owner").agg(count.alias("quarantined")),
    ]
    joined = reduce(lambda a, b: a.join(b, "owner", "full_outer"), parts)
    return joined.select("owner", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("accepted", "emitted", "quarantined")))


def rewrite_call_triggers(accepted: DataFrame, schema: str) -> DataFrame:
    """A trigger that calls a routine: the routine becomes a trigger function, its parameters trigger arguments.

    A routine called by many triggers is rewritten once; the triggers only look up that it exists. A trigger
    whose routine is missing or rejected is not emitted: ``without_routine`` lists it.
    """
    triggers, routines = _calling(accepted), _callable(accepted)
    wanted = triggers.select("owner", "callee").distinct()
    called = routines.join(wanted, ["owner", "callee"], "left_semi")
    head = R.header_of(F.col("_code"))
    rest = R.after(F.col("_code"), head)
    declared = F.array_join(
        F.transform(
            R.parameter_list(head),
            lambda p, i: F.concat(p, F.lit(" := TG_ARGV["), i.cast("string"), F.lit("];\n")),
        ),
        "",
    )
    own = F.regexp_replace(F.regexp_extract(rest, r"(?is)^(.*?)\bBEGIN\b", 1), r"^\s+|\s+$", "")
    block = F.regexp_extract(rest, r"(?is)\bBEGIN\b.*$", 0)
    functions = called.withColumn(
        "_code",
        trigger_function_text(
            schema, F.col("callee"), F.concat(F.lit("DECLARE\n"), declared, own, F.lit("\n"), block)
        ),
    )
    functions = _emitted(
        _finish(functions), F.concat(F.lit("fn_"), F.col("callee")), F.lit("FUNCTION"), F.col("_code")
    )
    arguments = F.coalesce(
        F.nullif(F.regexp_extract(F.col("_code"), r"(?i)\bCALL\s+[\w$#]+\s*(\([^()]*\))", 1), F.lit("")), F.lit("()")
    )
    runs = triggers.join(routines.select("owner", "callee").distinct(), ["owner", "callee"], "left_semi").withColumn(
        "target", F.lower("name")
    )
    runs = runs.withColumn(
        "_code", trigger_text(schema, F.col("target"), F.col("_code"), F.col("callee"), arguments)
    )
    return functions.unionByName(_emitted(runs, F.col("target"), F.lit("TRIGGER"), F.col("_code")))


def rewrite_views(views: DataFrame, schema: str) -> DataFrame:
    """View definitions with bare names and their FROM tables in the target schema; system views stay behind."""
    rows = masked(view_bodies(views.where(F.col("owner") != "SYS")))
    for rule in (R.unquote_names, R.types, R.qualify(schema, "FROM")):
        rows = rows.withColumn("_code", rule(F.col("_code")))
    text = F.concat(F.lit(f"CREATE OR REPLACE VIEW {schema}."), F.col("_code"))
    return _emitted(rows, F.lower("name"), F.lit("VIEW"), text)


def rewrite_all(bodies: DataFrame, views: DataFrame, schema: str) -> DataFrame:
    """Everything that can be translated, as ``target_name, target_type, script`` rows."""
    accepted = ready(bodies, views, schema)
    parts = [
        rewrite_routines(accepted, schema), rewrite_block_triggers(accepted, schema),
        rewrite_call_triggers(accepted, schema),
        rewrite_views(views, schema),
    ]
    return reduce(DataFrame.unionByName, parts)


def with_drop(scripts: DataFrame, existing: DataFrame, schema: str) -> DataFrame:
    """Scripts with a DROP in front for objects the target already has.

    A trigger is dropped by its name on its table, which its own text names after ON.
    """
    found = existing.select(
        F.lower("name").alias("target_name"), F.upper("type").alias("target_type")
    ).distinct().withColumn("_found", F.lit(True))
    table = F.regexp_extract("script", r"(?i)\bON\s+([\w$#.\"]+)", 1)
    drop = F.when(
        F.col("target_type") == "TRIGGER",
        F.concat(F.lit("DROP TRIGGER IF EXISTS "), F.col("target_name"), F.lit(" ON "), table, F.lit(";\n")),
    ).otherwise(F.concat(
        F.lit("DROP "), F.col("target_type"), F.lit(f" IF EXISTS {schema}."), F.col("target_name"), F.lit(" CASCADE;\n")
    ))
    return scripts.join(found, ["target_name", "target_type"], "left").select(
        *scripts.columns[:-1], F.concat(F.when(F.col("_found"), drop).otherwise(""), "script").alias("script")
    )


def _judged(bodies: DataFrame, views: DataFrame, schema: str, with_body: bool) -> DataFrame:
    """Every object with its ``reason`` (null if it can be translated), the routine it names behind CALL as ``callee``, and its
    ``body``, or else ``calls``, all names before a parenthesis or the end of a statement. A written table."""
    # From the beginning of a name and without going back in it: a shorter piece of it cannot stand before a parenthesis either.
    names = F.regexp_extract_all("_code", F.lit(rf"(?<![\w$#])((?:{R.NAME}+\.)?+{R.NAME}+)\s*+[(;]"), F.lit(1))
    found = {
        "callee": F.when(F.col("type") == "TRIGGER", called_routine(F.col("_code"))).otherwise(""),
        "body" if with_body else "calls": F.col("body") if with_body else F.array_distinct(F.transform(names, F.lower)),
    }
    return stage(_triaged(bodies, views, schema, found), new_work_dir(bodies.sparkSession, "judged-code"))


def _set_aside(judged: DataFrame) -> DataFrame:
    """What cannot be translated by itself: rejected objects, and triggers that call a routine which is missing or rejected."""
    routines = judged.where("reason IS NULL AND type IN ('PROCEDURE', 'FUNCTION')").select("owner", F.lower("name").alias("callee")).distinct()
    lost = judged.where("reason IS NULL AND callee <> ''").join(routines, ["owner", "callee"], "left_anti")
    lost = lost.withColumn("reason", F.lit("missing routine")).select(judged.columns)
    return judged.where("reason IS NOT NULL").unionByName(lost)


def quarantined(bodies: DataFrame, views: DataFrame, schema: str) -> DataFrame:
    """Objects that are not emitted, with the reason, whole, for manual migration: with what ``rewrite_all`` emits, all there are."""
    return _set_aside(_judged(bodies, views, schema, with_body=True)).select(*_KEY, "reason", "body")


def blocked_by_calls(bodies: DataFrame, views: DataFrame, schema: str) -> DataFrame:
    """Objects that can be translated but call, directly or through others, one that is set aside: ``blocked_by`` is the
    smallest such object and ``reason`` what is wrong with it.

    Names count as calls when the same owner (or the one before the dot) has a routine of that name; others may be
    functions of the database. The failure is carried along the call graph as ``graph.blocked_by_failure`` carries it.
    """
    judged = _judged(bodies, views, schema, with_body=False)
    identity = F.concat_ws(".", "owner", F.lower("name"), F.lower("type"))
    routines = judged.where("type IN ('PROCEDURE', 'FUNCTION')").select(
        F.lower("owner").alias("_owner"), F.lower("name").alias("_name"), identity.alias("parent")
    )
    named = judged.select(identity.alias("child"), F.lower("owner").alias("_owner"), F.explode("calls").alias("_call")).select(
        "child", F.when(F.col("_call").contains("."), F.substring_index("_call", ".", 1)).otherwise(F.col("_owner")).alias("_owner"),
        F.substring_index("_call", ".", -1).alias("_name"),
    )
    edges = named.join(routines, ["_owner", "_name"]).select("child", "parent")
    aside = stage(_set_aside(judged).select(identity.alias("node"), "reason"), new_work_dir(bodies.sparkSession, "set-aside"))
    blocked = blocked_by_failure(edges, aside.select("node"))
    found = judged.select(*_KEY, identity.alias("node")).join(blocked, "node")
    return found.join(aside.withColumnRenamed("node", "blocked_by"), "blocked_by").select(*_KEY, "blocked_by", "reason")


def write_quarantine(rejected: DataFrame, path: str) -> None:
    rejected.write.mode("overwrite").partitionBy("reason").json(path)
