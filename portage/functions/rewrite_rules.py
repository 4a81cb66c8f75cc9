"""Rules that turn stored PL/SQL text into PL/pgSQL, as column expressions.

Text is masked before any rule sees it: each string literal and comment becomes a numbered mark, so that no rule
changes what stands inside one, and is put back at the end. Patterns avoid repeated groups, which the Java matcher
handles by recursion: a text of any length is safe.

Every rule takes the masked code and returns it changed. Rules depend on their order; ``GENERAL_RULES`` lists it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from portage.functions.columns import let

Rule = Callable[[Column], Column]

_OPEN, _CLOSE = "\x01", "\x02"
# Literals, line comments, block comments, and stray mark characters of the text itself.
# Only behind a character that can begin one are the four alternatives tried.
_ATOM = r"(?=['/\x01\x02-])(?:'[^']*'|--[^\n]*|(?s:/\*.*?\*/)|[\x01\x02])"
_NAME = NAME = r"[\w$#]+"


def literals(body: Column) -> Column:
    """The literals and comments of a body, in order."""
    return F.regexp_extract_all(body, F.lit(_ATOM), F.lit(0))


def mask(body: Column) -> Column:
    """The body with every literal and comment replaced by its number between two marks."""
    return F.array_join(
        F.transform(
            F.split(body, _ATOM),
            lambda part, i: F.when(i == 0, part).otherwise(
                F.concat(F.lit(_OPEN), (i - 1).cast("string"), F.lit(_CLOSE), part)
            ),
        ),
        "",
    )


def restore(code: Column, atoms: Column) -> Column:
    """Masked code with the literals and comments put back."""

    def joined(known: Column) -> Column:
        def piece(part: Column, i: Column) -> Column:
            number = F.substring_index(part, _CLOSE, 1).try_cast("int")
            rest = F.substr(part, F.instr(part, _CLOSE) + 1)
            return F.when(i == 0, part).otherwise(F.concat(F.get(known, number), rest))

        return F.array_join(F.transform(F.split(code, _OPEN), piece), "")

    return let(atoms, joined)


def _sub(code: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(code, pattern, replacement)


def mentions(lower: Column, *words: str) -> Column:
    """Whether one of ``words`` occurs in a text in lower case: a search for bytes, several times as fast as a pattern."""
    return reduce(Column.__or__, [F.contains(lower, F.lit(w)) for w in words])


def header_of(code: Column) -> Column:
    """A routine's text up to and with the first IS or AS; empty for anything else."""
    return F.regexp_extract(code, r"(?is)^\s*(?:PROCEDURE|FUNCTION)\b.*?\b(?:IS|AS)\b", 0)


def after(code: Column, head: Column) -> Column:
    return F.substr(code, F.length(head) + 1)


# Types, names, references -----------------------------------------------------------------------------------


def types(code: Column) -> Column:
    """``number`` becomes ``numeric``, ``varchar2`` becomes ``varchar``."""
    return _sub(_sub(code, r"(?i)\bnumber\b", "numeric"), r"(?i)\bvarchar2\b", "varchar")


def pct_type(schema: str) -> Rule:
    """``t.c%TYPE`` gets the target schema in front; a variable's type and one with a schema stay as they are."""
    if schema == "public":
        return lambda code: code
    return lambda code: _sub(code, r"(?i)(^|[^\w$#.])([\w$#]+\.[\w$#]+%TYPE)\b", f"$1{schema}.$2")


def qualify_steps(schema: str, keywords: str = "FROM|JOIN") -> list[tuple[Rule, list[str]]]:
    """The steps of ``qualify``, each with the words of which its pattern needs one."""
    if schema == "public":
        return []
    places = keywords.lower().split("|")

    def step(pattern: str, replacement: str) -> Rule:
        return lambda code: _sub(code, pattern, replacement)

    return [
        (step(rf"(?i)\b({keywords})(\s+)({_NAME})", rf"$1$2{schema}.$3"), places),
        (step(rf"(?i)\b({keywords})(\s+){schema}\.({_NAME}\.)", "$1$2$3"), places),
        (step(rf"(?i)\b({keywords})(\s+){schema}\.(dual)\b", "$1$2$3"), ["dual"]),
        (step(rf"(?i)\b((?:EXTRACT|TRIM)\s*\([^()]*\bFROM\s+){schema}\.", "$1"), ["extract", "trim"]),
    ]


def qualify(schema: str, keywords: str = "FROM|JOIN") -> Rule:
    """Tables behind the keywords get the target schema, unless they are ``dual`` or have a schema already.

    Without look-around: first every name is qualified, then the exceptions are taken back, among them the FROM
    of EXTRACT and TRIM.
    """
    return lambda code: reduce(lambda text, step: step[0](text), qualify_steps(schema, keywords), code)


def referenced_names(code: Column) -> Column:
    """Distinct upper-case bare names behind FROM and JOIN."""
    names = F.regexp_extract_all(code, F.lit(rf"(?i)\b(?:FROM|JOIN)\s+((?:{_NAME}\.)?{_NAME})"), F.lit(1))
    return F.array_distinct(F.transform(names, lambda n: F.upper(F.substring_index(n, ".", -1))))


def trigger_rows(code: Column) -> Column:
    """``:new`` and ``:old`` become ``NEW`` and ``OLD``."""
    return _sub(_sub(code, r"(?i):new\b", "NEW"), r"(?i):old\b", "OLD")


def nextval(code: Column) -> Column:
    """``seq.nextval`` becomes ``nextval('seq')``."""
    return _sub(code, rf"(?i)\b((?:{_NAME}\.)?{_NAME})\.nextval\b", "nextval('$1')")


# Declarations -----------------------------------------------------------------------------------------------


def params(code: Column) -> Column:
    """``name MODE type`` becomes ``MODE name type``, in the header only."""
    head = header_of(code)
    moved = _sub(head, rf"(?i)({_NAME})\s+(IN\s+OUT|IN|OUT)\s+([\w$#.%]+)", "$2 $1 $3")
    return F.concat(moved, after(code, head))


def cursors(code: Column) -> Column:
    """``CURSOR c IS`` becomes ``c CURSOR FOR``."""
    return _sub(code, rf"(?i)\bCURSOR\s+({_NAME})\s+IS\b", "$1 CURSOR FOR")


def pragmas(code: Column) -> Column:
    """Pragmas and exception variables go."""
    return _sub(_sub(code, r"(?i)\bPRAGMA\s+[^;]*;", ""), rf"(?i)\b{_NAME}\s+EXCEPTION\s*;", "")


# Statements -------------------------------------------------------------------------------------------------


def raise_name(code: Column) -> Column:
    """``RAISE x;`` becomes an exception with the name in its text."""
    return _sub(code, rf"(?i)\bRAISE\s+({_NAME})\s*;", "RAISE EXCEPTION 'EXCEPTION_$1';")


def sleep(code: Column) -> Column:
    return _sub(code, r"(?i)\bdbms_lock\.sleep\s*\(([^()]*)\)\s*;", r"PERFORM pg_sleep($1);")


def drop_dual(code: Column) -> Column:
    """``FROM dual`` goes; meant for trigger bodies."""
    return _sub(code, r"(?i)\s*\bFROM\s+dual\b", "")


def execute(code: Column) -> Column:
    return _sub(code, r"(?i)\bEXECUTE\s+IMMEDIATE\b", "EXECUTE")


def for_paren(code: Column) -> Column:
    """``FOR x IN ( query ) LOOP`` loses the parentheses; a query with parentheses of its own keeps them."""
    return _sub(code, rf"(?i)\bFOR\s+({_NAME})\s+IN\s*\(([^()]*)\)\s*LOOP\b", "FOR $1 IN $2 LOOP")


def _found(code: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(code, F.lit(pattern), F.lit(1)), F.lower)


def loop_variables(code: Column) -> Column:
    """The variables of all FOR loops behind BEGIN that are no cursors, in lower case and sorted."""
    block = F.regexp_extract(code, r"(?is)\bBEGIN\b.*$", 0)
    loops, cursors = _found(block, rf"(?i)\bFOR\s+({_NAME})\s+IN\b"), _found(code, rf"(?i)\b({_NAME})\s+CURSOR\s+FOR\b")
    return F.array_sort(F.array_except(loops, cursors))


def loop_record(code: Column) -> Column:
    """Declarations ``x record;`` of the loop variables, one on each line; empty when there are none."""
    return F.array_join(F.transform(loop_variables(code), lambda name: F.concat(name, F.lit(" record;"))), "\n")


def _replace_calls(code: Column, pattern: str, convert: Callable[[Column], Column]) -> Column:
    """Every match of ``pattern`` replaced by ``convert`` of its first group."""
    between = F.split(code, pattern)
    args = F.regexp_extract_all(code, F.lit(pattern), F.lit(1))
    return F.array_join(
        F.zip_with(between, F.transform(args, convert), lambda text, call: F.concat(text, F.coalesce(call, F.lit("")))), ""
    )


def notices(atoms: Column) -> Rule:
    """``dbms_output.put_line('a' || b)`` becomes ``RAISE NOTICE 'a %', b``.

    Comes last, as it writes literal text into the code. Calls with parentheses in their arguments stay, for
    the triage to find.
    """

    def convert(args: Column, atoms: Column) -> Column:
        pieces = F.transform(F.split(args, r"\|\|"), lambda p: F.trim(p))

        def is_text(piece: Column) -> Column:
            return piece.rlike(r"^\x01[\d\x01\x02]*\x02$")

        def format_part(piece: Column) -> Column:
            inner = restore(piece, atoms)
            bare = F.substr(inner, F.lit(2), F.length(inner) - 2)
            return F.when(is_text(piece), F.replace(bare, F.lit("%"), F.lit("%%"))).otherwise("%")

        values = F.transform(F.filter(pieces, lambda p: ~is_text(p)), lambda p: F.concat(F.lit(", "), p))
        return F.concat(
            F.lit("RAISE NOTICE '"),
            F.array_join(F.transform(pieces, format_part), ""),
            F.lit("'"),
            F.array_join(values, ""),
            F.lit(";"),
        )

    pattern = r"(?i)\bdbms_output\.put_line\s*\(([^()]*)\)\s*;"
    return lambda code: let(atoms, lambda known: _replace_calls(code, pattern, lambda args: convert(args, known)))


def raise_call(atoms: Column) -> Rule:
    """``raise_xyz(args);`` becomes an exception whose text is the arguments. Comes last, like ``notices``."""

    def convert(args: Column, atoms: Column) -> Column:
        text = F.replace(restore(F.trim(args), atoms), F.lit("'"), F.lit("''"))
        return F.concat(F.lit("RAISE EXCEPTION '"), F.replace(text, F.lit("%"), F.lit("%%")), F.lit("';"))

    pattern = r"(?i)\braise_\w+\s*\(([^()]*)\)\s*;"
    return lambda code: let(atoms, lambda known: _replace_calls(code, pattern, lambda args: convert(args, known)))


def unquote_names(code: Column) -> Column:
    """Double quotes around identifiers go."""
    return _sub(code, r'"([^"]*)"', "$1")


# The order of the general rules -----------------------------------------------------------------------------


def general_steps(schema: str) -> list[tuple[Rule, list[str]]]:
    """Rules for every kind of source, in the order they must run, each with words in lower case: in code without any of them
    its pattern cannot match."""
    return [
        (types, ["number", "varchar2"]), (pct_type(schema), ["%type"]), (nextval, [".nextval"]), (trigger_rows, [":new", ":old"]),
        (params, ["procedure", "function"]), (cursors, ["cursor"]), (pragmas, ["pragma", "exception"]), (raise_name, ["raise"]),
        *qualify_steps(schema), (sleep, ["dbms_lock"]), (execute, ["immediate"]), (for_paren, ["loop"]),
    ]


def general_rules(schema: str) -> list[Rule]:
    return [rule for rule, _ in general_steps(schema)]


# Envelopes --------------------------------------------------------------------------------------------------

# The parts of a translated routine.
LANGUAGE_LINE = "\nLANGUAGE PLPGSQL AS\n$$\nDECLARE\n"
HANDLER = (
    "\nEXCEPTION WHEN OTHERS THEN"
    "\nraise notice 'Transaction has failed and rolledback!';"
    "\nraise notice '% %', SQLERRM, SQLSTATE;"
    "\nEND;\n$$;"
)
TRIGGER_FUNCTION_LINE = "() RETURNS TRIGGER LANGUAGE PLPGSQL AS \n$$\n"
TRIGGER_FUNCTION_END = "\nRETURN NEW;\n\nEND;\n$$;"


def statements(block: Column) -> Column:
    """Block text without its exception section and its last END."""
    cut = F.regexp_extract(block, r"(?is)^(.*?)\bEXCEPTION\s+WHEN\b", 1)
    body = F.when(cut != "", cut).otherwise(
        _sub(block, rf"(?i)\bEND\b\s*(?:{_NAME})?\s*;?\s*$", "")
    )
    return F.trim(F.regexp_replace(body, r"\s+$", ""))


def parameter_list(header: Column) -> Column:
    """The ``name type`` parameters of a header whose modes are already in front."""
    inner = F.regexp_extract(header, r"\(([^()]*)\)", 1)
    cleaned = F.transform(
        F.split(inner, ","), lambda p: F.trim(_sub(F.trim(p), r"(?i)^(?:IN\s+OUT|IN|OUT)\s+", ""))
    )
    return F.filter(cleaned, lambda p: p != "")
