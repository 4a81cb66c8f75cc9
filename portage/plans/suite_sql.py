"""The registered queries as SQL over the same tables, for checking results in another engine."""

from __future__ import annotations

from portage.sources.instance_catalog import _INPUTS, SHAPES

S = "app"

# Catalog tables -----------------------------------------------------------------------------------------------

_DOC_LINES = """
SELECT 'DOCS' AS owner, 'doc_' || doc_id AS name, 'PROCEDURE' AS type, CAST(pos + 9 AS INT) AS line,
       'DBMS_OUTPUT.PUT_LINE(''' || replace(line_text, '''', '''''') || ''' || a);' AS text
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line_text,
             unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents) d
UNION ALL SELECT 'DOCS', 'doc_' || doc_id, 'PROCEDURE', 1, 'PROCEDURE doc_' || doc_id || '(a IN NUMBER) IS' FROM documents
UNION ALL SELECT 'DOCS', 'doc_' || doc_id, 'PROCEDURE', 2, 'BEGIN' FROM documents
UNION ALL SELECT 'DOCS', 'doc_' || doc_id, 'PROCEDURE', CAST(len(string_split(text, chr(10))) + 10 AS INT), 'END;'
FROM documents"""

_CTES = {name: text.format(**{t: t for t in _INPUTS}) for name, text in SHAPES.items()}
_CTES["source_lines"] = f"""
SELECT owner, name, type, line, text FROM ({_CTES['order_source']}) o UNION ALL {_DOC_LINES}
UNION ALL SELECT owner, name, type, line, text FROM ({_CTES['turn_source']}) t"""
_CTES["bodies"] = """
SELECT owner, name, type, string_agg(text, chr(10) ORDER BY line, text) AS body
FROM source_lines GROUP BY ALL"""
_CTES["pk"] = """
SELECT cc.owner, cc.table_name, cc.constraint_name, cc.column_name, cc.position FROM cat_cons_columns cc
JOIN cat_constraints c ON c.owner = cc.owner AND c.constraint_name = cc.constraint_name WHERE c.constraint_type = 'P'"""
_CTES["targets"] = """
SELECT c.owner AS src_owner, c.table_name AS src_table, c.constraint_name, s.position, s.column_name AS src_column,
       c.r_owner AS ref_owner, r.table_name AS ref_table, r.column_name AS ref_column, c.delete_rule AS on_delete
FROM cat_constraints c
JOIN cat_cons_columns s ON s.owner = c.owner AND s.constraint_name = c.constraint_name
JOIN cat_cons_columns r ON r.owner = c.r_owner AND r.constraint_name = c.r_constraint_name AND r.position = s.position
WHERE c.constraint_type = 'R'"""
_CTES["edges"] = """
SELECT DISTINCT c.owner || '.' || c.table_name AS child, p.owner || '.' || p.table_name AS parent
FROM cat_constraints c JOIN cat_constraints p ON p.owner = c.r_owner AND p.constraint_name = c.r_constraint_name
WHERE c.constraint_type = 'R'"""
_CTES["auto"] = """
SELECT c.owner, c.table_name, c.column_name, split_part(replace(c.data_default, '"', ''), '.', 2) AS sequence_name
FROM cat_columns c JOIN (SELECT DISTINCT owner, table_name, column_name FROM pk) p USING (owner, table_name, column_name)
WHERE c.data_default ILIKE '%nextval%'"""
_CTES["existing"] = """
SELECT lower(table_name) AS table_name FROM cat_tables WHERE owner IN ('SALES_F', 'GEO', 'SUPPLY')"""
_CTES["replaced"] = "SELECT table_name FROM cat_tables WHERE table_name LIKE 'ORDERS%' OR owner = 'GEO'"
_CTES["turn_edges"] = """
SELECT 'TURN_' || conv_id || '_' || turn AS child, 'TURN_' || conv_id || '_' || (turn - 1) AS parent
FROM conversations WHERE turn > 0"""

# Which tables each one reads, so that a query carries no more than it needs.
_NEEDS = {
    "bodies": ["source_lines"], "pk": ["cat_cons_columns", "cat_constraints"],
    "targets": ["cat_constraints", "cat_cons_columns"], "edges": ["cat_constraints"], "auto": ["cat_columns", "pk"],
    "existing": ["cat_tables"], "replaced": ["cat_tables"],
}


def _with(query: str, *names: str, recursive: bool = False) -> str:
    """``query`` behind the named tables and what they need."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, []):
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    tables = ",\n".join(f"{n} AS ({_CTES[n]})" for n in order)
    if recursive:
        return f"WITH RECURSIVE {tables}, {query.strip().lstrip('+')}"
    joiner = ", " if query.lstrip().startswith("+") else " "
    return f"WITH {tables}{joiner}{query.lstrip().lstrip('+')}"


# Stored-code rules --------------------------------------------------------------------------------------------

_ATOM = r"'[^']*'|--[^\n]*|(?s:/\*.*?\*/)|[\x01\x02]"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_MASKED = f"""masked AS (
SELECT owner, name, type, body, regexp_extract_all(body, {_q(_ATOM)}) AS atoms,
  array_to_string(list_transform(regexp_split_to_array(body, {_q(_ATOM)}),
    lambda p, i: CASE WHEN i = 1 THEN p ELSE chr(1) || CAST(i - 2 AS VARCHAR) || chr(2) || p END), '') AS code
FROM bodies)"""


def _restore(code: str, atoms: str = "atoms") -> str:
    return (
        f"array_to_string(list_transform(string_split({code}, chr(1)), lambda p, i: CASE WHEN i = 1 THEN p ELSE "
        f"{atoms}[try_cast(split_part(p, chr(2), 1) AS INT) + 1] || substr(p, instr(p, chr(2)) + 1) END), '')"
    )


def _re(code: str, *rules: tuple[str, str]) -> str:
    for pattern, replacement in rules:
        code = f"regexp_replace({code}, {_q(pattern)}, {_q(replacement)}, 'g')"
    return code


_N = r"[\w$#]+"
_HEAD = r"(?is)^\s*(?:PROCEDURE|FUNCTION)\b.*?\b(?:IS|AS)\b"

TYPES = [(r"(?i)\bnumber\b", "numeric"), (r"(?i)\bvarchar2\b", "varchar")]
PCT_TYPE = [(r"(?i)(^|[^\w$#.])([\w$#]+\.[\w$#]+%TYPE)\b", rf"\1{S}.\2")]
NEXTVAL = [(rf"(?i)\b((?:{_N}\.)?{_N})\.nextval\b", r"nextval('\1')")]
TRIGGER_ROWS = [(r"(?i):new\b", "NEW"), (r"(?i):old\b", "OLD")]
CURSORS = [(rf"(?i)\bCURSOR\s+({_N})\s+IS\b", r"\1 CURSOR FOR")]
PRAGMAS = [(r"(?i)\bPRAGMA\s+[^;]*;", ""), (rf"(?i)\b{_N}\s+EXCEPTION\s*;", "")]
RAISE_NAME = [(rf"(?i)\bRAISE\s+({_N})\s*;", r"RAISE EXCEPTION 'EXCEPTION_\1';")]
SLEEP = [(r"(?i)\bdbms_lock\.sleep\s*\(([^()]*)\)\s*;", r"PERFORM pg_sleep(\1);")]
EXECUTE = [(r"(?i)\bEXECUTE\s+IMMEDIATE\b", "EXECUTE")]
FOR_PAREN = [(rf"(?i)\bFOR\s+({_N})\s+IN\s*\(([^()]*)\)\s*LOOP\b", r"FOR \1 IN \2 LOOP")]
DROP_DUAL = [(r"(?i)\s*\bFROM\s+dual\b", "")]


def _qualify(keywords: str = "FROM|JOIN") -> list[tuple[str, str]]:
    return [
        (rf"(?i)\b({keywords})(\s+)({_N})", rf"\1\2{S}.\3"),
        (rf"(?i)\b({keywords})(\s+){S}\.({_N}\.)", r"\1\2\3"),
        (rf"(?i)\b({keywords})(\s+){S}\.(dual)\b", r"\1\2\3"),
        (rf"(?i)\b((?:EXTRACT|TRIM)\s*\([^()]*\bFROM\s+){S}\.", r"\1"),
    ]


def _params(code: str) -> str:
    head = f"regexp_extract({code}, {_q(_HEAD)}, 0)"
    moved = _re(head, (rf"(?i)({_N})\s+(IN\s+OUT|IN|OUT)\s+([\w$#.%]+)", r"\2 \1 \3"))
    return f"({moved} || substr({code}, length({head}) + 1))"


_CALL = r"(?i)\bdbms_output\.put_line\s*\(([^()]*)\)\s*;"
_RAISE_CALL = r"(?i)\braise_\w+\s*\(([^()]*)\)\s*;"


def _calls(code: str, pattern: str, convert: str) -> str:
    """Every match of ``pattern`` replaced by ``convert``, an expression over its first group ``g``."""
    return (
        f"array_to_string(list_transform(list_zip(regexp_split_to_array({code}, {_q(pattern)}), "
        f"list_transform(regexp_extract_all({code}, {_q(pattern)}, 1), lambda g: {convert})), "
        "lambda z: z[1] || coalesce(z[2], '')), '')"
    )


def _notices(code: str) -> str:
    is_text = r"regexp_matches({0}, '^\x01[\d\x01\x02]*\x02$')"
    pieces = "list_transform(string_split(g, '||'), lambda s: trim(s))"
    inner = _restore("t")
    part = f"CASE WHEN {is_text.format('t')} THEN replace(substr({inner}, 2, length({inner}) - 2), '%', '%%') ELSE '%' END"
    values = f"list_transform(list_filter({pieces}, lambda t: NOT {is_text.format('t')}), lambda t: ', ' || t)"
    return _calls(
        code, _CALL,
        f"'RAISE NOTICE ''' || array_to_string(list_transform({pieces}, lambda t: {part}), '') || '''' "
        f"|| array_to_string({values}, '') || ';'",
    )


def _raise_calls(code: str) -> str:
    text = f"replace({_restore('trim(g)')}, '''', '''''')"
    return _calls(code, _RAISE_CALL, f"'RAISE EXCEPTION ''' || replace({text}, '%', '%%') || ''';'")


def _rule(code: str, where: str = "true") -> str:
    return _with(f"+{_MASKED} SELECT owner, name, type, {_restore(code)} AS body FROM masked WHERE {where}", "bodies")


def _steps(start: str, steps: list[tuple[str, str]]) -> str:
    """Chain of tables, each with ``code`` changed by one expression."""
    out, before = [], start
    for name, expression in steps:
        out.append(f"{name} AS (SELECT * EXCLUDE (code), {expression} AS code FROM {before})")
        before = name
    return ",\n".join(out)


_GENERAL = _steps("masked", [
    ("g1", _re("code", *TYPES, *PCT_TYPE, *NEXTVAL, *TRIGGER_ROWS)),
    ("g2", _params("code")),
    ("general", _re("code", *CURSORS, *PRAGMAS, *RAISE_NAME, *_qualify(), *SLEEP, *EXECUTE, *FOR_PAREN)),
])

_SYSTEM = rf"""named AS (
SELECT owner, name, type, unnest(list_transform(regexp_extract_all(code, '(?i)\b(?:FROM|JOIN)\s+((?:{_N}\.)?{_N})', 1),
  lambda n: upper(split_part(n, '.', -1)))) AS view_name FROM masked),
system AS (SELECT DISTINCT n.owner, n.name, n.type FROM named n
  WHERE n.view_name IN (SELECT upper(view_name) FROM cat_views WHERE owner = 'SYS'))"""

_KNOWN_CALL = r"(?i)\b(?:dbms_output\.put_line|raise_\w+)\s*\("
_LEFT = _re("code", (r"(?i)\b(?:dbms_output\.put_line|raise_\w+)\s*\([^()]*\)\s*;", ""))
_TRIAGED = f"""{_MASKED}, {_GENERAL}, {_SYSTEM},
verdict AS (SELECT *, {_LEFT} AS rest FROM general),
triaged AS (SELECT v.* EXCLUDE (rest), CASE
  WHEN s.name IS NOT NULL THEN 'untranslatable'
  WHEN len(regexp_extract_all(v.rest, '(?i)\\bBEGIN\\b')) > 1 THEN 'factory'
  WHEN regexp_matches(regexp_replace(v.rest, {_q(_KNOWN_CALL)}, '', 'g'), '(?i)\\bDBMS_') THEN 'unsupported'
  WHEN regexp_matches(v.rest, {_q(_KNOWN_CALL)}) THEN 'review' END AS reason
  FROM verdict v LEFT JOIN system s ON s.owner = v.owner AND s.name = v.name AND s.type = v.type),
ready AS (SELECT * FROM triaged WHERE reason IS NULL)"""


_CALLED = rf"lower(regexp_extract(code, '(?i)\bCALL\s+({_N})', 1))"

#: Rejected objects, and triggers whose routine is missing or rejected.
_ASIDE = f"""aside AS (SELECT owner, name, type, body, reason FROM triaged WHERE reason IS NOT NULL
  UNION ALL SELECT t.owner, t.name, t.type, t.body, 'missing routine' FROM ready t WHERE t.type = 'TRIGGER' AND {_CALLED} <> ''
    AND NOT EXISTS (SELECT 1 FROM ready r WHERE r.type IN ('PROCEDURE', 'FUNCTION') AND r.owner = t.owner
      AND lower(r.name) = {_CALLED.replace('code', 't.code')}))"""


def _statements(block: str) -> str:
    cut = f"regexp_extract({block}, '(?is)^(.*?)\\bEXCEPTION\\s+WHEN\\b', 1)"
    end = _re(block, (rf"(?i)\bEND\b\s*(?:{_N})?\s*;?\s*$", ""))
    return f"rtrim({_re(f'CASE WHEN {cut} <> {chr(39)*2} THEN {cut} ELSE {end} END', (r'\s+$', ''))})"


def _strip(text: str) -> str:
    return _re(text, (r"^\s+|\s+$", ""))


_LOOPS = rf"regexp_extract_all(lower(regexp_extract(code, '(?is)\bBEGIN\b.*$', 0)), '\bfor\s+({_N})\s+in\b', 1)"
_CURSOR_NAMES = rf"regexp_extract_all(lower(code), '\b({_N})\s+cursor\s+for\b', 1)"
_LOOP_RECORD = (
    f"coalesce(array_to_string(list_transform(list_sort(list_distinct(list_filter({_LOOPS}, "
    f"lambda x: NOT list_contains({_CURSOR_NAMES}, x)))), lambda x: x || ' record;'), chr(10)), '')"
)
_NL = "chr(10)"
_HANDLER = (
    f"{_NL} || 'EXCEPTION WHEN OTHERS THEN' || {_NL} || 'raise notice ''Transaction has failed and rolledback!'';' || {_NL}"
    f" || 'raise notice ''% %'', SQLERRM, SQLSTATE;' || {_NL} || 'END;' || {_NL} || '$$;'"
)
_FN_OPEN = f"'() RETURNS TRIGGER LANGUAGE PLPGSQL AS ' || {_NL} || '$$' || {_NL}"
_FN_CLOSE = f"{_NL} || 'RETURN NEW;' || {_NL} || {_NL} || 'END;' || {_NL} || '$$;'"

_HEAD_OF = f"regexp_extract(code, {_q(_HEAD)}, 0)"
_ROUTINE_PARTS = f"""heads AS (SELECT *, {_HEAD_OF} AS head, {_LOOP_RECORD} AS record, lower(name) AS target FROM ready
  WHERE type IN ('PROCEDURE', 'FUNCTION')),
rests AS (SELECT *, substr(code, length(head) + 1) AS rest FROM heads),
routines AS (SELECT *, regexp_extract(rest, '(?is)^(.*?)\\bBEGIN\\b', 1) AS declared,
  regexp_extract(rest, '(?is)\\bBEGIN\\b(.*)$', 1) AS block, regexp_extract(rest, '(?is)\\bBEGIN\\b.*$', 0) AS whole FROM rests)"""

_SIGNATURE = _re(
    "head", (r"(?i)^\s*(?:PROCEDURE|FUNCTION)\s+[\w$#.\"]+|\b(?:IS|AS)$", ""), (r"(?i)\bRETURN\b", "RETURNS")
)
_ENVELOPE = f"""+{_TRIAGED}, {_ROUTINE_PARTS},
built AS (SELECT owner, name, type, atoms, target, 'CREATE OR REPLACE ' || type || ' {S}.' || target || trim({_SIGNATURE})
  || {_NL} || 'LANGUAGE PLPGSQL AS' || {_NL} || '$$' || {_NL} || 'DECLARE' || {_NL}
  || CASE WHEN record <> '' THEN record || {_NL} ELSE '' END || {_strip('declared')} || {_NL} || 'BEGIN' || {_NL}
  || {_re(_statements('block'), (r'^\s+', ''))} || {_HANDLER} AS code FROM routines),
{_steps('built', [('late1', _raise_calls('code')), ('late2', _notices('code'))])}
SELECT owner, name, type, target AS target_name, type AS target_type, {_restore('code')} AS script FROM late2"""

_TRIGGER_HEAD = _strip(_re(
    r"regexp_extract(code, '(?is)^(.*?)\b(?:DECLARE|BEGIN|CALL)\b', 1)",
    (r"(?i)^\s*TRIGGER\s+[\w$#.\"]+", ""), *_qualify("ON"),
))


def _trigger_function(name: str, block: str) -> str:
    return f"'CREATE OR REPLACE FUNCTION {S}.fn_' || {name} || {_FN_OPEN} || {_statements(_re(block, *DROP_DUAL))} || {_FN_CLOSE}"


def _trigger(name: str, function: str, arguments: str) -> str:
    return (
        f"'CREATE OR REPLACE TRIGGER ' || {name} || ' ' || {_TRIGGER_HEAD} || {_NL} || 'EXECUTE FUNCTION {S}.fn_' || {function} "
        f"|| {arguments} || ';'"
    )


_BLOCK_TRIGGERS = f"""+{_TRIAGED},
blocks AS (SELECT *, lower(name) AS target, regexp_extract(code, '(?is)\\b(?:DECLARE|BEGIN)\\b.*$', 0) AS block FROM ready
  WHERE type = 'TRIGGER' AND {_CALLED} = ''),
built AS (
  SELECT owner, name, type, atoms, 'fn_' || target AS target_name, 'FUNCTION' AS target_type,
    {_trigger_function('target', 'block')} AS code FROM blocks
  UNION ALL SELECT owner, name, type, atoms, target, 'TRIGGER', {_trigger('target', 'target', "'()'")} FROM blocks),
{_steps('built', [('late1', _raise_calls('code')), ('late2', _notices('code'))])}
SELECT owner, name, type, target_name, target_type, {_restore('code')} AS script FROM late2"""

_PARAMETERS = (
    "list_filter(list_transform(string_split(regexp_extract(head, '\\(([^()]*)\\)', 1), ','), lambda p: "
    + "trim(" + _re("trim(p)", (r"(?i)^(?:IN\s+OUT|IN|OUT)\s+", "")) + ")), lambda p: p <> '')"
)
_CALL_TRIGGERS = f"""+{_TRIAGED}, {_ROUTINE_PARTS},
calls AS (SELECT *, {_CALLED} AS callee FROM ready WHERE type = 'TRIGGER' AND {_CALLED} <> ''),
called AS (SELECT * FROM routines r WHERE EXISTS (SELECT 1 FROM calls c WHERE c.owner = r.owner AND c.callee = r.target)),
functions AS (SELECT owner, name, type, atoms, target, {_trigger_function('target', f'''
  ('DECLARE' || {_NL} || array_to_string(list_transform({_PARAMETERS}, lambda p, i: p || ' := TG_ARGV[' || CAST(i - 1 AS VARCHAR)
    || '];' || {_NL}), '') || {_strip('declared')} || {_NL} || whole)''')} AS code FROM called),
{_steps('functions', [('late1', _raise_calls('code')), ('late2', _notices('code'))])}
SELECT owner, name, type, 'fn_' || target AS target_name, 'FUNCTION' AS target_type, {_restore('code')} AS script FROM late2
UNION ALL SELECT owner, name, type, lower(name), 'TRIGGER', {_restore(_trigger('lower(name)', 'callee',
  f"coalesce(nullif(regexp_extract(code, '(?i)CALL\\s+{_N}\\s*(\\([^()]*\\))', 1), ''), '()')"))} AS script
FROM calls c WHERE EXISTS (SELECT 1 FROM routines r WHERE r.owner = c.owner AND r.target = c.callee)"""

_VIEW = f"""+bodies AS (SELECT owner, view_name AS name, 'VIEW' AS type, lower(view_name) || ' AS ' || text AS body
  FROM cat_views WHERE owner <> 'SYS'), {_MASKED}
SELECT owner, name, type, lower(name) AS target_name, 'VIEW' AS target_type,
  {_restore("('CREATE OR REPLACE VIEW " + S + ".' || " + _re('code', (r'"([^"]*)"', r'\1'), *TYPES, *_qualify('FROM')) + ")")} AS script
FROM masked"""

# The queries --------------------------------------------------------------------------------------------------

_ALL_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
_NUMBERED = {
    "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id",
    "documents": "doc_id", "pages": "page_id", "benchmark": "item_id",
}

_KIND = """CASE kind WHEN 'r' THEN 'TABLE' WHEN 'm' THEN 'MATERIALIZED_VIEW' WHEN 'i' THEN 'INDEX' WHEN 'S' THEN 'SEQUENCE'
WHEN 'v' THEN 'VIEW' WHEN 'c' THEN 'TYPE' ELSE kind END AS object_type"""

_TYPE_BASE = "upper(split_part(data_type, '(', 1))"
_TARGET_TYPE = f"""CASE {_TYPE_BASE} WHEN 'NUMBER' THEN 'NUMERIC' WHEN 'VARCHAR2' THEN 'VARCHAR' WHEN 'CLOB' THEN 'TEXT'
ELSE {_TYPE_BASE} END || regexp_extract(data_type, '\\(.*\\)$', 0)"""

_CLOSED = """WITH RECURSIVE o AS (
          SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey > 3 AND o_orderkey % 16 = 0 THEN o_orderkey // 4 END AS o_follows FROM orders),
        c AS (SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) END AS c_order
          FROM customer WHERE c_acctbal > -900),
        refs AS (
          SELECT 'orders' AS t, o_orderkey AS k, 'customer' AS pt, o_custkey AS pk, 'orders(o_custkey) -> customer(c_custkey)' AS fk FROM o
          UNION ALL SELECT 'orders', o_orderkey, 'orders', o_follows, 'orders(o_follows) -> orders(o_orderkey)' FROM o WHERE o_follows IS NOT NULL
          UNION ALL SELECT 'customer', c_custkey, 'orders', c_order, 'customer(c_order) -> orders(o_orderkey)' FROM c WHERE c_order IS NOT NULL),
        there AS (SELECT 'orders' AS pt, o_orderkey AS pk FROM o UNION ALL SELECT 'customer', c_custkey FROM c),
        dead AS (
          SELECT t, k FROM refs ANTI JOIN there USING (pt, pk)
          UNION SELECT r.t, r.k FROM refs r JOIN dead d ON r.pt = d.t AND r.pk = d.k),
        lines AS (SELECT l_orderkey, l_orderkey IN (SELECT k FROM dead WHERE t = 'orders')
          OR l_orderkey NOT IN (SELECT o_orderkey FROM orders) AS gone FROM lineitem)"""

_PRICE = "o_totalprice + CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END"

_REPORT = """
WITH c AS (SELECT * FROM customer WHERE c_acctbal > 0),
o AS (SELECT * FROM orders {orders_where}), l AS (SELECT * FROM lineitem {lines_where}),
dup AS (SELECT count(*) AS n FROM (SELECT 1 FROM l GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) d),
r AS (
SELECT 'region' AS table_name, 0 AS level, (SELECT count(*) FROM region) AS n, 0 AS dups, 0 AS orphans, NULL AS next_value
UNION ALL SELECT 'nation', 1, (SELECT count(*) FROM nation), 0, 0, NULL
UNION ALL SELECT 'customer', 2, (SELECT count(*) FROM c), 0, 0, (SELECT max(c_custkey) + 1 FROM c)
UNION ALL SELECT 'supplier', 2, (SELECT count(*) FROM supplier), 0, 0, (SELECT max(s_suppkey) + 1 FROM supplier)
UNION ALL SELECT 'part', 0, (SELECT count(*) FROM part), 0, 0, (SELECT max(p_partkey) + 1 FROM part)
UNION ALL SELECT 'orders', 3, (SELECT count(*) FROM o), 0,
  (SELECT count(*) FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM c)), (SELECT max(o_orderkey) + 1 FROM o)
UNION ALL SELECT 'lineitem', 4, (SELECT count(*) FROM l), (SELECT n FROM dup),
  (SELECT count(*) FROM l WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o)), NULL
UNION ALL SELECT 'labels', 1, count(*), count(*) - count(DISTINCT doc_id),
  count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM documents)), NULL FROM labels
UNION ALL SELECT 'conversations', 0, count(*), 0, 0, NULL FROM conversations
UNION ALL SELECT 'events', 0, count(*), 0, 0, max(event_id) + 1 FROM events
UNION ALL SELECT 'documents', 0, count(*), 0, 0, max(doc_id) + 1 FROM documents
UNION ALL SELECT 'embeddings', 0, count(*), 0, 0, max(vec_id) + 1 FROM embeddings
UNION ALL SELECT 'pages', 0, count(*), 0, 0, max(page_id) + 1 FROM pages
UNION ALL SELECT 'benchmark', 0, count(*), 0, 0, max(item_id) + 1 FROM benchmark)
SELECT table_name, CAST(level AS INT) AS level, 'done' AS state, CAST(NULL AS VARCHAR) AS blocked_by,
  CAST(n AS BIGINT) AS rows_in, CAST(n AS BIGINT) AS rows_out, CAST(dups AS BIGINT) AS pk_violations,
  CAST(orphans AS BIGINT) AS fk_orphan_rows, CAST(next_value AS BIGINT) AS next_value FROM r"""



def _inserts(table: str, numbers: tuple[str, ...], columns: tuple[str, ...]) -> str:
    """SQL for the INSERT statements of a table of numbers and texts."""
    values = " || ', ' || ".join(
        f"coalesce({'CAST(' + c + ' AS VARCHAR)' if c in numbers else f"chr(39) || replace({c}, chr(39), chr(39) || chr(39)) || chr(39)"}, 'NULL')"
        for c in columns
    )
    names = ", ".join(columns)
    return f"UNION ALL SELECT 2, '{S}.{table}', 'INSERT INTO {S}.{table} ({names}) VALUES (' || {values} || ');' FROM {table} "


ORACLE_SQL = {
    "scan_full": "SELECT * FROM lineitem",
    "scan_query": """SELECT o.o_orderkey, o.o_totalprice, c.c_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
        WHERE o.o_orderstatus = 'F' AND c.c_mktsegment = 'BUILDING'""",
    "load_overwrite": "SELECT * FROM orders",
    "snapshot_restore": "SELECT * FROM orders",
    "run_log": """SELECT event_id, strftime(ts, '%d/%m/%Y %H:%M:%S') AS logged_at,
        CASE WHEN event_type = 'error' THEN 'failed' ELSE 'executing' END AS state, event_type AS message FROM events""",
    "script_inserts": f"""SELECT CAST(2 AS INT) AS section, '{S}.orders' AS seq,
        'INSERT INTO {S}.orders (o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority) VALUES ('
        || o_orderkey || ', ' || o_custkey || ', ''' || o_orderstatus || ''', ' || o_totalprice || ', TIMESTAMP '''
        || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ''', ''' || o_orderpriority || ''');' AS value FROM orders
        """ + "".join(_inserts(*table) for table in (
        ("documents", ("doc_id", "n_chars"), ("doc_id", "text", "lang", "source", "n_chars")),
        ("benchmark", ("item_id",), ("item_id", "text")), ("labels", ("doc_id", "quality", "toxic"), ("doc_id", "quality", "toxic")),
        ("conversations", ("conv_id", "turn"), ("conv_id", "turn", "role", "text")),
    )),
    "script_ddl": _with(f"""+starts AS (SELECT a.*, s.last_number + 1 AS start_with FROM auto a
  LEFT JOIN cat_sequences s ON s.sequence_owner = a.owner AND s.sequence_name = a.sequence_name)
SELECT CAST(1 AS INT) AS section, '{S}.' || lower(table_name) AS seq, 'CREATE TABLE {S}.' || lower(table_name) || ' (' ||
  string_agg(lower(column_name) || ' ' || {_TARGET_TYPE}, ', ' ORDER BY position) || ');' AS value
  FROM cat_columns GROUP BY owner, table_name
UNION ALL SELECT 3, '{S}.' || lower(table_name), 'ALTER TABLE {S}.' || lower(table_name) || ' ADD PRIMARY KEY (' ||
  string_agg(lower(column_name), ',' ORDER BY position) || ');' FROM pk GROUP BY owner, table_name, constraint_name
UNION ALL SELECT 4, '{S}.' || lower(table_name) || '_' || lower(column_name) || '_seq 1', 'CREATE SEQUENCE {S}.' ||
  lower(table_name) || '_' || lower(column_name) || '_seq START WITH ' || coalesce(start_with, 1) || ';' FROM starts
UNION ALL SELECT 4, '{S}.' || lower(table_name) || '_' || lower(column_name) || '_seq 2', 'ALTER TABLE {S}.' ||
  lower(table_name) || ' ALTER COLUMN ' || lower(column_name) || ' SET DEFAULT nextval(''{S}.' || lower(table_name) || '_'
  || lower(column_name) || '_seq'');' FROM starts
UNION ALL SELECT 5, lower(constraint_name), 'ALTER TABLE {S}.' || lower(src_table) || ' ADD CONSTRAINT ' ||
  lower(constraint_name) || ' FOREIGN KEY (' || string_agg(lower(src_column), ',' ORDER BY position) || ') REFERENCES {S}.'
  || lower(ref_table) || ' (' || string_agg(lower(ref_column), ',' ORDER BY position) || ') ON DELETE ' || on_delete || ';'
  FROM targets GROUP BY src_owner, src_table, constraint_name, ref_owner, ref_table, on_delete""",
        "auto", "cat_sequences", "targets"),
    "cols_lower": "SELECT * FROM customer",
    "name_normalise": """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN '"APP"."ORD_' || o_orderkey || '"'
          WHEN '2-HIGH' THEN 'Public.Ord_' || o_orderkey WHEN '3-MEDIUM' THEN 'OTHER.ORD_' || o_orderkey
          WHEN '4-NOT SPECIFIED' THEN '"ORD_' || o_orderkey || '"' ELSE 'ORD_' || o_orderkey END AS raw_name,
        CASE o_orderpriority WHEN '3-MEDIUM' THEN NULL ELSE 'ord_' || o_orderkey END AS name FROM orders""",
    "flt_eq": "SELECT * FROM orders WHERE o_custkey = 77",
    "flt_ne": "SELECT * FROM orders WHERE o_orderstatus <> 'F'",
    "flt_gt": "SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01'",
    "flt_lt": "SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'",
    "flt_ge": "SELECT * FROM lineitem WHERE l_quantity >= 45",
    "flt_le": "SELECT * FROM customer WHERE c_acctbal <= -100",
    "flt_between": "SELECT * FROM orders WHERE o_totalprice BETWEEN 1000 AND 20000",
    "flt_like": "SELECT * FROM part WHERE p_type LIKE 'ECON%'",
    "flt_not_like": "SELECT * FROM part WHERE p_name NOT LIKE '%widget'",
    "flt_conjunction": """SELECT * FROM lineitem WHERE l_quantity BETWEEN 10 AND 30 AND l_returnflag LIKE 'R%'
        AND l_discount >= 0.05""",
    "flt_preview": "SELECT * FROM orders WHERE o_totalprice > 100000 ORDER BY o_orderdate, o_orderkey LIMIT 25",
    "flt_allowed_ops": _with(f"""SELECT owner, table_name, column_name, data_type,
        CASE WHEN {_TYPE_BASE} IN ('NUMBER', 'INTEGER', 'LONG', 'FLOAT', 'DATE', 'TIMESTAMP', 'RAW') THEN '=,!=,>,<,>=,<=,BETWEEN'
             WHEN {_TYPE_BASE} IN ('VARCHAR', 'VARCHAR2', 'NVARCHAR2', 'CHAR', 'NCHAR') THEN 'LIKE,NOT LIKE' END AS operators
        FROM cat_columns""", "cat_columns"),
    "extract_skeleton": "SELECT * FROM lineitem WHERE false",
    "extract_modes": """SELECT 'orders' AS table_name, count(*) AS n_rows FROM orders
        UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_quantity > 40 UNION ALL SELECT 'part', 0""",
    "probe_nonempty": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) > 0 AS has_rows FROM {t}" for t in _ALL_TABLES
    ) + " UNION ALL SELECT 'denied', count(*) > 0 FROM lineitem WHERE l_quantity < 0",
    "inv_tables": _with("SELECT * FROM cat_tables WHERE owner = 'SALES_F'", "cat_tables"),
    "inv_columns": _with(
        "SELECT table_name, column_name, data_type, data_default FROM cat_columns WHERE owner = 'SALES_F'", "cat_columns"),
    "inv_user_objects": _with("""SELECT * FROM cat_dependencies WHERE referenced_type NOT IN ('PACKAGE')
        AND referenced_owner <> 'PUBLIC' AND referenced_owner NOT LIKE '%SYS%'""", "cat_dependencies"),
    "inv_objects": _with("""SELECT owner, table_name AS name, 'TABLE' AS type FROM cat_tables
        UNION SELECT owner, view_name, 'VIEW' FROM cat_views UNION SELECT owner, name, type FROM source_lines""",
        "cat_tables", "cat_views", "source_lines"),
    "inv_owned": _with(f"""SELECT o.schema, o.name, o.owner, {_KIND}, c.c_custkey AS role_id, n.n_nationkey AS schema_id
        FROM cat_objects o JOIN customer c ON c.c_name = o.owner JOIN nation n ON n.n_name = o.schema
        WHERE o.schema NOT IN ('information_schema', 'pg_catalog') AND o.schema NOT LIKE 'pg_%'
        ORDER BY o.schema, o.name""", "cat_objects"),
    "kind_decode": _with(f"SELECT name, kind, {_KIND} FROM cat_objects", "cat_objects"),
    "trigger_map": _with("""SELECT t.schema, t.trigger_name, t.table_name, b.owner AS table_owner, t.function_name,
        c.c_mktsegment AS function_owner, CAST(substr(t.schema, 1, 1) AS INT) AS schema_id
        FROM cat_triggers t JOIN cat_tables b ON b.table_name = t.table_name
        JOIN customer c ON 'FN_' || c.c_custkey = t.function_name WHERE NOT t.is_internal""",
        "cat_triggers", "cat_tables"),
    "pk_columns": _with("SELECT * FROM pk", "pk"),
    "fk_columns": _with("""SELECT cc.owner, cc.table_name, cc.constraint_name, cc.column_name, cc.position
        FROM cat_cons_columns cc JOIN cat_constraints c ON c.owner = cc.owner AND c.constraint_name = cc.constraint_name
        WHERE c.constraint_type = 'R'""", "cat_cons_columns", "cat_constraints"),
    "fk_targets": _with("SELECT * FROM targets", "targets"),
    "fk_grouped": _with("""SELECT src_owner, src_table, constraint_name, ref_owner, ref_table, on_delete,
        string_agg(src_column, ',' ORDER BY position) AS src_columns, string_agg(ref_column, ',' ORDER BY position) AS ref_columns
        FROM targets GROUP BY ALL""", "targets"),
    "key_list": _with("""SELECT owner, table_name, '(' || string_agg(lower(column_name), ',' ORDER BY position) || ')' AS key_list
        FROM pk GROUP BY owner, table_name, constraint_name""", "pk"),
    "auto_column": _with("SELECT * FROM auto", "auto"),
    "seq_next": _with("""SELECT a.owner AS sequence_owner, a.sequence_name, s.last_number + s.increment_by AS start_with,
        s.increment_by, CASE WHEN s.last_number IS NULL THEN 'failed' ELSE 'done' END AS state
        FROM auto a LEFT JOIN cat_sequences s ON s.sequence_owner = a.owner AND s.sequence_name = a.sequence_name""",
        "auto", "cat_sequences"),
    "seq_actions": _with("""SELECT a.*, CASE WHEN lower(a.sequence_name) IN (SELECT lower(sequence_name) FROM cat_sequences)
        THEN 'restart' ELSE 'create' END AS action FROM auto a""", "auto", "cat_sequences"),
    "next_value": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, CAST(max({c}) + 1 AS BIGINT) AS next_value FROM {t}" for t, c in _NUMBERED.items()
    ) + " UNION ALL SELECT 'empty', NULL",
    "seq_assign": """SELECT o_orderkey, o_orderdate, o_totalprice, (SELECT max(o_orderkey) FROM orders)
        + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS new_key FROM orders""",
    "pk_violations": """SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL
        HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL""",
    "fk_orphans": """SELECT o_custkey, count(*) AS n_rows FROM orders
        WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey""",
    "extract_referential": """SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders
        WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))""",
    "extract_closure": f"""{_CLOSED}
        SELECT 'customer' AS table_name, c_custkey AS key FROM c WHERE c_custkey NOT IN (SELECT k FROM dead WHERE t = 'customer')
        UNION ALL SELECT 'orders', o_orderkey FROM o WHERE o_orderkey NOT IN (SELECT k FROM dead WHERE t = 'orders')
        UNION ALL SELECT 'lineitem', l_orderkey FROM lines WHERE NOT gone""",
    "extract_removed": f"""{_CLOSED}, broken AS (
          SELECT r.t, fk FROM refs r JOIN dead d ON d.t = r.pt AND d.k = r.pk UNION ALL SELECT t, fk FROM refs ANTI JOIN there USING (pt, pk)
          UNION ALL SELECT 'lineitem', 'lineitem(l_orderkey) -> orders(o_orderkey)' FROM lines WHERE gone
          UNION ALL SELECT t, NULL FROM dead UNION ALL SELECT 'lineitem', NULL FROM lines WHERE gone)
        SELECT t AS table_name, fk AS reference, count(*) AS n_rows FROM broken GROUP BY t, fk""",
    "count_rows": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in _ALL_TABLES),
    "recon_counts": """SELECT 'customer' AS table_name, count(*) AS source_rows, count(*) AS target_rows, 'done' AS state
          FROM customer
        UNION ALL SELECT 'orders', count(*), count(*), 'done' FROM orders
        UNION ALL SELECT 'lineitem', count(*), count(*) FILTER (l_returnflag = 'R'),
          CASE WHEN count(*) = count(*) FILTER (l_returnflag = 'R') THEN 'done' ELSE 'failed' END FROM lineitem
        UNION ALL SELECT 'part', count(*), NULL, 'failed' FROM part""",
    "recon_pk": _with("""+side AS (SELECT DISTINCT lower(owner) AS o, lower(table_name) AS t, lower(column_name) AS c, 1 AS s FROM pk
          UNION SELECT lower(owner), lower(table_name), CASE WHEN owner = 'SALES_F' THEN 'extra' ELSE lower(column_name) END, 2
          FROM pk WHERE owner <> 'SALES_P'),
        per AS (SELECT o, t, c, min(s) AS lo, max(s) AS hi FROM side GROUP BY o, t, c)
        SELECT o AS owner, t AS table_name, count(*) FILTER (hi = 1) AS missing_in_target, count(*) FILTER (lo = 2) AS only_in_target,
          CASE WHEN count(*) FILTER (lo = hi) = 0 THEN 'done' ELSE 'failed' END AS state FROM per GROUP BY o, t""", "pk"),
    "recon_fk": _with("""SELECT owner, table_name, constraint_name FROM cat_constraints WHERE constraint_type = 'R'
        AND (owner, table_name, lower(constraint_name)) NOT IN (SELECT (owner, table_name, lower(constraint_name))
          FROM cat_constraints WHERE constraint_type = 'R' AND owner <> 'SALES_O')""", "cat_constraints"),
    "recon_sources": """SELECT 'src_' || o_orderkey AS name,
          CASE o_orderstatus WHEN 'F' THEN 'FUNCTION' WHEN 'O' THEN 'PROCEDURE' ELSE 'TRIGGER' END AS type,
          CASE WHEN o_orderpriority = '5-LOW' THEN 'absent' ELSE 'not bound' END AS reason FROM orders
        WHERE o_orderpriority = '5-LOW' OR (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')""",
    "recon_content": f"""WITH tgt AS (
          SELECT o_orderkey, o_custkey, o_orderstatus, {_PRICE} AS o_totalprice, o_orderdate, o_orderpriority FROM orders
            WHERE o_orderstatus <> 'P'
          UNION ALL SELECT -o_orderkey - 1, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders
            WHERE o_orderstatus = 'P')
        SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey,
          CASE WHEN t.o_orderkey IS NULL THEN 'lost' WHEN s.o_orderkey IS NULL THEN 'added' ELSE 'changed' END AS difference,
          CAST(NULL AS VARCHAR) AS column_name, CAST(s.o_orderkey IS NOT NULL AS BIGINT) AS source_rows, CAST(t.o_orderkey IS NOT NULL AS BIGINT) AS target_rows
        FROM orders s FULL OUTER JOIN tgt t ON t.o_orderkey = s.o_orderkey
        WHERE s.o_orderkey IS NULL OR t.o_orderkey IS NULL OR (s.o_custkey, s.o_orderstatus, s.o_totalprice, s.o_orderdate)
          IS DISTINCT FROM (t.o_custkey, t.o_orderstatus, t.o_totalprice, t.o_orderdate)
        UNION ALL SELECT NULL, 'lost_column', 'o_orderpriority', NULL, NULL
        UNION ALL SELECT NULL, 'added_column', 'loaded', NULL, NULL""",
    "recon_tree": """WITH tgt AS (
          SELECT o_orderkey AS source_key, CASE o_orderkey % 997 WHEN 2 THEN -o_orderkey ELSE o_orderkey END AS o_orderkey,
            o_orderkey % 997 = 1 AS changed FROM orders WHERE o_orderkey % 997 <> 0)
        SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey,
          CASE WHEN t.o_orderkey IS NULL THEN 'lost' WHEN s.o_orderkey IS NULL THEN 'added' ELSE 'changed' END AS difference,
          CAST(NULL AS VARCHAR) AS column_name, CAST(s.o_orderkey IS NOT NULL AS BIGINT) AS source_rows, CAST(t.o_orderkey IS NOT NULL AS BIGINT) AS target_rows
        FROM orders s FULL OUTER JOIN tgt t ON t.o_orderkey = s.o_orderkey
        WHERE s.o_orderkey IS NULL OR t.o_orderkey IS NULL OR t.changed""",
    "scan_split": "SELECT * FROM lineitem",
    "conflict_tables": _with(
        "SELECT * FROM cat_tables WHERE lower(table_name) IN (SELECT table_name FROM existing)", "cat_tables", "existing"),
    "conflict_keep": _with("""SELECT * FROM cat_tables WHERE lower(table_name) NOT IN (SELECT table_name FROM existing)
        OR lower(table_name) IN (SELECT lower(table_name) FROM replaced)""", "cat_tables", "existing", "replaced"),
    "conflict_sources": """SELECT 'APP' AS owner, 'SRC_' || o_orderkey AS name, 'FUNCTION' AS type FROM orders
        WHERE o_orderstatus = 'F'""",
    "plan_report": _with("""SELECT *, CASE WHEN lower(table_name) NOT IN (SELECT table_name FROM existing) THEN 'create'
        WHEN lower(table_name) IN (SELECT lower(table_name) FROM replaced) THEN 'replace' ELSE 'keep' END AS action
        FROM cat_tables""", "cat_tables", "existing", "replaced"),
    "status_summary": """WITH s AS (SELECT 'ORDERS_' || o_orderkey AS name,
          CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'failed' ELSE 'blocked' END AS state,
          CASE WHEN o_orderstatus = 'P' THEN 'CUSTOMER_' || o_custkey END AS blocked_by FROM orders)
        SELECT state, blocked_by, count(*) AS n_objects, min(name) AS first_name, max(name) AS last_name FROM s
        GROUP BY state, blocked_by""",
    "dep_semi": _with("""SELECT DISTINCT owner, table_name FROM cat_constraints WHERE (owner, constraint_name) IN (
        SELECT (r_owner, r_constraint_name) FROM cat_constraints WHERE constraint_type = 'R' AND owner = 'SALES_F')""",
        "cat_constraints"),
    "dep_sources": _with("""SELECT * FROM cat_dependencies WHERE referenced_type IN ('PROCEDURE', 'FUNCTION', 'VIEW', 'SEQUENCE')
        AND (owner, name) IN (SELECT (owner, name) FROM cat_dependencies WHERE owner = 'SALES_F' OR type = 'FUNCTION')""",
        "cat_dependencies"),
    "distinct_deps": _with(
        "SELECT DISTINCT referenced_owner, referenced_name, referenced_type FROM cat_dependencies", "cat_dependencies"),
    "dep_missing": _with("""+selected AS (SELECT owner || '.' || table_name AS node FROM cat_tables
          WHERE owner IN ('SALES_F', 'GEO', 'BUILDING'))
        SELECT DISTINCT parent AS node FROM edges WHERE child <> parent AND child IN (SELECT node FROM selected)
          AND parent NOT IN (SELECT node FROM selected)""", "edges", "cat_tables"),
    "dep_closure": _with("""walk AS (SELECT owner || '.' || table_name AS node, 0 AS hops FROM cat_tables
          WHERE owner = 'SALES_F' AND table_name LIKE 'SHIPMENT%'
          UNION SELECT e.parent, w.hops + 1 FROM walk w JOIN edges e ON e.child = w.node)
        SELECT node, CAST(min(hops) AS INT) AS hops FROM walk GROUP BY node""", "edges", "cat_tables", recursive=True),
    "dep_levels": _with("""links AS (SELECT * FROM edges UNION ALL SELECT * FROM turn_edges),
        walk AS (SELECT owner || '.' || table_name AS node, 0 AS level FROM cat_tables
          UNION SELECT 'TURN_' || conv_id || '_' || turn, 0 FROM conversations
          UNION SELECT e.child, w.level + 1 FROM walk w JOIN links e ON e.parent = w.node)
        SELECT node, CAST(max(level) AS INT) AS level FROM walk GROUP BY node""",
        "edges", "turn_edges", "cat_tables", recursive=True),
    "dep_blocked": _with("""walk AS (SELECT c_mktsegment || '.CUSTOMER_' || c_custkey AS node,
          c_mktsegment || '.CUSTOMER_' || c_custkey AS root FROM customer WHERE c_acctbal < 0
          UNION SELECT e.child, w.root FROM walk w JOIN edges e ON e.parent = w.node)
        SELECT node, min(root) AS blocked_by FROM walk WHERE node NOT IN (
          SELECT c_mktsegment || '.CUSTOMER_' || c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY node""",
        "edges", recursive=True),
    "dep_cycles": _with("""trade AS (SELECT 'C' || o_custkey AS c, 'S' || l_suppkey AS s, l_returnflag AS f
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
        links AS (SELECT c AS child, s AS parent FROM trade WHERE f <> 'R' UNION SELECT s, c FROM trade WHERE f = 'R'
          UNION SELECT * FROM turn_edges
          UNION SELECT 'TURN_' || conv_id || '_0', 'TURN_' || conv_id || '_' || turn FROM conversations v
            WHERE role = 'user' AND turn = (SELECT max(turn) FROM conversations m WHERE m.conv_id = v.conv_id) AND turn > 0),
        reach AS (SELECT child AS a, parent AS b FROM links
          UNION SELECT r.a, e.parent FROM reach r JOIN links e ON e.child = r.b)
        SELECT x.a AS node, min(x.b) AS cycle_id FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY x.a""",
        "turn_edges", recursive=True),
    "contains_join": """SELECT DISTINCT b.item_id, d.doc_id FROM benchmark b JOIN documents d
        ON position(b.text IN d.text) > 0""",
    "dep_by_text": _with("""+named AS (
          SELECT CASE WHEN p_size > 40 THEN 'other.' ELSE '' END || 'part_' || p_partkey AS full_name FROM part
          UNION SELECT 'seq_' || s_suppkey FROM supplier UNION SELECT 'customer_' || c_custkey FROM customer
          UNION SELECT 'other.dept' FROM region),
        texts AS (SELECT name, body FROM bodies)
        SELECT DISTINCT n.full_name, t.name FROM named n JOIN texts t ON position(n.full_name IN t.body) > 0""", "bodies"),
    "src_assemble": _with("SELECT * FROM bodies", "bodies"),
    "src_tokens": r"""WITH d AS (SELECT doc_id, regexp_split_to_array(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'),
          '^(\S+\s+[^\s(]+)\(', '\1 ('), '\s+') AS tokens FROM documents)
        SELECT doc_id, CAST(unnest(range(0, len(tokens))) AS INT) AS pos, unnest(tokens) AS token FROM d""",
    "rw_types": _rule(_re("code", *TYPES)),
    "rw_pct_type": _rule(_re("code", *PCT_TYPE)),
    "rw_qualify": _rule(_re("code", *_qualify())),
    "rw_trigger_rows": _rule(_re("code", *TRIGGER_ROWS)),
    "rw_nextval": _rule(_re("code", *NEXTVAL)),
    "rw_params": _rule(_params("code")),
    "rw_cursor": _rule(_re("code", *CURSORS)),
    "rw_pragma": _rule(_re("code", *PRAGMAS)),
    "rw_raise": _with(
        f"+{_MASKED}, {_steps('masked', [('r1', _re('code', *RAISE_NAME)), ('r2', _raise_calls('code'))])} "
        f"SELECT owner, name, type, {_restore('code')} AS body FROM r2", "bodies"),
    "rw_notice": _rule(_notices("code")),
    "rw_sleep": _rule(_re("code", *SLEEP)),
    "rw_dual": _rule(_re("code", *DROP_DUAL), "type = 'TRIGGER'"),
    "rw_for_paren": _rule(_re("code", *FOR_PAREN)),
    "rw_loop_record": _with(
        f"+{_MASKED}, {_steps('masked', [('c1', _re('code', *CURSORS))])} "
        f"SELECT owner, name, type, {_LOOP_RECORD} AS declaration FROM c1", "bodies"),
    "src_untranslatable": _with(f"+{_MASKED}, {_SYSTEM} SELECT * FROM system", "bodies", "cat_views"),
    "src_triage": _with(f"""+{_TRIAGED} SELECT owner, name, type,
        CASE WHEN reason IS NULL THEN 'ok' ELSE 'failed' END AS status, reason FROM triaged""", "bodies", "cat_views"),
    "src_quarantine": _with(f"""+{_TRIAGED}, {_ASIDE} SELECT owner, name, type, body, reason FROM aside""", "bodies", "cat_views"),
    "src_blocked": _with(f"""+{_TRIAGED}, {_ASIDE},
        ids AS (SELECT *, owner || '.' || lower(name) || '.' || lower(type) AS id FROM triaged),
        calls AS (SELECT id, lower(owner) AS o, unnest(list_transform(regexp_extract_all(code, '(?i)((?:{_N}\\.)?{_N})\\s*[(;]', 1),
          lambda x: lower(x))) AS c FROM ids),
        edges AS (SELECT DISTINCT k.id AS child, r.id AS parent FROM calls k JOIN ids r ON r.type IN ('PROCEDURE', 'FUNCTION')
          AND lower(r.owner) = CASE WHEN contains(c, '.') THEN split_part(c, '.', 1) ELSE o END
          AND lower(r.name) = split_part(c, '.', -1) WHERE k.id <> r.id),
        roots AS (SELECT owner || '.' || lower(name) || '.' || lower(type) AS id, reason FROM aside),
        reach AS (SELECT child, parent AS root FROM edges WHERE parent IN (SELECT id FROM roots)
          UNION SELECT e.child, r.root FROM edges e JOIN reach r ON e.parent = r.child)
        SELECT i.owner, i.name, i.type, min(root) AS blocked_by, arg_min(r.reason, root) AS reason
        FROM reach JOIN ids i ON i.id = child JOIN roots r ON r.id = root
        WHERE child NOT IN (SELECT id FROM roots) GROUP BY i.owner, i.name, i.type""", "bodies", "cat_views", recursive=True),
    "rw_envelope": _with(_ENVELOPE, "bodies", "cat_views"),
    "rw_trigger": _with(_BLOCK_TRIGGERS, "bodies", "cat_views"),
    "rw_trigger_call": _with(_CALL_TRIGGERS, "bodies", "cat_views"),
    "trigger_balance": _with(f"""+{_TRIAGED},
        t AS (SELECT *, {_CALLED} AS callee FROM ready WHERE type = 'TRIGGER'),
        r AS (SELECT DISTINCT owner, lower(name) AS target FROM ready WHERE type IN ('PROCEDURE', 'FUNCTION')),
        j AS (SELECT t.owner, t.callee = '' OR r.target IS NOT NULL AS runs FROM t
          LEFT JOIN r ON r.owner = t.owner AND r.target = t.callee)
        SELECT owner, count(*) AS accepted, count(*) FILTER (runs) AS emitted, count(*) FILTER (NOT runs) AS quarantined
        FROM j GROUP BY owner""", "bodies", "cat_views"),
    "rw_view": _with(_VIEW, "cat_views"),
    "migrate_report": _REPORT.format(orders_where="", lines_where=""),
    "migrate_referential": _REPORT.format(
        orders_where="WHERE o_custkey IN (SELECT c_custkey FROM c)", lines_where="WHERE l_orderkey IN (SELECT o_orderkey FROM o)"
    ),
}

#: Text columns, which may hold line breaks.
_TEXTS = {
    "region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"],
    "part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag", "l_linestatus"],
    "events": ["event_type", "props"], "documents": ["text", "lang", "source"], "embeddings": [], "pages": ["url", "html"], "benchmark": ["text"],
    "labels": [], "conversations": ["role", "text"],
}


def _line_breaks(column: str) -> str:
    return f"coalesce(length({column}) - length(replace({column}, chr(10), '')), 0)"


def _script_rows(table: str) -> str:
    breaks = "".join(f" + {_line_breaks(c)}" for c in _TEXTS[table])
    kept = " WHERE c_acctbal > 0" if table == "customer" else ""
    return f"SELECT 'rows' AS section, '{table}' AS name, CAST(sum(1{breaks}) AS BIGINT) AS n_lines FROM {table}{kept}"


def _script_code(section: str, kinds: str, *queries: str) -> str:
    parts = " UNION ALL ".join(f"SELECT target_type, script FROM ({ORACLE_SQL[q]})" for q in queries)
    return (
        f"SELECT '{section}' AS section, 'all' AS name, CAST(sum(1 + {_line_breaks('script')}) AS BIGINT) AS n_lines "
        f"FROM ({parts}) WHERE target_type IN ({kinds})"
    )


ORACLE_SQL["script_full"] = " UNION ALL ".join([
    "SELECT 'tables' AS section, 'all' AS name, CAST(14 AS BIGINT) AS n_lines", "SELECT 'primary-keys', 'all', 14", "SELECT 'sequences', 'all', 18",
    "SELECT 'foreign-keys', 'all', 8", *(_script_rows(t) for t in _TEXTS),
    _script_code("routines", "'FUNCTION', 'PROCEDURE'", "rw_envelope", "rw_trigger", "rw_trigger_call"),
    _script_code("views", "'VIEW'", "rw_view"), _script_code("triggers", "'TRIGGER'", "rw_trigger", "rw_trigger_call"),
])
