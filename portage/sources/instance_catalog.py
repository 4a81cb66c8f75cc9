"""Catalog tables with one object per business row.

A database catalog is small; the operators over it are not limited to small ones. These shapes turn every row of
the business tables into a catalog object (a table, a constraint, a stored source, ...), so that the catalog
operators run over inputs that grow with the data. Each shape is one SQL text over the business tables, written
in the dialect Spark and other ANSI engines share, with ``{table}`` marking an input.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portage.operators.stored_code import assemble
from portage.session import new_work_dir, path_bytes, path_exists, path_state, stage
from portage.sources.tables import parquet_table, spread

_OWNER = "'SALES_' || o.o_orderstatus"

# One row per order line: duplicates of (order, line number) collapse.
_LINES = """
SELECT l_orderkey, l_linenumber, min(l_returnflag) AS flag, min(l_linestatus) AS status,
       min(l_partkey) AS partkey, min(l_suppkey) AS suppkey
FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""

SHAPES = {
    "cat_tables": """
SELECT 'GEO' AS owner, 'REGION_' || r_regionkey AS table_name FROM {region}
UNION ALL SELECT 'GEO', 'NATION_' || n_nationkey FROM {nation}
UNION ALL SELECT c_mktsegment, 'CUSTOMER_' || c_custkey FROM {customer}
UNION ALL SELECT 'SUPPLY', 'SUPPLIER_' || s_suppkey FROM {supplier}
UNION ALL SELECT upper(p_brand), 'PART_' || p_partkey FROM {part}
UNION ALL SELECT 'SALES_' || o_orderstatus, 'ORDERS_' || o_orderkey FROM {orders}
UNION ALL SELECT 'SALES_' || o_orderstatus, 'SHIPMENT_' || o_orderkey FROM {orders}""",
    "cat_constraints": f"""
SELECT 'GEO' AS owner, 'PK_REGION_' || r_regionkey AS constraint_name, 'REGION_' || r_regionkey AS table_name,
       'P' AS constraint_type, CAST(NULL AS STRING) AS r_owner, CAST(NULL AS STRING) AS r_constraint_name,
       CAST(NULL AS STRING) AS delete_rule FROM {{region}}
UNION ALL SELECT 'GEO', 'PK_NATION_' || n_nationkey, 'NATION_' || n_nationkey, 'P', NULL, NULL, NULL FROM {{nation}}
UNION ALL SELECT c_mktsegment, 'PK_CUSTOMER_' || c_custkey, 'CUSTOMER_' || c_custkey, 'P', NULL, NULL, NULL
  FROM {{customer}}
UNION ALL SELECT 'SUPPLY', 'PK_SUPPLIER_' || s_suppkey, 'SUPPLIER_' || s_suppkey, 'P', NULL, NULL, NULL FROM {{supplier}}
UNION ALL SELECT upper(p_brand), 'PK_PART_' || p_partkey, 'PART_' || p_partkey, 'P', NULL, NULL, NULL FROM {{part}}
UNION ALL SELECT {_OWNER}, 'PK_ORDERS_' || o.o_orderkey, 'ORDERS_' || o.o_orderkey, 'P', NULL, NULL, NULL
  FROM {{orders}} o JOIN (SELECT DISTINCT l_orderkey FROM {{lineitem}}) l ON l.l_orderkey = o.o_orderkey
UNION ALL SELECT 'GEO', 'FK_NATION_' || n_nationkey, 'NATION_' || n_nationkey, 'R', 'GEO', 'PK_REGION_' || n_regionkey,
  'CASCADE' FROM {{nation}}
UNION ALL SELECT c_mktsegment, 'FK_CUSTOMER_' || c_custkey, 'CUSTOMER_' || c_custkey, 'R', 'GEO',
  'PK_NATION_' || c_nationkey, 'NO ACTION' FROM {{customer}}
UNION ALL SELECT 'SUPPLY', 'FK_SUPPLIER_' || s_suppkey, 'SUPPLIER_' || s_suppkey, 'R', 'GEO',
  'PK_NATION_' || s_nationkey, 'NO ACTION' FROM {{supplier}}
UNION ALL SELECT {_OWNER}, 'FK_ORDERS_' || o.o_orderkey, 'ORDERS_' || o.o_orderkey, 'R', c.c_mktsegment,
  'PK_CUSTOMER_' || o.o_custkey, CASE o.o_orderstatus WHEN 'F' THEN 'CASCADE' WHEN 'O' THEN 'NO ACTION' ELSE 'SET NULL' END
  FROM {{orders}} o JOIN {{customer}} c ON c.c_custkey = o.o_custkey
UNION ALL SELECT {_OWNER}, 'FK_ORDERS_' || o.o_orderkey || '_P' || l.l_partkey, 'ORDERS_' || o.o_orderkey, 'R',
  upper(p.p_brand), 'PK_PART_' || l.l_partkey, 'SET NULL'
  FROM {{orders}} o JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM {{lineitem}}) l ON l.l_orderkey = o.o_orderkey
  JOIN {{part}} p ON p.p_partkey = l.l_partkey
UNION ALL SELECT {_OWNER}, 'FK_ORDERS_' || o.o_orderkey || '_S' || l.l_suppkey, 'ORDERS_' || o.o_orderkey, 'R',
  'SUPPLY', 'PK_SUPPLIER_' || l.l_suppkey, 'SET NULL'
  FROM {{orders}} o JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM {{lineitem}}) l ON l.l_orderkey = o.o_orderkey
UNION ALL SELECT {_OWNER}, 'FK_SHIPMENT_' || o.o_orderkey, 'SHIPMENT_' || o.o_orderkey, 'R', {_OWNER},
  'PK_ORDERS_' || o.o_orderkey, 'CASCADE'
  FROM {{orders}} o JOIN (SELECT DISTINCT l_orderkey FROM {{lineitem}}) l ON l.l_orderkey = o.o_orderkey""",
    "cat_cons_columns": f"""
SELECT 'GEO' AS owner, 'PK_REGION_' || r_regionkey AS constraint_name, 'REGION_' || r_regionkey AS table_name,
       'R_KEY' AS column_name, 1 AS position FROM {{region}}
UNION ALL SELECT 'GEO', 'PK_NATION_' || n_nationkey, 'NATION_' || n_nationkey, 'N_KEY', 1 FROM {{nation}}
UNION ALL SELECT c_mktsegment, 'PK_CUSTOMER_' || c_custkey, 'CUSTOMER_' || c_custkey, 'C_KEY', 1 FROM {{customer}}
UNION ALL SELECT 'SUPPLY', 'PK_SUPPLIER_' || s_suppkey, 'SUPPLIER_' || s_suppkey, 'S_KEY', 1 FROM {{supplier}}
UNION ALL SELECT upper(p_brand), 'PK_PART_' || p_partkey, 'PART_' || p_partkey, 'P_KEY', 1 FROM {{part}}
UNION ALL SELECT {_OWNER}, 'PK_ORDERS_' || o.o_orderkey, 'ORDERS_' || o.o_orderkey, 'LINE_' || l.l_linenumber, l.l_linenumber
  FROM {{orders}} o JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM {{lineitem}}) l ON l.l_orderkey = o.o_orderkey
UNION ALL SELECT 'GEO', 'FK_NATION_' || n_nationkey, 'NATION_' || n_nationkey, 'N_REGION', 1 FROM {{nation}}
UNION ALL SELECT c_mktsegment, 'FK_CUSTOMER_' || c_custkey, 'CUSTOMER_' || c_custkey, 'C_NATION', 1 FROM {{customer}}
UNION ALL SELECT 'SUPPLY', 'FK_SUPPLIER_' || s_suppkey, 'SUPPLIER_' || s_suppkey, 'S_NATION', 1 FROM {{supplier}}
UNION ALL SELECT {_OWNER}, 'FK_ORDERS_' || o.o_orderkey, 'ORDERS_' || o.o_orderkey, 'O_CUST', 1 FROM {{orders}} o
UNION ALL SELECT {_OWNER}, 'FK_ORDERS_' || o.o_orderkey || '_P' || l.l_partkey, 'ORDERS_' || o.o_orderkey,
  'P_' || l.l_partkey, 1
  FROM {{orders}} o JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM {{lineitem}}) l ON l.l_orderkey = o.o_orderkey
UNION ALL SELECT {_OWNER}, 'FK_ORDERS_' || o.o_orderkey || '_S' || l.l_suppkey, 'ORDERS_' || o.o_orderkey,
  'S_' || l.l_suppkey, 1
  FROM {{orders}} o JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM {{lineitem}}) l ON l.l_orderkey = o.o_orderkey
UNION ALL SELECT {_OWNER}, 'FK_SHIPMENT_' || o.o_orderkey, 'SHIPMENT_' || o.o_orderkey, 'S_LINE_' || l.l_linenumber,
  l.l_linenumber
  FROM {{orders}} o JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM {{lineitem}}) l ON l.l_orderkey = o.o_orderkey""",
    "cat_columns": f"""
SELECT {_OWNER} AS owner, 'ORDERS_' || o.o_orderkey AS table_name, 'LINE_' || l.l_linenumber AS column_name,
  CASE l.flag WHEN 'A' THEN 'NUMBER' WHEN 'N' THEN 'VARCHAR2' ELSE 'TIMESTAMP(6)' END AS data_type,
  CASE WHEN l.flag = 'R' THEN '"SALES_' || o.o_orderstatus || '"."ISEQ_' || o.o_orderkey || '_' || l.l_linenumber || '".nextval'
       WHEN l.status = 'O' THEN '''O''' END AS data_default, l.l_linenumber AS position
  FROM {{orders}} o JOIN ({_LINES}) l ON l.l_orderkey = o.o_orderkey
UNION ALL SELECT {_OWNER}, 'ORDERS_' || o.o_orderkey, 'O_CUST', 'NUMBER',
  CASE WHEN o.o_orderstatus = 'P' THEN '"APP"."S_CUST".nextval' END, 100 FROM {{orders}} o
UNION ALL SELECT {_OWNER}, 'ORDERS_' || o.o_orderkey, 'O_NOTE', 'CLOB', NULL, 101 FROM {{orders}} o
UNION ALL SELECT {_OWNER}, 'SHIPMENT_' || o.o_orderkey, 'S_LINE_' || l.l_linenumber, 'NUMBER', NULL, l.l_linenumber
  FROM {{orders}} o JOIN ({_LINES}) l ON l.l_orderkey = o.o_orderkey
UNION ALL SELECT c_mktsegment, 'CUSTOMER_' || c_custkey, 'C_KEY', 'NUMBER', NULL, 1 FROM {{customer}}
UNION ALL SELECT c_mktsegment, 'CUSTOMER_' || c_custkey, 'C_NATION', 'INTEGER', NULL, 2 FROM {{customer}}
UNION ALL SELECT 'SUPPLY', 'SUPPLIER_' || s_suppkey, 'S_KEY', 'NUMBER', NULL, 1 FROM {{supplier}}
UNION ALL SELECT 'SUPPLY', 'SUPPLIER_' || s_suppkey, 'S_NATION', 'INTEGER', NULL, 2 FROM {{supplier}}
UNION ALL SELECT upper(p_brand), 'PART_' || p_partkey, 'P_KEY', 'NUMBER', NULL, 1 FROM {{part}}
UNION ALL SELECT 'GEO', 'NATION_' || n_nationkey, 'N_KEY', 'NUMBER', NULL, 1 FROM {{nation}}
UNION ALL SELECT 'GEO', 'NATION_' || n_nationkey, 'N_REGION', 'NUMBER', NULL, 2 FROM {{nation}}
UNION ALL SELECT 'GEO', 'REGION_' || r_regionkey, 'R_KEY', 'NUMBER', NULL, 1 FROM {{region}}""",
    # Sequences exist for lines of finished orders only; those of other orders are unknown to the source.
    "cat_sequences": f"""
SELECT 'SALES_' || o.o_orderstatus AS sequence_owner, 'ISEQ_' || o.o_orderkey || '_' || l.l_linenumber AS sequence_name,
  l.partkey AS last_number, CAST(l.l_linenumber AS BIGINT) AS increment_by
  FROM {{orders}} o JOIN ({_LINES}) l ON l.l_orderkey = o.o_orderkey
  WHERE l.flag = 'R' AND o.o_orderstatus = 'F'""",
    "cat_dependencies": f"""
SELECT DISTINCT {_OWNER} AS owner, 'SRC_' || o.o_orderkey AS name,
  CASE o.o_orderstatus WHEN 'F' THEN 'FUNCTION' WHEN 'O' THEN 'PROCEDURE' ELSE 'TRIGGER' END AS type,
  CASE WHEN l.l_linestatus = 'F' THEN 'APP' WHEN l.l_returnflag = 'N' THEN 'PUBLIC' WHEN l.l_returnflag = 'A' THEN 'MDSYS'
       ELSE 'APP' END AS referenced_owner,
  'OBJ_' || l.l_partkey AS referenced_name,
  CASE WHEN l.l_returnflag = 'A' THEN 'VIEW' WHEN l.l_returnflag = 'N' THEN 'SEQUENCE' WHEN l.l_linestatus = 'F' THEN 'TABLE'
       ELSE 'PACKAGE' END AS referenced_type
  FROM {{orders}} o JOIN {{lineitem}} l ON l.l_orderkey = o.o_orderkey
UNION ALL SELECT 'CHAT' AS owner, 'TURN_' || conv_id || '_' || turn, CASE role WHEN 'user' THEN 'PROCEDURE' ELSE 'FUNCTION' END,
  'CHAT', 'TURN_' || conv_id || '_' || (turn - 1), CASE role WHEN 'user' THEN 'FUNCTION' ELSE 'PROCEDURE' END
  FROM {{conversations}} WHERE turn > 0""",
    "cat_views": """
SELECT CASE WHEN p_size > 45 THEN 'SYS' ELSE 'APP' END AS owner, 'PART_' || p_partkey AS view_name,
  'SELECT "P"."NAME", P."SIZE" FROM "STOCK_' || p_partkey || '" P JOIN SIZES S ON S.N = ' || p_size
  || ' WHERE "P"."NAME" = ''' || p_name || ' FROM x''' AS text FROM {part}""",
    "cat_triggers": """
SELECT o_orderpriority AS schema, 'TRG_' || o_orderkey AS trigger_name, 'CUSTOMER_' || o_custkey AS table_name,
  'FN_' || o_custkey AS function_name, o_orderstatus = 'P' AS is_internal FROM {orders}""",
    # One-letter kind codes; 'p' is a code the decoding does not know.
    "cat_objects": """
SELECT n.n_name AS schema, 'obj_' || o.o_orderkey AS name, c.c_name AS owner,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'r' WHEN '2-HIGH' THEN 'v' WHEN '3-MEDIUM' THEN 'i'
       WHEN '4-NOT SPECIFIED' THEN 'S' ELSE 'p' END AS kind
  FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey JOIN {nation} n ON n.n_nationkey = c.c_nationkey""",
    # Stored code: one object per order (its lines are the statements).
    "order_source": """
SELECT owner, name, type, line, text FROM (
SELECT 'APP' AS owner, 'src_' || o.o_orderkey AS name,
  CASE o.o_orderstatus WHEN 'F' THEN 'FUNCTION' WHEN 'O' THEN 'PROCEDURE' ELSE 'TRIGGER' END AS type, 1 AS line,
  CASE o.o_orderstatus
    WHEN 'O' THEN 'PROCEDURE src_' || o.o_orderkey || '(a IN NUMBER, b OUT VARCHAR2) IS'
    WHEN 'F' THEN 'FUNCTION src_' || o.o_orderkey || '(a NUMBER) RETURN NUMBER IS'
    ELSE 'TRIGGER src_' || o.o_orderkey || ' BEFORE INSERT ON customer_' || o.o_custkey || ' FOR EACH ROW'
      || CASE WHEN o.o_orderpriority = '1-URGENT' THEN ' CALL src_' || o.o_custkey || '(1, ''x'')' ELSE '' END END AS text
  FROM {orders} o
UNION ALL SELECT 'APP', 'src_' || o.o_orderkey, CASE o.o_orderstatus WHEN 'F' THEN 'FUNCTION' ELSE 'PROCEDURE' END, 2,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'v customer_' || o.o_custkey || '.c_acctbal%TYPE; -- don''t use NUMBER here'
    WHEN '2-HIGH' THEN 'PRAGMA AUTONOMOUS_TRANSACTION;' WHEN '3-MEDIUM' THEN 'too_big EXCEPTION;'
    WHEN '4-NOT SPECIFIED' THEN 'CURSOR c1 IS SELECT 1 FROM dual;' ELSE 'n NUMBER := 1; /* a VARCHAR2 ''note'' */' END
  FROM {orders} o WHERE o.o_orderstatus <> 'P'
UNION ALL SELECT 'APP', 'src_' || o.o_orderkey,
  CASE o.o_orderstatus WHEN 'F' THEN 'FUNCTION' WHEN 'O' THEN 'PROCEDURE' ELSE 'TRIGGER' END, 10, 'BEGIN'
  FROM {orders} o WHERE NOT (o.o_orderstatus = 'P' AND o.o_orderpriority = '1-URGENT')
UNION ALL SELECT 'APP', 'src_' || o.o_orderkey,
  CASE o.o_orderstatus WHEN 'F' THEN 'FUNCTION' WHEN 'O' THEN 'PROCEDURE' ELSE 'TRIGGER' END, 10 + l.l_linenumber,
  CASE WHEN o.o_orderstatus = 'P' THEN
    CASE l.l_returnflag WHEN 'A' THEN ':new.id := seq_' || l.l_suppkey || '.nextval;'
      WHEN 'N' THEN 'SELECT ' || l.l_partkey || ' INTO x FROM dual;'
      ELSE 'DBMS_OUTPUT.PUT_LINE(''was '' || :old.qty || '' of 100%'');' END
  ELSE
    CASE l.l_returnflag || l.l_linestatus
      WHEN 'AF' THEN 'DBMS_OUTPUT.PUT_LINE(''part '' || a || '' of supplier '' || b);'
      WHEN 'AO' THEN 'DBMS_LOCK.SLEEP(' || l.l_linenumber || ');'
      WHEN 'NF' THEN 'EXECUTE IMMEDIATE q; y := ''NUMBER one'';'
      WHEN 'NO' THEN 'SELECT seq_' || l.l_suppkey || '.nextval INTO y FROM dual;'
      WHEN 'RF' THEN 'RAISE too_big;'
      ELSE 'FOR r IN (SELECT 1 FROM part_' || l.l_partkey || ' e JOIN other.dept d ON 1 = 1) LOOP x := 1; END LOOP;' END
  END
  FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey
  WHERE NOT (o.o_orderstatus = 'P' AND o.o_orderpriority = '1-URGENT')
UNION ALL SELECT 'APP', 'src_' || o.o_orderkey, 'FUNCTION', 70, 'y := src_' || (o.o_orderkey - 1) || '(1) + app.src_' || o.o_custkey || '(2);'
  FROM {orders} o WHERE o.o_orderstatus = 'F'
UNION ALL SELECT 'APP', 'src_' || o.o_orderkey, CASE o.o_orderstatus WHEN 'F' THEN 'FUNCTION' ELSE 'PROCEDURE' END, 80,
  CASE WHEN o.o_orderstatus = 'F' THEN 'RETURN 1;'
    WHEN o.o_orderpriority = '2-HIGH' THEN 'raise_application_error(-20001, ''bad row 5%'');'
    WHEN o.o_orderpriority = '5-LOW' THEN 'DBMS_LOB.WRITE(x);'
    WHEN o.o_orderpriority = '3-MEDIUM' THEN 'BEGIN x := 2; END;' ELSE 'x := 3;' END
  FROM {orders} o WHERE o.o_orderstatus <> 'P'
UNION ALL SELECT 'APP', 'src_' || o.o_orderkey, CASE o.o_orderstatus WHEN 'F' THEN 'FUNCTION' ELSE 'PROCEDURE' END, 90,
  'EXCEPTION WHEN too_big THEN x := 0;' FROM {orders} o WHERE o.o_orderstatus <> 'P' AND o.o_orderpriority = '3-MEDIUM'
UNION ALL SELECT 'APP', 'src_' || o.o_orderkey,
  CASE o.o_orderstatus WHEN 'F' THEN 'FUNCTION' WHEN 'O' THEN 'PROCEDURE' ELSE 'TRIGGER' END, 99, 'END;'
  FROM {orders} o WHERE NOT (o.o_orderstatus = 'P' AND o.o_orderpriority = '1-URGENT')
) s""",
    "turn_source": """
SELECT 'CHAT' AS owner, 'conv_' || conv_id AS name, 'PROCEDURE' AS type, CAST(turn AS INT) AS line, text FROM {conversations}""",
}

# The same rows by plans that move the order lines once for each use: they are dealt by order into parts of a bounded size (``{parts}``
# of them), in which they are made distinct as numbers and meet their orders; only then names are made. The shapes above say
# what the rows are. Branches without order lines are taken from there.
_DEALT = "SELECT /*+ REPARTITION({{parts}}, l_orderkey) */ {columns} FROM {{lineitem}}"
_ORDERS_ONCE = "(SELECT DISTINCT o_orderkey, o_orderstatus FROM {orders})"
_REFERENCED = "inline(array(named_struct('kind', 'L', 'num', CAST(l_linenumber AS BIGINT)), named_struct('kind', 'P', 'num', CAST(l_partkey AS BIGINT)), named_struct('kind', 'S', 'num', CAST(l_suppkey AS BIGINT))))"


def _without_lines(text: str) -> str:
    """The branches of a shape that do not read the order lines."""
    first, *others = text.split("UNION ALL SELECT")
    return first + "".join("UNION ALL SELECT" + b for b in others if "{lineitem}" not in b)


PLANS = {
    "cat_constraints": _without_lines(SHAPES["cat_constraints"]) + f"""
UNION ALL SELECT k.* FROM (
  SELECT inline(CASE WHEN l.suppkey IS NULL AND l.whole THEN array(
      named_struct('owner', {_OWNER}, 'constraint_name', 'PK_ORDERS_' || o.o_orderkey, 'table_name', 'ORDERS_' || o.o_orderkey,
        'constraint_type', 'P', 'r_owner', CAST(NULL AS STRING), 'r_constraint_name', CAST(NULL AS STRING), 'delete_rule', CAST(NULL AS STRING)),
      named_struct('owner', {_OWNER}, 'constraint_name', 'FK_SHIPMENT_' || o.o_orderkey, 'table_name', 'SHIPMENT_' || o.o_orderkey,
        'constraint_type', 'R', 'r_owner', {_OWNER}, 'r_constraint_name', 'PK_ORDERS_' || o.o_orderkey, 'delete_rule', 'CASCADE'))
    ELSE array(
      named_struct('owner', {_OWNER}, 'constraint_name', 'FK_ORDERS_' || o.o_orderkey || '_S' || l.suppkey, 'table_name', 'ORDERS_' || o.o_orderkey,
        'constraint_type', 'R', 'r_owner', 'SUPPLY', 'r_constraint_name', 'PK_SUPPLIER_' || l.suppkey, 'delete_rule', 'SET NULL')) END)
  FROM {{orders}} o JOIN (
    SELECT DISTINCT l_orderkey, whole, suppkey FROM (
      SELECT l_orderkey, inline(array(named_struct('whole', true, 'suppkey', CAST(NULL AS BIGINT)), named_struct('whole', false, 'suppkey', CAST(l_suppkey AS BIGINT))))
      FROM ({_DEALT.format(columns="l_orderkey, l_suppkey")}))) l ON l.l_orderkey = o.o_orderkey) k
UNION ALL SELECT {_OWNER}, 'FK_ORDERS_' || o.o_orderkey || '_P' || l.l_partkey, 'ORDERS_' || o.o_orderkey, 'R',
  upper(p.p_brand), 'PK_PART_' || l.l_partkey, 'SET NULL'
  FROM {{orders}} o JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM ({_DEALT.format(columns="l_orderkey, l_partkey")})) l
  ON l.l_orderkey = o.o_orderkey JOIN {{part}} p ON p.p_partkey = l.l_partkey""",
    "cat_cons_columns": _without_lines(SHAPES["cat_cons_columns"]) + f"""
UNION ALL SELECT k.* FROM (
  SELECT inline(CASE l.kind
    WHEN 'L' THEN array(
      named_struct('owner', {_OWNER}, 'constraint_name', 'PK_ORDERS_' || o.o_orderkey, 'table_name', 'ORDERS_' || o.o_orderkey,
        'column_name', 'LINE_' || l.num, 'position', CAST(l.num AS INT)),
      named_struct('owner', {_OWNER}, 'constraint_name', 'FK_SHIPMENT_' || o.o_orderkey, 'table_name', 'SHIPMENT_' || o.o_orderkey,
        'column_name', 'S_LINE_' || l.num, 'position', CAST(l.num AS INT)))
    ELSE array(
      named_struct('owner', {_OWNER}, 'constraint_name', 'FK_ORDERS_' || o.o_orderkey || '_' || l.kind || l.num, 'table_name', 'ORDERS_' || o.o_orderkey,
        'column_name', l.kind || '_' || l.num, 'position', 1)) END)
  FROM {{orders}} o JOIN (
    SELECT DISTINCT l_orderkey, kind, num FROM (
      SELECT l_orderkey, {_REFERENCED} FROM ({_DEALT.format(columns="l_orderkey, l_linenumber, l_partkey, l_suppkey")}))) l
  ON l.l_orderkey = o.o_orderkey) k""",
    "cat_dependencies": f"""
SELECT {_OWNER} AS owner, 'SRC_' || o.o_orderkey AS name,
  CASE o.o_orderstatus WHEN 'F' THEN 'FUNCTION' WHEN 'O' THEN 'PROCEDURE' ELSE 'TRIGGER' END AS type,
  l.referenced_owner, 'OBJ_' || l.l_partkey AS referenced_name, l.referenced_type
  FROM {_ORDERS_ONCE} o JOIN (
    SELECT DISTINCT l_orderkey, l_partkey, referenced_owner, referenced_type FROM ({_DEALT.format(columns='''l_orderkey, l_partkey,
      CASE WHEN l_linestatus = 'F' THEN 'APP' WHEN l_returnflag = 'N' THEN 'PUBLIC' WHEN l_returnflag = 'A' THEN 'MDSYS'
        ELSE 'APP' END AS referenced_owner,
      CASE WHEN l_returnflag = 'A' THEN 'VIEW' WHEN l_returnflag = 'N' THEN 'SEQUENCE' WHEN l_linestatus = 'F' THEN 'TABLE'
        ELSE 'PACKAGE' END AS referenced_type''')})) l ON l.l_orderkey = o.o_orderkey
""" + "UNION ALL SELECT" + SHAPES["cat_dependencies"].split("UNION ALL SELECT", 1)[1],
}

#: Stored bytes of order lines that make one part: about half a million of them.
PART_BYTES = 8 << 20

# Business tables each shape reads.
_INPUTS = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "conversations"]


# Catalog tables of this session and where they are stored, by folder, name and state of the folder.
_WRITTEN: dict[tuple, tuple[DataFrame, str]] = {}


def _written_once(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The catalog table as a stored table, as a catalog is: written on first use, then read.

    It is written anew if the files in the folder have changed.
    """
    key = (spark.sparkContext.applicationId, folder, name, path_state(spark, f"{folder.rstrip('/')}/*"))
    if key not in _WRITTEN or not path_exists(spark, _WRITTEN[key][1]):
        path = f"{new_work_dir(spark, 'catalog')}/{name}"
        _WRITTEN[key] = stage(make(), path), path
    return _WRITTEN[key][0]


def shape(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One catalog table over the business tables in ``folder``."""
    text = PLANS.get(name, SHAPES[name])

    def make() -> DataFrame:
        nonlocal text
        if "{parts}" in text:
            parts = max(spark.sparkContext.defaultParallelism, path_bytes(spark, f"{folder.rstrip('/')}/lineitem.parquet") // PART_BYTES)
            text = text.replace("{parts}", str(parts))
        inputs = {t: parquet_table(spark, folder, t) for t in _INPUTS if "{" + t + "}" in text}
        return spark.sql(text, **inputs)

    return _written_once(spark, folder, name, make)


def document_source(spark: SparkSession, folder: str) -> DataFrame:
    """Stored procedures made of whole documents: every text line is printed by one statement."""
    documents = spread(parquet_table(spark, folder, "documents"))
    name = F.concat(F.lit("doc_"), F.col("doc_id"))
    lines = documents.select(name.alias("name"), F.posexplode(F.split("text", "\n")).alias("pos", "line_text")).select(
        "name",
        (F.col("pos") + 10).alias("line"),
        F.concat(
            F.lit("DBMS_OUTPUT.PUT_LINE('"), F.replace("line_text", F.lit("'"), F.lit("''")), F.lit("' || a);")
        ).alias("text"),
    )
    frame = [
        (F.lit(1), F.concat(F.lit("PROCEDURE "), name, F.lit("(a IN NUMBER) IS"))),
        (F.lit(2), F.lit("BEGIN")),
        (F.size(F.split("text", "\n")) + 10, F.lit("END;")),
    ]
    out = lines
    for line, text in frame:
        out = out.unionByName(documents.select(name.alias("name"), line.alias("line"), text.alias("text")))
    return out.select(
        F.lit("DOCS").alias("owner"), "name", F.lit("PROCEDURE").alias("type"), F.col("line").cast("int").alias("line"), "text"
    )


def source_lines(spark: SparkSession, folder: str) -> DataFrame:
    """All stored code lines: ``owner, name, type, line, text``."""
    documents = _written_once(spark, folder, "document_source", lambda: document_source(spark, folder))
    return shape(spark, folder, "order_source").unionByName(documents).unionByName(shape(spark, folder, "turn_source"))


def bodies(spark: SparkSession, folder: str) -> DataFrame:
    """The stored code assembled, one row per object."""
    return _written_once(spark, folder, "bodies", lambda: assemble(source_lines(spark, folder)))


cat_tables = partial(shape, name="cat_tables")
cat_columns = partial(shape, name="cat_columns")
cat_constraints = partial(shape, name="cat_constraints")
cat_cons_columns = partial(shape, name="cat_cons_columns")
cat_dependencies = partial(shape, name="cat_dependencies")
cat_sequences = partial(shape, name="cat_sequences")
cat_views = partial(shape, name="cat_views")
cat_triggers = partial(shape, name="cat_triggers")
cat_objects = partial(shape, name="cat_objects")
