"""Catalog tables of a live database, as pushed queries.

Each query runs in the database and returns the columns the catalog operators expect. The owner is an SQL literal
with its quotes doubled; nothing else is put into the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from portage.functions.names import lower_columns
from portage.sources.tables import JdbcSource

# A schema's own constraints and those its foreign keys point to.
_WANTED = """(owner = {owner} OR (owner, constraint_name) IN
  (SELECT r_owner, r_constraint_name FROM all_constraints WHERE owner = {owner} AND constraint_type = 'R'))"""

ORACLE = {
    "cat_tables": "SELECT owner, table_name FROM all_tables WHERE owner = {owner}",
    "cat_columns": """SELECT owner, table_name, column_name, data_type, data_default, column_id AS position
        FROM all_tab_columns WHERE owner = {owner}""",
    "cat_constraints": f"""SELECT owner, constraint_name, table_name, constraint_type, r_owner, r_constraint_name, delete_rule
        FROM all_constraints WHERE constraint_type IN ('P', 'U', 'R') AND {_WANTED}""",
    "cat_cons_columns": f"""SELECT owner, constraint_name, table_name, column_name, position
        FROM all_cons_columns WHERE {_WANTED}""",
    "cat_dependencies": """SELECT owner, name, type, referenced_owner, referenced_name, referenced_type
        FROM all_dependencies WHERE owner = {owner}""",
    "cat_source": "SELECT owner, name, type, line, text FROM all_source WHERE owner = {owner}",
    "cat_views": "SELECT owner, view_name, text FROM all_views WHERE owner IN ({owner}, 'SYS')",
    "cat_sequences": """SELECT sequence_owner, sequence_name, last_number, increment_by FROM all_sequences
        WHERE sequence_owner = {owner}""",
}

POSTGRES = {
    "cat_tables": """SELECT table_schema AS owner, table_name FROM information_schema.tables
        WHERE table_schema = {owner} AND table_type = 'BASE TABLE'""",
    "cat_columns": """SELECT table_schema AS owner, table_name, column_name, data_type, column_default AS data_default,
        ordinal_position AS position FROM information_schema.columns WHERE table_schema = {owner}""",
    "cat_constraints": """SELECT n.nspname AS owner, c.conname AS constraint_name, t.relname AS table_name,
        CASE c.contype WHEN 'p' THEN 'P' WHEN 'u' THEN 'U' ELSE 'R' END AS constraint_type, rn.nspname AS r_owner, r.conname AS r_constraint_name,
        CASE c.confdeltype WHEN 'c' THEN 'CASCADE' WHEN 'n' THEN 'SET NULL' WHEN 'd' THEN 'SET DEFAULT'
          WHEN 'r' THEN 'RESTRICT' WHEN 'a' THEN 'NO ACTION' END AS delete_rule
        FROM pg_constraint c JOIN pg_class t ON t.oid = c.conrelid JOIN pg_namespace n ON n.oid = t.relnamespace
        LEFT JOIN pg_constraint r ON r.conrelid = c.confrelid AND r.conindid = c.conindid AND r.contype IN ('p', 'u')
        LEFT JOIN pg_namespace rn ON rn.oid = r.connamespace
        WHERE n.nspname = {owner} AND c.contype IN ('p', 'u', 'f')""",
    "cat_cons_columns": """SELECT constraint_schema AS owner, constraint_name, table_name, column_name,
        ordinal_position AS position FROM information_schema.key_column_usage WHERE constraint_schema = {owner}""",
    "cat_sequences": """SELECT schemaname AS sequence_owner, sequencename AS sequence_name, last_value AS last_number,
        increment_by FROM pg_sequences WHERE schemaname = {owner}""",
    "cat_objects": """SELECT n.nspname AS schema, c.relname AS name, r.rolname AS owner, c.relkind AS kind FROM pg_class c
        JOIN pg_namespace n ON n.oid = c.relnamespace JOIN pg_roles r ON r.oid = c.relowner WHERE n.nspname = {owner}""",
    "cat_routines": """SELECT n.nspname AS schema, p.proname AS name, r.rolname AS owner, p.prokind AS kind,
        pg_get_functiondef(p.oid) AS body FROM pg_proc p JOIN pg_namespace n ON n.oid = p.pronamespace
        JOIN pg_roles r ON r.oid = p.proowner WHERE n.nspname = {owner} AND p.prokind IN ('f', 'p')""",
    "cat_views": "SELECT schemaname AS owner, viewname AS view_name, definition AS text FROM pg_views WHERE schemaname = {owner}",
    "cat_triggers": """SELECT n.nspname AS schema, g.tgname AS trigger_name, t.relname AS table_name,
        p.proname AS function_name, g.tgisinternal AS is_internal FROM pg_trigger g JOIN pg_class t ON t.oid = g.tgrelid
        JOIN pg_namespace n ON n.oid = t.relnamespace JOIN pg_proc p ON p.oid = g.tgfoid WHERE n.nspname = {owner}""",
}


@dataclass(frozen=True)
class DatabaseCatalog:
    """The catalog of one owner or schema; ``queries`` is ``ORACLE`` or ``POSTGRES``."""

    source: JdbcSource
    owner: str
    queries: dict[str, str]

    def sql(self, name: str) -> str:
        literal = "'" + self.owner.replace("'", "''") + "'"
        return self.queries[name].replace("{owner}", literal)

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """One catalog table. A run that reads it more than once should store it."""
        return lower_columns(self.source.query(spark, self.sql(name)))
