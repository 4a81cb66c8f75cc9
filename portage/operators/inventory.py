"""What a catalog holds: objects of an owner, user objects only, kinds decoded, triggers with their functions.

All joins are plain equi-joins. Catalogs are usually small, and then AQE broadcasts by measured size; nothing here
assumes it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Decoded relation kinds.
RELATION_KINDS = {
    "r": "TABLE", "m": "MATERIALIZED_VIEW", "i": "INDEX", "S": "SEQUENCE", "v": "VIEW", "c": "TYPE",
}
# Decoded routine kinds.
ROUTINE_KINDS = {"f": "FUNCTION", "p": "PROCEDURE"}


def owned_by(catalog: DataFrame, owner: str) -> DataFrame:
    return catalog.where(F.col("owner") == owner)


def decode_kind(code: Column, kinds: dict[str, str] = RELATION_KINDS) -> Column:
    """Readable kind; a code the table does not know stays as it is."""
    decoded = None
    for key, value in kinds.items():
        decoded = F.when(code == key, value) if decoded is None else decoded.when(code == key, value)
    return decoded.otherwise(code.cast("string"))


def user_dependencies(dependencies: DataFrame) -> DataFrame:
    """Dependency rows on user objects: packages, public synonyms and system schemas are left out."""
    return dependencies.where(
        ~F.col("referenced_type").isin("PACKAGE")
        & (F.col("referenced_owner") != "PUBLIC")
        & ~F.col("referenced_owner").like("%SYS%")
    )


def user_objects(objects: DataFrame) -> DataFrame:
    """Objects outside the system schemas. ``_`` in the pattern is a wildcard, as in the databases."""
    return objects.where(
        ~F.col("schema").isin("information_schema", "pg_catalog") & ~F.col("schema").like("pg_%")
    )


def all_objects(tables: DataFrame, views: DataFrame, lines: DataFrame) -> DataFrame:
    """Distinct ``owner, name, type`` of tables, views and stored sources."""
    return (
        tables.select("owner", F.col("table_name").alias("name"), F.lit("TABLE").alias("type"))
        .unionByName(views.select("owner", F.col("view_name").alias("name"), F.lit("VIEW").alias("type")))
        .unionByName(lines.select("owner", "name", "type"))
        .distinct()
    )


def route_objects(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables, and everything else."""
    is_table = F.col("type") == "TABLE"
    return objects.where(is_table), objects.where(~is_table)


def owned_report(objects: DataFrame, roles: DataFrame, schemas: DataFrame) -> DataFrame:
    """Objects with role and schema resolved and the kind decoded, in name order.

    ``objects(schema, name, owner, kind)``, ``roles(owner, role_id)``, ``schemas(schema, schema_id)``.
    """
    return (
        user_objects(objects)
        .join(roles, "owner")
        .join(schemas, "schema")
        .select("schema", "name", "owner", decode_kind(F.col("kind")).alias("object_type"), "role_id", "schema_id")
        .orderBy("schema", "name")
    )


def trigger_map(triggers: DataFrame, functions: DataFrame, tables: DataFrame, schemas: DataFrame) -> DataFrame:
    """User triggers with their table, function and schema.

    ``functions(function_name, function_owner)``, ``tables(table_name, table_owner)``, ``schemas(schema, schema_id)``.
    """
    return (
        triggers.where(~F.col("is_internal"))
        .join(functions, "function_name")
        .join(tables, "table_name")
        .join(schemas, "schema")
        .select("schema", "trigger_name", "table_name", "table_owner", "function_name", "function_owner", "schema_id")
    )


def dependency_rows(dependencies: DataFrame, selected: DataFrame, types: Iterable[str] | None = None) -> DataFrame:
    """Dependency rows of the selected ``owner, name`` objects, of the given referenced types."""
    rows = dependencies if types is None else dependencies.where(F.col("referenced_type").isin(*types))
    return rows.join(selected.select("owner", "name").distinct(), ["owner", "name"], "left_semi")


def distinct_references(dependencies: DataFrame) -> DataFrame:
    """The objects that any other refers to.

    Rows are dealt by object before they are made distinct: a task then holds its share of the objects. Where they are read it
    would hold nearly all objects of its split, of which a stored catalog has few and long ones.
    """
    names = ["referenced_owner", "referenced_name", "referenced_type"]
    return dependencies.select(*names).repartition(*names).distinct()
