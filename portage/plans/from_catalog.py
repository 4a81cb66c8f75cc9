"""Turn catalog rows into the table specifications of a run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portage.operators import keys
from portage.plans.migrate import ForeignKey, TableSpec
from portage.sources.tables import Extraction, JdbcSource


def _lower(names: Sequence[str]) -> tuple[str, ...]:
    return tuple(n.lower() for n in names)


def table_specs(
    spark: SparkSession, source: JdbcSource, owner: str, tables: Sequence[str], constraints: DataFrame,
    cons_columns: DataFrame, columns: DataFrame, extractions: Mapping[str, Extraction] | None = None,
    partitions: int = 8, qualified: bool = True,
) -> dict[str, TableSpec]:
    """Specifications of the named tables of ``owner``, by lower-case name.

    Keys, references and auto columns of these tables are collected: names of the run's own objects, no table data.
    A table whose primary key is one number is read over ``partitions`` connections.
    """
    def mine(df: DataFrame, owner_column: str = "owner", table_column: str = "table_name") -> list:
        return df.where((F.col(owner_column) == owner) & F.col(table_column).isin(list(tables))).collect()

    pk = keys.pk_columns(constraints, cons_columns)
    primary = {r["table_name"]: list(r["columns"]) for r in mine(keys.keys_grouped(pk))}
    foreign: dict[str, list[ForeignKey]] = {}
    for r in mine(keys.fk_grouped(constraints, cons_columns), "src_owner", "src_table"):
        # A parent of another owner is outside the run, even if a table of this run has the same name.
        parent = r["ref_table"].lower() if r["ref_owner"] == owner else f"{r['ref_owner']}.{r['ref_table']}".lower()
        fk = ForeignKey(_lower(r["src_columns"]), parent, _lower(r["ref_columns"]))
        foreign.setdefault(r["src_table"], []).append(fk)
    # Of several columns with a sequence the first by name gives the table's restart value.
    auto = {
        r["table_name"]: r["column_name"].lower()
        for r in sorted(mine(keys.auto_columns(columns, pk)), key=lambda r: r["column_name"], reverse=True)
    }

    specs = {}
    for table in tables:
        full = f"{owner}.{table}" if qualified else table
        data = source.table(spark, full)
        key = primary.get(table, [])
        if len(key) == 1 and isinstance(data.schema[key[0]].dataType, T.NumericType):
            data = source.table(spark, full, key[0], partitions)
        specs[table.lower()] = TableSpec(
            data, _lower(key), tuple(foreign.get(table, ())), auto.get(table),
            (extractions or {}).get(table, Extraction()),
        )
    return specs
