"""Checks after the load: counts, keys, stored sources, content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, n_rows`` for each table, as one job."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def reconcile_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """Row counts side by side; ``done`` when equal, ``failed`` when not or when one side lacks the table."""
    return source.withColumnRenamed("n_rows", "source_rows").join(
        target.withColumnRenamed("n_rows", "target_rows"), "table_name", "full_outer"
    ).select(
        "table_name",
        "source_rows",
        "target_rows",
        F.when(F.col("source_rows") == F.col("target_rows"), "done").otherwise("failed").alias("state"),
    )


def reconcile_pk(source: DataFrame, target: DataFrame) -> DataFrame:
    """Tables whose primary-key columns differ, by set equality both ways; names fold to lower case.

    Both inputs hold ``owner, table_name, column_name``; the target's owner is the one the source's table was moved from
    or to, as the caller maps it. A target without any key fails.
    """
    def side(df: DataFrame, flag: str) -> DataFrame:
        other = "in_target" if flag == "in_source" else "in_source"
        return df.select(
            F.lower("owner").alias("owner"), F.lower("table_name").alias("table_name"), F.lower("column_name").alias("column_name"),
            F.lit(1).alias(flag), F.lit(0).alias(other),
        )

    both = side(source, "in_source").unionByName(side(target, "in_target"))
    per_column = both.groupBy("owner", "table_name", "column_name").agg(
        F.max("in_source").alias("in_source"), F.max("in_target").alias("in_target")
    )
    return (
        per_column.groupBy("owner", "table_name")
        .agg(
            F.count_if((F.col("in_source") == 1) & (F.col("in_target") == 0)).alias("missing_in_target"),
            F.count_if((F.col("in_source") == 0) & (F.col("in_target") == 1)).alias("only_in_target"),
        )
        .withColumn(
            "state", F.when((F.col("missing_in_target") == 0) & (F.col("only_in_target") == 0), "done").otherwise("failed")
        )
    )


def missing_constraints(source: DataFrame, target: DataFrame) -> DataFrame:
    """Foreign keys of the source that the target's table of the same owner lacks; names fold to lower case."""
    folded = {f"_{c}": F.lower(c) for c in ("owner", "table_name", "constraint_name")}
    there = target.select(*[expression.alias(c) for c, expression in folded.items()]).distinct()
    return source.withColumns(folded).join(there, list(folded), "left_anti").drop(*folded)


def missing_sources(expected: DataFrame, target: DataFrame, bound_to: DataFrame | None = None) -> DataFrame:
    """Migrated sources the target catalog lacks, and triggers not bound to their table.

    ``expected(name, type, table_name)``, ``target(name, type)``, ``bound_to(name, table_name)`` for triggers.
    """
    fold = [F.lower("name").alias("name"), F.upper("type").alias("type")]
    wanted = expected.select(*fold, F.lower("table_name").alias("table_name"))
    absent = wanted.join(target.select(*fold).distinct(), ["name", "type"], "left_anti").select(
        "name", "type", F.lit("absent").alias("reason")
    )
    if bound_to is None:
        return absent
    bound = bound_to.select(F.lower("name").alias("name"), F.lower("table_name").alias("table_name")).distinct()
    unbound = (
        wanted.where(F.col("type") == "TRIGGER")
        .join(target.select(*fold).distinct(), ["name", "type"], "left_semi")
        .join(bound, ["name", "table_name"], "left_anti")
        .select("name", "type", F.lit("not bound").alias("reason"))
    )
    return absent.unionByName(unbound)


#: Marks rows of the target that hold a value which the source's type cannot hold.
FITS = "_fits"


def row_parts(columns: list[str]) -> list[Column]:
    """What tells rows apart: values and null flags, which keep (null, x) and (x, null) apart as a null adds nothing itself."""
    parts: list[Column] = []
    for name in columns:
        column = F.col(f"`{name}`")
        parts += [column, column.isNull()]
    return parts


def compared_like(df: DataFrame, other: DataFrame) -> DataFrame:
    """``df`` with the names and types of the columns of ``other`` that it has in whatever case.

    Where a type differs, ``_fits`` tells whether all values of the row come back unchanged from the other's type: 45.7
    does not from a whole number, nor a time of day from a date.
    """
    wanted = {f.name.lower(): f for f in other.schema.fields}
    columns, fits = [], []
    for field in df.schema.fields:
        column, like = F.col(f"`{field.name}`"), wanted.get(field.name.lower())
        if like is None:
            columns.append(column)
            continue
        own = column.try_cast(like.dataType)
        columns.append(own.alias(like.name))
        if field.dataType != like.dataType:
            fits.append(own.try_cast(field.dataType).eqNullSafe(column))
    return df.select(*columns, *([reduce(lambda a, b: a & b, fits).alias(FITS)] if fits else []))


def column_differences(source: DataFrame, target: DataFrame) -> list[tuple[str, str]]:
    """Columns of one side only, as (column, ``lost_column`` or ``added_column``); case does not matter."""
    here, there = ({c.lower() for c in df.columns if c != FITS} for df in (source, target))
    return sorted([(c, "lost_column") for c in here - there] + [(c, "added_column") for c in there - here])


def reconcile_content(source: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """Keys that were ``lost``, ``added`` or ``changed``, comparing all common columns; names match in any case.

    A column that only one side has is a difference too: one row per such column, with its name in ``column_name``, a
    null key and no counts. Without a key column in common nothing can be compared, which is an error.

    Both sides are tagged and put through one aggregation on the key: one shuffle of key and hash instead of two
    and an outer join, combined map-side, so keys that repeat (also within a side) cannot pile up in a task.
    Where a database changed a type (a number's width, a timestamp's zone) the target is compared in the source's
    type; a value that does not come back unchanged from it counts as changed.
    """
    target = target if FITS in target.columns else compared_like(target, source)
    key = [next((c for c in source.columns if c.lower() == k.lower()), k) for k in key]
    if absent := [k for k in key if k not in source.columns or k not in target.columns]:
        raise ValueError(f"both sides need the key column {absent[0]}")
    common = [c for c in source.columns if c in target.columns and c not in key]

    def side(df: DataFrame, sign: int) -> DataFrame:
        fits = F.col(FITS) if FITS in df.columns else F.lit(True)
        value = F.xxhash64(*row_parts(common), fits).cast("decimal(38,0)")
        return df.select(
            *key,
            F.lit(1 if sign > 0 else 0).cast("long").alias("_source"),
            F.lit(1 if sign < 0 else 0).cast("long").alias("_target"),
            (value * sign).cast("decimal(38,0)").alias("_diff"),
        )

    totals = side(source, 1).unionByName(side(target, -1)).groupBy(*key).agg(
        F.sum("_source").alias("source_rows"), F.sum("_target").alias("target_rows"), F.sum("_diff").alias("_diff")
    )
    rows = totals.where((F.col("source_rows") != F.col("target_rows")) | (F.col("_diff") != 0)).select(
        *key,
        F.when(F.col("target_rows") == 0, "lost")
        .when(F.col("source_rows") == 0, "added")
        .otherwise("changed")
        .alias("difference"),
        F.lit(None).cast("string").alias("column_name"),
        "source_rows",
        "target_rows",
    )
    apart = column_differences(source, target)
    if not apart:
        return rows
    columns = source.sparkSession.createDataFrame(apart, "column_name string, difference string")
    return rows.unionByName(columns.select(
        *[F.lit(None).cast(source.schema[k].dataType).alias(k) for k in key], "difference", "column_name",
        *[F.lit(None).cast("long").alias(c) for c in ("source_rows", "target_rows")],
    ))
