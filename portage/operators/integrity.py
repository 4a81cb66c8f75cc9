"""Key checks as distributed jobs: nothing enforces a key on a lake table, so these find what would break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _any_null(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def pk_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """Key values that are null or occur more than once, with their row count.

    Only the key is read, and one aggregation with a map-side part finds both cases, so a key value shared by
    a third of the rows costs one row per task.
    """
    return (
        df.select(*key)
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .where((F.col("n_rows") > 1) | _any_null(key))
    )


def fk_orphans(child: DataFrame, child_key: list[str], parent: DataFrame, parent_key: list[str]) -> DataFrame:
    """Child key values without a parent and how many rows hold them. Keys with a null part are exempt.

    Child keys are counted before the join, so it moves each value once.
    """
    wanted = child.select(*child_key).where(~_any_null(child_key)).groupBy(*child_key).agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    known = parent.select(*[F.col(p).alias(c) for p, c in zip(parent_key, child_key)]).distinct()
    return wanted.join(known, child_key, "left_anti")


def keep_referenced(child: DataFrame, child_key: list[str], parent: DataFrame, parent_key: list[str]) -> DataFrame:
    """Child rows whose parent row is present, plus rows exempt through a null key part.

    The exempt rows pass by without a shuffle: joined on their null key they would all meet in one task.
    """
    known = parent.select(*[F.col(p).alias(c) for p, c in zip(parent_key, child_key)]).distinct()
    exempt = _any_null(child_key)
    matched = child.where(~exempt).join(known, child_key, "left_semi").select(*child.columns)
    if not any(f.nullable for f in child.schema.fields if f.name in child_key):
        return matched
    return matched.unionByName(child.where(exempt))
