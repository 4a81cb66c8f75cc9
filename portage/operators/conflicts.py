"""What the target already has, and what the run will do about it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _folded(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.lower(name).alias("_folded")).distinct()


def existing_among(selected: DataFrame, existing: DataFrame, name: str) -> DataFrame:
    """Selected objects the target already has; names match case-insensitively."""
    return (
        selected.withColumn("_folded", F.lower(name)).join(_folded(existing, name), "_folded", "left_semi").drop("_folded")
    )


def existing_sources(selected: DataFrame, existing: DataFrame) -> DataFrame:
    """Selected stored sources the target already has, by name and type."""
    keys = existing.select(F.lower("name").alias("_folded"), F.upper("type").alias("_type")).distinct()
    return (
        selected.withColumn("_folded", F.lower("name"))
        .withColumn("_type", F.upper("type"))
        .join(keys, ["_folded", "_type"], "left_semi")
        .drop("_folded", "_type")
    )


def drop_unreplaced(selected: DataFrame, existing: DataFrame, replace: DataFrame, name: str) -> DataFrame:
    """The selection without the existing objects nobody chose to replace: new ones, then those to replace."""
    tagged = selected.withColumn("_folded", F.lower(name))
    new = tagged.join(_folded(existing, name), "_folded", "left_anti")
    chosen = tagged.join(_folded(existing, name), "_folded", "left_semi").join(
        _folded(replace, name), "_folded", "left_semi"
    )
    return new.unionByName(chosen).drop("_folded")


def plan_report(selected: DataFrame, existing: DataFrame, replace: DataFrame, name: str) -> DataFrame:
    """``create``, ``replace`` or ``keep`` for every selected object."""
    found = _folded(existing, name).withColumn("_found", F.lit(True))
    chosen = _folded(replace, name).withColumn("_chosen", F.lit(True))
    return (
        selected.withColumn("_folded", F.lower(name))
        .join(found, "_folded", "left")
        .join(chosen, "_folded", "left")
        .select(
            *selected.columns,
            F.when(F.col("_found").isNull(), "create")
            .when(F.col("_chosen").isNull(), "keep")
            .otherwise("replace")
            .alias("action"),
        )
    )


def common_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows both sides hold, as a set."""
    return left.intersect(right)


def names_only_in(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of the left side the right side lacks, counting copies."""
    return left.exceptAll(right)


def status_summary(status: DataFrame) -> DataFrame:
    """How many objects ended in each state, and behind which failed object.

    One row per state and blocker rather than a list in a cell: a list of all failures may be as long as the run.
    """
    return status.groupBy("state", "blocked_by").agg(
        F.count(F.lit(1)).alias("n_objects"), F.min("name").alias("first_name"), F.max("name").alias("last_name")
    )


def failures(status: DataFrame) -> DataFrame:
    """The distinct objects that did not finish."""
    return status.where(F.col("state") != "done").select("name", "state", "blocked_by").distinct()
