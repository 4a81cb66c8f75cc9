"""Sequences: restart values, stand-alone sequences, and new keys for new rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portage.session import new_work_dir, stage


def next_value(df: DataFrame, column: str) -> DataFrame:
    """``max + 1`` of the auto column; null on an empty table (a maximum of 0 gives 1)."""
    return df.agg((F.max(column) + 1).alias("next_value"))


def migrated_sequences(planned: DataFrame, sequences: DataFrame) -> DataFrame:
    """Start and increment of each planned sequence; one the source does not know is ``failed``.

    ``planned(sequence_owner, sequence_name)``, ``sequences(sequence_owner, sequence_name, last_number, increment_by)``.
    """
    return planned.join(sequences, ["sequence_owner", "sequence_name"], "left").select(
        "sequence_owner",
        "sequence_name",
        (F.col("last_number") + F.col("increment_by")).alias("start_with"),
        "increment_by",
        F.when(F.col("last_number").isNull(), "failed").otherwise("done").alias("state"),
    )


def sequence_actions(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """``create`` or ``restart`` for each planned sequence, by whether the target schema has it."""
    found = existing.select(F.lower("sequence_name").alias("folded")).distinct().withColumn("found", F.lit(True))
    return (
        planned.withColumn("folded", F.lower("sequence_name"))
        .join(found, "folded", "left")
        .select(*planned.columns, F.when(F.col("found"), "restart").otherwise("create").alias("action"))
    )


def assign_keys(
    df: DataFrame, order_by: list[str], key: str, last_value: int, path: str | None = None, partitions: int | None = None
) -> DataFrame:
    """Number the rows ``last_value + 1, + 2, ...`` in ``order_by`` order, without a one-task window.

    The rows are range-partitioned and sorted once and written with their place in the partition, so that the
    numbering cannot change when a lost task is run again. Counts per partition give each partition its offset:
    that table has one row per partition, whatever the data size. ``order_by`` should end in a unique key; it
    also keeps the ranges even when the leading column is skewed.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(partitions, *order_by) if partitions else df.repartitionByRange(*order_by)
    placed = stage(
        # The id holds the partition number above bit 33 and the row's place below it.
        ranged.sortWithinPartitions(*order_by).withColumn("_place", F.monotonically_increasing_id()),
        path or new_work_dir(spark, "assign-keys"),
    )
    part, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per written partition, so this is plan metadata: small enough to collect and to broadcast.
    sizes = sorted((row["_part"], row["_n"]) for row in counts.collect())
    starts = accumulate((n for _, n in sizes), initial=0)
    offsets = spark.createDataFrame(
        [(part_id, start) for (part_id, _), start in zip(sizes, starts)], "_part bigint, _offset bigint"
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .select((F.lit(last_value) + F.col("_offset") + place + 1).alias(key), *df.columns)
    )
