"""Content check by hash trees: digests of key ranges are compared from the top down, and only ranges that differ are read again."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portage.operators.key_ranges import KeyRanges, key_ranges
from portage.operators.reconcile import FITS, compared_like, reconcile_content, row_parts
from portage.session import new_work_dir, stage

#: Children of a node.
FANOUT_BITS = 4

_DIGEST = ["n_rows", "d0", "d1", "d2", "d3"]


def _digests(df: DataFrame, columns: list[str]) -> list[Column]:
    """Sums of the halves of two 64-bit hashes of a row: 128 bits that do not depend on the order of the rows.

    A sum of halves holds 2 ** 31 rows of one range.
    """
    parts = [*row_parts(columns), F.col(FITS) if FITS in df.columns else F.lit(True)]
    low = F.lit(0xFFFFFFFF).cast("long")
    sums = [F.count(F.lit(1)).alias("n_rows")]
    for i, hashed in enumerate((F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts))):
        sums.append(F.sum(F.shiftrightunsigned(hashed, 32)).alias(f"d{2 * i}"))
        sums.append(F.sum(hashed.bitwiseAND(low)).alias(f"d{2 * i + 1}"))
    return sums


def hash_tree(df: DataFrame, ranges: KeyRanges, columns: list[str]) -> DataFrame:
    """``level, node`` and the digest of every node that has rows: level 0 are the ranges, the last level is one node.

    One pass over the rows with a part per task; what is shuffled and stored grows with the number of ranges only.
    """
    spark = df.sparkSession
    leaves = stage(
        df.groupBy(ranges.number().alias("node")).agg(*_digests(df, columns)), new_work_dir(spark, "hash-tree")
    )
    levels = [leaves.select(F.lit(0).alias("level"), "node", *_DIGEST)]
    for level in range(1, levels_of(ranges)):
        node = F.shiftright("node", FANOUT_BITS * level).alias("node")
        levels.append(leaves.groupBy(node).agg(*[F.sum(c).alias(c) for c in _DIGEST]).select(F.lit(level).alias("level"), "node", *_DIGEST))
    return reduce(DataFrame.unionByName, levels)


def levels_of(ranges: KeyRanges) -> int:
    """Levels until one node is left."""
    levels, nodes = 1, len(ranges)
    while nodes > 1:
        levels, nodes = levels + 1, -(-nodes >> FANOUT_BITS)
    return levels


def differing_ranges(source: DataFrame, target: DataFrame, ranges: KeyRanges) -> DataFrame:
    """The ranges whose digests differ: ``node, source_rows, target_rows``.

    Goes down from the root; of each level only the children of nodes that differ are compared.
    """
    spark, found = source.sparkSession, None
    for level in range(levels_of(ranges) - 1, -1, -1):
        sides = []
        for side, tree in (("s", source), ("t", target)):
            nodes = tree.where(F.col("level") == level)
            if found is not None:
                nodes = nodes.join(found.select(F.col("node").alias("above")), F.shiftright("node", FANOUT_BITS) == F.col("above"), "left_semi")
            sides.append(nodes.select("node", F.struct(*_DIGEST).alias(side)))
        met = sides[0].join(sides[1], "node", "full_outer").where(~F.col("s").eqNullSafe(F.col("t")))
        found = stage(met.select(
            "node", F.coalesce("s.n_rows", F.lit(0)).alias("source_rows"), F.coalesce("t.n_rows", F.lit(0)).alias("target_rows")
        ), new_work_dir(spark, "hash-tree"))
    return found


@dataclass(frozen=True)
class TreeDifference:
    """``rows`` as ``reconcile_content`` gives them; ``parts`` the ranges that differ, with their first key and rows read."""

    rows: DataFrame
    parts: DataFrame
    ranges: KeyRanges


def reconcile_tree(source: DataFrame, target: DataFrame, key: list[str], ranges: int = 1024) -> TreeDifference:
    """What ``reconcile_content`` finds, reading the rows of equal key ranges once and shuffling none of them.

    Both sides are cut at the same split points of the source's keys and digested in one pass each; trees of digests are
    compared from the top down; the second pass reads the ranges that differ, by predicates on the key that scans use to
    skip row groups. A row that lies on the other side of a split point only there is in both ranges' digests, so nothing is missed.
    """
    target = compared_like(target, source)
    key = [next((c for c in source.columns if c.lower() == k.lower()), k) for k in key]
    if absent := [k for k in key if k not in source.columns or k not in target.columns]:
        raise ValueError(f"both sides need the key column {absent[0]}")
    parts = key_ranges(source, key, ranges)
    common = [c for c in source.columns if c in target.columns]
    trees = [hash_tree(df, parts, common) for df in (source, target)]
    differ = differing_ranges(*trees, parts)
    # At most as many as there are ranges.
    numbers = [r["node"] for r in differ.select("node").collect()]
    wanted = parts.covering(numbers)
    rows = reconcile_content(source.where(wanted), target.where(wanted), key)
    starts = source.sparkSession.createDataFrame(
        [(i, parts.points[i - 1] if i else None) for i in numbers], "node int, from_key string"
    )
    return TreeDifference(rows, differ.join(starts, "node").select("node", "from_key", "source_rows", "target_rows"), parts)
