"""Equi-depth ranges of a key of any number and type of columns: split points, range numbers and scan predicates."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from functools import reduce
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sampled keys for each range. The sample, not the table, goes through the driver.
KEYS_PER_RANGE = 128

#: Most ranges of one table: their split points are literals of a plan.
MOST_RANGES = 4096

_FORMATS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _all(parts: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


@dataclass(frozen=True)
class KeyRanges:
    """Ranges between ascending split points. Range 0 lies below the first point and holds the null keys; a point opens
    its range. ``fields`` are the key's columns with their types, each point is a JSON object of their values."""

    fields: T.StructType
    points: tuple[str, ...] = ()

    def __len__(self) -> int:
        return len(self.points) + 1

    @property
    def _places(self) -> T.StructType:
        return T.StructType([T.StructField(f"k{i}", f.dataType) for i, f in enumerate(self.fields)])

    def _literal(self, json: str, kind: T.DataType) -> Column:
        return F.from_json(F.lit(json), kind, _FORMATS)

    def number(self) -> Column:
        """The number of the range that a row's key lies in; nulls are smallest. Searches groups of points, then one group."""
        if not self.points:
            return F.lit(0)
        key = F.struct(*[F.col(f"`{f.name}`").alias(f"k{i}") for i, f in enumerate(self.fields)])
        width = isqrt(len(self.points)) + 1
        groups = [self.points[i : i + width] for i in range(0, len(self.points), width)]
        heads = self._literal(f"[{','.join(g[0] for g in groups)}]", T.ArrayType(self._places))
        bodies = self._literal(
            f"[{','.join('[' + ','.join(g) + ']' for g in groups)}]", T.ArrayType(T.ArrayType(self._places))
        )

        def within(group: Column) -> Column:
            passed = F.size(F.filter(F.get(bodies, group - 1), lambda p: p <= key))
            return F.when(group == 0, F.lit(0)).otherwise((group - 1) * width + passed)

        # The group's number is bound once; referring to it would search for it again.
        return F.transform(F.array(F.size(F.filter(heads, lambda p: p <= key))), within)[0]

    def _values(self, point: int) -> list[Column]:
        whole = self._literal(self.points[point], self._places)
        return [whole[f"k{i}"] for i in range(len(self.fields))]

    def _from(self, point: int) -> Column:
        """Rows whose key is not below a point; a null part is below everything."""
        out = F.lit(True)
        for field, value in reversed(list(zip(self.fields, self._values(point)))):
            column = F.col(f"`{field.name}`")
            out = (column > value) | ((column == value) & out)
        return out

    def _below(self, point: int) -> Column:
        out = F.lit(False)
        for field, value in reversed(list(zip(self.fields, self._values(point)))):
            column = F.col(f"`{field.name}`")
            out = column.isNull() | (column < value) | ((column == value) & out)
        return out

    def between(self, first: int, last: int) -> Column:
        """Rows of the ranges ``first`` to ``last``: comparisons of the key's columns with literals, which scans push down."""
        parts = ([self._from(first - 1)] if first > 0 else []) + ([self._below(last)] if last < len(self.points) else [])
        return _all(parts)

    def covering(self, numbers: Iterable[int], most: int = 64) -> Column:
        """A predicate that holds for all rows of the given ranges, made of at most ``most`` intervals.

        Neighbouring ranges are one interval. If there are too many, those with the smallest gaps between them are joined,
        and the rows of the gaps are taken too.
        """
        runs: list[list[int]] = []
        for number in sorted(set(numbers)):
            if runs and runs[-1][1] == number - 1:
                runs[-1][1] = number
            else:
                runs.append([number, number])
        if len(runs) > most:
            gaps = sorted(range(1, len(runs)), key=lambda i: runs[i][0] - runs[i - 1][1], reverse=True)
            starts = [0, *sorted(gaps[: most - 1])]
            runs = [[runs[a][0], runs[b - 1][1]] for a, b in zip(starts, [*starts[1:], len(runs)])]
        return reduce(lambda a, b: a | b, [self.between(*run) for run in runs], F.lit(False))

    def sql(self, values: list[tuple] | None = None, quote: str = '"') -> list[str]:
        """One SQL condition per range, for a database to evaluate: every row fulfils exactly one of them.

        The order is the database's own, so ``values``, the points as it sorts them, replace this object's points if given.
        """
        names = [f"{quote}{f.name}{quote}" for f in self.fields]
        points = self.point_values() if values is None else values

        def at_least(point: tuple) -> str:
            out = "1 = 1"
            for name, value in reversed(list(zip(names, point))):
                out = f"({name} > {sql_literal(value)} OR ({name} = {sql_literal(value)} AND {out}))"
            return out

        def below(point: tuple) -> str:
            out = "1 = 0"
            for name, value in reversed(list(zip(names, point))):
                out = f"({name} IS NULL OR {name} < {sql_literal(value)} OR ({name} = {sql_literal(value)} AND {out}))"
            return out

        if not points:
            return ["1 = 1"]
        middle = [f"{at_least(a)} AND {below(b)}" for a, b in zip(points, points[1:])]
        return [below(points[0]), *middle, at_least(points[-1])]

    def point_values(self) -> list[tuple]:
        """The points as Python values."""
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        whole = self._literal(f"[{','.join(self.points)}]", T.ArrayType(self._places))
        return [tuple(p) for p in spark.range(1).select(whole.alias("points")).first()["points"]] if self.points else []


def sql_literal(value: object) -> str:
    """A value as a literal that the usual databases read."""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, (int, float, Decimal)):
        return str(value)
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    raise TypeError(f"no literal for {type(value).__name__}")


def key_ranges(df: DataFrame, key: list[str], ranges: int) -> KeyRanges:
    """About ``ranges`` ranges of the key of ``df`` that hold about equally many distinct keys.

    The split points come from a sample that is chosen by a hash of the key, so a second call finds the same ones,
    in whatever order the rows come. A key that many rows share counts once and lies in one range. Keys with a null part are no
    points. The sample has about ``KEYS_PER_RANGE`` keys a range; only what is sampled is shuffled and collected.
    """
    if not 0 < ranges <= MOST_RANGES:
        raise ValueError(f"between 1 and {MOST_RANGES} ranges")
    by_name = {f.name: f for f in df.schema.fields}
    fields = T.StructType([by_name[k] for k in key])
    if ranges == 1:
        return KeyRanges(fields)
    columns = [F.col(f"`{k}`") for k in key]
    share = ranges * KEYS_PER_RANGE / max(1, df.count())
    keys = df.select(*[c.alias(f"k{i}") for i, c in enumerate(columns)])
    places = [F.col(c) for c in keys.columns]
    if share < 1:
        keys = keys.where(F.pmod(F.xxhash64(*places), F.lit(1 << 31)) < int(share * (1 << 31)))
    keys = keys.where(_all(c.isNotNull() for c in places)).distinct().orderBy(*places)
    sample = [r[0] for r in keys.select(F.to_json(F.struct(*places), _FORMATS)).collect()]
    step = len(sample) / ranges
    chosen = [sample[int(i * step)] for i in range(1, ranges)] if sample else []
    return KeyRanges(fields, tuple(dict.fromkeys(chosen)))
