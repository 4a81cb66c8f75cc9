"""Referential closure: rows without a parent go, then the rows that refer to those, until no foreign key is broken."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portage.session import new_work_dir, stage


@dataclass(frozen=True)
class Reference:
    """A foreign key between two tables of the set; a table may refer to itself, and tables to each other."""

    child: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]

    @property
    def name(self) -> str:
        return f"{self.child}({','.join(self.columns)}) -> {self.parent}({','.join(self.parent_columns)})"


_REMOVED = "table_name string, reference string, n_rows long"


@dataclass(frozen=True)
class Closure:
    """``kept`` rows by table; ``removed``: ``table_name, reference, n_rows``, where ``reference`` null counts the
    table's removed rows and the others those that a reference breaks on (a row may break on several); ``rounds``."""

    kept: dict[str, DataFrame]
    removed: DataFrame
    rounds: int


def _key(columns: Sequence[str]) -> Column:
    """A key as a struct with names of its own, so that keys of different tables compare."""
    return F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(columns)])


def _complete(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in columns])


def _without(df: DataFrame, columns: Sequence[str], dead: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is not in ``dead`` (one column ``key``). Rows with a null part are spread by a hash: they
    match nothing, and on their common key they would meet in one task."""
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    salt = F.when(_complete(columns), F.lit(0).cast("long")).otherwise(F.xxhash64(*hashed))
    marked = df.withColumns({"_key": F.when(_complete(columns), _key(columns)), "_salt": salt})
    return marked.join(
        dead.select(F.col("key").alias("_key"), F.lit(0).cast("long").alias("_salt")), ["_key", "_salt"], "left_anti"
    ).select(*df.columns)


def _with(df: DataFrame, columns: Sequence[str], keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys``."""
    found = df.where(_complete(columns)).withColumn("key", _key(columns)).join(keys, "key", "left_semi")
    return found.select(*df.columns)


def _row(columns: Sequence[str]) -> Column:
    """A whole row of keys. Null fields of structs are equal, so rows with null parts compare too."""
    return F.struct(*[F.col(f"`{c}`") for c in columns])


def _is_unique(df: DataFrame, columns: Sequence[str]) -> bool:
    """Whether no key occurs in several combinations: then it vanishes with its one row."""
    keys = df.where(_complete(columns)).groupBy(_key(columns).alias("key"))
    return keys.agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


class _Growing:
    """A table that rounds add to; read afresh, it has all that was added."""

    def __init__(self, path: str, first: DataFrame) -> None:
        self.path, self.spark, self.schema = path, first.sparkSession, first.schema
        self.add(first)

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def referential_closure(tables: Mapping[str, DataFrame], references: Sequence[Reference]) -> Closure:
    """The largest part of ``tables`` in which every reference holds.

    A row is removed if a foreign key of it without null parts has no row left to refer to; references to tables that
    are not in the set are left alone. A parent key that several rows hold is there until the last of them goes.

    Works on the key columns only, with one row and a count per combination of a table's keys. Each round looks at what
    the round before removed: keys that vanished break references, the rows with them go, and the keys only they held
    vanish. Those sets are what joins with the key tables, which are never written again. There are as many rounds as
    the longest chain of removals has links; every round is a table in the shared work folder. Whole rows are read once,
    at the end, and without a removal not even then.
    """
    references = [r for r in references if r.child in tables and r.parent in tables]
    spark = next(iter(tables.values())).sparkSession
    if not references:
        return Closure(dict(tables), spark.createDataFrame([], _REMOVED), 0)
    base = new_work_dir(spark, "closure")
    wanted: dict[str, list[str]] = {}
    for r in references:
        for name, columns in ((r.child, r.columns), (r.parent, r.parent_columns)):
            wanted[name] = list(dict.fromkeys([*wanted.get(name, []), *columns]))
    narrow = {}
    for name, columns in wanted.items():
        keys = tables[name].select(*[F.col(f"`{c}`") for c in columns])
        narrow[name] = stage(keys.groupBy(*keys.columns).agg(F.count(F.lit(1)).alias("_rows")), f"{base}/{name}")
    parent_keys = sorted({(r.parent, r.parent_columns) for r in references})
    repeats = {k for k in parent_keys if not _is_unique(narrow[k[0]], k[1])}

    news: dict[Reference, DataFrame] = {}
    broken, gone = {}, {}
    for i, r in enumerate(references):
        asked = narrow[r.child].where(_complete(r.columns)).select(_key(r.columns).alias("key")).distinct()
        there = narrow[r.parent].select(_key(r.parent_columns).alias("key")).distinct()
        news[r] = stage(asked.join(there, "key", "left_anti"), f"{base}/broken-{i}-0")
        broken[r] = _Growing(f"{base}/broken-{i}", news[r])
        gone[r.child] = _Growing(f"{base}/{r.child}-gone", narrow[r.child].limit(0))
    rounds = 0
    while news := {r: keys for r, keys in news.items() if not keys.isEmpty()}:
        rounds += 1
        lost = {}
        for name in sorted({r.child for r in news}):
            hits = reduce(DataFrame.unionByName, [_with(narrow[name], r.columns, keys) for r, keys in news.items() if r.child == name])
            before = gone[name].read().select(_row(hits.columns).alias("_row"))
            fresh = hits.distinct().withColumn("_row", _row(hits.columns)).join(before, "_row", "left_anti").drop("_row")
            lost[name] = stage(fresh, f"{base}/{name}-gone-{rounds}")
            gone[name].add(lost[name])
        vanished = {}
        for i, (name, columns) in enumerate(parent_keys):
            if name not in lost:
                continue
            keys = lost[name].where(_complete(columns)).select(_key(columns).alias("key")).distinct()
            if (name, columns) in repeats:
                held = _with(narrow[name], columns, keys).withColumn("_row", _row(narrow[name].columns))
                dead = gone[name].read().select(_row(narrow[name].columns).alias("_row"))
                left = held.join(dead, "_row", "left_anti").select(_key(columns).alias("key"))
                keys = keys.join(left, "key", "left_anti")
            vanished[name, columns] = stage(keys, f"{base}/vanished-{i}-{rounds}")
        news = {}
        for i, r in enumerate(references):
            if (keys := vanished.get((r.parent, r.parent_columns))) is not None:
                asked = narrow[r.child].where(_complete(r.columns)).select(_key(r.columns).alias("key"))
                news[r] = stage(keys.join(asked, "key", "left_semi"), f"{base}/broken-{i}-{rounds}")
                broken[r].add(news[r])

    kept, counts = dict(tables), []
    for name in dict.fromkeys(r.child for r in references):
        if gone[name].read().isEmpty():
            continue
        for r in (r for r in references if r.child == name):
            dead = broken[r].read()
            hit = _with(narrow[name], r.columns, dead).agg(F.sum("_rows").alias("n_rows"))
            counts.append(hit.select(F.lit(name).alias("table_name"), F.lit(r.name).alias("reference"), "n_rows"))
            kept[name] = _without(kept[name], r.columns, dead)
        whole = gone[name].read().agg(F.sum("_rows").alias("n_rows"))
        counts.append(whole.select(F.lit(name).alias("table_name"), F.lit(None).cast("string").alias("reference"), "n_rows"))
    removed = reduce(DataFrame.unionByName, counts, spark.createDataFrame([], _REMOVED)).where("n_rows > 0")
    return Closure(kept, stage(removed, f"{base}/removed"), rounds)
