"""Loading a target: overwrite, with count and maximum taken from the same pass, and a snapshot to fall back on.

``commit`` of a target loads beside the table, checks there, and only then puts the new rows in its place, so what the
target held is neither copied nor touched by a load that fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from py4j.java_gateway import is_instance_of
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from portage.session import drop_dir, move_path, new_work_dir, path_exists, paths_like, remove_path, stage
from portage.sources.tables import JdbcSource

#: Rows per JDBC insert batch. A million, as some tools ask for, holds too much of one partition in memory.
JDBC_BATCH = 10_000

#: What databases say of a table that does not exist, by SQL state or error number.
ABSENT = ("42P01", "42X05", "42S02", "ORA-00942")


@dataclass(frozen=True)
class Loaded:
    """What went through one load."""

    n_rows: int
    max_value: object = None


def _totals(auto_column: str | None) -> list[Column]:
    parts = [F.count(F.lit(1)).alias("n_rows")]
    return parts + [F.max(auto_column).alias("max_value")] if auto_column else parts


def load_parquet(df: DataFrame, path: str, auto_column: str | None = None, max_records_per_file: int = 0) -> Loaded:
    """Overwrite the Parquet table at ``path``.

    The rows keep the partitions they come in, so nothing is shuffled just to be written; ``max_records_per_file``
    splits what would become huge files.
    """
    seen = Observation()
    writer = df.observe(seen, *_totals(auto_column)).write.mode("overwrite")
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    writer.parquet(path)
    return Loaded(seen.get["n_rows"], seen.get.get("max_value"))


def load_jdbc(
    df: DataFrame, target: JdbcSource, table: str, auto_column: str | None = None, connections: int = 8,
    truncate: bool = False,
) -> Loaded:
    """Overwrite a database table over at most ``connections`` connections.

    Spark narrows the partitions to that number without a shuffle. A partition commits on its own, so a task that
    runs twice may insert twice; the count check after the load finds that. The JDBC writer runs its own job, which
    no observation sees, so the totals come from a pass over the one column they need.
    """
    totals = df.agg(*_totals(auto_column)).first().asDict()
    write_jdbc(df, target, table, connections, truncate)
    return Loaded(totals["n_rows"], totals.get("max_value"))


def write_jdbc(df: DataFrame, target: JdbcSource, table: str, connections: int, truncate: bool = False) -> None:
    """Overwrite a database table. A partition commits on its own, so one whose task runs twice may be in it twice."""
    df.write.format("jdbc").mode("overwrite").options(
        url=target.url, driver=target.driver, dbtable=table, batchsize=JDBC_BATCH, numPartitions=connections,
        truncate=str(truncate).lower(), **target.options,
    ).save()


#: Times a table is loaded beside its place before a wrong number of rows is an error.
JDBC_TRIES = 3

Check = Callable[[DataFrame], None]


@dataclass(frozen=True)
class ParquetTarget:
    """A folder with one Parquet table per name."""

    folder: str

    def path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}"

    def exists(self, spark: SparkSession, name: str) -> bool:
        return path_exists(spark, self.path(name))

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(self.path(name))

    def load(self, df: DataFrame, name: str, auto_column: str | None = None) -> Loaded:
        return load_parquet(df, self.path(name), auto_column)

    def commit(self, df: DataFrame, name: str, auto_column: str | None = None, check: Check | None = None) -> Loaded:
        """Load beside the table, run ``check`` on the new rows, then put them in the table's place by renaming.

        The file system must rename a folder in one step, as HDFS and local ones do. A run that ends between the two
        renames leaves the old table under another name; the next commit puts it back first.
        """
        spark, place = df.sparkSession, self.path(name)
        self.recover(spark, name)
        mark = uuid.uuid4().hex
        beside, old = f"{place}.loading-{mark}", f"{place}.replaced-{mark}"
        try:
            done = load_parquet(df, beside, auto_column)
            if check:
                check(spark.read.schema(df.schema).parquet(beside))
        except BaseException:
            remove_path(spark, beside)
            raise
        if path_exists(spark, place):
            move_path(spark, place, old)
        move_path(spark, beside, place)
        remove_path(spark, old)
        return done

    def recover(self, spark: SparkSession, name: str) -> None:
        """Put back a table that a broken commit has moved away."""
        place = self.path(name)
        if not path_exists(spark, place) and len(moved := paths_like(spark, f"{place}.replaced-*")) == 1:
            move_path(spark, moved[0], place)

    def discard(self, spark: SparkSession, name: str) -> None:
        """Take away a table that a failed load has left."""
        remove_path(spark, self.path(name))


@dataclass(frozen=True)
class JdbcTarget:
    """The tables of a database schema; ``schema`` None leaves names unqualified."""

    database: JdbcSource
    schema: str | None = None
    connections: int = 8

    def table_name(self, name: str) -> str:
        return f"{self.schema}.{name}" if self.schema else name

    def exists(self, spark: SparkSession, name: str) -> bool:
        """Whether the table is there. Any error but the database's own word that it is not goes up to the caller:
        a table that cannot be seen for a moment must not be taken for a new one."""
        return _there(spark, self.database, self.table_name(name))

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return self.database.table(spark, self.table_name(name))

    def load(self, df: DataFrame, name: str, auto_column: str | None = None) -> Loaded:
        return load_jdbc(df, self.database, self.table_name(name), auto_column, self.connections)

    def commit(self, df: DataFrame, name: str, auto_column: str | None = None, check: Check | None = None) -> Loaded:
        """Load beside the table, then replace its rows in one transaction of the database.

        The rows are written to the work folder first, in the one pass over their source, with their totals; ``check``
        runs there. The number of rows that arrived in the table beside tells whether a task has inserted twice: then
        it is loaded again. What the table held goes and what was loaded comes in the same transaction, so a failure at
        any point leaves the old rows. A table that is new, or has other columns, is made as Spark makes it.
        """
        spark, table = df.sparkSession, self.table_name(name)
        seen = Observation()
        rows = stage(df.observe(seen, *_totals(auto_column)), new_work_dir(spark, "load-stage"))
        done = Loaded(seen.get["n_rows"], seen.get.get("max_value"))
        if check:
            check(rows)
        beside = f"{table}_loading"
        columns = ", ".join(f'"{c}"' for c in df.columns)
        try:
            for _ in range(JDBC_TRIES):
                write_jdbc(rows, self.database, beside, self.connections)
                arrived = self.database.query(spark, f"SELECT COUNT(*) AS n FROM {beside}").first()[0]
                if arrived == done.n_rows:
                    break
            else:
                raise RuntimeError(f"{beside}: {arrived} rows arrived of {done.n_rows} in {JDBC_TRIES} loads")
            if not self.exists(spark, name) or self.read(spark, name).columns != df.columns:
                write_jdbc(rows.limit(0), self.database, table, 1)
            self.database.execute(spark, f"DELETE FROM {table}", f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {beside}")
        finally:
            if _there(spark, self.database, beside):
                self.database.execute(spark, f"DROP TABLE {beside}")
        return done

    def discard(self, spark: SparkSession, name: str) -> None:
        """Take away the rows that a failed load has left. The empty table stays: Spark's writer drops none."""
        if self.exists(spark, name):
            self.load(self.read(spark, name).limit(0), name)


def _there(spark: SparkSession, database: JdbcSource, table: str) -> bool:
    try:
        database.query(spark, f"SELECT * FROM {table} WHERE 1 = 0")
    except Exception as error:  # each driver has an error class of its own
        if _says_absent(spark, error):
            return False
        raise
    return True


def _says_absent(spark: SparkSession, error: Exception) -> bool:
    """Whether an error of the database, or one that it caused, is about a table that does not exist."""
    said, cause = str(error), getattr(error, "_origin", None) or getattr(error, "java_exception", None)
    while cause is not None:
        said += f"\n{cause.toString()}"
        if is_instance_of(spark.sparkContext._gateway, cause, "java.sql.SQLException"):
            said += f" {cause.getSQLState()}"
        cause = cause.getCause()
    return any(code in said for code in ABSENT)


@contextmanager
def snapshot(spark: SparkSession, target: ParquetTarget | JdbcTarget, name: str):
    """Keep a copy of a target table while the block runs.

    If the block raises, the table is overwritten with the copy and the error goes on; either way the copy is
    deleted at the end. A table that does not exist yet needs no copy, and is taken away again if the block raises.
    """
    copy = None
    if there := target.exists(spark, name):
        copy = new_work_dir(spark, "snapshot")
        target.read(spark, name).write.parquet(copy)
    try:
        yield copy
    except BaseException:
        if copy:
            target.load(spark.read.parquet(copy), name)
        elif not there:
            target.discard(spark, name)
        raise
    finally:
        if copy:
            drop_dir(spark, copy)
