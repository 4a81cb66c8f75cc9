"""Table scans: Parquet folders and JDBC, in full, by pushed query, filtered or schema-only."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portage.functions.names import lower_columns
from portage.functions.predicates import ColumnFilter, apply_filters
from portage.operators.key_ranges import key_ranges, sql_literal
from portage.session import new_work_dir, stage


def parquet_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer partitions than task slots, spread over all slots for heavy work on each row.

    Small text tables come as one file, and one task would do all of it. A scan that has enough partitions is left
    as it is, so a large table is never shuffled for this.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


@dataclass(frozen=True)
class JdbcSource:
    """Where a database is and how to log in. ``options`` go to Spark's JDBC reader and writer as they are."""

    url: str
    driver: str
    options: dict[str, str] = field(default_factory=dict)

    def reader(self, spark: SparkSession):
        return spark.read.format("jdbc").options(url=self.url, driver=self.driver, **self.options)

    def query(self, spark: SparkSession, sql: str) -> DataFrame:
        """Rows of a query the database runs itself."""
        return self.reader(spark).option("query", sql).load()

    def execute(self, spark: SparkSession, *statements: str) -> None:
        """Run statements over one connection of the driver's, all of them or none."""
        jvm, gateway = spark._jvm, spark.sparkContext._gateway
        loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
        made = loader.loadClass(self.driver).getDeclaredConstructor(gateway.new_array(jvm.java.lang.Class, 0))
        properties = jvm.java.util.Properties()
        for key, value in self.options.items():
            properties.setProperty(key, str(value))
        connection = made.newInstance(gateway.new_array(jvm.java.lang.Object, 0)).connect(self.url, properties)
        try:
            connection.setAutoCommit(False)
            for sql in statements:
                statement = connection.createStatement()
                statement.execute(sql)
                statement.close()
            connection.commit()
        except BaseException:
            connection.rollback()
            raise
        finally:
            connection.close()

    def table(
        self,
        spark: SparkSession,
        name: str,
        partition_column: str | None = None,
        partitions: int = 1,
        fetch_size: int = 10_000,
    ) -> DataFrame:
        """Full scan of ``schema.table``.

        With a numeric ``partition_column`` the table is read by ``partitions`` connections, each over its own
        range of the key; the bounds are one pushed min/max query. The bounds only shape the ranges: rows
        outside them and null keys are still read.
        """
        reader = self.reader(spark).option("dbtable", name).option("fetchsize", fetch_size)
        if partition_column and partitions > 1:
            bounds = self.query(
                spark, f'SELECT min("{partition_column}") AS lo, max("{partition_column}") AS hi FROM {name}'
            ).first()
            if bounds[0] is not None:
                reader = (
                    reader.option("partitionColumn", partition_column)
                    .option("lowerBound", int(bounds[0]))
                    .option("upperBound", int(bounds[1]) + 1)
                    .option("numPartitions", partitions)
                )
        return reader.load()


    def table_by_key(self, spark: SparkSession, name: str, key: list[str], ranges: int, fetch_size: int = 10_000) -> DataFrame:
        """Full scan of ``schema.table`` over ``ranges`` connections, each with a range of a key of any columns and types.

        The key columns are read first, over one connection, for the split points. Each row, whatever nulls its key has,
        fulfils the condition of exactly one range, as the database itself orders its keys.
        """
        keys = stage(self.table(spark, name, fetch_size=fetch_size).select(*key), new_work_dir(spark, "split-keys"))
        parts = key_ranges(keys, key, ranges)
        points = parts.point_values()
        if points and any(isinstance(f.dataType, T.StringType) for f in parts.fields):
            points = self._sorted_there(spark, name, key, points)
        properties = {**self.options, "driver": self.driver, "fetchsize": str(fetch_size)}
        return spark.read.jdbc(self.url, name, predicates=parts.sql(points), properties=properties)

    def _sorted_there(self, spark: SparkSession, name: str, key: list[str], points: list[tuple]) -> list[tuple]:
        """Some of a table's keys, in the order of the database: it may collate text in a way of its own."""
        names = [f'"{k}"' for k in key]
        places = [" AND ".join(f"{n} = {sql_literal(v)}" for n, v in zip(names, p)) for p in points]
        listed = ", ".join(names)
        found = self.query(spark, f"SELECT DISTINCT {listed} FROM {name} WHERE {' OR '.join(places)} ORDER BY {listed}")
        return [tuple(r) for r in found.collect()]


@dataclass(frozen=True)
class Extraction:
    """How to extract one table: ``all`` rows, the ``custom`` filters, or ``none`` (schema only)."""

    mode: str = "all"
    filters: tuple[ColumnFilter, ...] = ()


def extract(df: DataFrame, how: Extraction | None = None) -> DataFrame:
    """The rows to migrate, with lower-case column names."""
    how = how or Extraction()
    if how.mode == "custom":
        df = apply_filters(df, how.filters)
    elif how.mode == "none":
        # Folds to an empty relation, so nothing is scanned; needs no key of any type.
        df = df.where(F.lit(False))
    elif how.mode != "all":
        raise ValueError(f"unknown extraction mode {how.mode!r}")
    return lower_columns(df)


def has_rows(df: DataFrame, label: str) -> DataFrame:
    """One row telling whether ``df`` has a readable row; the scan goes on by a few partitions until there is one."""
    return df.sparkSession.createDataFrame([(label, not df.isEmpty())], "table_name string, has_rows boolean")


def filters_from_rows(rows: Iterable[dict]) -> tuple[ColumnFilter, ...]:
    """Filters stored as rows ``(column, op, lo, hi)``."""
    return tuple(ColumnFilter(r["column"], r.get("op"), r.get("lo"), r.get("hi")) for r in rows)
