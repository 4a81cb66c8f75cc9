"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Settings the operators are written for. AQE sizes the shuffles and splits skewed join partitions.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A join whose measured build partitions all stay below this needs no sort.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.scheduler.mode": "FAIR",
}

#: Stored bytes up to which Spark may broadcast an intermediate table.
MOST_BROADCAST_BYTES = 1 << 20

_LOCAL_DIRS: dict[str, str] = {}
_MADE: list[tuple[str, str]] = []


def sized_for(input_bytes: int, most_partitions: int = 50_000) -> dict[str, str]:
    """Settings for a run over ``input_bytes`` of stored data.

    Shuffles start with partitions of about half a gigabyte and AQE merges those that turn out small. Above
    ``most_partitions`` the block bookkeeping is taken to cost more than smaller partitions save.
    """
    partitions = min(most_partitions, max(200, input_bytes // (512 << 20)))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
    }


def build_session(app_name: str = "portage", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local master without that setting
    gets a temporary folder: on a cluster an executor could not see the folders of another machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app_id = context.applicationId
    if app_id not in _LOCAL_DIRS:
        _LOCAL_DIRS[app_id] = tempfile.mkdtemp(prefix="portage-")
    return _LOCAL_DIRS[app_id]


def new_work_dir(spark: SparkSession, purpose: str) -> str:
    """A folder name nobody has used before, under the shared work folder."""
    path = f"{work_root(spark)}/{purpose}-{uuid.uuid4().hex}"
    _MADE.append((spark.sparkContext.applicationId, path))
    return path


def unbroadcast(df: DataFrame) -> DataFrame:
    """``df`` for joins that shuffle and sort, whatever size Spark takes it for: what is derived from it is not broadcast either."""
    return df.hint("merge")


def stored(spark: SparkSession, schema: StructType | str, *paths: str) -> DataFrame:
    """A table that ``stage`` has written, in one or several folders.

    Spark sizes it by its files, but names made from numbers unfold to some 50 times their stored bytes: a table that looks
    small enough for a broadcast may be more than the driver can hold. So only what has few stored bytes is left to be broadcast.
    """
    table = spark.read.schema(schema).parquet(*paths)
    return unbroadcast(table) if sum(path_bytes(spark, path) for path in paths) > MOST_BROADCAST_BYTES else table


def stage(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as a table and read it back: cuts the lineage and survives the loss of executors.

    Names and code that were made from numbers take half the room in zstd that they take in Spark's default.
    """
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return stored(df.sparkSession, df.schema, path)


def stage_counted(df: DataFrame, path: str) -> tuple[DataFrame, int]:
    """``stage``, with the number of rows taken from the same pass."""
    seen = Observation()
    staged = stage(df.observe(seen, F.count(F.lit(1)).alias("n")), path)
    return staged, seen.get["n"]


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def path_state(spark: SparkSession, pattern: str) -> tuple:
    """Names, sizes and times of the files that match a pattern: differs when one of them was replaced."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jvm_path) or ()
    return tuple((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found)


def path_bytes(spark: SparkSession, path: str) -> int:
    """Stored bytes of a file or of all files of a folder."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(jvm_path).getLength()


def remove_path(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def paths_like(spark: SparkSession, pattern: str) -> list[str]:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jvm_path) or ()
    return [f.getPath().toString() for f in found]


def move_path(spark: SparkSession, path: str, to: str) -> None:
    """Rename a folder; an error if the file system did not."""
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, to))
    if not source.getFileSystem(spark._jsc.hadoopConfiguration()).rename(source, target):
        raise OSError(f"{path} could not be renamed to {to}")


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a work folder this library made, on whichever file system it lies."""
    if not path.startswith(work_root(spark) + "/"):
        raise ValueError(f"{path} is not below the work folder")
    remove_path(spark, path)


def drop_work_dirs(spark: SparkSession) -> None:
    """Delete every work folder of this session. DataFrames that read intermediate tables are void afterwards."""
    app_id = spark.sparkContext.applicationId
    for owner, path in list(_MADE):
        if owner == app_id:
            drop_dir(spark, path)
            _MADE.remove((owner, path))
