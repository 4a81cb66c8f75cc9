"""The run log: one line per event of a session, appended to a table; and the states of a run's tables, to go on after a break."""

from __future__ import annotations

import json
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portage.session import path_exists

#: Session states, in the order a session goes through them.
STATES = ("idle", "executing", "success", "failed")


def log_line(at, state, message) -> list:
    """Columns of a log line: the formatted time, the state, the text."""
    return [
        F.date_format(at, "dd/MM/yyyy HH:mm:ss").alias("logged_at"), state.alias("state"), message.alias("message"),
    ]


def append(lines: DataFrame, path: str) -> None:
    lines.write.mode("append").parquet(path)


def log_event(spark: SparkSession, path: str, state: str, message: str) -> None:
    if state not in STATES:
        raise ValueError(f"unknown state {state!r}")
    append(spark.range(1).select(*log_line(F.current_timestamp(), F.lit(state), F.lit(message))), path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


_STATE = "table_name string, state string, detail string"


def note_state(spark: SparkSession, path: str, run_id: str, table: str, state: str, detail: dict) -> None:
    """Write that a table of a run is in a state (``started`` or ``done``). Each has a place of its own, so writing it again
    changes nothing, and runs and tables at the same time do not meet."""
    row = spark.createDataFrame([(table, state, json.dumps(detail, sort_keys=True, default=str))], _STATE)
    row.coalesce(1).write.mode("overwrite").parquet(f"{_run(path, run_id)}/{quote(table, safe='')}/{state}")


def states(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """``table_name, state, detail`` of a run: one row per table, its last state."""
    if not path_exists(spark, _run(path, run_id)):
        return spark.createDataFrame([], _STATE)
    rows = spark.read.schema(_STATE).option("recursiveFileLookup", "true").parquet(_run(path, run_id))
    last = F.max(F.struct((F.col("state") == "done").alias("ended"), "state", "detail")).alias("last")
    return rows.groupBy("table_name").agg(last).select("table_name", "last.state", "last.detail")


def finished(spark: SparkSession, path: str, run_id: str) -> dict[str, dict]:
    """What the done tables of a run reported, by name."""
    return {r["table_name"]: json.loads(r["detail"]) for r in states(spark, path, run_id).where("state = 'done'").collect()}


def _run(path: str, run_id: str) -> str:
    return f"{path.rstrip('/')}/{quote(run_id, safe='')}"
