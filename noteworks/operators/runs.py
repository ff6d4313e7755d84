"""Runs and their stages: row counts and times come from the writing itself, not from a second scan."""

from __future__ import annotations

import json
from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

STAGE = "stage string, status string, started_at timestamp, completed_at timestamp, seconds double, counts string, error string"
RUN = "run_id string, status string, started_at timestamp, completed_at timestamp, timings string, counts string, error string"


def write_stage(df: DataFrame, path: str, stage: str, measures: dict[str, Column] | None = None, mode: str = "overwrite") -> dict:
    """Write ``df`` as Parquet and return the stage's row: ``rows`` and each aggregate of ``measures``, observed while
    the rows went by, and the time it took. A stage that fails returns its error instead of raising it."""
    wanted = {"rows": F.count(F.lit(1)), **(measures or {})}
    seen, begun = Observation(), datetime.now(timezone.utc)
    row = {"stage": stage, "status": "completed", "counts": "{}", "error": None}
    try:
        df.observe(seen, *[value.alias(name) for name, value in wanted.items()]).write.mode(mode).parquet(path)
        row["counts"] = json.dumps(seen.get, sort_keys=True, default=str)
    except Exception as error:  # the run goes on record before anybody handles this
        row |= {"status": "failed", "error": str(error)[:1000]}
    ended = datetime.now(timezone.utc)
    return row | {"started_at": begun, "completed_at": ended, "seconds": (ended - begun).total_seconds()}


def stage_rows(spark: SparkSession, stages: Iterable[dict]) -> DataFrame:
    names = [c.split()[0] for c in STAGE.split(", ")]
    return spark.createDataFrame([tuple(s[n] for n in names) for s in stages], STAGE)


def run_row(spark: SparkSession, run_id: str, stages: list[dict]) -> DataFrame:
    """The run as one row: failed if a stage did, with seconds and counts of every stage as JSON."""
    failed = [s for s in stages if s["status"] != "completed"]
    timings = json.dumps({s["stage"]: round(s["seconds"], 3) for s in stages})
    counts = json.dumps({s["stage"]: json.loads(s["counts"]) for s in stages}, sort_keys=True)
    row = (run_id, "failed" if failed else "completed", min((s["started_at"] for s in stages), default=None),
           max((s["completed_at"] for s in stages), default=None), timings, counts, failed[0]["error"] if failed else None)
    return spark.createDataFrame([row], RUN)


def log_run(spark: SparkSession, folder: str, run_id: str, stages: list[dict]) -> None:
    """Append a finished run and its stages to the log tables under ``folder``."""
    run_row(spark, run_id, stages).write.mode("append").parquet(f"{folder}/runs")
    stage_rows(spark, stages).withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(f"{folder}/stages")
