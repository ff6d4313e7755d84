"""Small session helpers shared by the operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

# Largest driver-known table that an operator will ship to every task.
BROADCAST_ROW_LIMIT = 50_000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named in ``spark.checkpoint.dir``; fall back to a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if current is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            current = tempfile.mkdtemp(prefix="noteworks-ckpt-")
        sc.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor cannot undo it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_table(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Hint a broadcast only after counting that the side really is small; else leave it to the planner."""
    if df.limit(limit + 1).count() <= limit:
        return F.broadcast(df)
    return df


def literal_table(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """A dimension written in code: its size is fixed, so it is always safe to broadcast."""
    types = StructType.fromDDL(schema)
    columns = list(zip(*rows)) or [[] for _ in types]
    table = pa.table([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, types)], names=types.names)
    return F.broadcast(spark.createDataFrame(table))


def one_row(*frames: DataFrame) -> DataFrame:
    """Put single-row aggregates side by side, by a union and a null-skipping aggregate (no cross join)."""
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionByName(frame, allowMissingColumns=True)
    return union.agg(*[F.first(c, ignorenulls=True).alias(c) for c in union.columns])
