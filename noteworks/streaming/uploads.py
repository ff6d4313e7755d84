"""Uploads as a stream: read events, detect concepts, upsert, report status.

Sources are a Kafka topic or a folder of JSON files; the work between source and sink is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from noteworks import schemas
from noteworks.functions import text as T
from noteworks.operators.concepts import detect_concepts
from noteworks.operators.state import latest_change


def read_uploads_kafka(spark: SparkSession, servers: str, topic: str = "uploads") -> DataFrame:
    """Upload events of a Kafka topic from its beginning."""
    raw = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .option("startingOffsets", "earliest").load()
    )
    return raw.select(F.from_json(F.col("value").cast("string"), schemas.UPLOAD_EVENT).alias("e")).select("e.*")


def read_uploads_files(spark: SparkSession, folder: str, files_per_batch: int = 1000, schema: str = schemas.UPLOAD_EVENT) -> DataFrame:
    return spark.readStream.schema(StructType.fromDDL(schema)).option("maxFilesPerTrigger", files_per_batch).json(folder)


def dedup_uploads(batch: DataFrame, folder: str, batch_id: int) -> DataFrame:
    """Sessions of a batch that no earlier batch has written. However late an upload comes, it is not lost:
    it is compared with the session log, and nothing is forgotten."""
    fresh = batch.dropDuplicates(["upload_session_id"])
    if batch_id == 0:
        return fresh
    log = batch.sparkSession.read.parquet(f"{folder}/sessions")
    earlier = log.where(F.col("batch_id") < batch_id).select("upload_session_id").distinct()
    return fresh.join(earlier, "upload_session_id", "left_anti")


def upload_notes(uploads: DataFrame) -> DataFrame:
    """Upload events as notes, one per session."""
    return uploads.select(
        F.col("upload_session_id").alias("note_id"), "client_id", T.normalize_language(F.coalesce("language", F.lit("FR"))).alias("language"),
        T.clean_text(F.col("text")).alias("text"), F.col("_ts").alias("date"),
    )


def keyed_messages(rows: DataFrame, key: str, topic: str, at: Column | None = None) -> DataFrame:
    """Rows as keyed JSON messages ``(key, value)``, each stamped with its time ``_ts`` and its ``_topic``."""
    stamp = F.current_timestamp() if at is None else at
    body = F.struct(*rows.columns, stamp.alias("_ts"), F.lit(topic).alias("_topic"))
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(body).alias("value"))


def status_events(sessions: DataFrame, topic: str = "pipeline-status", at: Column | None = None) -> DataFrame:
    """Messages keyed by session, whether upload sessions or the states of ``session_states``."""
    return keyed_messages(sessions, "session_id" if "session_id" in sessions.columns else "upload_session_id", topic, at)


def result_events(results: DataFrame, key: str = "client_id", topic: str = "pipeline-results", at: Column | None = None) -> DataFrame:
    return keyed_messages(results, key, topic, at)


def session_status(log: DataFrame) -> DataFrame:
    """Latest status of every upload session from a plain log, with counts and elapsed seconds."""
    last = latest_change(log.select("upload_session_id", "status", "records", "at"), ["upload_session_id"], F.struct("at", "status"))
    span = log.groupBy("upload_session_id").agg(F.round(F.unix_micros(F.max("at")) / 1e6 - F.unix_micros(F.min("at")) / 1e6, 1).alias("elapsed"))
    return last.join(span, "upload_session_id")


# Kinds of session events in the order of a life; of events at one instant the later kind counts.
LIFE = ("started", "stage", "completed", "failed")


def session_states(events: DataFrame) -> DataFrame:
    """State of every session from its events ``(session_id, kind, stage, records, error, at)``, a batch or a stream.

    The state is an aggregate that does not depend on the order of arrival, so late events count like others, and
    what a task knows of a session is combined before it travels: a session with most of the events does not
    gather them. ``elapsed`` is in seconds; ``stage`` and ``records`` are the last known ones, ``error`` is that of
    the last failure. Unknown kinds rank before all others.
    """
    rank = F.coalesce(F.array_position(F.lit(list(LIFE)), F.col("kind")), F.lit(0))
    when = F.struct("at", rank.alias("rank"), "kind")
    known = {c: F.when(F.col(c).isNotNull(), when) for c in ("stage", "records")}
    failed = F.when(F.col("kind") == "failed", when)
    kept = events.select("session_id", "kind", "stage", "records", "error", "at", when.alias("_when"),
                         *[x.alias(f"_{c}") for c, x in known.items()], failed.alias("_failed"))
    states = kept.groupBy("session_id").agg(
        F.max_by("kind", "_when").alias("status"), F.max_by("stage", "_stage").alias("stage"), F.max_by("records", "_records").alias("records"),
        F.max_by("error", "_failed").alias("error"), F.min("at").alias("started_at"), F.max("at").alias("updated_at"),
        F.count("*").alias("events"), F.count_if(F.col("kind") == "failed").alias("failures"))
    span = F.unix_micros(F.col("updated_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    return states.withColumn("elapsed", F.round(span / 1e6, 1))


def follow_sessions(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep the state of every session of an event stream. Each batch writes the sessions it changed under its own
    number, so a batch that runs again overwrites itself; ``current_sessions`` reads the latest of each."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    states = session_states(events).writeStream.outputMode("update").foreachBatch(write)
    return states.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return latest_change(spark.read.parquet(folder), ["session_id"], F.col("batch_id")).drop("batch_id")


def audit_stream(events: DataFrame, path: str, checkpoint: str, details: list[str]) -> StreamingQuery:
    """Append audit events to a parquet table, details as JSON."""
    rest = [c for c in events.columns if c not in details]
    rows = events.select(*rest, F.to_json(F.struct(*details)).alias("details"))
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def write_event_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """JSON lines sink for keyed messages; for a Kafka sink use the same two columns."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def _event(kind: str, stage: str | None = None, records: Column | None = None, error: str | None = None) -> Column:
    count = F.lit(None) if records is None else records
    return F.struct(F.lit(kind).alias("kind"), F.lit(stage).cast("string").alias("stage"), count.cast("long").alias("records"),
                    F.lit(error).cast("string").alias("error"))


def process_uploads(uploads: DataFrame, aliases: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Detect the concepts of each batch and write notes, concepts and session events under the batch number: every
    upload is started, goes through a stage, and is completed with its count or, without a text, failed.

    A batch that runs again after a failure overwrites its own folder, so every upload counts once. Readers
    take the latest row per key (``current_notes``), which makes the tables an upsert log.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        notes = upload_notes(dedup_uploads(batch, folder, batch_id)).persist()
        found = detect_concepts(notes, aliases)
        readable = F.coalesce(F.col("text"), F.lit("")) != ""
        target = f"batch_id={batch_id}"
        notes.write.mode("overwrite").parquet(f"{folder}/notes/{target}")
        found.write.mode("overwrite").parquet(f"{folder}/concepts/{target}")
        written = batch.sparkSession.read.parquet(f"{folder}/concepts/{target}")
        counts = written.groupBy(F.col("note_id").alias("upload_session_id")).agg(F.count("*").alias("records"))
        done = notes.select(F.col("note_id").alias("upload_session_id"), F.col("date").alias("at"), readable.alias("ok")).join(counts, "upload_session_id", "left")
        end = F.when(F.col("ok"), _event("completed", records=F.coalesce("records", F.lit(0)))).otherwise(_event("failed", records=F.lit(0), error="no text"))
        life = [_event("started"), _event("stage", stage="detect_concepts"), end]
        log = done.select("upload_session_id", "at", F.explode(F.array(*life)).alias("e")).select(
            "upload_session_id", F.col("upload_session_id").alias("session_id"), "e.*", "at")
        log.write.mode("overwrite").parquet(f"{folder}/sessions/{target}")
        notes.unpersist()

    return uploads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_notes(spark: SparkSession, folder: str) -> DataFrame:
    """The newest note of each client."""
    return latest_change(spark.read.parquet(f"{folder}/notes").drop("batch_id"), ["client_id"], F.struct("date", "note_id"))
