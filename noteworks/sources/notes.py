"""Reading and writing notes, lexicons and playbooks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteworks import config, schemas
from noteworks.functions import text as T
from noteworks.functions.rules import rate
from noteworks.operators.privacy import RedactionConfig, redact_pii
from noteworks.operators.runs import write_stage


def require_columns(df: DataFrame, columns: tuple[str, ...] = schemas.REQUIRED_NOTE_COLUMNS) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def find_notes_csv(spark: SparkSession, folder: str) -> str:
    """The only, else the alphabetically first CSV file of a folder on any file system Spark can read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path")
    first = files.agg(F.min("path").alias("p")).first()["p"]
    if first is None:
        raise FileNotFoundError(f"no CSV file in {folder}")
    return first


def scan_notes_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw notes as text columns. ``path`` may be a file, a folder or a glob; quoted fields may span lines."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False)
    return require_columns(reader.csv(path))


def ingest(raw: DataFrame, redact: RedactionConfig | None = RedactionConfig(sensitive_mode="log")) -> DataFrame:
    """Raw notes to clean notes in one projection; no sort, since order is for whoever writes the result."""
    cleaned = T.clean_text(F.col("Transcription"))
    return require_columns(raw).select(
        F.col("ID").alias("note_id"), F.col("ID").alias("client_id"), T.parse_date(F.col("Date")).alias("date"),
        T.normalize_language(F.col("Language")).alias("language"), F.col("Duration").alias("duration"), F.col("Length").alias("length"),
        (redact_pii(cleaned, redact) if redact else cleaned).alias("text"),
    )


def run_ingest(spark: SparkSession, source: str, target: str, redact: RedactionConfig | None = RedactionConfig(sensitive_mode="log")) -> dict:
    """CSV files (one, a folder or a glob) to clean notes in Parquet under ``target``.

    Returns the stage's row for the run log; rows, unreadable dates, unknown languages and empty texts are observed
    while the notes are written. A source without rows is an error, as is one without the required columns.
    """
    measures = {
        "invalid_dates": F.count_if(F.col("date").isNull()),
        "unknown_languages": F.count_if(~F.col("language").isin(*config.SUPPORTED_LANGUAGES)),
        "empty_texts": F.count_if(F.coalesce("text", F.lit("")) == ""),
    }
    stage = write_stage(ingest(scan_notes_csv(spark, source), redact), target, "ingest", measures)
    if stage["status"] == "completed" and json.loads(stage["counts"])["rows"] == 0:
        raise ValueError(f"no rows in {source}")
    return stage


def notes_quality(notes: DataFrame) -> DataFrame:
    """Invalid dates, unknown languages and empty texts in one pass."""
    unknown = ~F.col("language").isin(*config.SUPPORTED_LANGUAGES)
    return notes.agg(
        F.count("*").alias("notes"), F.count_if(F.col("date").isNull()).alias("invalid_dates"),
        F.count_if(unknown).alias("unknown_languages"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("empty_texts"),
    ).withColumn("empty_pct", rate(F.col("empty_texts"), F.col("notes")))


def unknown_languages(notes: DataFrame) -> DataFrame:
    return notes.where(~F.col("language").isin(*config.SUPPORTED_LANGUAGES)).groupBy("language").agg(F.count("*").alias("notes"))


def language_counts(notes: DataFrame) -> DataFrame:
    return notes.groupBy("language").agg(F.count("*").alias("notes"))


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """CSV export for people: arrays joined by a bar, rows range-sorted over the part files."""
    flat = [F.array_join(F.transform(c, lambda x: x.cast("string")), "|").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).orderBy(*order).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_lexicon_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object per file keyed by concept id, to one row per concept."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", schemas.LEXICON_JSON).alias("m"))
    return whole.select(F.explode("m").alias("concept_id", "c")).select("concept_id", "c.*")


def write_lexicon_json(lexicon: DataFrame, path: str) -> None:
    """One JSON object per line, each keyed by its concept id; reads back with ``read_lexicon_json`` line by line."""
    entry = F.create_map("concept_id", F.struct("label", "aliases", "languages", "freq_notes", "examples", "bucket"))
    lexicon.select(F.to_json(entry).alias("value")).write.mode("overwrite").text(path)


def read_lexicon_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.from_json("value", schemas.LEXICON_JSON).alias("m"))
    return lines.select(F.explode("m").alias("concept_id", "c")).select("concept_id", "c.*")


def load_playbook(path: str | None) -> list[tuple]:
    """Actions of a playbook file (YAML); the default playbook when there is no file."""
    if path is None:
        return list(config.DEFAULT_PLAYBOOK)
    try:
        import yaml
    except ImportError as error:  # the parser is optional
        raise RuntimeError("reading a playbook file needs PyYAML") from error
    try:
        with open(path, encoding="utf-8") as handle:
            actions = (yaml.safe_load(handle) or {}).get("actions", [])
    except FileNotFoundError:
        return list(config.DEFAULT_PLAYBOOK)
    out = []
    for a in actions:
        rules = a.get("triggers", {})
        out.append((a.get("action_id", ""), a.get("title", ""), a.get("channel", ""), a.get("priority", "Low"), a.get("kpi", ""),
                    list(rules.get("buckets", [])), list(rules.get("keywords", [])), float(rules.get("min_confidence", 0.0)), a.get("description")))
    return out


def notes_from_transcripts(uploads: DataFrame) -> DataFrame:
    """Voice transcripts ``(client_id, duration_seconds, language, transcript, _ts)`` as raw note rows."""
    minutes = F.floor(F.coalesce("duration_seconds", F.lit(0)) / 60)
    return uploads.select(
        F.col("client_id").cast("string").alias("ID"), F.date_format("_ts", "yyyy-MM-dd").alias("Date"),
        F.when(minutes < 5, "Short").when(minutes < 15, "Medium").otherwise("Long").alias("Duration"),
        F.when(F.coalesce("language", F.lit("")) == "", "FR").otherwise(F.left(F.upper("language"), F.lit(2))).alias("Language"),
        T.word_size_class(F.col("transcript")).alias("Length"), F.trim("transcript").alias("Transcription"),
    )
