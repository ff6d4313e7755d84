"""Profiling an unknown table and mapping it to notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteworks.functions import text as T
from noteworks.operators.ranking import global_index, top_per_group

# Name patterns of column purposes, tried in this order.
NAME_PATTERNS = {
    "identifier": ("id", "client", "customer", "user", "account", "code", "number", "num", "ref"),
    "date": ("date", "time", "created", "updated", "timestamp", "when"),
    "language": ("lang", "language", "locale", "country"),
    "text": ("text", "note", "transcription", "description", "comment", "message", "content", "body"),
}
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _long(df: DataFrame) -> DataFrame:
    """``(column, position, dtype, value)``: one row per cell, values as text."""
    cells = [
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), F.lit(t).alias("dtype"), F.col(f"`{c}`").cast("string").alias("value"))
        for i, (c, t) in enumerate(df.dtypes)
    ]
    return df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def _purpose() -> Column:
    name = F.lower("column")
    rule = None
    for purpose, words in NAME_PATTERNS.items():
        hit = F.exists(F.lit(list(words)), lambda w: F.contains(name, w))
        rule = F.when(hit, purpose) if rule is None else rule.when(hit, purpose)
    numeric = F.col("dtype").isin(*NUMERIC) | F.startswith("dtype", F.lit("decimal"))
    text = F.col("dtype") == "string"
    return (
        rule.when(F.col("non_null") == 0, "empty").when(text & (F.col("avg_length") > 100), "text")
        .when(text & (F.col("avg_length") > 20), "short_text").when(numeric, "numeric")
        .when(F.col("dtype").isin("date", "timestamp", "timestamp_ntz") | (F.col("dated") == F.col("non_null")), "date").otherwise("categorical")
    )


def profile_table(df: DataFrame) -> DataFrame:
    """Per column: type, nulls, distinct values, average length and purpose.

    Cells are first counted per (column, digest), so common values and long texts travel once per task.
    """
    value = F.col("value")
    dated = T.parse_date(value).isNotNull()
    counted = _long(df).groupBy("column", "position", "dtype", F.md5("value").alias("digest")).agg(
        F.count("*").alias("n"), F.max(F.length("value")).alias("len"), F.max(dated.cast("int")).alias("dated")
    )
    per = counted.groupBy("column", "position", "dtype").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("digest").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("digest").alias("unique_count"), F.coalesce(F.sum(F.when(F.col("digest").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"),
        F.coalesce(F.sum(F.when(F.col("digest").isNotNull(), F.col("n") * F.col("len"))), F.lit(0)).alias("letters"),
        F.coalesce(F.sum(F.when(F.col("dated") == 1, F.col("n"))), F.lit(0)).alias("dated"),
    )
    sized = per.withColumn("avg_length", F.when(F.col("non_null") > 0, F.round(F.col("letters") / F.col("non_null"), 1)))
    return sized.select("column", "position", "dtype", "rows", "null_count", "unique_count", "avg_length", _purpose().alias("purpose"))


def sample_values(df: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` least distinct values of each column."""
    return top_per_group(_long(df).where("value IS NOT NULL").select("column", "value").distinct(), ["column"], ["value"], k)


def recommend_mapping(profile: DataFrame) -> DataFrame:
    """One row: the columns to use as text, id, language and date."""
    text = F.col("purpose").isin("text", "short_text")
    weight = F.when(F.col("purpose") == "text", F.coalesce("avg_length", F.lit(0.0)) * 2).otherwise(F.coalesce("avg_length", F.lit(0.0)))

    def best(when: Column, score: Column) -> Column:
        return F.max_by(F.when(when, F.col("column")), F.when(when, F.struct(score, -F.col("position"))))

    first = -F.col("position")
    return profile.agg(
        best(text, weight).alias("text_column"), best(F.col("purpose") == "identifier", F.col("unique_count") / F.col("rows")).alias("id_column"),
        best(F.col("purpose") == "language", first).alias("language_column"), best(F.col("purpose") == "date", first).alias("date_column"),
    )


def standardize(df: DataFrame, text: str, id_column: str | None = None, language: str | None = None, date: str | None = None, as_of: str = "2025-01-01") -> DataFrame:
    """Map any table to notes. Without an id column rows are numbered in the order of all their values."""
    if id_column is None:
        order = [F.col(c).cast("string") for c in df.columns]
        # Equal rows are kept apart by their number among themselves.
        copies = df.groupBy(*df.columns).agg(F.count("*").alias("_n")).select("*", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_copy"))
        df = global_index(copies, [*order, F.col("_copy")], "_i").withColumn("_id", F.format_string("NOTE_%04d", "_i"))
        id_column = "_id"
    stamp = F.lit(as_of).cast("timestamp")
    return df.select(
        F.col(id_column).cast("string").alias("note_id"), F.col(id_column).cast("string").alias("client_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(language), F.lit("EN")).alias("language") if language else F.lit("EN").alias("language"),
        (F.coalesce(T.parse_date(F.col(date).cast("string")), stamp) if date else stamp).alias("date"),
    )
