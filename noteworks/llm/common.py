"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the contracts: a word, and the white space that ends it.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once per row, however often the body (or a lambda in it) names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def fold(key: str, parts: int) -> Column:
    """Remainder of the CRC32 of the key's decimal text (null: of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def quoted(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, *named: str) -> DataFrame:
    """The ``named`` columns as they are and all others in one struct ``_rest`` with plain field names, so that no
    name of theirs can meet one that an operator adds."""
    rest = [quoted(c).alias(f"c{i}") for i, c in enumerate(df.columns) if c not in named]
    return df.select(*named, F.struct(*rest, F.lit(True).alias("_")).alias("_rest"))


def unpacked(df: DataFrame, columns: list[str], *named: str) -> DataFrame:
    """The table with ``columns`` that ``packed`` was made of."""
    return df.select(*[F.col(c) if c in named else F.col(f"_rest.c{i}").alias(c) for i, c in enumerate(columns)])


def row_key(df: DataFrame, name: str = "_row") -> DataFrame:
    """Add a 128-bit digest of the whole row: rows with the same key are the same in every column."""
    return df.withColumn(name, F.md5(F.to_json(F.struct(*[quoted(c) for c in df.columns])).cast("binary")))


def take_rows(keyed: DataFrame, takes: DataFrame, name: str = "_row") -> DataFrame:
    """Rows of ``keyed`` as often as told. ``takes`` has for each row key the rows that share it (``_rows``) and
    how many of them go out in all (``_copies``); keys it lacks go. Both sides are dealt and sorted by key for the
    join, so that repeated rows, which are neighbours then, need no further shuffle and nothing is read twice."""
    met = keyed.join(takes, name).where("_copies > 0").dropDuplicates([name])
    copies = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))
    return met.withColumn("_copy", copies).drop(name, "_rows", "_copies", "_copy")
