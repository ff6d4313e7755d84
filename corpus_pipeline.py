"""From raw documents to tokens: quality rules, near-dedup, secrets, source mix, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteworks.llm import common, mixing, pieces, quality, secrets, simhash
from noteworks.llm.queries import vocabulary_path
from noteworks.session import cut_lineage

SECRET_MASK = "[secret]"
MIN_LINES = 5  # a line that comes twice in a shorter text is no reason to drop the document here


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    judged = quality.apply_rules(common.packed(docs, "text"), min_lines=MIN_LINES)
    return common.unpacked(judged.where("quality.kept"), docs.columns, "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of ``simhash.near_duplicates`` (three-word shingles, up to three differing bits):
    the one with the least doc_id; of equal ids, and where no document of a group has one, the row with the least
    digest. Of repeated rows one stays."""
    keyed = common.row_key(common.packed(docs, "doc_id", "text"))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    grouped = simhash.near_duplicates(keyed.select("text", first.alias("first")), ["first"], key="first")
    keep = grouped.where(F.col("first") == F.col("component_id")).groupBy(F.col("first.row").alias("_row")).agg(F.count("*").alias("_rows"))
    return common.unpacked(common.take_rows(keyed, keep.withColumn("_copies", F.lit(1))), docs.columns, "doc_id", "text")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in them replaced by a mark; n_chars follows the text."""
    scanned = secrets.scan_secrets(common.packed(docs, "text", "n_chars"), mask=SECRET_MASK)
    changed = F.col("secrets.spans") != ""
    clean = scanned.withColumn("n_chars", F.when(changed, F.length("secrets.clean_text").cast("long")).otherwise(F.col("n_chars")))
    return common.unpacked(clean.withColumn("text", F.col("secrets.clean_text")), docs.columns, "text", "n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources come near their target shares of all words."""
    keyed = common.row_key(common.packed(docs, "text", "source"))
    sized = keyed.select(F.col("_row").alias("id"), "source", common.word_count(common.text_or_empty()).alias("size"))
    mixed = mixing.mix_sources(sized).groupBy(F.col("id").alias("_row")).agg(
        F.count("*").alias("_rows"), F.sum("copies").alias("_copies"))
    return common.unpacked(common.take_rows(keyed, mixed), docs.columns, "text", "source")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as piece ids ``ids`` and their number ``n_pieces``, without the text, which the ids give back.
    Own columns of these names leave as ``own_ids`` and ``own_n_pieces``."""
    encoded = pieces.encode(common.packed(docs, "text"), vocabulary_path())
    rest = [F.col(f"_rest.c{i}").alias(f"own_{c}" if c in ("ids", "n_pieces") else c) for i, c in enumerate(docs.columns) if c != "text"]
    return encoded.select(*rest, "ids", F.when(F.col("ids").isNotNull(), F.size("ids").cast("long")).alias("n_pieces"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("mask_secrets", mask_secrets),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]

# Fingerprints, balanced draws and token ids are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))  # the next stage reads its input more than once
    return STAGES[-1][1](spark, docs, sf_dir)
